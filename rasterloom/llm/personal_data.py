"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The patterns (email, ip, card, phone) give the base spans. The field reads runs of words that hold a digit or an @, or name a
credential (password, token, key and the like) or stand within two words after such a name; any other
word is outside, which cuts the chain exactly there. It has features of a word's shape, length, marks and the two words
before it, all of whole words. It is trained in numpy from a small labelled table (labelled_table(), or the caller's own rows) by likelihood,
and decoded by Viterbi over batches of runs. What it finds beyond the base spans is added if it touches none of them: numbers in
other notations, addresses without a dot, and a fifth kind, secret (keys, tokens and passwords; one of letters alone only right after the name of a credential).

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows come out each; extra columns aren't
read. A text is read whole, and time is linear in its length.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import load, ready
from .textops import LOWER, NOSPACE, blocks, char_offsets, utf8, word_spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BUCKETS = 1 << 12
Span = tuple[str, int, int]

# as the patterns of the contract, but started only where a match can start, so that no run of characters is read twice
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    """By kind as in BASE, then by start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    if at >= 0:
        runs = {m.end(): m.start() for m in _LOCAL.finditer(text)}
        while at >= 0:
            # a run of local characters that ends here; an address before may have taken its beginning
            start = runs.get(at)
            if start is not None and (start := max(start, end)) < at and (m := _DOMAIN.match(text, at)):
                end = m.end()
                out.append(("email", start, end))
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: What a credential is called; a word that holds one of these, and the two after it, are read whatever they are made of.
CREDENTIAL = re.compile(rb"passw|passphrase|pwd|token|secret|credential|apikey|api[_-]key|access[_-]?key|private[_-]?key|akia")
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd|token|secret|credential|key|pass)s?\W{0,4}(?:\s+(?:is|was|=|:))?\s*[\"'`(\[]*$")


def shape(word: str) -> str:
    """Runs of digits, small and capital letters as d, a and A with their length (5 for more), other marks as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[a-zà-öø-ÿß]+|[A-ZÀ-ÖØ-Þ]+|[^0-9a-zà-öø-ÿßA-ZÀ-ÖØ-Þ]", word):
        c = m[0][0]
        out.append(("d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c) + (str(min(len(m[0]), 5)) if c.isalnum() else ""))
    return "".join(out)


def features(word: str, before: str, earlier: str) -> list[int]:
    """Buckets of a word's features; before and earlier are the two words that precede it."""
    s = shape(word)
    mark = lambda w: re.sub("[0-9]+", "0", w.lower()) if len(w) < 24 else "~"
    n = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    lower = word.lower()
    found = [
        "bias", f"s={s}", f"flat={re.sub('[0-9]', '', s)}", f"head={s[:4]}", f"tail={s[-4:]}", f"n={min(n, 20)}", f"long={min(len(word) // 4, 12)}", f"mixed={n >= 2 and letters >= 2}{len(word) >= 14}",
        f"@{word.count('@')}", f".{min(word.count('.'), 5)}", f"hex={len(word) >= 16 and all(c in '0123456789abcdef\"' for c in lower)}", f"key={next((k for k in ('password', 'passwd', 'pwd', 'token', 'secret', 'api', 'key', 'akia') if k in lower), '')}", f"=:{'=' in word}",
        f"b={mark(before)}", f"e={mark(earlier)}", f"bs={shape(before)}", f"be={mark(earlier)}|{mark(before)}",
    ]
    return [zlib.crc32(x.encode()) % BUCKETS for x in found]


N_FEATURES = 17


def labelled_table(seed: int = 1, n: int = 900) -> list[tuple[str, list[Span]]]:
    """A small labelled table: invented lines (text, spans) with personal data in many notations and with numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "tion", "the", "ou", "lich", "que", "ado", "re", "mi", "st", "ing")) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    key = lambda k, a="0123456789abcdef": "".join(r.choice(a) for _ in range(k))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    both = mixed + mixed.lower()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    code = lambda: "-".join(key(k) for k in (8, 4, 4, 4, 12))
    name = lambda: word() + r.choice(("", ".", "_")) + r.choice((word(), digits(2)))

    def card() -> str:
        d = r.choice("3456") + digits(r.choice((14, 14, 14, 13)))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def personal() -> tuple[str, str, str, str]:
        """Kind, what stands before it, the span, what stands after it."""
        k = r.choice(KINDS)
        if k == "email":
            return k, "", f"{name()}@{word()}" + r.choice((f".{word()}.com", ".com", ".org", "")), r.choice(("", ".", ","))
        if k == "ip":
            return k, "", ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(("", "", ":8080")), r.choice(("", ".", ","))
        if k == "card":
            c = card()
            return k, "", r.choice((c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), "-".join(c[i : i + 4] for i in range(0, len(c), 4)))), r.choice(("", "."))
        if k == "phone":
            return k, "", r.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)}/{digits(7)}")), r.choice(("", ".", ","))
        pick = r.randint(0, 6)
        if pick == 5:
            return k, r.choice(("password=", "pwd=", "passphrase=", "password: ", "password is ", "secret: ", "token: ", "Passwort: ")), r.choice((key(r.randint(8, 30), letters), word() + word() + word())).ljust(8, "q"), r.choice(("", ".", ","))
        if pick == 6:
            return k, r.choice(("token = \"", "api_key: \"", "secret_key=\"", "access_key = '")), key(r.randint(16, 60), letters), r.choice(('"', "'"))
        if pick == 0:
            return k, "", "AKIA" + key(16, mixed), r.choice(("", ".", ","))
        if pick == 1:
            return k, r.choice(("password=", "pwd=", "passwd:", "api_key=", "secret=")), key(r.randint(10, 24), r.choice(("0123456789abcdef", both))) + digits(1), ""
        if pick == 2:
            return k, r.choice(("token", "secret", "api_key", "password")) + " " + r.choice("=:") + ' "', key(r.randint(20, 40), r.choice(("0123456789abcdef", both))) + digits(1), '"'
        if pick == 3:
            return k, "", r.choice(("ghp_", "sk-", "xoxb-")) + key(r.randint(20, 36), both) + digits(1), ""
        return k, r.choice(("token: ", "password: ", "api key: ")), key(r.randint(12, 32), both) + digits(1), ""

    def plain() -> str:
        return r.choice((lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 9)}.", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1, 99)}%", lambda: f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(r.randint(1, 7))}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"({digits(2)})", lambda: f"{digits(2)}-{digits(2)}", lambda: f"{word()}{digits(1)}", lambda: f"Version {r.randint(1, 9)}.0.", lambda: f"CC BY-NC {r.randint(1, 4)}.0", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"@{word()}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"#{digits(4)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"x={r.randint(1, 99)}", lambda: f"A{digits(1)}B", lambda: f"http://{word()}.com/{digits(4)}?p={digits(2)}", code, lambda: f"id {code()}", lambda: r.choice(("sha256:", "digest ", "commit ", "md5 ", "hash ", "")) + key(r.choice((32, 40, 64))), lambda: f"{key(2, letters[26:])}-{digits(4)}-{key(2, letters[26:])}", lambda: f"SKU{digits(6)}", lambda: f"{key(2, letters[26:])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", lambda: f"the {r.choice(('password', 'token', 'key', 'secret'))} {word()} {word()}", lambda: f"{r.choice(('passwords', 'tokens', 'a secret', 'my password'))} {r.choice(('must', 'can', 'should', 'of', 'and', 'for'))} {word()}", lambda: f"password: {r.choice(('required', 'optional', 'none', 'choose one', 'see below', 'hidden'))}", lambda: f"{r.choice(('token', 'secret'))} {r.choice(('economy', 'ring', 'service', 'garden'))}"))()

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 5))) + " "
            if r.random() < 0.55:
                k, head, span, tail = personal()
                spans.append((k, len(text) + len(head), len(text) + len(head) + len(span)))
                text += head + span + tail + " "
            else:
                text += plain() + " "
        rows.append((text + word(), spans))
    return rows


@dataclass
class Field:
    """Weights: emit (BUCKETS, labels), move (labels, labels), start (labels)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return self.emit[feats].sum(-2)

    def decode(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of runs: feats (words, N_FEATURES), first[r]: run r's first word (n + 1 of them). Batches of runs of like length."""
        size = np.diff(first)
        out = np.zeros(len(feats), np.int64)
        order = np.argsort(size, kind="stable")
        while len(order):
            # from the shortest on, runs up to twice as long, of about 64k places
            most = max(1, 2 * int(size[order[0]]))
            n = int(np.searchsorted(size[order], most, side="right"))
            part = order[: max(1, min(n, (1 << 16) // most + 1))]
            order = order[len(part) :]
            t = int(size[part].max())
            place = first[part][:, None] + np.minimum(np.arange(t), size[part][:, None] - 1)
            e = self.emissions(feats[place])
            best = self.start + e[:, 0]
            back = np.zeros((len(part), t, len(LABELS)), np.int8)
            for k in range(1, t):
                s = best[:, :, None] + self.move
                back[:, k] = s.argmax(1)
                best = np.where((k < size[part])[:, None], s.max(1) + e[:, k], best)
            label = best.argmax(1)
            for k in range(t - 1, -1, -1):
                live = k < size[part]
                out[first[part[live]] + k] = label[live]
                if k:
                    label = np.where(live, back[np.arange(len(part)), k, label], label)
        return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """No I after another kind or at the start."""
    move, start = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            start[j] = -1e4
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:] or a == "O":
                    move[i, j] = -1e4
    return move, start


def marked(text: str) -> list[list[tuple[int, int, str, str]]]:
    """Runs of words that the field reads: (start, end, the word before, the one before that)."""
    runs, last = [], ["", ""]
    open_, named = False, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        named = 3 if CREDENTIAL.search(LOWER[np.frombuffer(m[0].encode(), np.uint8)].tobytes()) else named - 1
        if named > 0 or re.search("[0-9@]", m[0]):
            if not open_:
                runs.append([])
            runs[-1].append((m.start(), m.end(), last[1], last[0]))
            open_ = True
        else:
            open_ = False
        last = [last[1], m[0]]
    return runs


def train(rows: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.3, seed: int = 0) -> Field:
    """Likelihood by forward and backward sums, AdaGrad, one run at a time."""
    runs = []
    for text, spans in rows:
        for run in marked(text):
            y = []
            for s, e, *_ in run:
                hit = next(((k, a) for k, a, z in spans if s < z and a < e), None)
                y.append(LABELS.index(f"{'B' if y == [] or hit[1] >= s or LABELS[y[-1]][2:] != hit[0] else 'I'}-{hit[0]}") if hit else 0)
            runs.append((np.array([features(text[s:e], b, c) for s, e, b, c in run]), np.array(y)))
    n = len(LABELS)
    fixed_move, fixed_start = _allowed()
    f = Field(np.zeros((BUCKETS, n)), fixed_move.copy(), fixed_start.copy())
    sums = [np.full(x.shape, 1e-2) for x in (f.emit, f.move, f.start)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in r.permutation(len(runs)):
            feats, y = runs[k]
            e = f.emissions(feats)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[0] = f.start + e[0]
            for t in range(1, len(e)):
                a[t] = lse(a[t - 1][:, None] + f.move, 0) + e[t]
            for t in range(len(e) - 2, -1, -1):
                b[t] = lse(f.move + e[t + 1] + b[t + 1], 1)
            z = lse(a[-1], 0)
            g = np.exp(a + b - z)
            move = np.zeros_like(f.move)
            for t in range(1, len(e)):
                move += np.exp(a[t - 1][:, None] + f.move + e[t] + b[t] - z)
                move[y[t - 1], y[t]] -= 1
            g[np.arange(len(y)), y] -= 1
            for w, acc, at, d in ((f.emit, sums[0], feats.ravel(), np.repeat(g, feats.shape[1], axis=0)), (f.move, sums[1], slice(None), move), (f.start, sums[2], slice(None), g[0])):
                if at is not None and not isinstance(at, slice):
                    at, inv = np.unique(at, return_inverse=True)
                    total = np.zeros((len(at), n))
                    np.add.at(total, inv, d)
                    d = total + 1e-4 * w[at]
                acc[at] += d * d
                w[at] -= rate * d / np.sqrt(acc[at])
            np.minimum(f.move, np.where(fixed_move < 0, -1e4, np.inf), out=f.move)
            np.minimum(f.start, np.where(fixed_start < 0, -1e4, np.inf), out=f.start)
    return f


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


_TRIM = "\"'`.,;:!?<>[]{}"


def plausible(kind: str, text: str, before: str = "") -> bool:
    """What the field adds must at least look like its kind; before: what stands before it on its line."""
    d = len(_digits(text))
    if kind == "secret":
        if re.search(r"[\s@/]", text):
            return False
        letters = sum(c.isalpha() for c in text)
        return len(text) >= 10 and d >= 2 and letters >= 2 or len(text) >= 8 and letters >= 6 and _NAMED.search(before) is not None
    if kind == "email":
        return re.fullmatch(r"[^@]+@[^@]+", text) is not None
    return {"ip": 4 <= d <= 20 and text.count(".") == 3, "card": 13 <= d <= 19 and luhn(_digits(text)), "phone": 9 <= d <= 15 and re.fullmatch(r"[+0-9()./\x20-]+", text) is not None}[kind]


#: A name and its mark at the beginning of a word.
_HEAD = re.compile(r"[\"']?[A-Za-z_-]{2,20}[=:]+")


def added_spans(text: str, words: list[tuple[int, int]], labels: list[str], base: list[Span]) -> list[Span]:
    """Spans of the field beside the base ones. words and labels of one run."""
    out, k = [], 0
    while k < len(words):
        if labels[k] == "O":
            k += 1
            continue
        kind, z = labels[k][2:], k + 1
        while z < len(words) and labels[z] == f"I-{kind}":
            z += 1
        s, e = words[k][0], words[z - 1][1]
        if kind == "secret" and (m := _HEAD.match(text, s, e)):
            s = m.end()
        while s < e and text[s] in _TRIM:
            s += 1
        while s < e and text[e - 1] in _TRIM:
            e -= 1
        if s < e and plausible(kind, text[s:e], text[max(0, s - 48) : s].rpartition("\n")[2]) and not any(s < b and a < e for _, a, b in base):
            out.append((kind, s, e))
        k = z
    return out


def _order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(data: np.ndarray, off: np.ndarray, field: Field) -> dict[int, tuple[list[Span], list[Span], str]]:
    """Base spans, all spans and the text of each document that can have any."""
    out = {}
    for i, j in blocks(off):
        b, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        # without a digit, an @ or the name of a credential there is neither a base span nor a run
        sign = ((b >= 48) & (b <= 57)) | (b == 64)
        sums = np.concatenate([[0], np.cumsum(sign)])
        named = np.array([m.start() for m in CREDENTIAL.finditer(LOWER[b].tobytes())], np.int64)
        some = sums[o[1:]] > sums[o[:-1]]
        some[np.searchsorted(o, named, side="right") - 1] = True
        docs = np.flatnonzero(some)
        if not len(docs):
            continue
        s, e, first = word_spans(b, o, NOSPACE)
        chars = char_offsets(b)
        hit = sums[e] > sums[s]
        # words that name a credential and the two after them, within a document
        w = np.searchsorted(s, named, side="right") - 1
        w = w[e[w] > named]
        stop = first[np.searchsorted(first, w, side="right")]
        for k in range(3):
            hit[(w + k)[w + k < stop]] = True
        buf = b.tobytes()
        feats, words, starts, owner = [], [], [], []
        for d in docs:
            last = -2
            for w in (first[d] + np.flatnonzero(hit[first[d] : first[d + 1]])).tolist():
                if w != last + 1:
                    starts.append(len(words))
                    owner.append(d)
                word = lambda k: buf[s[k] : e[k]].decode() if k >= first[d] else ""  # noqa: B023, E731
                feats.append(features(word(w), word(w - 1), word(w - 2)))
                words.append((int(chars[s[w]] - chars[o[d]]), int(chars[e[w]] - chars[o[d]])))
                last = w
        labels = [LABELS[k] for k in field.decode(np.array(feats), np.array([*starts, len(words)]))]
        run = 0
        for d in docs.tolist():
            text = buf[o[d] : o[d + 1]].decode()
            base = base_spans(text)
            spots, more = sorted(base, key=lambda x: x[1]), []
            while run < len(owner) and owner[run] == d:
                a, z = starts[run], starts[run + 1] if run + 1 < len(starts) else len(words)
                if any(x != "O" for x in labels[a:z]):
                    lo, hi = words[a][0], words[z - 1][1]
                    more += added_spans(text, words[a:z], labels[a:z], [x for x in spots if x[1] < hi and lo < x[2]])
                run += 1
            if base or more:
                out[i + d] = base, _order(base + more), text
    return out


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """id_col, base and spans, both arrays of (kind, start, end) in the order of kinds, then starts."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(field or default_field())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find(*utf8(batch.column(1)), sent.value)
            rows = [[[dict(zip(("kind", "start", "end"), x, strict=True)) for x in got[k][c]] if k in got else [] for k in range(batch.num_rows)] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], kind), pa.array(rows[1], kind)], names=[id_col, "base", "spans"])

    of = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {of}, base {span}, spans {span}")


def redact(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets, as [EMAIL]; texts without spans and all other columns stay as they are, but n_chars, where there is one, counts the new text."""
    spark = ready(docs.sparkSession)
    sent, place = spark.sparkContext.broadcast(field or default_field()), docs.columns.index(text_col)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find(*utf8(batch.column(place)), sent.value)
            if got:
                cols = batch.columns
                new = {}
                for k, (_, spans, text) in got.items():
                    parts, end = [], 0
                    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if s >= end:
                            parts += [text[end:s], f"[{kind.upper()}]"]
                        end = max(end, e)
                    new[k] = "".join([*parts, text[end:]])
                texts = cols[place].to_pylist()
                for k, t in new.items():
                    texts[k] = t
                cols[place] = pa.array(texts, cols[place].type)
                if count is not None:
                    n = cols[count].to_pylist()
                    for k, t in new.items():
                        n[k] = len(t)
                    cols[count] = pa.array(n, cols[count].type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every document."""
    d = spans_of(load(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *map(count, BASE), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
