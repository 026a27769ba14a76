"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: from its characters, how far the hashed character 4- to 6-grams of `<word>` lean to either label (most
toxic gram, mean, most toxic gram at the start) and a learned vector of its first three characters; from the word itself, how far the
word leans and a learned vector by hash. The leanings are log ratios of document frequencies, kept as two tables. A text is
all its overlapping windows of 32 words, 16 apart; each window runs through both recurrent layers, attention pools the
states, and the text's score is that of its most toxic window. Words are digits, letters and any character that isn't ASCII.

Learning takes at most `per_label` labelled rows of each label, of at most `max_chars` characters (both parameters), the
first by hash of their id. Of a toxic text, the windows of the strongest leaning are the examples; of a clean one those and
others. Leanings of the examples come from the other half of the sample, so that the network learns what held-out words look like.
How many
words go without their learned vectors in a step is chosen among DROPOUTS by a network of one half of the sample, tried on the other.
A last shift puts 0.5 where the two labels of the sample part best. With fewer than two labels every score is their share.

Null and empty texts have one window without words. Repeated rows get a score each. Labels that are null are ignored, and of
several labels of an id the toxic one counts. Of ids that stand for many rows, 4 x `per_label` rows count, by hash. Only ids and texts are read; a score depends on the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import load, ready
from .textops import ALNUM, LOWER, blocks, mix, span_hashes, utf8, word_spans

PER_LABEL = 3000
MAX_CHARS = 12_000
WINDOW, STRIDE = 32, 16
HIDDEN = 8
GRAM_BITS, WORD_BITS, HEAD_BITS, LEARNED = 18, 13, 12, 4
GRAMS = (4, 5, 6)
N_IN = 5 + 2 * LEARNED
BLOCK = 1 << 21
BATCH = 4096
EPOCHS = 12
#: A small sample takes more epochs, of smaller batches, until there are so many.
LEAST_STEPS = 600
#: Shares of words whose learned vectors are left out of a step, one of which the sample itself chooses.
DROPOUTS = (0.25, 0.75)


def _types(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block: number of each word's type, first word of each document, the types' bytes as `<word>` one after another, where each begins, and their hashes."""
    s, e, first = word_spans(b, off, ALNUM)
    kinds, one, inv = np.unique(span_hashes(b, s, e), return_index=True, return_inverse=True)
    s, n = s[one], e[one] - s[one]
    begin = np.concatenate([[0], np.cumsum(n + 2)])
    text = np.empty(begin[-1], dtype=np.uint8)
    at = np.arange(n.sum())
    text[at + np.repeat(2 * np.arange(len(n)) + 1, n)] = b[at + np.repeat(s - (np.cumsum(n) - n), n)]
    text[begin[:-1]], text[begin[1:] - 1] = ord("<"), ord(">")
    return inv, first, text, begin, kinds


def _grams(text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character grams of each type, and which type each is of, in order; a type too short for the shortest is a gram itself."""
    n = np.diff(begin)
    keys, owner, heads = [], [], []
    for k in GRAMS:
        m = np.maximum(n - k + 1, 1 if k == GRAMS[0] else 0)
        own = np.repeat(np.arange(len(n), dtype=np.int32), m)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        s = begin[own] + at
        keys.append((span_hashes(text, s, np.minimum(s + k, begin[own + 1])) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
        owner.append(own)
        heads.append(at == 0)
    keys, owner, heads = map(np.concatenate, (keys, owner, heads))
    order = np.argsort(owner, kind="stable")
    return keys[order], owner[order], heads[order]


@dataclass
class Leanings:
    grams: np.ndarray
    words: np.ndarray

    @staticmethod
    def learn(grams: list[np.ndarray], words: list[np.ndarray], labels: np.ndarray) -> Leanings:
        """From the distinct buckets of each text."""

        def odds(parts: list[np.ndarray], size: int) -> np.ndarray:
            count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(p for p, y in zip(parts, labels, strict=True) if y == v)]), minlength=size) for v in (0, 1)]
            n = [max(1, (labels == v).sum()) for v in (0, 1)]
            # one more text, split as the labels are: what no text has leans to neither
            more = [x / sum(n) for x in n]
            return (np.log((count[1] + more[1]) / n[1]) - np.log((count[0] + more[0]) / n[0])).astype(np.float32)

        return Leanings(odds(grams, 1 << GRAM_BITS), odds(words, 1 << GRAM_BITS))

    def inputs(self, text: np.ndarray, begin: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """(types, 5)"""
        if not len(kinds):
            return np.zeros((0, 5), np.float32)
        key, own, head = _grams(text, begin)
        v = self.grams[key]
        cut = np.searchsorted(own, np.arange(len(kinds)))
        size = np.diff(np.append(cut, len(own)))
        out = np.empty((len(kinds), 5), np.float32)
        out[:, 0] = np.maximum.reduceat(v, cut)
        out[:, 1] = np.add.reduceat(v, cut) / size
        out[:, 2] = np.maximum.reduceat(np.where(head, v, np.float32(-9)), cut)
        out[:, 3] = self.words[(kinds >> np.uint64(64 - GRAM_BITS)).astype(np.int64)]
        out[:, 4] = np.minimum(np.diff(begin) - 2, 20) / 10
        return out / np.float32(4)


def _learned_keys(text: np.ndarray, begin: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = (mix(kinds) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    s = begin[:-1]
    heads = (span_hashes(text, s, np.minimum(s + 4, begin[1:])) >> np.uint64(64 - HEAD_BITS)).astype(np.int64) if len(kinds) else words
    return words, heads


def windows(n_words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all documents: (windows, WINDOW) word numbers, -1 where there is none; first window of each document; its document."""
    n = np.maximum(0, -(-(n_words - WINDOW) // STRIDE)) + 1
    own = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < n_words[own][:, None], place + first[own][:, None], -1), np.cumsum(n) - n, own


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters in p: per direction W (inputs, 3 H), U (H, 3 H), c (3 H); a (2 H) attention; w (2 H), b; learned vectors of words and heads."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"a": f(2 * HIDDEN), "w": f(2 * HIDDEN), "b": np.zeros(1, np.float32), "words": f(1 << WORD_BITS, LEARNED) * 0, "heads": f(1 << HEAD_BITS, LEARNED) * 0}
        self.p["words"] += r.normal(0, 0.05, self.p["words"].shape).astype(np.float32)
        self.p["heads"] += r.normal(0, 0.05, self.p["heads"].shape).astype(np.float32)
        for d in "fb":
            self.p |= {f"W{d}": f(N_IN, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _run(self, g: np.ndarray, on: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (T, n, H) of one direction; g: (T, n, 3 H) projected inputs, on: (T, n, 1)."""
        u, h, k = self.p[f"U{d}"], np.zeros((g.shape[1], HIDDEN), np.float32), HIDDEN
        out = np.empty((g.shape[0], g.shape[1], HIDDEN), np.float32)
        for t in range(g.shape[0]) if d == "f" else range(g.shape[0] - 1, -1, -1):
            v = h @ u
            zr = v[:, : 2 * k]
            zr += g[t, :, : 2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :k], zr[:, k:]
            m = np.tanh(g[t, :, 2 * k :] + r * v[:, 2 * k :])
            new = m + z * (h - m)
            if keep is not None:
                keep.append((t, h, z, r, v[:, 2 * k :], m))
            h = np.where(on[t], new, h)
            out[t] = h
        return out

    def forward(self, g: dict[str, np.ndarray], on: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        h = np.concatenate([self._run(g[d], on, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        s = np.where(on[:, :, 0], h @ self.p["a"], np.float32(-1e9))
        s = np.exp(s - s.max(0))
        s *= on[:, :, 0]
        s /= np.maximum(s.sum(0), np.float32(1e-9))
        pooled = (s[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"h": h, "s": s, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, on: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted log loss; x: (T, n, inputs). Also dx."""
        p, keep, k = self.p, {}, HIDDEN
        logit = self.forward({d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}, on, keep)
        dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        h, s = keep["h"], keep["s"]
        out = {"w": keep["pooled"].T @ dl, "b": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["w"]
        ds = (h * dpool).sum(2)
        ds = s * (ds - (s * ds).sum(0))
        out["a"] = (ds[:, :, None] * h).sum((0, 1))
        dh_all = s[:, :, None] * dpool + ds[:, :, None] * p["a"]
        dx = np.zeros_like(x)
        for d, half in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            u, du, dg_all = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((*x.shape[:2], 3 * k), np.float32)
            dh = np.zeros((x.shape[1], k), np.float32)
            for t, before, z, r, v, m in reversed(keep[d]):
                dh += dh_all[t, :, half]
                new = np.where(on[t], dh, 0)
                dm = new * (1 - z) * (1 - m * m)
                dz = new * (before - m) * z * (1 - z)
                dr = dm * v * r * (1 - r)
                dg_all[t] = np.concatenate([dz, dr, dm], axis=1)
                dv = np.concatenate([dz, dr, dm * r], axis=1)
                du += before.T @ dv
                dh = np.where(on[t], new * z, dh) + dv @ u.T
            flat = dg_all.reshape(-1, 3 * k)
            out |= {f"U{d}": du, f"W{d}": x.reshape(-1, x.shape[2]).T @ flat, f"c{d}": flat.sum(0)}
            dx += dg_all @ p[f"W{d}"].T
        return out, dx

    def fit(self, x: np.ndarray, words: np.ndarray, heads: np.ndarray, on: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, dropout: float, seed: int = 3, rate: float = 0.01) -> None:
        """x: (n, T, 5) fixed inputs; words, heads: (n, T) rows of the learned vectors. Adam."""
        r, n, at = np.random.default_rng(seed), len(y), 0
        size = min(256, max(32, n // 32))
        epochs = max(epochs, -(-LEAST_STEPS * size // n))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = r.permutation(n)
            for i in range(0, n, size):
                b = order[i : i + size]
                wk, hk, o = words[b].T, heads[b].T, on[b].T[:, :, None]
                # learned vectors of a share of the words are left out, so that they aren't a memory of the sample
                use = o * (r.random(o.shape) >= dropout)
                full = np.concatenate([x[b].transpose(1, 0, 2), self.p["words"][wk] * use, self.p["heads"][hk] * use], axis=2).astype(np.float32)
                g, dx = self.gradients(full, o, y[b], weight[b])
                for name, key, cols in (("words", wk, slice(5, 5 + LEARNED)), ("heads", hk, slice(5 + LEARNED, N_IN))):
                    part = (dx[:, :, cols] * use).reshape(-1, LEARNED)
                    g[name] = np.stack([np.bincount(key.ravel(), part[:, c], len(self.p[name])) for c in range(LEARNED)], axis=1).astype(np.float32)
                at += 1
                step = rate * 0.5 ** (3 * epoch // epochs)
                for k, d in g.items():
                    d = d + 1e-4 * self.p[k]
                    m[k] += 0.1 * (d - m[k])
                    q[k] += 0.001 * (d * d - q[k])
                    self.p[k] -= (step * (m[k] / (1 - 0.9**at)) / (np.sqrt(q[k] / (1 - 0.999**at)) + 1e-8)).astype(np.float32)


@dataclass
class Model:
    network: Network | None
    leanings: Leanings | None
    shift: float
    prior: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One a document, that of its most toxic window."""
        out = np.zeros(len(off) - 1)
        for i, j in blocks(off, BLOCK):
            inv, first, text, begin, kinds = _types(LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i])
            x = self.leanings.inputs(text, begin, kinds)
            words, heads = _learned_keys(text, begin, kinds)
            g = self.network.project(np.concatenate([x, self.network.p["words"][words], self.network.p["heads"][heads]], axis=1))
            g = {d: np.concatenate([v, np.zeros((1, v.shape[1]), v.dtype)]) for d, v in g.items()}
            kind = np.append(inv, len(kinds)).astype(np.int32)  # the last row for places without a word
            n_words = np.diff(first)
            n = np.maximum(0, -(-(n_words - WINDOW) // STRIDE)) + 1
            begin_w = np.concatenate([[0], np.cumsum(n)])
            logit = np.empty(begin_w[-1], np.float32)
            a = 0
            while a < j - i:  # documents of about BATCH windows at a time, a longer one in parts
                z = max(a + 1, int(np.searchsorted(begin_w, begin_w[a] + BATCH, side="right")) - 1)
                place, _, _ = windows(n_words[a:z], first[a:z])
                for p in range(0, len(place), BATCH):
                    part = np.ascontiguousarray(place[p : p + BATCH].T)
                    k = kind[part]
                    logit[begin_w[a] + p : begin_w[a] + p + part.shape[1]] = self.network.forward({d: v[k] for d, v in g.items()}, (part >= 0)[:, :, None])
                a = z
            out[i:j] = np.maximum.reduceat(logit, begin_w[:-1])
        return out

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(off) - 1, self.prior)
        return _sigmoid(self.logits(data, off) + self.shift)


def _area(score: np.ndarray, label: np.ndarray) -> float:
    """Share of (toxic, clean) pairs in order; a tie counts half."""
    bad, good = np.sort(score[label == 1]), np.sort(score[label == 0])
    return float((np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")).mean() / (2 * len(good)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    prior = float(labels.mean()) if len(labels) else 0.0
    if len(np.unique(labels)) < 2:
        return Model(None, None, 0.0, prior)
    data, off = utf8(pa.array(texts, pa.string()))
    types = lambda i: _types(LOWER[data[off[i] : off[i + 1]]], off[i : i + 2] - off[i])
    per = []  # distinct buckets only: words are read again below
    for i in range(len(texts)):
        _, _, text, begin, kinds = types(i)
        gram = np.unique(_grams(text, begin)[0]) if len(kinds) else np.zeros(0, np.int32)
        per.append((gram, np.unique((kinds >> np.uint64(64 - GRAM_BITS)).astype(np.int32))))
    fold = np.random.default_rng(5).permutation(len(texts)) % 2
    learn = lambda ids: Leanings.learn([per[i][0] for i in ids], [per[i][1] for i in ids], labels[ids])
    other = [learn(np.flatnonzero(fold != f)) for f in (0, 1)]
    r = np.random.default_rng(11)
    xs, ws, hs, ons, ys, own = [], [], [], [], [], []
    final = learn(np.arange(len(texts)))
    per.clear()
    for i in range(len(texts)):
        inv, first, text, begin, kinds = types(i)
        if not len(kinds):
            continue
        x = other[fold[i]].inputs(text, begin, kinds)
        words, heads = _learned_keys(text, begin, kinds)
        place, _, _ = windows(np.diff(first), first[:-1])
        k = np.where(place >= 0, inv[place], len(kinds))
        x, words, heads = np.concatenate([x, np.zeros((1, 5), np.float32)]), np.append(words, 0), np.append(heads, 0)
        lean = np.where(place >= 0, x[k][:, :, 0] + x[k][:, :, 3], -9).max(1)
        best = np.argsort(-lean, kind="stable")[: 1 if labels[i] else 2]
        picked = best if labels[i] else np.unique(np.append(best, r.integers(len(place), size=1)))
        for w in picked:
            xs.append(x[k[w]])
            ws.append(words[k[w]].astype(np.int32))
            hs.append(heads[k[w]].astype(np.int32))
            ons.append(place[w] >= 0)
            ys.append(labels[i])
            own.append(fold[i])
    y = np.array(ys, np.float32)
    if len(np.unique(y)) < 2:
        return Model(None, None, 0.0, prior)
    x, words, heads, on, own = np.array(xs), np.array(ws), np.array(hs), np.array(ons), np.array(own)

    def trained(use: np.ndarray, dropout: float) -> Network:
        n, bad = use.sum(), y[use].sum()
        net = Network()
        net.fit(x[use], words[use], heads[use], on[use], y[use], np.where(y[use] == 1, n / (2 * bad), n / (2 * (n - bad))).astype(np.float32), epochs, dropout)
        return net

    def whole(net: Network, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of a fold and their logits, with the leanings of the other."""
        ids = np.flatnonzero(fold == f)
        return ids, Model(net, other[f], 0.0, prior).logits(*utf8(pa.array([texts[i] for i in ids], pa.string())))

    # learned on one half, tried on the other
    half, dropout = own == 0, DROPOUTS[-1]
    if all(len(np.unique(v)) == 2 for v in (y[half], labels[fold == 1])):
        tried = []
        for v in DROPOUTS:
            ids, got = whole(trained(half, v), 1)
            tried.append(_area(got, labels[ids]))
        dropout = DROPOUTS[int(np.argmax(tried))]
    net = trained(np.ones(len(y), bool), dropout)
    logit = np.zeros(len(texts))
    for f in (0, 1):
        ids, got = whole(net, f)
        logit[ids] = got
    order = np.argsort(logit, kind="stable")
    s, hit = logit[order], labels[order] == 1
    # the share of each label on its side when the cut stands before the k-th
    right = np.concatenate([[0], np.cumsum(~hit)]) / (~hit).sum() + (hit.sum() - np.concatenate([[0], np.cumsum(hit)])) / hit.sum()
    best = np.flatnonzero(right == right.max())
    lo, hi = max(best[0] - 1, 0), min(best[-1], len(s) - 1)
    return Model(net, final, -float(s[lo] + s[hi]) / 2, prior)


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """From labels of rows that aren't held out. Only the sample's ids, at most 2 x per_label, are broadcast; one task learns, from at most 4 x per_label rows, and the driver gets the model."""
    ready(docs.sparkSession)
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")).where(~held_out(id_col))
    pick = None
    for v in (0, 1):
        part = own.where(F.col("_label") == v).orderBy(F.xxhash64(id_col), id_col).limit(per_label)
        pick = part if pick is None else pick.unionByName(part)
    pick = pick.withColumnRenamed(id_col, "_id")
    got = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(pick), F.col("_doc") == F.col("_id")).where(F.length("_text") <= max_chars)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64)))], pa.binary())], names=["model"])

    # of ids that stand for many rows, always the same ones
    found = got.select("_doc", "_text", "_label").orderBy(F.xxhash64("_doc"), "_doc", F.xxhash64("_text"), "_text").limit(4 * per_label).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, 0 to 1."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(*utf8(b.column(1))))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """docs that score below limit; all columns stay. The score is computed beside the row, so nothing is joined."""
    spark = ready(docs.sparkSession)
    sent, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.scores(*utf8(b.column(place))) < limit))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = load(spark, sf_dir, "documents")
    d = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
