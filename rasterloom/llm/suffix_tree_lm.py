"""Language-model scoring with a probabilistic suffix tree over UTF-8 bytes.

A text is its tokens (lower-cased A-Z, cut at white space), one space between them and one end mark (a line feed, which no
token holds); that form and the tokens determine each other, so the probability of the bytes is that of the tokens.

Training counts every (depth + 1)-gram of bytes of all training texts; shorter contexts follow from those. A context is a
candidate if it occurs at least `least` times, an absolute count, so the tree grows with the corpus. A candidate is retained
if it, or one that ends in it, passes the divergence test: its count times the Kullback-Leibler divergence of its next-byte
distribution from that of the context one byte shorter is at least `evidence` nats. (`p_min` and `gain` give the two bounds
as shares of all training bytes instead.) Distributions are smoothed into that of the shorter context (Witten-Bell weights, times PRIOR),
at the root into the uniform one, so no text has probability zero. A byte is scored by the state of the longest retained
suffix of what precedes it (line feeds stand before the first byte).

Grams are counted in numpy and travel as pressed arrays, a row for each task and shard, so no engine row stands for a gram.
Contexts are dealt by their last two bytes, which all suffixes of two bytes or more share, so each shard of the tree is grown
by a task from its own grams, of which corpora too large for that are summed in pieces before; only contexts of up to one byte are the driver's. States are sparse: the log probability of
each byte met after a context, and the log weight of what the shorter context gives for others. The shards stand in a table
and go to the executors as broadcast blocks of at most `block_bytes` (or one larger shard), of which the driver and a task
hold one at a time.

Beside it stands the unigram base: counts of all training tokens, add one. Words of a share of at least `p_word` (at most
1 / p_word of them) and the end are broadcast; the rest are looked up by a join on the 64-bit hash of the word.

Null texts count as empty: no words, one end. A null id counts as the empty string for the split. Repeated rows give a row
each and count each. With no training text the tree is the uniform distribution. Extra columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import load, ready, table
from .textops import LOWER, NOSPACE, blocks, mix, run_sums, span_hashes, utf8, word_spans

DEPTH = 6
#: Occurrences of a candidate: what stands once in the corpus tells nothing that recurs.
LEAST = 2
#: Nats that the divergence test asks for.
EVIDENCE = 16.0
#: Weight of the shorter context for each kind of byte met after a context (1 is the plain Witten-Bell weight). Texts copy each other, so what few occurrences say counts for less.
PRIOR = 8.0
SHARDS = 256
#: Partial sums of grams that a task takes at once; of more, a shard's are first summed in pieces.
SHARD_GRAMS = 1 << 24
#: Bytes of states in one broadcast block, and blocks of text that a task scores against each when there are several.
BLOCK_BYTES = 3 << 25
TEXTS = 4
P_WORD = 5e-7
END = 10
#: The end token's key among word hashes (zero is given to no word).
END_KEY = 0
#: Grams and words that a task holds before it passes their counts on.
HELD = 1 << 22


def _keys(h: np.ndarray) -> np.ndarray:
    h = h.view(np.int64)
    return np.where(h == END_KEY, 1, h)


def padded(b: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, at, starts, ends, first, words): depth line feeds and the tokens with their end mark, for each document; at[d]: where d's scored bytes begin, and their number follows from the next; words: spans in b."""
    s, e, first = word_spans(b, off, NOSPACE)
    n_words = np.diff(first)
    keep = NOSPACE[b]
    n_bytes = run_sums(keep, off)
    size = depth + n_bytes + np.maximum(n_words, 1)
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.full(begin[-1], 32, dtype=np.uint8)
    heads = begin[:-1, None] + np.arange(depth)
    text[heads] = END
    text[begin[1:] - 1] = END
    # a word byte stands after the pads, the word bytes and the words before it in its document
    length = e - s
    doc = np.repeat(np.arange(len(n_words)), n_words)
    before = np.cumsum(length) - length
    base = before - np.concatenate([[0], np.cumsum(n_bytes)])[:-1][doc] + (np.arange(len(s)) - first[:-1][doc]) + begin[:-1][doc] + depth
    text[np.repeat(base - before, length) + np.arange(length.sum())] = b[keep]
    return text, begin, s, e, first, n_words


def _codes(text: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes up to each position, the latest lowest."""
    c = np.zeros(len(text), np.uint64)
    t = text.astype(np.uint64)
    for k in range(order):
        c[k:] |= t[: len(t) - k] << np.uint64(8 * k)
    return c


def _scored(begin: np.ndarray, depth: int) -> np.ndarray:
    ok = np.ones(begin[-1], dtype=bool)
    ok[(begin[:-1, None] + np.arange(depth)).ravel()] = False
    return ok


#: Shard of each two last bytes of a context.
_SHARD = (mix(np.arange(1 << 16, dtype=np.uint64)) & np.uint64(SHARDS - 1)).astype(np.uint8)


def pressed(code: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted codes and their counts, byte plane by byte plane: the planes that hardly change take next to nothing."""
    planes = np.concatenate([code.view(np.uint8).reshape(-1, 8).T, count.astype(np.uint64).view(np.uint8).reshape(-1, 8).T])
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpressed(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(16, n)
    code, count = (np.ascontiguousarray(planes[k : k + 8].T).view("<u8").ravel() for k in (0, 8))
    return code, count.astype(np.int64)


def _dealt(code: np.ndarray, count: np.ndarray, group: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """A row of pressed grams for each group (a byte)."""
    order = np.argsort(group, kind="stable")
    code, count, group = code[order], count[order], group[order]
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1).astype(bool)) if len(group) else np.zeros(1, np.int64)
    parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    for i in range(0, len(parts), 64):
        some = parts[i : i + 64]
        cols = [[kind] * len(some), [int(group[a]) for a, _ in some], [z - a for a, z in some], [pressed(code[a:z], count[a:z]) for a, z in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int8(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "key", "n", "grams"])


def gather(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """(kind, key, n, grams) of training texts, partial sums: kind 0 token counts by hash (0: the end), kind 2 counts of byte pairs, kind 1 pressed counts of n distinct byte grams of shard key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        pairs = np.zeros(1 << 16, np.int64)
        n, ends = 0, 0

        def counted(kind: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(key), 1 << 17):
                k = key[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(count[i : i + (1 << 17)]), pa.nulls(len(k), pa.binary())], names=["kind", "key", "n", "grams"])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    x = np.concatenate(parts)
                    parts.clear()
                    x.sort()
                    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    count, x = np.diff(np.append(cut, len(x))), x[cut]
                    if kind == 0:
                        yield from counted(0, x, count)
                    else:
                        np.add.at(pairs, _low(x, 2).astype(np.int64), count)
                        yield from _dealt(x, count, _SHARD[(_low(x, 3) >> np.uint64(8)).astype(np.int64)], 1)

        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                b = LOWER[data[off[i] : off[j]]]
                text, begin, s, e, *_ = padded(b, off[i : j + 1] - off[i], depth)
                held[0].append(_keys(span_hashes(b, s, e)))
                held[1].append(_codes(text, depth + 1)[_scored(begin, depth)])
                ends, n = ends + j - i, n + len(text)
                if n >= HELD:
                    yield from flush()
                    n = 0
        yield from flush()
        met = np.flatnonzero(pairs)
        yield from counted(2, met, pairs[met])
        yield from counted(0, np.array([END_KEY]), np.array([ends]))

    return docs.select(text_col).mapInArrow(run, "kind byte, key long, n long, grams binary")


def merged(grams: DataFrame, pieces: int) -> DataFrame:
    """Pressed grams (key: the shard, n, grams) summed piece by piece, each of some of a shard's grams: for corpora of which a shard's partial sums are too many for a task."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                code, count = unpressed(blob.as_buffer(), n)
                for part in _dealt(code, count, (mix(code) % np.uint64(pieces)).astype(np.int64), 1):
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * part.num_rows, pa.int64()), *part.columns[1:]], names=["key", "piece", "n", "grams"])

    def add(part: pa.Table) -> pa.Table:
        code, count = _sums(*(np.concatenate(x) for x in zip(*(unpressed(blob.as_buffer(), n) for n, blob in zip(part["n"].to_pylist(), part["grams"], strict=True)), strict=True)))
        return pa.table({"key": part["key"][:1], "n": pa.array([len(code)], pa.int64()), "grams": pa.array([pressed(code, count)], pa.binary())})

    return grams.mapInArrow(split, "key long, piece long, n long, grams binary").groupBy("key", "piece").applyInArrow(add, "key long, n long, grams binary")


def _low(code: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of codes."""
    return code & np.uint64((1 << 8 * n) - 1)


def _sums(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[cut], np.add.reduceat(count[order], cut) if len(cut) else np.zeros(0, np.int64)


#: Sorted contexts with the log10 weight of the shorter one, and sorted grams (context and next byte) with log10 probability, of one depth.
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grow(code: np.ndarray, count: np.ndarray, first: np.ndarray, depth: int, least: float, evidence: float) -> dict[int, Level]:
    """The retained states of 2 to depth bytes among grams (codes of depth earlier bytes and the next one) of some two last bytes. first[x, c]: probability of c after x."""
    grams, probs, contexts, backs, owners, parents, keep = {}, {}, {}, {}, {}, {}, {}
    for d in range(2, depth + 1):
        g, n = _sums(_low(code, d + 1), count)
        ctx, at = np.unique(g >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, n, len(ctx))
        kinds = np.bincount(at, minlength=len(ctx))
        ok = total >= least
        on = ok[at]
        g, n, at = g[on], n[on], (np.cumsum(ok) - 1)[at[on]]
        ctx, total, kinds = ctx[ok], total[ok], kinds[ok]
        # a candidate's suffixes occur as often at least, and each of its grams without the earliest byte was met
        short = _low(g, d)
        up = first[(short >> np.uint64(8)).astype(np.int64), _low(short, 1).astype(np.int64)] if d == 2 else probs[d - 1][np.searchsorted(grams[d - 1], short)]
        p = (n + PRIOR * kinds[at] * up) / (total + PRIOR * kinds)[at]
        keep[d] = np.bincount(at, n * np.log(n / total[at] / up), len(ctx)) >= evidence
        if d > 2:
            parents[d] = np.searchsorted(contexts[d - 1], _low(ctx, d - 1))
        grams[d], probs[d], contexts[d], owners[d], backs[d] = g, p, ctx, at, np.log10(PRIOR * kinds / (total + PRIOR * kinds))
    # a state that a retained one ends in stays
    for d in range(depth, 2, -1):
        keep[d - 1][parents[d][keep[d]]] = True
    out = {}
    for d, k in keep.items():
        on = k[owners[d]]
        out[d] = contexts[d][k], backs[d][k].astype(np.float32), grams[d][on], np.log10(probs[d][on]).astype(np.float32)
    return out


def _merged(parts: list[dict[int, Level]], depth: int) -> dict[int, Level]:
    out = {}
    for d in range(2, depth + 1):
        ctx, back, g, p = (np.concatenate([x[d][k] for x in parts]) for k in range(4))
        i, j = np.argsort(ctx, kind="stable"), np.argsort(g, kind="stable")
        out[d] = ctx[i], back[i], g[j], p[j]
    return out


def refine(block: dict[int, Level], code: np.ndarray, value: np.ndarray) -> None:
    """value: log10 probability of grams by contexts of up to one byte; where the block has longer ones, theirs. First down to the longest state of each gram, then back until one has met its byte."""
    code = code.view(np.uint64)
    on, found = np.arange(len(code), dtype=np.int32), []
    for d, (ctx, *_) in block.items():
        if not len(ctx) or not len(on):
            break
        own = _low(code[on], d + 1) >> np.uint64(8)
        at = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
        ok = ctx[at] == own
        on, at = on[ok], at[ok].astype(np.int32)
        found.append((d, on, at))
    weight = np.zeros(len(code) if found else 0, np.float32)
    open_ = np.zeros(len(weight), bool)  # whose probability is still looked for
    deeper = np.zeros(0, np.int32)
    for d, on, at in reversed(found):
        _, back, grams, p = block[d]
        new = np.ones(len(on), bool)
        new[np.searchsorted(on, deeper)] = False
        open_[on[new]] = True
        deeper, mine = on, open_[on]
        here, at = on[mine], at[mine]
        own = _low(code[here], d + 1)
        k = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        met = grams[k] == own
        value[here[met]] = weight[here[met]] + p[k[met]]
        open_[here[met]] = False
        weight[here[~met]] += back[at[~met]]
    value[open_.nonzero()[0]] += weight[open_]


@dataclass
class Tree:
    """head[x, c]: log10 probability of c by the longest retained context of x of up to one byte; ones: those of one byte; blocks: broadcasts of the longer states by depth."""

    head: np.ndarray
    root: np.ndarray
    ones: np.ndarray
    present: np.ndarray
    blocks: list
    depth: int

    @property
    def child(self) -> list[tuple[int, int]]:
        """All states as (bytes, context)."""
        more = [(d, int(c)) for b in self.blocks for d, level in b.value.items() for c in level[0]]
        return [(0, 0), *((1, int(x)) for x in np.flatnonzero(self.ones)), *more]

    @property
    def logp(self) -> np.ndarray:
        """log10 probability by each state of each byte of training, and of one that it lacks: a dense form, for small trees."""
        absent = np.flatnonzero(~self.present)[:1]
        bytes_ = np.concatenate([np.flatnonzero(self.present), absent])
        out = np.zeros((len(self.child), len(bytes_)))
        for k, (d, ctx) in enumerate(self.child):
            out[k] = self.root[bytes_] if d == 0 else self.head[ctx & 255][bytes_]
            for b in self.blocks:
                refine({e: x for e, x in b.value.items() if e <= d}, (np.uint64(ctx) << np.uint64(8)) + bytes_.astype(np.uint64), out[k])
        return out


@dataclass
class Model:
    tree: Tree
    hot_keys: np.ndarray
    hot_counts: np.ndarray
    n: int
    v: int


def states(grams: DataFrame, first: np.ndarray, depth: int, least: float, evidence: float) -> DataFrame:
    """(size, states): the retained states of each shard of pressed grams (key, n, grams), pickled, and their bytes."""
    sent = grams.sparkSession.sparkContext.broadcast(first)

    def run(part: pa.Table) -> pa.Table:
        code, count = (np.concatenate(x) for x in zip(*(unpressed(blob.as_buffer(), n) for n, blob in zip(part["n"].to_pylist(), part["grams"], strict=True)), strict=True))
        found = grow(*_sums(code, count), sent.value, depth, least, evidence)
        size = sum(x.nbytes for level in found.values() for x in level)
        return pa.table({"size": pa.array([size], pa.int64()), "states": pa.array([pickle.dumps(found)], pa.binary())})

    return grams.groupBy("key").applyInArrow(run, "size long, states binary")


def train(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, p_min: float | None = None, gain: float | None = None, p_word: float = P_WORD, least: float = LEAST, evidence: float = EVIDENCE, block_bytes: int = BLOCK_BYTES, shard_grams: int = SHARD_GRAMS) -> tuple[Model, DataFrame]:
    """The model, and the counts (key, n) of all training tokens. p_min and gain, where given, stand for least and evidence as shares of all training bytes. depth: 2 to 7, so that a context and the next byte are one 64-bit number."""
    spark = ready(docs.sparkSession)
    raw = table(gather(docs, text_col, depth), "gathered")
    counts = table(raw.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    pairs = raw.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most 65536
    two = np.zeros((256, 256))
    two[pairs["key"].to_numpy(np.int64) >> 8, pairs["key"].to_numpy(np.int64) & 255] = pairs["n"].to_numpy(np.int64)
    g = raw.where("kind = 1").select("key", "n", "grams")
    most = g.groupBy("key").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most > shard_grams:
        g = merged(g, min(1 << 20, -(-most // shard_grams)))
    total, count = two.sum(), two.sum(0)
    least = least if p_min is None else p_min * total
    evidence = evidence if gain is None else gain * total
    kinds = max(1, int((count > 0).sum()))
    root = (count + kinds / 256) / (total + kinds)
    m, k = two.sum(1, keepdims=True), (two > 0).sum(1, keepdims=True)
    first = np.where(m > 0, (two + PRIOR * k * root) / np.maximum(m + PRIOR * k, 1), root)
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = np.where(two > 0, two * np.log(two / m / root), 0).sum(1)
    ones = (m[:, 0] > 0) & (m[:, 0] >= least) & (worth >= evidence)
    blocks, held, size = [], [], 0
    for row in table(states(g, first, depth, least, evidence), "states").toLocalIterator():
        if held and size + row[0] > block_bytes:
            blocks.append(spark.sparkContext.broadcast(_merged(held, depth)))
            held, size = [], 0
        held.append(pickle.loads(row[1]))
        ones[_low(held[-1][2][0], 1).astype(np.int64)] = True
        size += row[0]
    if held:
        blocks.append(spark.sparkContext.broadcast(_merged(held, depth)))
    hot = counts.where((F.col("n") >= F.lit(p_word) * F.lit(n)) | (F.col("key") == END_KEY)).toPandas().sort_values("key")
    tree = Tree(np.log10(np.where(ones[:, None], first, root)), np.log10(root), ones, count > 0, blocks, depth)
    return Model(tree, hot["key"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), int(n), int(v)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, base_score, score: one row per row of docs."""
    spark = ready(docs.sparkSession)
    depth, trees = model.tree.depth, model.tree.blocks
    sent = spark.sparkContext.broadcast(replace(model, tree=replace(model.tree, blocks=[])))
    names = [id_col, "n_tokens", "known", "base", "score", "rest", "times"]

    def closed(held: list) -> Iterator[pa.RecordBatch]:
        """Scores of the blocks of text held, against each block of states in turn."""
        head = sent.value.tree.head
        values = [head[code >> 8 & 255, code & 255] for _, code, _, _ in held]
        for b in trees:
            for (_, code, _, _), value in zip(held, values, strict=True):
                refine(b.value, code, value)
            if len(trees) > 1:
                b.__dict__.pop("_value", None)
        for (cols, _, inverse, first), value in zip(held, values, strict=True):
            yield pa.RecordBatch.from_arrays([*cols[:4], pa.array(run_sums(value[inverse], first)), *cols[4:]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        floor, held = np.log10(m.n + m.v + 1), []
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in blocks(off):
                b = LOWER[data[off[i] : off[j]]]
                text, begin, s, e, first, n_words = padded(b, off[i : j + 1] - off[i], depth)
                code, inverse = np.unique(_codes(text, depth + 1)[_scored(begin, depth)].view(np.int64), return_inverse=True)
                key = _keys(span_hashes(b, s, e))
                hot = m.hot_keys
                at = np.searchsorted(hot, key)
                at[at == len(hot)] = 0
                known = hot[at] == key if len(hot) else np.zeros(len(key), bool)
                value = np.zeros(len(key))
                value[known] = np.log10(m.hot_counts[at[known]] + 1.0)
                p = np.searchsorted(hot, END_KEY)
                end = int(m.hot_counts[p]) if p < len(hot) and hot[p] == END_KEY else 0
                # distinct words that aren't broadcast, with their counts, wait for the join
                doc = np.repeat(np.arange(j - i), n_words)[~known]
                rest = key[~known]
                order = np.lexsort((rest, doc))
                doc, rest = doc[order], rest[order]
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])])) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(cut, len(doc)))
                per = np.searchsorted(doc[cut], np.arange(j - i + 1)).astype(np.int32)
                cols = [
                    batch.column(0).slice(i, j - i),
                    pa.array(n_words + 1, pa.int64()),
                    pa.array(run_sums(known, first) + (end > 0), pa.int64()),
                    pa.array(run_sums(value, first) + np.log10(end + 1.0) - (n_words + 1) * floor),
                    pa.ListArray.from_arrays(pa.array(per), pa.array(rest[cut], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(per), pa.array(times, pa.int32())),
                ]
                held.append((cols, code, inverse.astype(np.int32), begin - depth * np.arange(len(begin))))
                if len(held) >= (TEXTS if len(trees) > 1 else 1):
                    yield from closed(held)
                    held = []
        if held:
            yield from closed(held)

    kind = docs.schema[id_col].dataType.simpleString()
    cols = f"`{id_col}` {kind}, n_tokens long, known long, base double, score double, rest array<long>, times array<int>"
    part = docs.select(id_col, text_col).mapInArrow(run, cols).withColumn("row", F.monotonically_increasing_id())
    part = table(part, "scored")
    words = part.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("key"), F.col("x.times").alias("times"))
    met = words.join(counts, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("value"))
    out = part.select(id_col, "n_tokens", "known", "base", "score", "row").join(met, "row", "left")
    return out.select(id_col, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("value", F.lit(0.0))).alias("base_score"), "score")


def op8_suffix_tree_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = load(spark, sf_dir, "documents")
    held = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 7 == 2
    model, counts = train(docs.where(~held("doc_id")))
    d = score(docs, model, counts)
    return d.select("doc_id", held("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
