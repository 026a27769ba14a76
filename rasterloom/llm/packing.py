"""Best-fit packing planned on a histogram of lengths.

Documents become token ids (a tokenizer file that is a parameter) and one closing id; only what is longer than a sequence is
cut, into full pieces and a rest. One map pass writes a row for each piece with its rank among the pieces of its length in
its task. The driver sees the histogram alone, at most `size` numbers whatever the corpus, and runs best-fit decreasing
over counts: bins that are filled alike are one run of sequence numbers. Each run of a length gives a plan row, and pieces
take their slots by joining on length and rank. No text, no token and no group of equal lengths is shuffled or collected.

Null and empty texts have the closing id alone. Repeated rows are packed each. A sequence has no gaps; its ids are 0 to
n - 1. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import load, ready, table
from .textops import LOWER, NOSPACE, blocks, numbered, run_sums, same_spans, utf8, word_spans

SIZE = 4096
CLOSE = 1
TOKENIZER = "word_bpe_49k.json"
BLOCK = 1 << 21
#: Distinct words whose ids a task remembers.
KNOWN = 1 << 20


class Words:
    """Token ids of words, each distinct word encoded once; a hash counts as a word only where the bytes agree. For tokenizers that ignore case, drop white space, never merge across it, cut between letters and other marks and mark the ends of words."""

    #: One run of small letters in composed form, so one piece for the tokenizer's cutting and the same after its normalizing.
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    #: So many plain words go to the tokenizer as one text.
    TOGETHER = 256

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place, self.seed = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.text, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # the words themselves, by place

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        call = lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        plain = np.fromiter((self.joins and bool(self.PLAIN.fullmatch(w)) for w in words), bool, len(words))
        own = [w for w, p in zip(words, plain, strict=True) if p]
        flat = np.fromiter(chain.from_iterable(call([b" ".join(own[i : i + self.TOGETHER]).decode() for i in range(0, len(own), self.TOGETHER)])), np.uint32)
        stop = np.flatnonzero(self.ends[flat]) + 1
        if len(stop) != len(own):
            raise ValueError("the tokenizer doesn't end each word with one of its word ends")
        rest = call([w.decode() for w, p in zip(words, plain, strict=True) if not p])
        size = np.zeros(len(words), np.int64)
        size[plain] = np.diff(stop, prepend=0)
        size[~plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        ids = np.zeros(size.sum(), np.uint32)
        mine = np.repeat(plain, size)
        ids[mine] = flat
        ids[~mine] = np.fromiter(chain.from_iterable(rest), np.uint32)
        return ids, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, the closing one last in each, and where each begins (n + 1)."""
        buf = data.tobytes()
        if b"<|" not in buf:  # special tokens keep their case
            data = LOWER[data]
            buf = data.tobytes()
        s, e, first = word_spans(data, off, NOSPACE)
        s, e, first = _without_stops(data, s, e, first)
        kinds, one, inv, seed = numbered(data, s, e)
        a, z = s[one], e[one]
        if len(self.keys) + len(kinds) > KNOWN or seed != self.seed or not self._agrees(kinds, data, a, z):
            self.clear()  # a hash that stands for another word here starts anew, with this block's words alone
            self.seed = seed
        new = np.flatnonzero(~self._has(kinds))
        if len(new):
            a, z = a[new], z[new]
            ids, n = self._new([buf[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)])
            place = np.arange(len(n)) + len(self.start) - 1
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, ids])
            size = z - a
            self.text = np.concatenate([self.text, data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
            at = np.searchsorted(self.keys, kinds[new])
            self.keys, self.place = np.insert(self.keys, at, kinds[new]), np.insert(self.place, at, place)
        w = self.place[np.searchsorted(self.keys, kinds)][inv] if len(kinds) else np.zeros(0, np.int64)
        n = self.start[w + 1] - self.start[w]
        size = run_sums(n, first) + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.full(begin[-1], CLOSE, dtype=np.uint32)
        body = np.ones(begin[-1], dtype=bool)
        body[begin[1:] - 1] = False
        out[body] = self.ids[np.repeat(self.start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return out, begin

    def _agrees(self, kinds: np.ndarray, data: np.ndarray, a: np.ndarray, z: np.ndarray) -> bool:
        """Whether each known hash of kinds stands for the bytes data[a:z) too."""
        on = np.flatnonzero(self._has(kinds))
        if not len(on):
            return True
        p = self.place[np.searchsorted(self.keys, kinds[on])]
        n = z[on] - a[on]
        return bool(np.array_equal(self.at[p + 1] - self.at[p], n) and same_spans(data, a[on], self.text, self.at[p], n).all())

    def _has(self, kinds: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(kinds), dtype=bool)
        at = np.searchsorted(self.keys, kinds)
        at[at == len(self.keys)] = 0
        return self.keys[at] == kinds


def _without_stops(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans with a last full stop or comma after a small letter as a span of its own: the tokenizer cuts there anyhow."""
    if not len(s):
        return s, e, first
    last, before = data[e - 1], data[np.maximum(e - 2, 0)]
    stop = (e - s >= 2) & ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122)
    to = np.arange(len(s)) + np.cumsum(stop) - stop
    a, z = np.empty(len(s) + stop.sum(), np.int64), np.empty(len(s) + stop.sum(), np.int64)
    a[to], z[to] = s, e - stop
    a[to[stop] + 1], z[to[stop] + 1] = e[stop] - 1, e[stop]
    return a, z, first + np.concatenate([[0], np.cumsum(stop)])[first]


def _count_up(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each value among its equals, after those that seen counts; seen is brought up to date."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(v)))
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - np.repeat(head, size) + seen[v]
    seen[v[head]] += size
    return rank


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, part and rank (its rank within the task `part` and its length), and with with_ids its ids."""
    ready(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = Words(tokenizer), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in blocks(off, BLOCK):
                ids, begin = words.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total = np.diff(begin)
                n = -(-total // size)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(total[doc] - start, size)
                at = begin[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(_count_up(length, seen))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, begin[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *NAMES, *["ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<int>" * with_ids)


NAMES = ["piece", "start", "length", "ids_crc32", "part", "rank"]


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, lo, hi, sequence, each, offset): the pieces of this length with ranks lo to hi - 1 go to sequences from `sequence` on, `each` to a sequence, side by side from `offset`."""
    room: dict[int, list[tuple[int, int]]] = {}  # what is left in a bin: runs of such bins (first, how many)
    left: list[int] = []
    out, n_bins = [], 0
    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            k = bisect_left(left, length)
            if k == len(left):  # none fits: new bins
                each = size // length
                need = -(-n // each)
                first, have, free = n_bins, need, size
                n_bins += need
            else:
                free = left[k]
                first, have = room[free].pop()
                if not room[free]:
                    del room[free]
                    left.pop(k)
                each = free // length
            full = min(have, n // each)
            used = full * each
            runs = [(first, full, free - each * length)]
            if full < have and used < n and n - used < each:  # one more bin, in part
                runs.append((first + full, 1, free - (n - used) * length))
                used = n
            done = sum(x[1] for x in runs)
            out.append((length, rank, rank + used, first, each, size - free))
            for start, count, rest in [*runs, (first + done, have - done, free)]:
                if count and rest:
                    if rest not in room:
                        room[rest] = []
                        insort(left, rest)
                    room[rest].append((start, count))
            rank, n = rank + used, n - used
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, (ids,) sequence_id and offset."""
    spark = ready(docs.sparkSession)
    rows = table(pieces(docs, id_col, text_col, size, tokenizer, with_ids), "pieces")
    counts = table(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = np.array(plan(histogram, size), dtype=np.int64).reshape(-1, 6)
    slots = spark.createDataFrame(pa.table({k: slots[:, i] for i, k in enumerate(("length", "lo", "hi", "first", "each", "at"))}))
    placed = rows.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    slots = slots.withColumnRenamed("length", "slot_length")
    # bounded whatever the corpus: at most 3 x size runs of bins, each with at most sqrt(2 x size) different lengths, so 1.1 million rows
    met = placed.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    turn = F.col("rank") - F.col("lo")
    return met.select(id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("first") + F.floor(turn / F.col("each"))).alias("sequence_id"), (F.col("at") + turn % F.col("each") * F.col("length")).alias("offset"))


def sequences(docs: DataFrame, **how) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most `size`), in the order of their offsets."""
    p = pack(docs, with_ids=True, **how)
    rows = p.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", F.flatten(F.col("x.ids")).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(load(spark, sf_dir, "documents"))
