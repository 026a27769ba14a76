"""Benchmark decontamination with suffix arrays over the training text.

The training text is cut into shards (runs of documents within a task). For each shard the words that some benchmark item
has become numbers, all others a separator that matches nothing; stretches too short to hold a window can't match one and
are left out. Over the rest stands a word-level suffix array (prefix doubling in numpy, as deep as the longest item), in
which every suffix of every item is looked up by binary search. That gives the longest verbatim match of each suffix with
its place, and all places of each window. Nothing is shuffled: an item set in blocks of bounded size goes to the shards.

Words: runs of digits, ASCII letters (lower-cased) and any character that isn't ASCII. A window is `window` consecutive words of an item; an
item of fewer words, but not none, is one window. Null texts have no words. Items without words have no windows; those of
null id hit and contaminate like others and only have no place in the list of ids; an id that several items share counts once. Words count as equal by their bytes, not by a hash alone. A document's longest match is told
where it holds a window. Repeated documents give a row each; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import load, ready
from .textops import ALNUM, LOWER, blocks, numbered, run_sums, same_spans, span_hashes, utf8, word_spans

WINDOW = 10
#: Words of items in one broadcast block (8 bytes each): the proven bound of what goes to the executors at a time.
ITEM_WORDS = 2_000_000
#: Words (and documents) of a shard of training text; a longer document is a shard of its own.
SHARD_WORDS = 4_000_000


@dataclass
class Items:
    """A block of items: vocabulary (sorted word hashes under a seed that keeps all words apart, and the words' bytes) and text as word numbers from 1. An item of null id has the id None."""

    ids: list[str | None]
    vocab: np.ndarray
    seed: int
    bytes_: np.ndarray
    at: np.ndarray
    text: np.ndarray
    first: np.ndarray
    window: int
    seen: np.ndarray = field(init=False)
    least: int = field(init=False)

    @staticmethod
    def of(rows: list[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]], window: int) -> Items:
        """rows: id, lower-cased bytes, starts and ends of the words."""
        first = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int64)
        data = np.concatenate([r[1] for r in rows])
        shift = np.repeat(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])[:-1]]), np.diff(first))
        s, e = (np.concatenate([r[k] for r in rows]) + shift for k in (2, 3))
        vocab, one, text, seed = numbered(data, s, e)
        n = e[one] - s[one]
        at = np.concatenate([[0], np.cumsum(n)])
        own = data[np.repeat(s[one] - at[:-1], n) + np.arange(at[-1])]
        return Items([r[0] for r in rows], vocab, seed, own, at, text.astype(np.int32) + 1, first, window)

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 18, dtype=bool)
        self.seen[(self.vocab & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        n = np.diff(self.first)
        self.least = int(np.minimum(n, self.window).min())

    def number(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Number of each word of data, 0 for those of no item; equal hashes count only with equal bytes."""
        h = span_hashes(data, s, e, self.seed)
        out = np.zeros(len(h), dtype=np.int32)
        may = np.flatnonzero(self.seen[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocab, h[may])
        at[at == len(self.vocab)] = 0
        ok = (self.vocab[at] == h[may]) & (self.at[at + 1] - self.at[at] == e[may] - s[may])
        may, at = may[ok], at[ok]
        ok = same_spans(data, s[may], self.bytes_, self.at[at], e[may] - s[may])
        out[may[ok]] = at[ok] + 1
        return out

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and item of every suffix."""
        n = np.diff(self.first)
        item = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(self.text))
        return start, self.first[item + 1] - start, item

    def windows(self) -> tuple[np.ndarray, ...]:
        """Start and length of each distinct window; items by window as CSR (first, item); all suffixes that begin with a window and the number of theirs."""
        start, left, item = self.suffixes()
        n = np.diff(self.first)[item]
        ok = np.where(n >= self.window, left >= self.window, left == n)
        start, length, item = start[ok], np.minimum(left[ok], self.window), item[ok]
        rows = np.zeros((len(start), self.window + 1), dtype=np.int32)
        for k in range(self.window):
            on = length > k
            rows[on, k] = self.text[start[on] + k]
        rows[:, -1] = length
        _, one, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        pair = np.unique(np.stack([kind.ravel(), item], axis=1), axis=0)
        return start[one], length[one], np.searchsorted(pair[:, 0], np.arange(len(one) + 1)), pair[:, 1], start, kind.ravel()


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text that don't start at a separator (0), ordered by their first depth words at least."""
    rank, k = text.astype(np.int64), 1
    while k < depth:
        key = rank * (int(rank.max(initial=0)) + 1)
        key[:-k] += rank[k:]
        kinds, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64)
        k *= 2
        if len(kinds) == len(key):
            break
    sa = np.argsort(rank, kind="stable")
    return sa[text[sa] > 0]


def _bound(text: np.ndarray, sa: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray, above: bool) -> np.ndarray:
    """Binary search: for each query[start:start+length), how many suffixes stand below it (above: or begin with it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa))
    end = len(text) - 1
    while len(on := np.flatnonzero(lo < hi)):
        mid = (lo[on] + hi[on]) >> 1
        less = np.full(len(on), above)  # equal as far as the query goes
        rest, t = np.arange(len(on)), 0
        while len(rest := rest[length[on[rest]] > t]):
            a, b = text[np.minimum(sa[mid[rest]] + t, end)], query[start[on[rest]] + t]
            less[rest] = np.where(a != b, a < b, above)
            rest, t = rest[a == b], t + 1
        lo[on] = np.where(less, mid + 1, lo[on])
        hi[on] = np.where(less, hi[on], mid)
    return lo


def _common(text: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    n, rest, end, t = np.zeros(len(start), np.int64), np.arange(len(start)), len(text) - 1, 0
    while len(rest := rest[length[rest] > t]):
        same = text[np.minimum(at[rest] + t, end)] == query[start[rest] + t]
        rest, t = rest[same], t + 1
        n[rest] = t
    return n


class Shard:
    """Documents of one shard as they are met, then what the suffix array has of them."""

    def __init__(self, items: Items) -> None:
        self.items, self.text, self.doc, self.word, self.size, self.docs = items, [], [], [], 0, 0

    def add(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> None:
        """Lower-cased bytes and words of some more documents; s, e, first as of word_spans()."""
        ids = self.items.number(data, s, e)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        # stretches of numbered words within a document, of at least `least`
        edge = np.ones(len(ids) + 1, dtype=bool)
        edge[1:-1] = (ids[1:] == 0) | (ids[:-1] == 0) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(edge)
        a, z = a[:-1], a[1:]
        ok = (ids[a] > 0) & (z - a >= self.items.least) if len(a) else np.zeros(0, bool)
        a, z = a[ok], z[ok]
        if len(a):
            # each stretch and a separator after it
            size = z - a + 1
            at = np.repeat(a, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            stop = np.cumsum(size) - 1
            at[stop] = z - 1
            text = ids[at]
            text[stop] = 0
            self.text.append(text)
            self.doc.append(doc[at].astype(np.int32) + self.docs)
            self.word.append(at - first[:-1][doc[at]])
            self.size += len(text)
        self.docs += len(n)

    def close(self) -> None:
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.text, self.doc, self.word = cat(self.text, np.int32), cat(self.doc, np.int32), cat(self.word, np.int64)
        _, left, _ = self.items.suffixes()
        self.sa = suffix_array(self.text, int(left.max(initial=1)))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit flag of each candidate word, and the (document, window) pairs that occur."""
        start, length, *_ = self.items.windows()
        self.lo = lo = _bound(self.text, self.sa, self.items.text, start, length, False)
        self.hi = hi = _bound(self.text, self.sa, self.items.text, start, length, True)
        n = hi - lo
        w = np.repeat(np.arange(len(n)), n)
        at = self.sa[np.repeat(lo, n) + (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n))]
        cover = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length[w], -1)
        pairs = np.unique(self.doc[at].astype(np.int64) * max(1, len(n)) + w)
        return np.cumsum(cover[:-1]) > 0, pairs // max(1, len(n)), pairs % max(1, len(n))

    def longest_by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After windows(): each document with a hit, length of its longest match with an item, and the word where the first such begins. The suffixes of a window are followed beyond it, from where a match begins, so the work is that of the matches' lengths."""
        *_, start, kind = self.items.windows()
        _, left, item = self.items.suffixes()
        head = self.items.first[item[start]] == start
        best: list[np.ndarray] = []
        n = (self.hi - self.lo)[kind]
        edge = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + 1, 1 << 22), side="left").tolist()
        for i, z in zip(edge, [*edge[1:], len(n)], strict=True):
            m = n[i:z]
            j = np.repeat(np.arange(i, z), m)
            at = self.sa[np.repeat(self.lo[kind[i:z]], m) + (np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m))]
            new = head[j] | (at == 0) | (self.text[at - 1] != self.items.text[start[j] - 1])
            j, at = j[new], at[new]
            size = _common(self.text, at, self.items.text, start[j], left[start[j]])
            best.append(np.stack([self.doc[at].astype(np.int64), -size, self.word[at]], axis=1))
        rows = np.concatenate([np.zeros((0, 3), np.int64), *best])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        return rows[first, 0], -rows[first, 1], rows[first, 2]

    def longest(self) -> tuple[np.ndarray, ...]:
        """Item, word within it, length, document and word there of each suffix's longest match, if it has one."""
        start, left, item = self.items.suffixes()
        if not len(self.sa):
            z = np.zeros(0, np.int64)
            return z, z, z, z, z
        lo = _bound(self.text, self.sa, self.items.text, start, left, False)
        best, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for near in (lo - 1, lo):
            p = self.sa[np.clip(near, 0, len(self.sa) - 1)]
            n = _common(self.text, p, self.items.text, start, left)
            at, best = np.where(n > best, p, at), np.maximum(n, best)
        ok = best > 0
        return item[ok], (start - self.items.first[item])[ok], best[ok], self.doc[at[ok]], self.word[at[ok]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, size: int = ITEM_WORDS) -> Iterator[Items]:
    """The items in blocks of at most size words, or one longer item; the driver holds one partition and one block at a time."""
    held, n = [], 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        b, off = utf8(pa.array([r[1]], pa.string()))
        b = LOWER[b]
        s, e, _ = word_spans(b, off, ALNUM)
        if len(s):
            if held and n + len(s) > size:
                yield Items.of(held, window)
                held, n = [], 0
            held.append((None if r[0] is None else str(r[0]), b, s, e))
            n += len(s)
    if held:
        yield Items.of(held, window)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list]]:
    """Ids, word counts and the words (as for Shard.add) of each shard of documents."""
    ids, words, parts, n = [], [], [], 0
    for batch in batches:
        data, off = utf8(batch.column(1))
        for i, j in blocks(off):
            b, o = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
            s, e, first = word_spans(b, o, ALNUM)
            parts.append((b, s.astype(np.int32), e.astype(np.int32), first) if len(b) < 1 << 31 else (b, s, e, first))
            ids.append(batch.column(0).slice(i, j - i))
            words.append(np.diff(first))
            n += len(s) + j - i
            if n >= SHARD_WORDS:
                yield ids, np.concatenate(words), parts
                ids, words, parts, n = [], [], [], 0
    if ids:
        yield ids, np.concatenate(words), parts


def _closed(sent: list, parts: list) -> Iterator[Shard]:
    """The shard against each block of items in turn; of several blocks, one is in memory at a time."""
    for b in sent:
        shard = Shard(b.value)
        for words in parts:
            shard.add(*words)
        shard.close()
        yield shard
        if len(sent) > 1:
            b.__dict__.pop("_value", None)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = ITEM_WORDS) -> DataFrame:
    """Per document: id_col, n_words, n_hit, items (ids of items with occurring windows as strings, sorted), spans (hit words, [start, end)), longest (words of its longest verbatim match with an item, 0 without a hit) and longest_at (where the first such begins, null without a hit)."""
    spark = ready(docs.sparkSession)
    sent = [spark.sparkContext.broadcast(x) for x in item_blocks(items, item_col, item_text, window, block_words)]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, parts in _shards(batches):
            n_docs = len(words)
            found: dict[int, set[str]] = {}
            hits: list[np.ndarray] = []
            longest, place = np.zeros(n_docs, np.int64), np.full(n_docs, -1, np.int64)
            for shard in _closed(sent, parts):
                if not len(shard.sa):
                    continue
                hit, doc, win = shard.windows()
                hits.append(shard.doc[hit].astype(np.int64) << 32 | shard.word[hit])
                if len(doc):
                    d, size, at = shard.longest_by_document()
                    more = (size > longest[d]) | (size == longest[d]) & (at < place[d])
                    longest[d[more]], place[d[more]] = size[more], at[more]
                _, _, first, item, *_ = shard.items.windows()
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for w, d in zip(np.split(win, cuts), doc[np.concatenate([[0], cuts])] if len(doc) else [], strict=False):
                    found.setdefault(int(d), set()).update(i for k in np.unique(np.concatenate([item[first[x] : first[x + 1]] for x in w])) if (i := shard.items.ids[k]) is not None)
            at = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            n_hit = np.bincount(at >> 32, minlength=n_docs)
            a = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            z = np.append(a[1:], len(at))
            ends = at[z - 1] + 1 if len(at) else at
            per = np.searchsorted(at[a] >> 32, np.arange(n_docs + 1))
            spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(at[a] & 0xFFFFFFFF, pa.int64()), pa.array(ends & 0xFFFFFFFF, pa.int64())], names=["start", "end"])).cast(span)
            names = [sorted(found.get(d, ())) for d in range(n_docs)]
            yield pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks(), pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), spans, pa.array(longest), pa.array(place, mask=place < 0)], names=[id_col, "n_words", "n_hit", "items", "spans", "longest", "longest_at"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, longest long, longest_at long")


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = ITEM_WORDS) -> DataFrame:
    """Per item suffix with a match anywhere: item, item_word (where the suffix starts), length in words, and id_col and doc_word of one place of that length (least id, then least word)."""
    spark = ready(docs.sparkSession)
    # stretches of one word count here
    sent = [spark.sparkContext.broadcast(x) for x in item_blocks(items, item_col, item_text, 1, block_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, parts in _shards(batches):
            ids = pa.chunked_array(ids).combine_chunks()
            for shard in _closed(sent, parts):
                item, word, n, doc, there = shard.longest()
                yield pa.RecordBatch.from_arrays([pa.array([shard.items.ids[k] for k in item], pa.string()), pa.array(word, pa.int64()), pa.array(n, pa.int64()), ids.take(pa.array(doc, pa.int64())), pa.array(there, pa.int64())], names=["item", "item_word", "length", id_col, "doc_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(run, f"item string, item_word long, length long, `{id_col}` {kind}, doc_word long")
    best = found.where("item IS NOT NULL").groupBy("item", "item_word").agg(F.min(F.struct((-F.col("length")).alias("n"), F.col(id_col), F.col("doc_word"))).alias("x"))
    return best.select("item", "item_word", (-F.col("x.n")).alias("length"), F.col(f"x.{id_col}"), "x.doc_word")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that hold a window of an item; all columns stay. One pass, no join: the flag is computed beside the row."""
    spark = ready(docs.sparkSession)
    sent = [spark.sparkContext.broadcast(x) for x in item_blocks(items, how.get("item_col", "item_id"), how.get("item_text", "text"), how.get("window", WINDOW), how.get("block_words", ITEM_WORDS))]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.zeros(batch.num_rows, dtype=bool)
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["row", "text"])
            for ids, _, parts in _shards(iter([rows])):
                row = pa.chunked_array(ids).to_numpy()
                for shard in _closed(sent, parts):
                    if len(shard.sa):
                        flags[row[np.unique(shard.windows()[1])]] = True
            yield batch.filter(pa.array(~flags))

    return docs.mapInArrow(run, docs.schema)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at of every document."""
    d = overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_at")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT b, item, j, least(len(w), 10) AS n, array_to_string(w[j:j + 9], ' ') AS win
  FROM (SELECT b, item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.b, bw.item, bw.j FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r),
run AS (SELECT r, min(i) - 1 AS place, count(*) + any_value(n) - 1 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS g FROM m) GROUP BY r, b, i - j, g),
most AS (SELECT r, max(size) AS longest, arg_max(place, size * 1000000000 - place) AS longest_at FROM run GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated, CAST(coalesce(most.longest, 0) AS BIGINT) AS longest, CAST(most.longest_at AS BIGINT) AS longest_at
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN it ON d.r = it.r LEFT JOIN most ON d.r = most.r
"""
