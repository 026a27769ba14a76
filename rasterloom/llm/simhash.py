"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Two fingerprints that differ in at most `radius` (3) of 64 bits differ in at most 3 of their 8 bytes, so they share at
least 5 positional bytes. The index holds each distinct fingerprint under 14 sets of 4 byte positions, the blocks of the
Steiner system S(3,4,8): whichever 3 bytes differ, one block misses all of them. Within an index list the shared positional
bytes of each pair are tallied, pairs with fewer than 5 are dropped, the rest are verified on their bits.

A list of more than `bucket` fingerprints is never paired up: it is indexed again on the 8 half-bytes of the 4 bytes that
its members needn't share, and if need be on the 8 pairs of bits below. A list at the third level has 56 bits in common,
so at most 256 distinct fingerprints (several blocks lead to one list, so what enters a level is made distinct): the bound is
proven, no candidate is dropped, and a list only ever emits a spanning
forest of its links, never all pairs. Documents with one fingerprint are one node from the start.

Null and empty texts have fingerprint zero and link like any other. Repeated rows give a row each. A null doc_id is ranked
below no other: the component takes the least doc_id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .fingerprints import simhash
from .runtime import load, ready, split_join, table
from .textops import utf8

#: Blocks of S(3,4,8): the 4-sets of 0..7 whose members' XOR is 0.
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
RADIUS = 3
BUCKET = 256
LEVELS = 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sub_masks(mask: int) -> list[int]:
    """mask and half of the bits it leaves open, in 14 ways: however 3 of the open bits differ, one way misses them."""
    free = [k for k in range(64) if not mask >> k & 1]
    width = len(free) // 8
    return [mask | sum(1 << free[g * width + k] for g in block for k in range(width)) for block in BLOCKS]


def links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among at most BUCKET distinct fingerprints, as index pairs."""
    n = len(fps)
    x = fps[:, None] ^ fps[None, :]
    shared = np.zeros((n, n), dtype=np.int8)
    for k in range(8):
        shared += (x >> np.uint64(8 * k)) & np.uint64(255) == 0
    i, j = np.nonzero(np.triu(shared >= 8 - radius, 1))
    ok = np.bitwise_count(x[i, j]) <= radius
    root, out = list(range(n)), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
        r, s = find(p), find(q)
        if r != s:
            root[max(r, s)] = min(r, s)
            out.append((p, q))
    return out


_OUT = "mask long, a long, b long"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) ordered by mask and key. Gives links (mask 0, a, b), and the postings of the next level (mask, key, fp) for lists that are too long."""
    held: list[int] = []
    at, deep, out = None, None, ([], [], [])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal out
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["mask", "a", "b"])
            out = ([], [], [])

    def put(mask: int, a: int, b: int) -> None:
        for x, y in zip(out, (mask, a, b), strict=True):
            x.append(y)

    def further(fp: int) -> None:
        for m in deep:
            put(_signed(m), _signed(m & fp), _signed(fp))

    def close() -> None:
        if len(held) > 1 and deep is None:
            f = np.array(held, dtype=np.int64).view(np.uint64)
            for p, q in links(f):
                put(0, held[p], held[q])

    for batch in batches:
        mask, key, fp = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            if i == j:
                continue
            if at != (now := (int(mask[i]), int(key[i]))):
                close()
                at, held, deep = now, [], None
            if deep is None:
                held += fp[i:j].tolist()
            if len(held) > BUCKET or deep is not None:
                deep = deep or sub_masks(at[0] & (1 << 64) - 1)
                for x in held or fp[i:j].tolist():
                    further(x & (1 << 64) - 1)
                    if len(out[0]) > 20_000:
                        yield from flush()
                held = []
            if len(out[0]) > 20_000:
                yield from flush()
    close()
    yield from flush()


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """nodes: distinct long column fp. Edges (a, b) whose components are those of all links within the radius."""
    masks = F.array(*[F.lit(_signed(m)) for m in sub_masks(0)])
    postings = nodes.select(F.explode(masks).alias("mask"), "fp").select("mask", F.expr("mask & fp").alias("key"), "fp")
    edges = None
    for _ in range(LEVELS):
        spread = postings.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = table(spread.mapInArrow(_lists, _OUT), "links")
        level = found.where("mask = 0").select("a", "b")
        edges = level if edges is None else edges.unionByName(level)
        long = found.where("mask <> 0").select("mask", F.col("a").alias("key"), F.col("b").alias("fp"))
        if long.isEmpty():
            return edges
        postings = long.distinct()
    raise RuntimeError(f"a list of level {LEVELS} holds more than {BUCKET} fingerprints")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): one row per row of docs; other columns aren't read."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = simhash(*utf8(b.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, fp, component, root): root is the least fingerprint reachable over links. Documents of a popular fingerprint aren't shuffled: what it belongs to is sent to them."""
    fps = table(fingerprints(docs, id_col, text_col), "fps")
    nodes = table(fps.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp")))
    own = nodes.select("fp", "rep")
    least = own.join(roots, own.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    linked = least.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    of = least.join(linked, "root", "left").select("fp", F.coalesce("least", "rep").alias("component"), "root")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return split_join(fps, of, "fp", nodes.select("fp", "n"), total).select(id_col, "fp", "component", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component): component is the least id reachable over links."""
    return _rooted(docs, id_col, text_col).select(id_col, "fp", "component")


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with a last column _row_fp, the fingerprint."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = simhash(*utf8(b.column(place))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, "_row_fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_row_fp", LongType())]))


#: Ids (or pairs of id and fingerprint) that go to the executors as they are; more are met by a shuffle of docs.
SENT = 1 << 19


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """docs with one row of each component, one of least id (null after all others) and then of least fingerprint; all columns stay. Ids may be null or repeat, in one component or several. Up to `sent` rows to drop are broadcast, so that no text moves; only if there are more are docs shuffled, by id."""
    found = table(_rooted(docs, id_col, text_col), "components")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("fp").alias("fp"))
    groups = table(found.groupBy("root").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("n")).select("root", F.col("x.id").alias("_pick"), F.col("x.fp").alias("_pick_fp"), "n"), "groups")
    many = table(found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_many")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_many"), "many")
    repeated = not many.isEmpty()
    # an id of one row goes if its group has another pick
    more = groups.where("n > 1")
    total = more.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gone = split_join(found.select("root", id_col), more.select("root", "_pick"), "root", more.select("root", "n"), total)
    gone = gone.where(F.col(id_col).isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_pick"))).select(F.col(id_col).alias("_gone"))
    if repeated:
        gone = gone.join(many, gone["_gone"] == many["_many"], "left_anti").unionByName(many.select(F.col("_many").alias("_gone")))
    gone = table(gone, "gone")
    few = (lambda d: F.broadcast(d)) if gone.count() <= sent else lambda d: d
    out = docs.where(docs[id_col].isNotNull()).join(few(gone), docs[id_col] == gone["_gone"], "left_anti")
    # an id that doesn't tell rows apart: the fingerprint goes with it, which no two components share
    rest = [docs.where(docs[id_col].isNull())] if not groups.where("_pick IS NULL").isEmpty() else []
    if repeated:
        rest.append(docs.join(many, docs[id_col] == many["_many"], "left_semi"))
    for part in rest:
        part = _marked(part, text_col)
        part = part.join(groups, part[id_col].eqNullSafe(groups["_pick"]) & (part["_row_fp"] == groups["_pick_fp"]), "left_semi")
        out = out.unionByName(part.dropDuplicates([id_col, "_row_fp"]).drop("_row_fp"))
    return out


def op9_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    d = near_duplicates(load(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
