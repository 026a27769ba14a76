"""Importance resampling: documents drawn like a target text, by hashed n-gram models and Gumbel top-k.

Words are runs without white space, case kept; features are their hashed unigrams and bigrams. Two generative models, each one
distribution over the buckets: the raw one counts every document, the target one the labelled good documents, at most
`target_rows` of them (the first by hash of their id; a parameter). A text's log importance weight is the sum over its features of
the log ratio of the two, add-one smoothed. Adding Gumbel noise, drawn from the hash of seed, id and text, and keeping the k
largest keys draws k documents without replacement with chances in proportion to their weights; k is `share` of all rows.

The driver sees one count a bucket. The k-th key is found exactly by counting keys in ever finer ranges, never by sorting all
or by a sketch; equal keys are taken by least id. Null and empty texts have weight one. Without a target document all weights
are those of the smoothed models. Repeated rows share their key and count each. Null labels and ids count as unlabelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import load, ready, table
from .textops import NOSPACE, blocks, mix, run_sums, span_hashes, utf8, word_spans

BITS = 14
TARGET_ROWS = 20_000
SHARE = 0.8
SEED = 17
BINS = 1024


def _features(b: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all unigrams, of all bigrams (of a document's last word none: -1), and first words."""
    s, e, first = word_spans(b, off, NOSPACE)
    h = span_hashes(b, s, e)
    pair = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        two = (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(64 - bits)).astype(np.int64)
        ends = np.zeros(len(h), dtype=bool)
        ends[first[1:][np.diff(first) > 0] - 1] = True
        pair[:-1] = np.where(ends[:-1], -1, two)
    return (h >> np.uint64(64 - bits)).astype(np.int64), pair, first


def models(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> np.ndarray:
    """Log ratio of target to raw of each bucket. target: distinct ids, a bounded number."""
    spark = ready(docs.sparkSession)
    ids = {r[0] for r in target.collect()}
    sent = spark.sparkContext.broadcast(ids)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            data, off = utf8(batch.column(1))
            mine = np.fromiter((x in sent.value for x in batch.column(0).to_pylist()), bool, batch.num_rows)
            for i, j in blocks(off):
                one, two, first = _features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                good_word = np.repeat(mine[i:j], np.diff(first))
                for x in (one, two):
                    raw += np.bincount(x[x >= 0], minlength=size)
                    good += np.bincount(x[good_word & (x >= 0)], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    got = docs.select(id_col, text_col).mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()
    raw, good = np.ones(size), np.ones(size)
    for k, r, g in got:
        raw[k] += r
        good[k] += g
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, n_grams, log_weight, key of every row."""
    spark = ready(docs.sparkSession)
    sent, bits = spark.sparkContext.broadcast(ratio), int(np.log2(len(ratio)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            n, w = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j in blocks(off):
                one, two, first = _features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                v = sent.value[one] + np.where(two >= 0, sent.value[two], 0)
                words = np.diff(first)
                n[i:j], w[i:j] = words + np.maximum(words - 1, 0), run_sums(v, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(w), batch.column(2)], names=[id_col, "n_grams", "log_weight", "noise"])

    # 52 bits of a hash, never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.lit("\x1f"), text_col), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select(id_col, text_col, (-F.log(-F.log(u))).alias("noise"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"`{id_col}` {kind}, n_grams long, log_weight double, noise double")
    return out.select(id_col, "n_grams", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"))


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> tuple[float, int]:
    """The k-th largest value and how many are greater, by rounds of counting; keys: no nulls, at least k rows, k > 0."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / BINS
        if lo + width <= lo or hi - width >= hi:  # as fine as the numbers go: the distinct values left are few
            for v, n in sorted(((r[0], r[1]) for r in keys.where(F.col(column).between(lo, hi)).groupBy(column).count().collect()), reverse=True):
                if above + n >= k:
                    return v, above
                above += n
        place = F.least(F.lit(BINS - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("int"))
        got = keys.where(F.col(column).between(lo, hi)).groupBy(place.alias("place")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()
        for _, n, least, most in sorted(got, key=lambda r: -r[0]):
            if above + n >= k:
                lo, hi = least, most
                break
            above += n
    return lo, above


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, target_rows: int = TARGET_ROWS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """id_col, n_grams, log_weight, key, kept of every row."""
    good = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(target_rows)
    rows = table(weights(docs, models(docs, good, id_col, text_col, bits), id_col, text_col, seed), "weights")
    k = int(share * rows.count() + 0.5)
    if k == 0:
        return rows.withColumn("kept", F.lit(False))
    least, above = kth_largest(rows, k)
    # equal keys: repeated rows, few
    ties = rows.where(F.col("key") == F.lit(least))
    if above + ties.count() == k:
        return rows.withColumn("kept", F.col("key") >= F.lit(least))
    ties = ties.withColumn("kept", F.row_number().over(Window.partitionBy("key").orderBy(id_col)) <= k - above)
    return rows.where(F.col("key") != F.lit(least)).withColumn("kept", F.col("key") > F.lit(least)).unionByName(ties)


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept of every document."""
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
