import math
import random

import numpy as np

from rasterloom.llm import resampling as R
from rasterloom.llm.textops import mix, token_hash

from .common import docs, edge_rows, invented, words


def buckets(text, bits):
    h = [token_hash(w.encode()) for w in words(text, fold=False)]
    pairs = [int(mix(np.array([a], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([b], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
    return [x >> (64 - bits) for x in (*h, *pairs)]


def labels(spark, good):
    return spark.createDataFrame([(i, q, 0) for i, q in good], "doc_id long, quality int, toxic int")


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = [*edge_rows(), *((100 + k, invented(r, 60, 200 + k)) for k in range(40))]
    marks = [(100 + k, k % 2) for k in range(30)] + [(None, 1), (5, None), (100, 1)]
    good = {i for i, q in marks if q == 1 and i is not None}
    raw, target = np.ones(1 << 14), np.ones(1 << 14)
    for i, t in rows:
        for b in buckets(t, 14):
            raw[b] += 1
            target[b] += i in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = R.resample(docs(spark, rows, extra=True).repartition(3), labels(spark, marks), share=0.5).collect()
    want = sorted((str(i), len(buckets(t, 14)), round(sum(ratio[b] for b in buckets(t, 14)), 6)) for i, t in rows)
    assert [x[:2] for x in sorted((str(g.doc_id), g.n_grams, g.log_weight) for g in got)] == [x[:2] for x in want]
    assert all(math.isclose(a[2], b[2], abs_tol=1e-4) for a, b in zip(sorted((str(g.doc_id), g.n_grams, g.log_weight) for g in got), want, strict=True))
    assert sum(g.kept for g in got) == (len(rows) + 1) // 2
    assert min(g.key for g in got if g.kept) >= max(g.key for g in got if not g.kept)


def test_noise_is_gumbel(spark):
    rows = [(k, f"same {k}") for k in range(4000)]
    w = R.weights(docs(spark, rows), np.zeros(1 << 14)).collect()
    keys = np.array([x.key for x in w])
    assert abs(keys.mean() - 0.5772) < 0.08 and abs(keys.std() - math.pi / math.sqrt(6)) < 0.08


def test_kth_largest_is_exact(spark):
    r = random.Random(2)
    v = [r.choice((r.gauss(0, 1), r.gauss(0, 1e-9), 3.0, 1e12)) for _ in range(3000)]
    d = spark.createDataFrame([(x,) for x in v], "key double")
    for k in (1, 7, 500, 1500, 3000):
        x, above = R.kth_largest(d, k)
        assert x == sorted(v, reverse=True)[k - 1] and above == sum(y > x for y in v)


def test_shares_and_empty(spark):
    d, none = docs(spark, edge_rows()), labels(spark, [])
    n = len(edge_rows())
    for share, want in ((0.0, 0), (1.0, n), (0.3, int(0.3 * n + 0.5))):
        assert sum(r.kept for r in R.resample(d, none, share=share).collect()) == want
    assert R.resample(d.where("false"), none).count() == 0
    same = docs(spark, [(1, "a b")] * 10)
    assert sum(r.kept for r in R.resample(same, none, share=0.5).collect()) == 5
