import random

import numpy as np
import pytest
import xxhash

from rasterloom.llm import simhash as S
from rasterloom.llm.components import components

from .common import docs, edge_rows, invented, words


def brute_fingerprint(text):
    w = words(text)
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    """Fingerprint: the least one that it reaches, by comparing all pairs."""
    f = np.array(sorted(set(fps)), dtype=np.uint64)
    root = list(range(len(f)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(x): int(f[find(i)]) for i, x in enumerate(f)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, set()).add(k)
    return {frozenset(x) for x in out.values()}


def test_blocks_miss_any_three_bytes():
    from itertools import combinations

    assert len(S.BLOCKS) == 14
    assert all(any(not set(b) & set(c) for b in S.BLOCKS) for c in combinations(range(8), 3))


@pytest.mark.parametrize("kind", ["random", "ball", "one_byte_row"])
def test_links_give_all_components(spark, kind):
    r = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    if kind == "random":
        fps = [r.getrandbits(64) for _ in range(300)]
        fps += [flip(r.choice(fps), r.randint(1, 4)) for _ in range(600)] + [0]
    elif kind == "ball":  # more than a list takes, at two levels
        base = r.getrandbits(64)
        fps = [flip(base, r.randint(0, 5)) for _ in range(1500)]
    else:  # the same four bytes throughout
        base = r.getrandbits(32) << 32
        fps = [base | r.getrandbits(32) & 0x00FF0FF3 for _ in range(1500)]
    nodes = spark.createDataFrame([(signed(x),) for x in set(fps)], "fp long")
    found = {x: x for x in set(fps)} | {row.node % (1 << 64): row.root % (1 << 64) for row in components(S.fingerprint_links(nodes)).collect()}
    assert groups(found) == groups(brute_roots(fps))


def test_lists_that_several_blocks_lead_to_hold_each_fingerprint_once(spark):
    paths = [m for one in S.sub_masks(0) for two in S.sub_masks(one) for m in S.sub_masks(two) if not m & 7]
    fps = {0, 7}
    for m in set(paths):  # all that is no link of 0 or 7 within the bits that the list leaves open
        bits = [k for k in range(64) if not m >> k & 1]
        inside = (sum(1 << b for k, b in enumerate(bits) if n >> k & 1) for n in range(256))
        fps |= {f for f in inside if f.bit_count() > 3 and (f ^ 7).bit_count() > 3}
    assert len(fps) == 1622 and len(paths) > len(set(paths))
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {x: x for x in fps} | {row.node % (1 << 64): row.root % (1 << 64) for row in components(S.fingerprint_links(nodes)).collect()}
    assert groups(found) == groups(brute_roots(fps))


def test_documents_match_brute_force(spark):
    r = random.Random(3)
    rows = edge_rows()
    base = [invented(r, 300) for _ in range(12)]
    for k, t in enumerate(base):
        rows += [(100 + 10 * k, t), (101 + 10 * k, t + " tail"), (102 + 10 * k, t.upper()), (103 + 10 * k, t.replace(" ", "\n", 3))]
    got = S.near_duplicates(docs(spark, rows, extra=True).repartition(3)).collect()
    fp = [brute_fingerprint(t) for _, t in rows]
    assert sorted((str(x.doc_id), x.fp % (1 << 64)) for x in got) == sorted((str(i), f) for (i, _), f in zip(rows, fp, strict=True))
    roots, least = brute_roots(fp), {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert all(x.component == least[roots[x.fp % (1 << 64)]] for x in got)
    kept = S.drop_near_duplicates(docs(spark, rows, extra=True))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(least.values())
    assert kept.columns == docs(spark, rows, extra=True).columns


def test_null_and_repeated_ids_leave_one_row_of_each_component(spark):
    r = random.Random(9)
    texts = [invented(r, 300) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[2])]
    rows += [(5, texts[3]), (5, texts[4]), (3, texts[4]), (6, texts[5]), (6, texts[6]), (6, texts[6]), (7, texts[7])]
    fps = [brute_fingerprint(t) for _, t in rows]
    assert len(set(brute_roots(fps).values())) == 8
    want = [(None, texts[0]), (None, texts[1]), (4, texts[2]), (5, texts[3]), (3, texts[4]), (6, texts[5]), (6, texts[6]), (7, texts[7])]
    for k in range(3):
        d = docs(spark, r.sample(rows, len(rows)), extra=True).repartition(k + 1)
        kept = S.drop_near_duplicates(d, sent=(0, 2, 1 << 19)[k])
        assert kept.columns == d.columns
        assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted((str(i), t) for i, t in want)


def test_only_null_ids_and_empty(spark):
    assert S.drop_near_duplicates(docs(spark, [(None, "a b c"), (None, "a b c")])).count() == 1
    assert S.near_duplicates(docs(spark, [])).count() == 0
    assert S.drop_near_duplicates(docs(spark, [])).count() == 0


def test_chain_of_links(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(500, 501), (501, 501), (500, 501)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert components(e.where("false")).count() == 0


def test_hubs_and_popular_fingerprints_are_split(spark, monkeypatch):
    from rasterloom.llm import components as C
    from rasterloom.llm import runtime, simhash

    split = lambda *a: runtime.split_join(*a, share=0.01, least=3)
    monkeypatch.setattr(C, "MANY", 1)
    monkeypatch.setattr(C, "split_join", split)
    monkeypatch.setattr(simhash, "split_join", split)
    star = [(k, 0) for k in range(1, 60)] + [(100, 101), (101, 102), (60, 59)]
    got = {r.node: r.root for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    r = random.Random(2)
    same = invented(r, 50)
    rows = [(k, same) for k in range(40)] + [(50 + k, invented(r, 60)) for k in range(5)]
    near = S.near_duplicates(docs(spark, rows))
    assert {x.doc_id: x.component for x in near.collect()} == {k: 0 if k < 40 else k for k, _ in rows}
    assert sorted(x.doc_id for x in S.drop_near_duplicates(docs(spark, rows)).collect()) == [0, *range(50, 55)]


def test_query_columns(spark, tmp_path):
    docs(spark, edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op9_simhash_near_dup(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert all(len(x.fingerprint) == 16 for x in got.collect()) and got.count() == len(edge_rows())
