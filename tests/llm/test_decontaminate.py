import hashlib
import random

import duckdb
import pytest

from rasterloom.llm.decontaminate import ORACLE_SQL, decontaminate, longest_matches, op1_benchmark_decontamination, overlaps, suffix_array

from .common import alnum_words, docs, edge_rows


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def brute(texts, benchmark, window):
    """(id, words, hit words, items) of each text, by comparing every window with every place."""
    out = []
    for i, t in texts:
        w, hit, names = alnum_words(t), set(), set()
        for name, text in benchmark:
            b = alnum_words(text)
            if not b:
                continue
            size = min(window, len(b))
            wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    names.add(name)
        out.append((i, len(w), sorted(hit), sorted(x for x in names if x is not None)))
    return out


def told(df):
    return [(r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], list(r["items"]), r.n_hit) for r in df.collect()]


@pytest.mark.parametrize("block_words", [7, 2_000_000])
def test_overlaps_match_brute_force(spark, block_words):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    texts = [(i, text(r.choice((0, 1, 3, 8, 30)))) for i in range(40)]
    benchmark = [(f"q{i}", text(r.choice((0, 1, 2, 4, 9)))) for i in range(8)] + [("q1", text(6)), (None, "a b c"), ("q9", None)]
    got = told(overlaps(docs(spark, texts).repartition(3), items(spark, benchmark), window=4, block_words=block_words))
    benchmark = [x for x in benchmark if x[1] is not None]
    want = {i: (n, hit, names) for i, n, hit, names in brute(texts, benchmark, 4)}
    assert {i: (n, hit, names) for i, n, hit, names, _ in got} == want
    assert all(n == len(hit) for _, _, hit, _, n in got)


def test_longest_matches_match_brute_force(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    texts = [(i, text(20)) for i in range(12)]
    benchmark = [(f"q{i}", text(7)) for i in range(5)] + [("z", "never here")]
    want = {}
    for name, t in benchmark:
        b = alnum_words(t)
        for k in range(len(b)):
            best = (0,)
            for i, d in texts:
                w = alnum_words(d)
                for p in range(len(w)):
                    n = next((x for x in range(len(b) - k) if p + x >= len(w) or w[p + x] != b[k + x]), len(b) - k)
                    if n > best[0] or n == best[0] and n and (i, p) < best[1:]:
                        best = (n, i, p)
            if best[0]:
                want[name, k] = best[0]
    got = longest_matches(docs(spark, texts).repartition(2), items(spark, benchmark), block_words=9).collect()
    assert {(r["item"], r.item_word): r.length for r in got} == want
    at = dict(texts)
    for g in got:  # the place holds the match
        b = alnum_words(dict(benchmark)[g["item"]])
        assert alnum_words(at[g.doc_id])[g.doc_word : g.doc_word + g.length] == b[g.item_word : g.item_word + g.length]


def test_suffix_array_orders_suffixes():
    import numpy as np

    r = np.random.default_rng(1)
    t = r.integers(0, 3, 200).astype(np.int32)
    sa = suffix_array(t, 400)
    assert sa.tolist() == sorted((k for k in range(200) if t[k]), key=lambda k: t[k:].tolist())


def test_edges(spark):
    passage = " ".join(f"w{k}" for k in range(25))
    rows = [*edge_rows(), (20, "before it " + passage.upper() + ", after"), (20, passage)]
    bench = items(spark, [("a", passage), ("b", "zz"), ("c", ""), ("d", None), (None, passage)])
    d = docs(spark, rows, extra=True)
    got = told(overlaps(d, bench))
    assert sorted((str(x[0]), x[1], x[2], x[3]) for x in got) == sorted((str(i), n, h, names) for i, n, h, names in brute(rows, [("a", passage), ("b", "zz")], 10))
    assert sum(r.n_hit == 25 and not r["items"] for r in overlaps(d, bench.where("item_id IS NULL")).collect()) == 2
    kept = decontaminate(d, bench)
    assert kept.schema == d.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i != 20)
    assert decontaminate(d, bench.where("false")).count() == len(rows)
    assert overlaps(d.where("false"), bench).count() == 0 and longest_matches(d.where("false"), bench).count() == 0
    assert hashlib.sha256(b"a").hexdigest() == [r for r in overlaps(d, bench).selectExpr("doc_id", "sha2(array_join(items, ','), 256) h").collect() if r.doc_id == 20][0].h


def longest_of(text, benchmark, window):
    """(length, place) of the longest match that holds a window, by all pairs of places."""
    w, best = alnum_words(text), (0, None)
    for _, t in benchmark:
        b = alnum_words(t)
        for p in range(len(w)):
            for k in range(len(b)):
                n = next((x for x in range(min(len(w) - p, len(b) - k)) if w[p + x] != b[k + x]), min(len(w) - p, len(b) - k))
                if n >= min(window, len(b)) and (n > best[0] or n == best[0] and p < best[1]):
                    best = (n, p)
    return best


@pytest.mark.parametrize("block_words", [7, 2_000_000])
def test_longest_match_of_each_document(spark, block_words):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    texts = [(i, text(r.choice((0, 2, 8, 40)))) for i in range(30)]
    benchmark = [(f"q{i}", text(r.choice((2, 5, 12)))) for i in range(6)]
    got = overlaps(docs(spark, texts).repartition(2), items(spark, benchmark), window=4, block_words=block_words).collect()
    assert {g.doc_id: (g.longest, g.longest_at) for g in got} == {i: longest_of(t, benchmark, 4) for i, t in texts}


def like(n, flip):
    """Words of two letters that sums of powers modulo 2^64 can't tell apart: bits of a sum of binary digits."""
    return "".join("ab"[bin(k).count("1") + flip & 1] for k in range(n))


@pytest.mark.parametrize("n", [8, 64, 128, 1024, 4096])
def test_words_are_told_apart_by_their_bytes(spark, n):
    rows = [(1, like(n, 0)), (2, like(n, 1))]
    got = overlaps(docs(spark, rows), items(spark, [("a", like(n, 0))]))
    assert sorted((g.doc_id, g.n_hit, list(g["items"])) for g in got.collect()) == [(1, 1, ["a"]), (2, 0, [])]


def test_query_matches_sql(spark, tmp_path):
    r = random.Random(12)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    rows = [*edge_rows()[:6], *((100 + k, text(r.choice((5, 60)))) for k in range(40))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, [("q1", text(30)), ("q2", text(12)), ("q3", "one"), (None, text(11)), ("q1", text(14)), ("q5", None), ("q6", "")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got, want = op1_benchmark_decontamination(spark, str(tmp_path)), con.sql(ORACLE_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
