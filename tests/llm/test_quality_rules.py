import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import quality_rules as Q

from .common import docs, edge_rows, invented, words


def brute(t):
    t = t or ""
    w = words(t, fold=False)
    seen, repeat = set(), 0
    for x in t.split("\n"):
        if words(x, False):
            repeat += x in seen
            seen.add(x)
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    at = {k + d for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), repeat, len(at)


def sample():
    r = random.Random(3)
    rows = edge_rows()
    for k in range(200):
        t = invented(r, r.choice((20, 60, 200)), r.choice((5, 400)))
        rows.append((100 + k, t if k % 5 else t.replace(" ", "\n", 30).replace("a", "#", 9)))
    return [*rows, (90, "a b c a b c a b c " * 20), (91, "same line\nsame line\n \nsame line\n"), (92, "!" * 70), (93, "A B " * 100), (94, "é\x0bü\x1cö\x85z " * 30)]


def test_measures_match_brute_force(spark):
    got = Q.measures(docs(spark, sample(), extra=True).repartition(3)).collect()
    of = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted((str(r.doc_id), *of(r)) for r in got) == sorted((str(i), *brute(t)) for i, t in sample())


def test_query_matches_sql(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, t, r.choice(("en", "de", None)), r.choice(("web", "web", "web", "books", None)), 1) for i, t in sample()]
    spark.createDataFrame(rows, docs(spark, []).schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op7_adaptive_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(Q.ORACLE_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_base_failures_are_never_kept(spark):
    got = Q.judged(docs(spark, sample())).collect()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in got)


def test_thresholds_follow_their_group(spark):
    """The same text stays where its kind is usual and goes where it isn't."""
    r = random.Random(9)
    plain = [invented(r, 80) for _ in range(120)]
    marked = [invented(r, 80).replace(" ", " # ", 60) for _ in range(120)]
    rows = [(k, t, "en", "prose", 1) for k, t in enumerate(plain)] + [(1000 + k, t, "en", "code", 1) for k, t in enumerate(marked)] + [(5000, marked[0], "en", "prose", 1), (5001, marked[0], "en", "code", 1)]
    got = {x.doc_id: x.kept for x in Q.judged(spark.createDataFrame(rows, docs(spark, []).schema)).collect()}
    assert not got[5000] and got[5001] and sum(got[k] for k in range(120)) == 120


def test_spreads_decide_and_groups_judge_for_themselves(spark):
    """Where a ratio varies at all, a group's own spread sets its fence in most groups, and one fence for the whole corpus would judge otherwise."""
    r = random.Random(4)
    rows = []
    for g in range(20):
        size = r.choice((30, 400, 3000))
        for k in range(60):
            t = invented(r, r.choice((60, 120, 300)), size).split()
            for _ in range(r.randrange(1 + g % 5)):  # phrases again
                at = r.randrange(len(t) - 5)
                t += t[at : at + 4]
            t = [x.capitalize() if r.random() < 0.02 * (1 + g % 5) else x + "x" * (g % 4) for x in t]
            rows.append((g * 100 + k, " ".join(t), "en", f"s{g}", 1))
        # of the kind of another group
        t = " ".join(x + "x" * ((g + 2) % 4) for x in invented(r, 300).split())
        rows.append((g * 100 + 90, t, "en", f"s{g}", 1))
    d = spark.createDataFrame(rows, docs(spark, []).schema)
    own = Q.ratios(Q.measures(d))
    q = own.groupBy("source").agg(*[F.percentile_approx(x, [0.5, 0.9]).alias(x) for x in Q.UNIT]).collect()
    for x in ("word_length", "repeat_ratio", "upper_ratio"):
        assert sum(g[x][1] - g[x][0] > Q.UNIT[x] for g in q) > len(q) / 2, x
    mine = {x.doc_id: x.kept for x in Q.judged(d).collect()}
    one = {x.doc_id: x.kept for x in Q.judged(d.withColumn("source", F.lit("all"))).collect()}
    assert sum(mine[k] != one[k] for k in mine) >= 10
    fences = {tuple(round(v, 6) for v in f[2:]) for f in Q.fences(own).collect()}
    assert len(fences) == 20


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, None)]])
def test_small_tables(spark, rows):
    got = Q.judged(docs(spark, rows)).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got)


def test_no_python_in_the_plan(spark):
    plan = Q.judged(docs(spark, edge_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
