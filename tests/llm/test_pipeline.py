import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rasterloom.llm import registry

from .common import docs, edge_rows, invented
from .test_decontaminate import brute as brute_overlaps
from .test_packing import best_fit, ids_of
from .test_personal_data import brute as brute_personal
from .test_simhash import brute_fingerprint, brute_roots

BAD = ("grumbaltz", "snorvik", "plurdge", "wexhole")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and what was planted."""
    r, top = random.Random(12), tmp_path_factory.mktemp("world")
    passage = invented(r, 30, 90)
    rows, labels = edge_rows(), []
    for k in range(300):
        w = invented(r, r.choice((30, 60, 150))).split()
        if k % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((1000 + k, " ".join(w)))
        labels.append((1000 + k, 1, int(k % 3 == 0)))
    clean = dict(rows)[1001]
    rows += [(2000, clean), (2001, clean + " end"), (2002, f"{clean[:100]} {passage} {clean[-200:]}"), (2003, clean[::-1] + " write to ann@ex.org"), (2004, clean[::-1][:300] + " grumbaltz snorvik plurdge wexhole")]
    docs(spark, rows, extra=True).repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([("q1", passage), ("q2", None)], "item_id string, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), passage


@pytest.fixture(scope="module")
def stages(spark, world):
    """What each stage was given and gave."""
    d, out = spark.read.parquet(f"{world[0]}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, d, world[0])
        got.write.parquet(f"{world[0]}/out{k}")
        got = spark.read.parquet(f"{world[0]}/out{k}")
        out[name] = (d, got)
        d = got
    return out


def pairs(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = stages["toxicity"]
    kept = {r.doc_id for r in after.collect()}
    toxic = {r.doc_id for r in before.collect() if r.text and any(b in r.text for b in BAD)}
    clean = {r.doc_id for r in before.collect()} - toxic
    assert len(toxic & kept) <= 0.05 * len(toxic) and len(clean - kept) <= 0.05 * len(clean)


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = stages["simhash_near_dup"]
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in before.collect()]
    roots, least = brute_roots([f for _, f in rows]), {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())
    assert 2000 not in least.values()


def test_benchmark_passages_go(stages, world):
    before, after = stages["benchmark_decontamination"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    hit = {i for i, _, h, _ in brute_overlaps(rows, [("q1", world[1])], 10) if h}
    assert hit == {2002} and sorted(r.doc_id for r in after.collect()) == sorted(i for i, _ in rows if i not in hit)


def test_personal_data_is_replaced(stages):
    before, after = stages["personal_data"]
    was, now = dict(pairs(before)), dict(pairs(after))
    assert was.keys() == now.keys() and now["2003"].endswith("write to [EMAIL]")
    for i, t in was.items():
        assert not brute_personal(now[i]) or t == now[i] and not brute_personal(t)
        assert any(c in t for c in "0123456789@") or t == now[i]


def test_everything_left_is_packed(stages):
    before, after = stages["best_fit_packing"]
    got = after.collect()
    want = sorted(n for _, t in pairs(before) for x in [len(ids_of(t))] for n in [4096] * (x // 4096) + [x % 4096] * (x % 4096 > 0))
    assert sorted(r.length for r in got) == want and len({r.sequence_id for r in got}) <= best_fit(want, 4096)


def test_run_does_all_stages(spark, world, stages):
    got = corpus_pipeline.run(spark, world[0])
    want = stages["best_fit_packing"][1]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, map(tuple, want.select(cols).collect())))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, world, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs(spark, [], extra=True), world[0])
    assert got.count() == 0 and (k == 4 or got.columns == docs(spark, [], extra=True).columns)


def test_registry():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_on_generated_tables(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = registry.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
