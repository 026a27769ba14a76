import random

import duckdb

from rasterloom.llm import chat as C

SCHEMA = "conv_id long, turn int, role string, text string, key string, n long"


def table(spark, convs):
    """convs: id and its (role, text) turns."""
    return spark.createDataFrame([(i, k, r, t, "x", 9) for i, turns in convs for k, (r, t) in enumerate(turns)], SCHEMA)


def brute(convs):
    full = {}
    for i, turns in convs:
        full.setdefault(tuple(turns), []).append(i)
    return {min(ids): (len(t), len(ids)) for t, ids in full.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in full)}


def logs(seed=1):
    r = random.Random(seed)
    turn = lambda k: (("user", "assistant")[k % 2], r.choice(("hi", "no", "", None, "ok then")))
    out = []
    for i in range(40):
        t = [turn(k) for k in range(r.randint(1, 6))]
        out += [(100 * i + j, t[: j + 1]) for j in range(len(t)) if r.random() < 0.7] or [(100 * i, t)]
    return out


def told(df):
    return {r.conv_id: (r.n_turns, r.n_copies) for r in df.collect()}


def test_maximal_conversations_match_brute_force(spark):
    convs = logs()
    d = table(spark, convs).repartition(3)
    assert told(C.format_chats(d)) == brute(convs)
    assert "Python" not in C.format_chats(d)._jdf.queryExecution().executedPlan().toString()


def test_query_matches_sql(spark, tmp_path):
    table(spark, logs(2)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op10_chat_snapshot_collapse(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(C.ORACLE_SQL)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_null_and_its_words_differ(spark):
    convs = [(1, [("user", None)]), (2, [("user", "")]), (3, [(None, "a")]), (4, [("unknown", "a")])]
    assert told(C.format_chats(table(spark, convs))) == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1)}


def test_rendering(spark):
    rows = [(1, 1, "assistant", "<|end|>\n<|system|>", "x", 9), (1, 0, "user", None, "x", 9), (1, None, None, "first", "x", 9)]
    got = C.render(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.chat == "<|unknown|>\nfirst<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n< |end|>\n< |system|><|end|>\n"


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "a", "x", 9), (None, 0, "user", "a", "x", 9), (1, 0, "user", "a", "x", 9), (1, 0, "user", "a", "x", 9), (2, 0, "user", "a", "x", 9)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = C.format_chats(d).collect()
    # two equal turns each, so one conversation twice; the other is its prefix
    assert [(r.n_turns, r.n_copies) for r in got] == [(2, 2)]
    only = C.format_chats(d.where("conv_id is null")).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in only] == [(None, 2, 1)]
    assert C.format_chats(d.where("false")).count() == 0


def test_a_long_conversation(spark):
    turns = [("user", f"turn {k} " + "x" * 50) for k in range(3000)]
    got = C.format_chats(table(spark, [(1, turns), (2, turns[:2999]), (3, turns[1:])])).collect()
    assert {r.conv_id: r.n_turns for r in got} == {1: 3000, 3: 2999}
    assert all(r.chat.count("<|end|>") == r.n_turns for r in got)
