import math
import random
import zlib

import numpy as np
import pytest

from rasterloom.llm import toxicity as T

from .common import docs, edge_rows, invented

BAD = ("grumbaltz", "snorvik", "plurdge", "wexhole")


def world(n=240, seed=2):
    """(rows, labels): a toxic text has a slur, perhaps bent, somewhere in ordinary words."""
    r = random.Random(seed)
    rows, labels = [], {}
    for i in range(n):
        w = invented(r, r.choice((15, 40, 200))).split()
        if i % 3 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(("", "s", "ing", "!")))
        rows.append((i, " ".join(w)))
        labels[i] = int(i % 3 == 0)
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = world()
    return T.train(docs(spark, rows), table(spark, labels))


def test_held_out_accuracy(spark, model):
    rows, labels = world()
    got = {r.doc_id: r for r in T.score(docs(spark, rows), model).withColumn("held_out", T.held_out()).collect()}
    held = [i for i in got if got[i].held_out]
    assert len(held) > 20
    right = sum((got[i].score >= 0.5) == labels[i] for i in held)
    assert right >= 0.95 * len(held)


def test_held_out_labels_are_not_learned(spark, model):
    rows, labels = world()
    held = {r.doc_id for r in docs(spark, rows).where(T.held_out()).collect()}
    turned = {i: 1 - y if i in held else y for i, y in labels.items()}
    other = T.train(docs(spark, rows), table(spark, turned))
    assert np.array_equal(other.leanings.grams, model.leanings.grams) and np.array_equal(other.network.p["w"], model.network.p["w"]) and other.shift == model.shift


def test_a_long_text_is_read_to_its_end(spark, model):
    long = invented(random.Random(8), 30_000)
    a, b = (r.score for r in T.score(docs(spark, [(1, long), (2, long + " grumbaltz snorvik plurdge wexhole")]), model).orderBy("doc_id").collect())
    assert a < 0.5 <= b


def test_windows_cover_every_word():
    n = np.array([0, 1, 31, 32, 33, 48, 49, 200])
    place, first, own = T.windows(n, np.concatenate([[0], np.cumsum(n)[:-1]]))
    assert set(place[place >= 0]) == set(range(n.sum())) and len(first) == len(n) and set(own) == set(range(len(n)))


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = T.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, on = r.normal(size=(5, 3, T.N_IN)), np.ones((5, 3, 1), bool)
    on[3:, 1] = False
    y, w = np.array([0.0, 1, 1]), np.ones(3)
    g, dx = net.gradients(x, on, y, w)

    def loss():
        z = net.forward({d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}, on).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for name in ("Wf", "Ub", "cf", "a", "w"):
        flat, k = net.p[name].reshape(-1), 3
        was = flat[k]
        flat[k] = was + 1e-2
        up = loss()
        flat[k] = was - 1e-2
        down = loss()
        flat[k] = was
        assert abs((up - down) / 2e-2 - g[name].reshape(-1)[k]) < 2e-3, name


def plain_score(model, text):
    """The score of a text by loops over windows, words and units, in plain numbers."""
    data = T.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    inv, first, flat, begin, kinds = T._types(data, np.array([0, len(data)]))
    p, net, logits = {k: v.astype(float) for k, v in model.network.p.items()}, T.HIDDEN, []
    x = model.leanings.inputs(flat, begin, kinds)
    words, heads = T._learned_keys(flat, begin, kinds)
    vectors = [[*x[k], *p["words"][words[k]], *p["heads"][heads[k]]] for k in inv]
    sig = lambda v: 1 / (1 + math.exp(-v))
    for start in range(0, max(len(vectors) - T.WINDOW, 0) + T.STRIDE, T.STRIDE) if vectors else [0]:
        win = vectors[start : start + T.WINDOW]
        if start and start + T.WINDOW - T.STRIDE >= len(vectors):
            break
        states = [[] for _ in win]
        for d in "fb":
            h = [0.0] * net
            for t in range(len(win)) if d == "f" else reversed(range(len(win))):
                g = [sum(a * w for a, w in zip(win[t], p[f"W{d}"][:, j], strict=True)) + p[f"c{d}"][j] for j in range(3 * net)]
                v = [sum(a * w for a, w in zip(h, p[f"U{d}"][:, j], strict=True)) for j in range(3 * net)]
                new = []
                for j in range(net):
                    z, r = sig(g[j] + v[j]), sig(g[net + j] + v[net + j])
                    m = math.tanh(g[2 * net + j] + r * v[2 * net + j])
                    new.append(m + z * (h[j] - m))
                h = new
                states[t] += h
        e = [math.exp(sum(a * w for a, w in zip(s, p["a"], strict=True))) for s in states]
        pooled = [sum(w * s[j] for w, s in zip(e, states, strict=True)) / sum(e) for j in range(2 * net)] if e else [0.0] * 2 * net
        logits.append(sum(a * w for a, w in zip(pooled, p["w"], strict=True)) + p["b"][0])
    return sig(max(logits) + model.shift)


def test_scores_match_plain_loops(spark, model):
    r = random.Random(5)
    texts = ["", None, "one", *(invented(r, n) for n in (5, 31, 32, 33, 48, 49, 100)), invented(r, 40) + " snorviks " + invented(r, 40)]
    got = {x.doc_id: x.score for x in T.score(docs(spark, list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - plain_score(model, t)) < 1e-5, t


def test_repeated_ids_give_the_same_model(spark):
    rows, labels = world(90)
    rows = rows + [(i, t + " x") for i, t in rows for _ in range(5)]
    a, b = (T.train(docs(spark, d).repartition(n), table(spark, labels), per_label=20) for d, n in ((rows, 2), (rows[::-1], 5)))
    assert np.array_equal(a.network.p["w"], b.network.p["w"]) and a.shift == b.shift


def test_query(spark, tmp_path):
    rows, labels = world(120)
    docs(spark, [*rows, *edge_rows()[:6]]).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op4_toxicity(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got.collect())


def test_edges(spark, model):
    d = docs(spark, edge_rows(), extra=True)
    got = T.score(d, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in edge_rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert all(abs(a.score - b.score) < 1e-6 for s in ((1, 2, 3), (5, 6)) for a in got for b in got if a.doc_id in s and b.doc_id in s)
    kept = T.drop_toxic(d, model)
    assert kept.schema == d.schema and 0 < kept.count() <= len(edge_rows())
    assert T.score(d.where("false"), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(4, 1, None), (None, 1, 1), (5, 1, 1), (5, 1, 0)]])
def test_few_labels(spark, labels):
    d = docs(spark, edge_rows())
    m = T.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len({r.score for r in T.score(d, m).collect()}) == 1
