import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterloom.llm import suffix_tree_lm as L

from .common import docs, edge_rows, invented, words


def byte_form(t, depth):
    return b"\n" * depth + " ".join(words(t)).encode() + b"\n"


class Brute:
    """The tree with one dictionary for each context."""

    def __init__(self, texts, depth, p_min, gain):
        self.depth, count = depth, defaultdict(Counter)
        for t in texts:
            b = byte_form(t, depth)
            for k in range(depth, len(b)):
                for d in range(depth + 1):
                    count[b[k - d : k]][b[k]] += 1
        total = sum(count[b""].values())
        self.count = {c: n for c, n in count.items() if not c or sum(n.values()) >= p_min * total}
        self.total, self.kinds = total, max(1, len(count[b""]))
        self.kept = {b""}
        for c, n in self.count.items():
            if c and total:
                m = sum(n.values())
                if m / total * sum(x / m * math.log(x / m / self.p(c[1:], y)) for y, x in n.items()) >= gain:
                    self.kept |= {c[k:] for k in range(len(c))}

    def p(self, ctx, byte):
        n = self.count[ctx] if ctx in self.count else Counter()
        m = sum(n.values())
        if not ctx:
            return (n[byte] + self.kinds / 256) / (m + self.kinds)
        return (n[byte] + L.PRIOR * len(n) * self.p(ctx[1:], byte)) / max(m + L.PRIOR * len(n), 1e-9) if m else self.p(ctx[1:], byte)

    def score(self, t):
        b, out = byte_form(t, self.depth), 0.0
        for k in range(self.depth, len(b)):
            state = next(b[k - d : k] for d in range(self.depth, -1, -1) if b[k - d : k] in self.kept)
            out += math.log10(self.p(state, b[k]))
        return out


def base(texts, t):
    c = Counter(w for x in texts for w in (*words(x), None))
    n, own = sum(c.values()), (*words(t), None)
    return len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in own)


@pytest.mark.parametrize(("p_min", "gain", "p_word"), [(0, 0, 0), (1e-3, 1e-4, 1e-2), (1e-2, 1e-3, 1)])
def test_scores_match_brute_force(spark, p_min, gain, p_word):
    r = random.Random(4)
    learn = [invented(r, n, 30) for n in (40, 10, 25, 1)] + ["", None, "Größe Größe ÄÖ", "a b\na\tb"]
    other = [*learn[:3], invented(r, 30, 50), "zzz 日本 unseen", "", None, "A B"]
    model, counts = L.train(docs(spark, list(enumerate(learn))).repartition(3), depth=3, p_min=p_min, gain=gain, p_word=p_word)
    got = {x.doc_id: x for x in L.score(docs(spark, list(enumerate(other)), extra=True), model, counts).collect()}
    want = Brute(learn, 3, p_min, gain)
    assert len(model.tree.child) == len(want.kept)
    for k, t in enumerate(other):
        n, known, b = base(learn, t)
        assert (got[k].n_tokens, got[k].n_known) == (n, known)
        assert math.isclose(got[k].base_score, b, rel_tol=1e-9) and math.isclose(got[k].score, want.score(t), rel_tol=1e-4, abs_tol=1e-4)


def test_distributions_sum_to_one(spark):
    model, _ = L.train(docs(spark, [(1, "the cat sat on the mat the end")]), depth=3)
    t = model.tree
    p = 10.0 ** t.logp.astype("float64")
    absent = 256 - (p.shape[1] - 1)
    assert abs(p[:, :-1].sum(1) + absent * p[:, -1] - 1).max() < 1e-4


@pytest.mark.parametrize("block_bytes", [1, 1 << 26])
def test_what_recurs_a_few_times_is_learned_however_large_the_corpus(spark, block_bytes):
    r = random.Random(2)
    rare = "aaq1 bbq2 xaq xaq"
    rows = [(k, " ".join(r.choice(("ba", "ab", "aab", "bba")) for _ in range(4000))) for k in range(90)] + [(100, rare), (101, rare), (102, rare), (103, rare)]
    assert 8 / sum(len(t) for _, t in rows) < 1e-5
    model, counts = L.train(docs(spark, rows), block_bytes=block_bytes)
    assert (len(model.tree.blocks) > 1) == (block_bytes == 1)
    assert (2, int.from_bytes(b"xa")) in model.tree.child
    want = Brute([t for _, t in rows], L.DEPTH, L.LEAST / sum(len(byte_form(t, 0)) for _, t in rows), L.EVIDENCE)
    want.kept = {c.to_bytes(d) for d, c in model.tree.child}
    got = L.score(docs(spark, [(1, rare), (2, "ab aab qzxq zz")]), model, counts).orderBy("doc_id").collect()
    assert all(math.isclose(g.score, want.score(t), rel_tol=1e-4) for g, t in zip(got, (rare, "ab aab qzxq zz"), strict=True))


def test_query(spark, tmp_path):
    rows = [*edge_rows(), *((100 + k, invented(random.Random(k), 50)) for k in range(30))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op8_suffix_tree_lm_scoring(spark, str(tmp_path)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    learn = [t for i, t in rows if not held(i)]
    want = sorted((str(i), held(i), *base(learn, t)[:2], sum(len(words(t)) + 1 for t in learn), round(base(learn, t)[2], 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_learning_helps(spark):
    r = random.Random(1)
    train = [(k, invented(r, 200, 60)) for k in range(60)]
    m, c = L.train(docs(spark, train))
    alike, noise = (x.score / 1000 for x in L.score(docs(spark, [(1, invented(r, 100, 60)), (2, "".join(r.choice("qwxyzjkv ") for _ in range(500)))]), m, c).orderBy("doc_id").collect())
    assert alike > noise


def sentences(r, n):
    """Text of a small grammar, so that longer contexts tell more."""
    names, verbs, ends = ("the harbour", "a lantern", "our neighbour", "the orchard", "every traveller"), ("watches over", "remembers", "belongs to", "walks towards"), ("the quiet river", "an old mountain", "the northern road", "a distant island")
    return ". ".join(" ".join((r.choice(names), r.choice(verbs), r.choice(ends))) for _ in range(n))


def test_each_depth_helps_on_held_out_text(spark):
    r = random.Random(6)
    train = docs(spark, [(k, sentences(r, 30)) for k in range(40)])
    other = docs(spark, [(k, sentences(r, 30)) for k in range(10)])
    total = []
    for depth in (2, 3, 4, 5, 6, 7):
        m, c = L.train(train, depth=depth)
        total.append(sum(x.score for x in L.score(other, m, c).collect()))
    assert all(b >= a for a, b in zip(total, total[1:], strict=False)) and total[4] > total[3] > total[2], total
    m, c = L.train(train, least=1e12)
    assert total[-1] > 0.35 * sum(x.score for x in L.score(other, m, c).collect())  # the tree of the root alone


def test_grams_summed_in_pieces_give_the_same_tree(spark):
    r = random.Random(3)
    d = docs(spark, [(k, invented(r, 60, 40)) for k in range(20)]).repartition(3)
    a, b = (L.train(d, shard_grams=n, evidence=2.0)[0].tree for n in (1 << 24, 40))
    assert sorted(a.child) == sorted(b.child) and len(a.child) > 50
    got = [[x.score for x in L.score(d, *L.train(d, shard_grams=n, evidence=2.0)).orderBy("doc_id").collect()] for n in (1 << 24, 40)]
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(*got, strict=True))


def test_pressed_grams_come_back():
    r = np.random.default_rng(1)
    code, count = np.sort(r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)), r.integers(1, 1 << 40, 1000)
    a, b = L.unpressed(L.pressed(code, count), 1000)
    assert np.array_equal(a, code) and np.array_equal(b, count)


def test_bytes_of_every_kind(spark):
    """Contexts and grams whose first byte sets the sign of their number."""
    rows = [(k, "日本語 ÿþ 語語 日本 ☃☃☃ ☃☃ \U0001f600\U0001f600 " * 3) for k in range(5)]
    m, c = L.train(docs(spark, rows), evidence=0.0)
    want = Brute([t for _, t in rows], L.DEPTH, L.LEAST / sum(len(byte_form(t, 0)) for _, t in rows), 0)
    got = L.score(docs(spark, [(1, rows[0][1]), (2, "☃ 日 ÿ")]), m, c).orderBy("doc_id").collect()
    assert all(math.isclose(g.score, want.score(t), rel_tol=1e-4) for g, t in zip(got, (rows[0][1], "☃ 日 ÿ"), strict=True))


def test_no_training_text(spark):
    m, c = L.train(docs(spark, []))
    got = L.score(docs(spark, [(1, "ab"), (2, None)]), m, c).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known) for r in got] == [(2, 0), (1, 0)]
    assert math.isclose(got[0].score, 3 * math.log10(1 / 256), rel_tol=1e-4) and got[0].base_score == 0
    assert L.score(docs(spark, []), m, c).count() == 0
