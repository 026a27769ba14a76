import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm.packing import Words, op3_best_fit_packing, pack, plan, sequences

from .common import docs, edge_rows, invented

TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*TOKENS.encode(text or "", add_special_tokens=False).ids, 1]


def best_fit(lengths, size):
    """Bins that best-fit decreasing over single pieces takes."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, x in enumerate(room) if x >= n]
        if fit:
            k = min(fit, key=lambda k: room[k])
            room[k] -= n
        else:
            room.append(size - n)
    return len(room)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_fills_bins_without_gaps(histogram):
    bins = {}
    for length, lo, hi, first, each, offset in plan(histogram, 40):
        for k in range(hi - lo):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    placed = sorted((n for b in bins.values() for _, n in b))
    assert placed == sorted(n for n, c in histogram.items() for _ in range(c))
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 40


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=8))
@settings(max_examples=100, deadline=None)
def test_plan_needs_no_more_bins_than_best_fit_decreasing(histogram):
    want = best_fit((n for n, c in histogram.items() for _ in range(c)), 30)
    used = {first + k // each for _, lo, hi, first, each, _ in plan(histogram, 30) for k in range(hi - lo)}
    assert len(used) <= want


@pytest.mark.parametrize("seed", [1, 2])
def test_word_ids_are_the_tokenizers(seed):
    r = random.Random(seed)
    marks = ["don't", "it's.", "a.b", "x,", "1999.", "3,4", "straße.", "Ünder", "äb", "日本語", "\U0001f600ok", "<|endoftext|>", "x<|startoftext|>y", "...", "a..", "##", "é,", "ǆ", "İ", "ﬁne", " z", "tail x", "​q", "&amp;", "'s", "we'll", "\x00", "O'Neil."]
    texts = ["".join(r.choice((*marks, "the", "word", "and")) + r.choice((" ", "\n", "  ", "\t")) for _ in range(60)) for _ in range(20)] + ["", " ", "ABC Def."]
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    ids, begin = Words(public_tokenizers.path("word_bpe_49k.json")).encode(np.frombuffer(b"".join(data), np.uint8), off)
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == ids_of(t), t


def test_pack_is_an_exact_round_trip(spark):
    rows = [*edge_rows(), *((100 + k, invented(random.Random(k), 40 + k * 29 % 300)) for k in range(60))]
    d = docs(spark, rows, extra=True).repartition(5)
    got = pack(d, size=256, with_ids=True).collect()
    want = []
    for i, t in rows:
        x = ids_of(t)
        want += [(str(i), k, 256 * k, x[256 * k : 256 * k + 256]) for k in range(-(-len(x) // 256))]
    assert sorted((str(r.doc_id), r.piece, r.start, list(r.ids)) for r in got) == sorted(want)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [a for a, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() and sum(n for _, n in b) <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= best_fit((r.length for r in got), 256)
    s = {r.sequence_id: list(r.ids) for r in sequences(d, size=256).collect()}
    assert len(s) == len(bins) and sum(map(len, s.values())) == total and max(map(len, s.values())) <= 256


def test_empty_table(spark):
    assert pack(docs(spark, [])).count() == 0
    one = pack(docs(spark, [(1, None)])).collect()
    assert [(r.piece, r.length, r.sequence_id, r.offset) for r in one] == [(0, 1, 0, 0)]


@pytest.mark.parametrize("n", [8, 64, 1024])
def test_words_are_told_apart_by_their_bytes(n):
    """Words of two letters that sums of powers modulo 2^64 can't tell apart."""
    texts = ["".join("ab"[bin(k).count("1") + flip & 1] for k in range(n)) for flip in (0, 1)]
    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    for order in ((0, 1), (1, 0)):
        data = [texts[k].encode() for k in order]
        ids, begin = words.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, n, n]))
        assert [ids[begin[i] : begin[i + 1]].tolist() for i in (0, 1)] == [ids_of(texts[k]) for k in order]


def test_a_hash_that_stands_for_another_word_is_noticed():
    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    data = np.frombuffer(b"alpha beta", np.uint8)
    words.encode(data, np.array([0, 10]))
    words.text[:5] = np.frombuffer(b"gamma", np.uint8)  # as if another word had had the hash before
    words.text[-5:] = np.frombuffer(b"delta", np.uint8)
    ids, _ = words.encode(data, np.array([0, 10]))
    assert ids.tolist() == ids_of("alpha beta")


def test_query_columns(spark, tmp_path):
    docs(spark, edge_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_best_fit_packing(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
