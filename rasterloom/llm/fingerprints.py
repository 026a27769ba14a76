"""SimHash fingerprints: XXH64 of word shingles, majority vote per bit."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

from .textops import LOWER, NOSPACE, blocks, word_spans


def _hash_runs(b: np.ndarray, off: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of each document of a block, and first[d]: where document d's begin."""
    s, e, first = word_spans(b, off, NOSPACE)
    keep = NOSPACE[b]
    # of white space, the byte after a word stays, as the one space between words
    space = ~keep
    space[1:] &= keep[:-1]
    if len(space):
        space[0] = False
    norm = np.where(keep, b, np.uint8(32))[keep | space]
    place = np.concatenate([[0], np.cumsum(keep | space)])
    s, e = place[s], place[e]
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n_shingles)])
    # the k-th shingle of d starts at its k-th word and ends size - 1 words later, or at its last word
    local = np.arange(at[-1]) - np.repeat(at[:-1], n_shingles)
    w = np.repeat(first[:-1], n_shingles) + local
    last = np.minimum(w + size - 1, np.repeat(first[1:] - 1, n_shingles))
    buf, xx = norm.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter(map(xx, [buf[i:j] for i, j in zip(s[w].tolist(), e[last].tolist(), strict=True)], repeat(seed)), np.uint64, len(w))
    return h, at


def simhash(data: np.ndarray, off: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint a document; zero if it has no words."""
    out = np.zeros(len(off) - 1, dtype=np.uint64)
    for i, j in blocks(off):
        h, at = _hash_runs(LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], size, seed)
        n = np.diff(at)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        votes = np.zeros((len(full), 64), dtype=np.int64)
        step = 1 << 18
        edges = np.append(at[full], at[-1])
        for a in range(0, len(h), step):  # bounded: 64 bytes a shingle
            z = min(a + step, len(h))
            bits = np.unpackbits(h[a:z].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo, hi = np.searchsorted(edges, a, side="right") - 1, np.searchsorted(edges, z, side="left")
            cuts = np.maximum(edges[lo:hi], a) - a
            votes[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        bits = (2 * votes > n[full][:, None]).astype(np.uint8)
        out[i + full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out
