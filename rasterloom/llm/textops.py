"""Byte-level text kernels in numpy: Arrow string columns in, word positions and 64-bit word hashes out.

Everything works on whole texts. A block is a run of documents of bounded total bytes (a longer document is a block of
its own), so memory follows the block and the longest document, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one block holds.
BLOCK = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a to z, all that isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

#: Word bytes of `[^\x20\x09-\x0D]+`.
NOSPACE = np.ones(256, dtype=bool)
NOSPACE[32] = False
NOSPACE[9:14] = False

#: Spans of more bytes are hashed whole by XXH64, shorter ones eight bytes at a time in numpy.
LANES = 128
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if off is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents [i, j) of at most limit bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words, and first[d]: index of document d's first word, n + 1 of them."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = word[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    cut = off[(off > 0) & (off < n)]
    start[cut] = w[cut]
    end[cut - 1] = w[cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; beyond the end zeros."""
    b = np.zeros(len(data) + 8, dtype=np.uint8)
    b[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", b, 0, (1,))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[s:e): equal bytes have equal hashes wherever they stand. Each step is a bijection of the state, so spans of one length up to 8 never share one; no rule of bytes makes others collide."""
    if not len(s):
        return np.zeros(0, np.uint64)
    lanes, n = _lanes(data), e - s
    h = mix(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mix_int(seed)))
    h = mix(h ^ lanes[s] & _KEEP[np.minimum(n, 8)])
    on, at = np.flatnonzero((n > 8) & (n <= LANES)), 8
    while len(on):
        h[on] = mix(h[on] * np.uint64(0xD6E8FEB86659FD93) ^ lanes[s[on] + at] & _KEEP[np.minimum(n[on] - at, 8)])
        at += 8
        on = on[n[on] > at]
    for k in np.flatnonzero(n > LANES).tolist():
        h[k] = xxhash.xxh64_intdigest(data[s[k] : e[k]].tobytes(), seed)
    return h


def same_spans(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[sa:sa + n) and b[sb:sb + n) hold the same bytes, pair by pair."""
    la, lb = _lanes(a), _lanes(b)
    out = (la[sa] ^ lb[sb]) & _KEEP[np.minimum(n, 8)] == 0
    on, at = np.flatnonzero(out & (n > 8) & (n <= LANES)), 8
    while len(on):
        out[on] = (la[sa[on] + at] ^ lb[sb[on] + at]) & _KEEP[np.minimum(n[on] - at, 8)] == 0
        at += 8
        on = on[out[on] & (n[on] > at)]
    for k in np.flatnonzero(out & (n > LANES)).tolist():
        out[k] = np.array_equal(a[sa[k] : sa[k] + n[k]], b[sb[k] : sb[k] + n[k]])
    return out


def numbered(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hashes, sorted; one span of each; number of each span's hash; seed): distinct spans by hashes under a seed that keeps all of them apart, which is made sure of byte by byte."""
    for seed in range(64):
        kinds, one, inv = np.unique(span_hashes(data, s, e, seed), return_index=True, return_inverse=True)
        rep = one[inv]
        if np.array_equal(e[rep] - s[rep], e - s) and same_spans(data, s, data, s[rep], e - s).all():
            return kinds, one, inv, seed
    raise RuntimeError("no seed tells the words apart")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x], dtype=np.uint64))[0])


def token_hash(text: bytes) -> int:
    """The hash of one word, as span_hashes() gives it."""
    a = np.frombuffer(text, dtype=np.uint8)
    return int(span_hashes(a, np.array([0]), np.array([len(a)]))[0])


def run_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]), zero for empty runs."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[first[1:]] - c[first[:-1]]


def char_offsets(data: np.ndarray) -> np.ndarray:
    """Code points that start before each byte position, len + 1 of them."""
    c = np.empty(len(data) + 1, dtype=np.int64)
    c[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c
