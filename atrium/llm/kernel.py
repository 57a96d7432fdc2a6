"""Vectorised text kernels that run inside Spark tasks.

Every function takes the UTF-8 bytes of a batch of documents (one buffer plus
offsets) and works on all of them at once with numpy, so a task's memory is a
small multiple of ``CHUNK_BYTES`` whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes stay under ``limit`` (one long document may exceed it)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), U64(base), dtype=U64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and leaves all other bytes."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of UTF-8 bytes as numbers, and the offsets of the documents in them."""
    first = (data & 0xC0) != 0x80
    at = np.flatnonzero(first)
    lead = data[at].astype(np.uint32)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    out = np.where(size == 1, lead, lead & (0xFF >> np.minimum(size + 1, 7)))
    for k in range(1, 4):
        more = size > k
        out[more] = (out[more] << 6) | (data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F)
    return out, np.concatenate((np.zeros(1, np.int64), np.cumsum(first)))[offsets]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by differences of one running sum."""
    cum = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_P, len(data)), out=cum[1:])
    raw = (cum[ends] - cum[starts]) * powers(_P_INV, len(data) + 1)[starts]
    return mix(raw ^ ((ends - starts).astype(U64) * U64(0xA24BAED4963EE407)))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None):
    """(starts, ends, first): byte spans of the words, and for each document its first word's index."""
    if is_word is None:
        is_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], is_word[:-1])) if len(data) else np.empty(0, bool)
    after = np.concatenate((is_word[1:], [False])) if len(data) else np.empty(0, bool)
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(word_hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and each one's document.

    A document with fewer than n words gives its whole word sequence as one
    shingle; one without words gives none.
    """
    total, counts = len(word_hashes), np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    if total >= n:
        h = word_hashes[: total - n + 1].copy()
        for k in range(1, n):
            h = mix(h * U64(0x9FB21C651E98DF25) + word_hashes[k : total - n + 1 + k])
        whole = doc[: total - n + 1] == doc[n - 1 :]
        h, d = h[whole], doc[: total - n + 1][whole]
    else:
        h, d = np.empty(0, U64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.empty(len(short), U64)
        for i, x in enumerate(short):
            v = word_hashes[first[x] : first[x + 1]]
            a = v[:1].copy()
            for k in range(1, len(v)):
                a = mix(a * U64(0x9FB21C651E98DF25) + v[k : k + 1])
            extra[i] = mix(a ^ U64(len(v)))[0]
        h, d = np.concatenate((h, extra)), np.concatenate((d, short))
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document, ordered by document: (hashes, bounds)."""
    data = fold_ascii(data)
    starts, ends, first = words(data, offsets)
    h, d = ngram_hashes(span_hashes(data, starts, ends), first, n)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(offsets)))
