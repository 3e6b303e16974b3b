"""Vectorised word scanning and rolling hashes over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D. Blocks of whole texts of about
``target`` bytes are scanned at once, so that temporaries stay bounded whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTE_P, _WORD_P = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first k of eight bytes, in the order of memory.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(p: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n at least."""
    have = _powers.get(int(p))
    if have is None or len(have[0]) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        inv = U(pow(int(p), -1, 1 << 64))
        both = []
        for q in (p, inv):
            a = np.full(m, q, U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[int(p)] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "" if not pa.types.is_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    return data, off


@dataclass
class Words:
    """Words of the texts r0 <= row < r1. first[i]: index of the first word of text r0+i."""

    r0: int
    r1: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    h: np.ndarray
    text_offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _hash_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word, in pieces of about ``piece`` bytes cut between words. Eight
    bytes at a time are mixed with their place before they are summed, as sums of powers alone
    give some words of a regular build, such as Thue-Morse texts, the same hash."""
    out = np.empty(len(s), U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + piece, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        part = np.zeros(hi - lo + 8, np.uint8)
        part[: hi - lo] = data[lo:hi]
        lanes_at = np.ndarray(hi - lo + 1, "<u8", part, strides=(1,))
        size = e[i:j] - s[i:j]
        lanes = (size + 7) >> 3
        first = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        left = np.minimum(np.repeat(size, lanes) - 8 * place, 8)
        v = lanes_at[np.repeat(s[i:j] - lo, lanes) + 8 * place] & _LANE[left]
        out[i:j] = mix(np.add.reduceat(mix(v + place.astype(U) * _BYTE_P + U(1)), first) + size.astype(U))
        i = j
    return out


def words(arr: pa.Array, lower: bool = False, target: int = 1 << 20) -> Iterator[Words]:
    data, off = column(arr)
    n, r0 = len(off) - 1, 0
    while r0 < n:
        r1 = max(r0 + 1, int(np.searchsorted(off, off[r0] + target, "right")) - 1)
        part = data[off[r0] : off[r1]]
        if lower:
            part = _LOWER[part]
        cut = off[r0 : r1 + 1] - off[r0]
        sp = _SPACE[part]
        edge = np.empty(len(part) + 1, bool)  # between texts a word ends, too
        edge[1:-1] = sp[1:] != sp[:-1]
        edge[0] = edge[-1] = True
        edge[cut] = True
        b = np.flatnonzero(edge)
        s, e = b[:-1], b[1:]
        keep = ~sp[s] if len(s) else np.zeros(0, bool)
        s, e = s[keep], e[keep]
        yield Words(r0, r1, part, s, e, np.searchsorted(s, cut), _hash_words(part, s, e), cut)
        r0 = r1


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; the caller drops runs across texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    up, down = powers(_WORD_P, len(h))
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(h * up, out=acc[1:])
    return mix((acc[n:] - acc[:-n]) * down[:m] + U(n))


def run_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Mask over word indices: a run of n words of one text starts here."""
    total = int(first[-1])
    ok = np.zeros(max(0, total - n + 1), bool)
    c = np.diff(first)
    keep = c >= n
    if len(ok) and keep.any():
        d = np.zeros(total + 1, np.int32)
        d[first[:-1][keep]] += 1
        d[(first[1:] - n + 1)[keep]] -= 1
        ok = np.cumsum(d)[: len(ok)] > 0
    return ok


def word_rows(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
