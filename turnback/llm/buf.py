"""Vectorised views of Arrow string columns: words, lines and their 64-bit hashes without Python objects.

A word is a run of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = ~_SPACE
_rng = np.random.Generator(np.random.PCG64(20240229))
_MIX = _rng.integers(0, 2**64, 256, dtype=U64) | U64(1)
_LOWER = _MIX.copy()
_LOWER[65:91] = _MIX[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 2**64)
_pows: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n, kept between calls."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, U64(base % 2**64))
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _pows[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) from 64-bit hashes."""
    return (mix(x) >> U64(11)).astype(np.float64) * 2.0**-53


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset in them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = pc.fill_null(col, "" if "string" in str(col.type) else b"")
    _, at, data = col.buffers()
    off = np.frombuffer(at, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = (2 << 20) - 64) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of text (a longer text stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = flat(b.column(text))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
            yield b.slice(a, z - a)
            a = z


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row, and each row's offset among the runs."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; with ``lower``, A-Z count as a-z."""
    with np.errstate(over="ignore"):
        cs = np.zeros(len(buf) + 1, U64)
        np.cumsum((_LOWER if lower else _MIX)[buf] * powers(_P, len(buf)), out=cs[1:])
        h = (cs[ends] - cs[starts]) * powers(_INV, len(buf) + 1)[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buf, starts, ends, row offsets among the words, word hashes."""
    buf, off = flat(col)
    starts, ends, woff = spans(WORD[buf], off)
    return buf, starts, ends, woff, span_hash(buf, starts, ends, lower)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive elements of ``h`` (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        cs = np.zeros(len(h) + 1, U64)
        np.cumsum(h * powers(_P, len(h)), out=cs[1:])
        return mix((cs[k:] - cs[:-k]) * powers(_INV, len(h) + 1)[: len(h) - k + 1])


def row_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row, empty rows included."""
    cs = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=cs[1:])
    return cs[off[1:]] - cs[off[:-1]]


def row_of(off: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
