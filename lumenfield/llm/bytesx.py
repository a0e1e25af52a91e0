"""Array kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = U(0x2545F4914F6CDD1D)
_BACK = U(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_STEP, _BACK))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) for runs of whole texts of about size bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, which a text's end also ends."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], mask])[:-1] if len(mask) else mask
    start = mask & (~before | edge[:-1])
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    end = mask & (~after | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, the same wherever it stands."""
    ahead, back = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * ahead[: len(buf)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash, never 0, of each k-byte string; k of 1 at least."""
    out, have, part, width, shift = None, 0, _VALUES[buf], 1, 1
    base = int(_STEP)
    while shift <= k:
        if k & shift:
            if out is None:
                out, have = part, width
            else:  # out covers the first bytes, part the next ones
                n = len(buf) - have - width + 1
                out = out[: max(n, 0)] * U(pow(base, width, 1 << 64)) + part[have : have + max(n, 0)]
                have += width
        shift <<= 1
        if shift <= k:
            n = max(len(part) - width, 0)
            part = part[:n] * U(pow(base, width, 1 << 64)) + part[width : width + n]
            width *= 2
    return mixed(out) | U(1)


def sliding(f: np.ufunc, a: np.ndarray, w: int) -> np.ndarray:
    """f over each w values in a row, by doubling."""
    if len(a) < w:
        return a[:0]
    have, out = 1, a
    while have * 2 <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(a) - w + 1], out[w - have : w - have + len(a) - w + 1])
