"""Shingle sets of texts as 64-bit hashes, and min-hash signatures, over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WIDTH = 5
#: Coordinates of a signature.
COORDINATES = 64
#: Bytes of text that are hashed at a time; a longer text is hashed by itself.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_IS_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
_random = np.random.Generator(np.random.PCG64(20_240_501))
_MULTIPLY = _random.integers(1, 1 << 63, COORDINATES, dtype=_U) * _U(2) + _U(1)
_ADD = _random.integers(0, 1 << 63, COORDINATES, dtype=_U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    up = down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            most = max(n, CHUNK_BYTES)
            cls.up, cls.down = _powers(_BASE, most), _powers(pow(_BASE, -1, 1 << 64), most)
        return cls.up[:n], cls.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _chunk_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of each text; offsets are relative to data."""
    n = len(data)
    if n == 0:
        yield from (np.empty(0, _U) for _ in offsets[1:])
        return
    up, down = _Powers.get(n)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * up, out=sums[1:])
    space = _IS_SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | border[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | border[1:])) + 1
    words = _mixed((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, offsets)
    window = np.zeros(max(0, len(words) - WIDTH + 1), _U)
    for k in range(WIDTH):
        window = window * _U(_STEP) + words[k : k + len(window)]
    window = _mixed(window)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            yield np.unique(window[a : b - WIDTH + 1])
        else:
            # A text of fewer words has one shingle of them all.
            few = _U(b - a)
            for k in range(a, b):
                few = few * _U(_STEP) + words[k]
            yield _mixed(np.array([few] if b > a else [], _U))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit hashes of each text's shingles; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    with np.errstate(over="ignore"):
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1)
            cut = offsets[begin : end + 1]
            yield from _chunk_sets(data[cut[0] : cut[-1]], cut - cut[0])
            begin = end


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES hash functions over a set that is not empty."""
    out = np.full(COORDINATES, 0xFFFFFFFF, _U)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 4096):
            values = (hashes[k : k + 4096] * _MULTIPLY[:, None] + _ADD[:, None]) >> _U(32)
            np.minimum(out, values.min(1), out=out)
    return out.astype(np.uint32)
