"""Vectorised 64-bit hashes of words and windows. All are fixed functions of their input, equal in every task."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SLAB = 1 << 14
WORD_SLAB = 1 << 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits (the SplitMix64 finisher)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd pseudo-random multipliers."""
    steps = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    return mixed(steps) | U64(1)


_BYTES = constants(1000, 256)


def spans(data: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes: runs without ASCII white space, or without other ``breaks``."""
    word = np.concatenate(([False], ~breaks[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: sums of byte constants times place constants, then mixed; in slabs of bounded size."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place_constants = constants(2000, int(lengths.max()))
    out = np.empty(len(starts), U64)
    cuts = np.searchsorted(before, np.arange(0, before[-1] + 1, WORD_SLAB))
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        if a < b:
            part, first = lengths[a:b], before[a:b] - before[a]
            place = np.arange(int(part.sum())) - np.repeat(first, part)
            out[a:b] = np.add.reduceat(_BYTES[data[place + np.repeat(starts[a:b], part)]] * place_constants[place], first)
    return mixed(out + lengths.astype(U64))


def window_hashes(values: np.ndarray, size: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of ``size`` consecutive values from each place (or from the places ``at``)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.zeros(n if at is None else len(at), dtype=U64)
    for k, c in enumerate(constants(seed, size)):
        out += (values[k : k + n] if at is None else values[at + k]) * c
    return mixed(out)


def byte_windows(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive bytes from each place, built from halves of halves, in slabs that fit a cache."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.empty(n, U64)
    for at in range(0, n, SLAB):
        out[at : at + SLAB] = _byte_windows(data[at : at + SLAB + size - 1], size)
    return out


def _byte_windows(data: np.ndarray, size: int) -> np.ndarray:
    n = len(data) - size + 1
    base = int(constants(3000, 1)[0])
    power = lambda k: U64(pow(base, k, 1 << 64))
    whole, done, part, length = None, 0, _BYTES[data], 1
    while True:
        if size & length:
            tail = part[done : done + n]
            whole = tail.copy() if whole is None else whole * power(length) + tail
            done += length
        if done == size:
            return mixed(whole)
        part = part[:-length] * power(length) + part[length:]
        length *= 2


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` (minimum or maximum) over each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, length = values, 1
    while length * 2 <= width:
        out = best(out[:-length], out[length:])
        length *= 2
    rest = width - length
    return best(out[: len(out) - rest], out[rest:]) if rest else out
