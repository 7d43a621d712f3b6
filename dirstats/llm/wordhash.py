"""Words and word shingles of Arrow text columns as 64-bit hashes, computed array at a time.

A word is a run of bytes outside space and \\t..\\r, with A-Z lower-cased. Two different words
share a hash with a probability of 2^-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_ODD = _RNG.integers(1, 2**63, size=128, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_ODD[0])
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
#: Bytes hashed at a time; a single longer word is hashed whole.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up = base, np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            factors = np.full(n, self.base, dtype=np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
        return self.up


_UP, _DOWN = Powers(_BASE), Powers(_BASE_INVERSE)
_FIRST, _SECOND = Powers(int(_ODD[1])), Powers(int(_ODD[2]))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and where in them each text begins and ends; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin and end (one entry more than
    texts). A null text has none."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw, bounds = buffers(texts)
    begin, end = int(bounds[0]), int(bounds[-1])
    hashes, starts = [], []
    at = begin
    while at < end:
        stop = min(end, at + PIECE)
        while stop < end:  # a piece ends where a word ends
            gaps = np.flatnonzero(_SPACE[raw[stop : stop + PIECE]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop = min(end, stop + PIECE)
        part = raw[at:stop]
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop)] - at
        first[cuts[inside[cuts]]] = True  # texts follow each other without a gap
        s = np.flatnonzero(first)
        if len(s):
            last = inside.copy()
            last[:-1] &= ~inside[1:] | first[1:]
            e = np.flatnonzero(last) + 1
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * _UP.get(len(part))[: len(part)], out=sums[1:])
            h = (sums[e] - sums[s]) * _DOWN.get(len(part))[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * _ODD[3]))
            starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(where, bounds).astype(np.int64)


def sequences(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each text's word sequence, as two halves; 0, 0 without words."""
    counts = np.diff(bounds)
    out = [np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)]
    some = counts > 0
    if some.any():
        n = int(counts.max())
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)
        for k, powers in enumerate((_FIRST, _SECOND)):
            terms = mix(hashes + _ODD[4 + k]) * powers.get(n)[place]
            sums = np.add.reduceat(terms, bounds[:-1][some])
            out[k][some] = mix(sums + counts[some].astype(np.uint64) * _ODD[6 + k])
    return out[0], out[1]


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of size words; the whole sequence
    where there are fewer words; none without words."""
    counts = np.diff(bounds)
    many = max(0, len(hashes) - size + 1)
    runs = np.zeros(many, dtype=np.uint64)
    for k in range(size):
        runs += hashes[k : k + many] * _ODD[8 + k]
    runs = mix(runs)
    out = []
    for k, n in enumerate(counts.tolist()):
        b = int(bounds[k])
        if n >= size:
            out.append(np.unique(runs[b : b + n - size + 1]))
        elif n:
            short = (hashes[b : b + n] * _ODD[8 : 8 + n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + _ODD[64 + n % 64 : 65 + n % 64]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
