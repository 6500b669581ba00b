"""Vectorised word shingles and HyperMinHash signatures over batches of texts (numpy only)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_PRIME, _GOLD = _U(0x9E3779B97F4A7C15 | 1), _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = _U(pow(int(_PRIME), -1, 1 << 64))
    up, down = np.full(n, _PRIME), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its 64-bit hash) for data, words being parted by ASCII white space.

    Polynomial hashes modulo 2**64 of all words at once, from one prefix sum.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(max(20, int(len(raw)).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of so many words, A-Z in lower case.

    A text with fewer words has its whole sequence as one shingle; one without words, none.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0
    for k, t in enumerate(raw):  # blocks bound the arrays' memory; a text is never split
        block.append(t)
        size += len(t) + 1
        if size >= 1 << 20 or k + 1 == len(raw):
            out += _block_sets(block, words)
            block, size = [], 0
    return out


def _block_sets(block: list[bytes], words: int) -> list[np.ndarray]:
    starts, hashes = word_hashes(b" ".join(block))
    bounds = np.cumsum([0, *(len(t) + 1 for t in block)])
    at = np.searchsorted(starts, bounds)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    if n >= words:
        m = n - words + 1
        acc = hashes[words - 1 :].copy()
        for j in range(words - 2, -1, -1):
            acc = mix(acc * _PRIME + hashes[j : j + m])
        rolled[:m] = acc
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)
            for h in hashes[lo:hi]:
                whole = mix(whole * _PRIME + h)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


class HyperMinHash:
    """HyperMinHash registers: one hash per element goes to one of m buckets; a bucket keeps its
    minimum as the count of leading zeros and the first mantissa bits after the leading one.

    Buckets that no element reaches take the register of another bucket, found by a fixed
    sequence of probes that all sets share, so that two sets agree in a register with the
    probability of their Jaccard similarity, however small they are.
    """

    def __init__(self, buckets: int = 128, mantissa: int = 10):
        self.buckets, self.mantissa = buckets, mantissa
        self.probes = mix(np.arange(buckets * 64, dtype=np.uint64) * _GOLD + _U(77)).reshape(64, buckets) % _U(buckets)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """uint16 per bucket: zeros << mantissa | mantissa bits. Needs at least one shingle."""
        h = mix(shingles + _GOLD)
        bucket = ((h >> _U(40)) * _U(self.buckets)) >> _U(24)
        low = np.full(self.buckets, _U(1 << 40))
        np.minimum.at(low, bucket.astype(np.int64), h & _U((1 << 40) - 1))
        filled = low < _U(1 << 40)
        zeros = 40 - np.frexp(np.where(filled, low, 0).astype(np.float64))[1]  # frexp's exponent is the bit length
        shift = 40 - 1 - self.mantissa - zeros
        part = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & _U((1 << self.mantissa) - 1)
        out = ((zeros.astype(np.uint64) << _U(self.mantissa)) | part).astype(np.uint16)
        for row in self.probes if not filled.all() else ():
            empty = np.flatnonzero(~filled)
            if not len(empty):
                return out
            source = row[empty].astype(np.int64)
            good = low[source] < _U(1 << 40)
            out[empty[good]] = out[source[good]]
            filled[empty[good]] = True
        if not filled.all():
            out[~filled] = out[np.flatnonzero(filled)[0]] if filled.any() else 0
        return out

    def collisions(self, n: int) -> float:
        """Chance that two different minima share a register, for sets of about n elements.

        A register of z leading zeros and mantissa v is one cell of width 2**-(z + 1 + mantissa);
        the minimum of k uniform hashes lies in the cell of its value x with chance k * width.
        """
        k = max(1.0, n / self.buckets)
        z = np.arange(0, 40)
        lo, hi = 0.5 ** (z + 1), 0.5**z
        within = np.exp(k * np.log1p(-lo)) - np.where(hi < 1, np.exp(k * np.log1p(-np.minimum(hi, 1 - 1e-15))), 0.0)
        return float(np.sum(within**2) / (1 << self.mantissa))

    def estimate(self, agree: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
        c = np.array([self.collisions(int(x)) for x in np.atleast_1d(n)])
        share = np.atleast_1d(agree) / self.buckets
        return np.clip((share - c) / (1 - c), 0.0, 1.0)
