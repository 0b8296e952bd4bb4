"""Hashes of words and of runs of words, over Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import words

STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words, and a 64-bit hash of each word."""
    texts = pc.fill_null(texts, "")
    ends, index, distinct = words(pc.ascii_lower(texts) if lower else texts)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    return ends, own[index]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each position a hash of the k hashes from there on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= STEP
            out += hashes[j : j + n]
        return mixed(out)
    back = pow(int(STEP), -1, 1 << 64)
    up, down = powers(int(STEP), len(hashes)), powers(back, n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
    return mixed((sums[k:] - sums[:n]) * down)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        got = np.multiply.accumulate(factors)
        if n <= 4 << 20:
            _powers[base] = got
    return got[:n]


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z in lower case. With fewer than k words, the
    whole sequence is its one shingle; without words there is none."""
    ends, hashes = word_hashes(texts, lower=True)
    all_runs = runs(hashes, k)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            own = np.sort(all_runs[a : b - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
