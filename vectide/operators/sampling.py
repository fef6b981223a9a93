"""Seeded random numbers for fixtures and models that must come out the same everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Multiplier and increment of the 64-bit linear congruential generator that fixtures use.
LCG = (2862933555777941757, 3037000493)


class Lcg:
    """A linear congruential generator; a float is the upper 53 bits of a state."""

    def __init__(self, seed: int):
        self.state = seed % 2**64

    def next(self) -> int:
        self.state = (self.state * LCG[0] + LCG[1]) % 2**64
        return self.state

    def jump(self, n: int) -> Lcg:
        """Where n further steps lead, in time of the logarithm of n; a worker takes its own stretch of one sequence."""
        a, b, times, plus = 1, 0, *LCG
        while n:
            if n & 1:
                a, b = a * times % 2**64, (b * times + plus) % 2**64
            times, plus = times * times % 2**64, (plus * times + plus) % 2**64
            n >>= 1
        out = Lcg(0)
        out.state = (self.state * a + b) % 2**64
        return out

    def unit(self) -> float:
        return (self.next() >> 11) / 2.0**53

    def vectors(self, n: int, d: int) -> np.ndarray:
        """Unit vectors of 32-bit floats."""
        x = np.array([self.unit() * 2 - 1 for _ in range(n * d)], np.float32).reshape(n, d)
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def split_seed(seed: int, n: int) -> list[int]:
    """Independent seeds for n workers."""
    return [int(s.generate_state(1, np.uint64)[0]) for s in np.random.SeedSequence(seed).spawn(n)]


def bounded_sample(df: DataFrame, most: int, seed: int, key: str = "id") -> DataFrame:
    """At most ``most`` rows: those with the smallest seeded hash of the key, whatever the layout.

    Rows over a hash limit that leaves about twice as many are dropped where they stand, so that no
    task sends more than its share on.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    n = df.count()
    if n > 4 * most and most >= 1000:
        df = df.where(hashed < F.lit(int(-(2**63) + 2**64 * (2 * most / n))))
    return df.orderBy(hashed, key).limit(most)


def permutation(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """``(key, position)``: a seeded permutation of the rows, positions gapless from 0, whatever the layout: by the MD5 of seed and key."""
    from vectide.operators.ids import assign_ids

    keyed = df.select(F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("hash"), F.col(key).alias("key")).alias("external_id"))
    return assign_ids(keyed, check=False).select(F.col("external_id.key").alias(key), F.col("internal_id").alias("position"))


def weighted_pick(weights: np.ndarray, rng: np.random.Generator) -> int:
    total = float(weights.sum())
    if total <= 0:
        return int(rng.integers(len(weights)))
    return int(min(np.searchsorted(np.cumsum(weights), rng.random() * total, side="right"), len(weights) - 1))


def gaussians(rng: np.random.Generator, n: int) -> np.ndarray:
    """Box-Muller pairs."""
    u, v = 1.0 - rng.random((n + 1) // 2), rng.random((n + 1) // 2)
    r = np.sqrt(-2 * np.log(u))
    return np.concatenate([r * np.cos(2 * np.pi * v), r * np.sin(2 * np.pi * v)])[:n]
