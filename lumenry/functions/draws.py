"""Seeded draws by random access: draw ``n`` of a seed needs none of the draws before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_mix(seed: int | np.ndarray, n: np.ndarray) -> np.ndarray:
    """Draws ``n`` (from 0) of the SplitMix64 sequence, as uint64; each of its own seed where ``seed`` is an array."""
    with np.errstate(over="ignore"):
        z = (seed.astype(np.uint64) if isinstance(seed, np.ndarray) else np.uint64(seed % 2**64)) + (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def seed_column(seed: int | Column) -> Column:
    """A seed as a long; those from 2**63 on as the negative number of the same bits."""
    return seed.cast("long") if isinstance(seed, Column) else F.lit((seed + 2**63) % 2**64 - 2**63).cast("long")


def below(seed: int | Column, n: Column, bound: int) -> Column:
    """Draw ``n`` of ``seed``, modulo ``bound``."""

    @F.pandas_udf("long")
    def drawn(seed: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series((split_mix(seed.to_numpy(), n.to_numpy()) % np.uint64(bound)).astype(np.int64))

    return drawn(seed_column(seed), n)


class Draws:
    """Draws one after another, for the few that shape an effect."""

    def __init__(self, seed: int) -> None:
        self.seed, self.n = seed, 0

    def below(self, bound: int) -> int:
        if bound == 0:
            return 0
        value = int(split_mix(self.seed, np.array([self.n]))[0]) % bound
        self.n += 1
        return value

    def between(self, low: int, high: int) -> int:
        low, high = min(low, high), max(low, high)
        return low + self.below(high - low + 1)

    def around(self, extent: int) -> int:
        return self.below(2 * extent + 1) - extent


def value_noise(seed: int | Column, width: int, height: int, u: Column, v: Column) -> Column:
    """Smooth noise from 0 to 1 over a lattice of draws that repeats beyond its edges."""

    @F.pandas_udf("double")
    def noise(seed: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        seed, u, v = seed.to_numpy(), u.to_numpy(np.float64), v.to_numpy(np.float64)
        u0, v0 = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        fu, fv = ((t * t * (3 - 2 * t)) for t in (u - u0, v - v0))
        at = lambda i, j: (split_mix(seed, (v0 + j) % height * width + (u0 + i) % width) % np.uint64(10_001)).astype(np.float64) / 10_000
        top, bottom = (at(0, j) * (1 - fu) + at(1, j) * fu for j in (0, 1))
        return pd.Series(top * (1 - fv) + bottom * fv)

    return noise(seed_column(seed), u.cast("double"), v.cast("double"))
