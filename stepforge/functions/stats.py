"""Confidence intervals: Wilson score as column arithmetic, seeded bootstrap as a grouped aggregate."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def wilson(successes: int, n: int, z: float = Z_95) -> tuple[float, float]:
    """Interval of a rate on the driver; the whole unit interval where nothing was tried."""
    if n <= 0:
        return 0.0, 1.0
    p, zz = successes / n, z * z
    spread = z * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    middle, scale = p + zz / (2 * n), 1 + zz / n
    return max(0.0, (middle - spread) / scale), min(1.0, (middle + spread) / scale)


def wilson_columns(successes: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """(low, high) as expressions, evaluated where the counts are."""
    k = F.when(n > 0, n.cast("double"))
    p = successes.cast("double") / k
    zz = z * z
    spread = F.lit(z) * F.sqrt(p * (1 - p) / k + F.lit(zz) / (4 * k * k))
    middle, scale = p + F.lit(zz) / (2 * k), 1 + F.lit(zz) / k
    low = F.coalesce(F.greatest(F.lit(0.0), (middle - spread) / scale), F.lit(0.0))
    return low, F.coalesce(F.least(F.lit(1.0), (middle + spread) / scale), F.lit(1.0))


def with_rate(df: DataFrame, successes: str, n: str, prefix: str = "") -> DataFrame:
    """Adds rate, low and high of successes / n."""
    low, high = wilson_columns(F.col(successes), F.col(n))
    rate = F.when(F.col(n) > 0, F.col(successes) / F.col(n)).otherwise(F.lit(0.0))
    return df.withColumns({f"{prefix}rate": rate, f"{prefix}low": low, f"{prefix}high": high})


def bootstrap_mean(values: list[float], seed: int = 0, resamples: int = 2000, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of the mean; repeatable for a seed."""
    n = len(values)
    if n < 2:
        only = float(values[0]) if n else 0.0
        return only, only
    x, means, each = np.array(values, float), [], max(1, (1 << 20) // n)
    draws = Draws(seed)
    for some in range(0, resamples, each):
        many = min(each, resamples - some)
        means.append(x[draws.below(n, many * n).reshape(many, n)].mean(axis=1))
    means = np.sort(np.concatenate(means))
    return float(means[int(alpha / 2 * resamples)]), float(means[min(int((1 - alpha / 2) * resamples), resamples - 1)])


class Draws:
    """The numbers that random.Random(seed).randrange gives, many at a time."""

    def __init__(self, seed: int):
        *key, pos = random.Random(seed).getstate()[1]
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
        self.left = np.zeros(0, np.uint64)

    def below(self, n: int, count: int) -> np.ndarray:
        """The next ``count`` numbers under n, n below 2**32: top bits, drawn again where they are too large."""
        shift = np.uint64(32 - n.bit_length())
        got = [np.zeros(0, np.uint64)]
        have = 0
        while have < count:
            raw = np.concatenate([self.left, self.bits.random_raw(count - have)]) if len(self.left) else self.bits.random_raw(count - have)
            self.left = np.zeros(0, np.uint64)
            ok = np.flatnonzero((raw >> shift) < n)
            if len(ok) > count - have:
                last = ok[count - have - 1]
                self.left, ok = raw[last + 1 :], ok[: count - have]
            got.append(raw[ok] >> shift)
            have += len(ok)
        return np.concatenate(got).astype(np.int64)


def bootstrap_by(df: DataFrame, key: str, value: str, seed: int = 0, resamples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(key, low, high) for each group; values are taken in order, nulls left out."""
    kind = dict(df.dtypes)[key]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_mean(sorted(g[value].dropna().tolist()), seed, resamples, alpha)
        return pd.DataFrame({key: g[key].iloc[:1].to_numpy(), "low": [low], "high": [high]})

    return df.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, f"{key} {kind}, low double, high double")
