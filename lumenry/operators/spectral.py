"""Periodic light bands: power at candidate periods, prominence, folding into phase bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .effects import upper_median


def local_light(signal: DataFrame, half: int, by: str = "id", row: str = "row", value: str = "v") -> DataFrame:
    """Centred moving mean; at the edges the window is shorter."""
    frame = W.partitionBy(by).orderBy(row).rowsBetween(-half, half)
    return signal.withColumn("local", F.avg(value).over(frame))


def band_power(signal: DataFrame, periods: list[float], by: str = "id", row: str = "row", value: str = "v") -> DataFrame:
    """``(id, period, power)`` at each period. Periods are a short list, exploded beside each row and summed at once."""
    spread = signal.select(by, row, value, F.explode(F.array(*map(F.lit, periods))).alias("period"))
    turn = 2 * math.pi * F.col(row) / F.col("period")
    sums = spread.groupBy(by, "period").agg(F.sum(F.col(value) * F.cos(turn)).alias("re"), F.sum(F.col(value) * F.sin(turn)).alias("im"))
    return sums.select(by, "period", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def prominence(powers: DataFrame, by: str = "id") -> DataFrame:
    """Power over the upper median of its neighbours from 3/4 to 4/3 of the period, those within 3 % left out."""
    near = powers.select(by, F.col("period").alias("other"), F.col("power").alias("beside"))
    met = powers.join(near, by).where("other between period * 3 / 4 and period * 4 / 3 and abs(other - period) > 0.03 * period")
    held = met.groupBy(by, "period", "power").agg(F.collect_list("beside").alias("around"))
    return held.select(by, "period", (F.col("power") / upper_median(F.col("around"))).alias("ratio"))


def strongest(ratios: DataFrame, by: str = "id") -> DataFrame:
    return ratios.groupBy(by).agg(F.max_by("period", F.struct("ratio", "period")).alias("period"), F.max("ratio").alias("ratio"))


def folded_gains(signal: DataFrame, period: float, bins: int = 32, by: str = "id", row: str = "row", value: str = "v") -> DataFrame:
    """``(id, bin, gain)``: mean of each phase bin over the mean of all, kept within 0.8 to 1.25."""
    phase = F.col(row) / period
    place = F.floor((phase - F.floor(phase)) * bins).cast("int")
    mean = signal.groupBy(by).agg(F.avg(value).alias("mean"))
    held = signal.groupBy(by, place.alias("bin")).agg(F.avg(value).alias("own")).join(F.broadcast(mean), by)
    return held.select(by, "bin", F.greatest(F.lit(0.8), F.least(F.lit(1.25), F.col("own") / F.col("mean"))).alias("gain"))


def smooth_gains(gains: DataFrame, harmonics: int = 4, bins: int = 32, by: str = "id") -> DataFrame:
    """Gains replaced by the sum of their first harmonics around 1."""
    waves = F.explode(F.sequence(F.lit(1), F.lit(harmonics)))
    spread = gains.withColumn("h", waves).withColumn("turn", 2 * math.pi * F.col("h") * (F.col("bin") + 0.5) / bins)
    fits = spread.groupBy(by, "h").agg(*[(F.sum((F.col("gain") - 1) * f("turn")) * 2 / bins).alias(n) for n, f in (("a", F.cos), ("b", F.sin))])
    met = spread.join(F.broadcast(fits), [by, "h"])
    return met.groupBy(by, "bin").agg((1 + F.sum(F.col("a") * F.cos("turn") + F.col("b") * F.sin("turn"))).alias("gain"))


def deband(signal: DataFrame, gains: DataFrame, period: float, bins: int = 32, by: str = "id", row: str = "row", value: str = "v") -> DataFrame:
    """Values divided by the gain of their phase bin."""
    phase = F.col(row) / period
    placed = signal.withColumn("bin", F.floor((phase - F.floor(phase)) * bins).cast("int"))
    return placed.join(gains, [by, "bin"], "left").select(by, row, (F.col(value) / F.coalesce("gain", F.lit(1.0))).alias(value))
