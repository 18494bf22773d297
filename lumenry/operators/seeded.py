"""Effects shaped by seeded draws, and the ones that smear or glow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Draws, below
from ..functions.scalars import brightness, from_hsv
from . import plate_effects, plates
from .effects import REGISTRY, Colour, painted, rgb, scaled, slices, stretch


def grain(px: DataFrame, width: int, height: int, strength: int = 30, size: int = 2, color: bool = False, seed: int = 0) -> DataFrame:
    """Noise in clumps, strongest in the middle tones."""
    dot, each = max(1, scaled(size, max(width, height))), 3 if color else 1
    cell = F.floor(F.col("y") / dot) * math.ceil(width / dot) + F.floor(F.col("x") / dot)
    weight = 1 - F.abs(2 * brightness(*rgb()) / 255 - 1) * 0.7
    noise = [below(seed, cell * each + (k if color else 0), 2001) / 1000 - 1 for k in range(3)]
    return painted(px, [c + n * (strength / 100 * 80) * weight for c, n in zip(rgb(), noise)])


def liquid(px: DataFrame, width: int, height: int, amplitude: int = 40, scale: int = 150, octaves: int = 2, drift: int = 0, seed: int = 0) -> DataFrame:
    """Pixels pushed by two fields of noise."""
    if scale == 0:
        return px
    return plates.spread(plate_effects.liquid(plates.gathered(px, width, height), amplitude, scale, octaves, drift, seed))


def screened(under: Column, over: Column, mix: Column) -> Column:
    return under + (255 - (255 - under) * (255 - over) / 255.0 - under) * mix


def streaks(px: DataFrame, width: int, height: int, hue: float = 10.0, saturation: float = 0.94, strength: int = 85, count: int = 3, wide: int = 28, spread: int = 20,
            softness: int = 40, seed: int = 0) -> DataFrame:
    """Bands of light across the height: a soft rise, a hard edge, redder where dim and whiter at the core."""
    drawn, fade_out, bands = Draws(seed), softness / 100 * 0.5, []
    for _ in range(max(1, min(8, count))):
        centre = width * drawn.below(1001) / 1000
        size = width * max(0.01, wide / 100) * (0.6 + drawn.below(801) / 1000)
        bands.append((centre - size / 2, size, drawn.below(2) == 0))
    light = F.lit(0.0)
    smooth = lambda t: t * t * (3 - 2 * t)
    for k, (start, size, hard_right) in enumerate(bands):
        u = (F.col("x") - start) / size
        px = px.withColumn(f"u{k}", u if hard_right else 1 - u)
        u = F.col(f"u{k}")
        gone = (u - 1) / fade_out if fade_out else F.lit(1.0)
        light = light + F.when((u >= 0) & (u < 1), smooth(u)).when((u >= 1) & (u < 1 + fade_out), 1 - smooth(gone)).otherwise(0.0)
    # Steps that later ones use more than once are columns, so that they are worked out once and the expressions stay small.
    px = px.withColumn("light", F.least(F.lit(1.0), light))
    px = px.withColumn("core", F.greatest(F.lit(0.0), (F.col("light") - 0.75) / 0.25))
    px = px.withColumns({"hue": hue + (2 * F.col("light") - 1) * spread, "saturation": saturation * (1 - F.col("core") * 0.3)})
    band = from_hsv(F.col("hue"), F.col("saturation"), F.lit(255.0))
    return painted(px, [F.when(F.col("light") > 0, screened(c, o, F.col("light") * (strength / 100))).otherwise(c) for c, o in zip(rgb(), band)])


def drag(px: DataFrame, width: int, height: int, kind: str = "motion", length: int = 60, angle: float = 0, center=(50, 50), mix: int = 70, blend: str = "lighten") -> DataFrame:
    """A smear: the mean of up to 32 samples along a line, towards a centre, or round it."""
    return plates.spread(plate_effects.drag(plates.gathered(px, width, height), kind, length, angle, center, mix, blend))


def bloom(px: DataFrame, width: int, height: int, threshold: int = 200, radius: int = 30, strength: int = 60) -> DataFrame:
    """Lights blurred and screened back."""
    return plates.spread(plate_effects.bloom(plates.gathered(px, width, height), threshold, radius, strength))


def dither_diffusion(px: DataFrame, width: int, height: int, mid: int = 128) -> DataFrame:
    """Black and white by error diffusion, a picture's pixels along slanted lines."""
    return plates.spread(plate_effects.dither(plates.gathered(px, width, height), size=0, mid=mid))


def drawn_slices(px: DataFrame, width: int, height: int, count: int = 12, shift: int = 120, tall=(8, 120), seed: int = 0) -> DataFrame:
    """Bands of rows drawn from the seed, each moved sideways and wrapped."""
    side, drawn, bands = max(width, height), Draws(seed), []
    for _ in range(count):
        rows = max(1, drawn.between(scaled(tall[0], side), scaled(tall[1], side)))
        top = drawn.below(height)
        bands.append((top, min(height, top + rows), drawn.around(scaled(shift, side)), False))
    return slices(px, width, bands)


def drawn_stretch(px: DataFrame, width: int, height: int, bands: int = 6, length=(20, 200), seed: int = 0) -> DataFrame:
    """Rows drawn from the seed, repeated downwards."""
    side, drawn, runs = max(width, height), Draws(seed), []
    for _ in range(bands):
        line = drawn.below(height)
        runs.append((line, min(height, line + drawn.between(scaled(length[0], side), scaled(length[1], side)))))
    return stretch(px, runs)


REGISTRY.update(grain=grain, liquid=liquid, streaks=streaks, drag=drag, bloom=bloom, diffusion=dither_diffusion, slice=drawn_slices, stretch=drawn_stretch)
SEEDED = {"grain", "liquid", "streaks", "slice", "stretch"}
