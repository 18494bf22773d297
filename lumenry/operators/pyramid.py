"""Frames of a scene lined up over three sizes: a shift found on a small copy is refined on larger ones.

Frames are plates with ``scene`` and ``frame``. Each frame meets its scene's main frame in a window over the
scene, which holds a scene and no more; the search is array work on one pair of pictures at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import with_main
from .plates import arrays, resized

#: Widths of the copies, and how far about the last shift each is searched.
LEVELS = ((192, 16), (768, 4), (1536, 3))
#: Grey from which a pixel is a light; only lights are compared.
LIGHT_FROM = 110.0


def nearest(x: float) -> int:
    """Rounded, halves away from nought."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def lights(picture: np.ndarray, width: int) -> np.ndarray:
    """Lights, from 0 to 1, of a copy of at most ``width``."""
    h, w = picture.shape[:2]
    sw = max(1, min(width, w))
    sh = max(1, h * sw // w)
    small = np.floor(np.round(resized(picture, sh, sw), 9) + 0.5)
    grey = small @ np.array([0.299, 0.587, 0.114])
    return np.clip((grey - LIGHT_FROM) / (255 - LIGHT_FROM), 0, 1) ** 2


def least_shift(main: np.ndarray, frame: np.ndarray, about: tuple[int, int], radius: int) -> tuple[int, int]:
    """The shift (dx, dy) about another with the least mean difference over the middle; the first by (dy, dx) of equal ones, ``about`` if none fits."""
    h, w = main.shape
    step = max(1, w // 384)
    ys, xs = np.arange(h * 3 // 10, h - h // 5, step), np.arange(w // 5, w - w // 5, step)
    best = (math.inf, about)
    if not len(ys) or not len(xs):
        return about
    base = main[np.ix_(ys, xs)]
    for dy in range(about[1] - radius, about[1] + radius + 1):
        for dx in range(about[0] - radius, about[0] + radius + 1):
            if ys[0] + dy >= 0 and ys[-1] + dy < h and xs[0] + dx >= 0 and xs[-1] + dx < w:
                cost = float(np.abs(base - frame[ys[0] + dy : ys[-1] + dy + 1 : step, xs[0] + dx : xs[-1] + dx + 1 : step]).mean())
                if cost < best[0] - 1e-12:
                    best = (cost, (dx, dy))
    return best[1]


def shift_of(main: np.ndarray, frame: np.ndarray) -> tuple[int, int]:
    """Where the main picture's lights are in ``frame``, in its pixels."""
    found, before = (0, 0), None
    for width, radius in LEVELS:
        one, two = lights(main, width), lights(frame, width)
        if before:
            found = tuple(nearest(v * one.shape[1] / before) for v in found)
        found, before = least_shift(one, two, found, radius), one.shape[1]
    return tuple(nearest(v * main.shape[1] / before) for v in found)


def registered(frames: DataFrame, main: int) -> DataFrame:
    """``(scene, frame, dx, dy)`` of ``frames(scene, frame, width, height, rgb)`` against frame ``main`` of their scene.

    The main frame's shift is 0. Frames of a scene without a main frame are left out; a frame of another size has a null shift.
    """
    met = with_main(frames, main, ["width", "height", "rgb"], scene=("scene",))
    met = met.select("scene", "frame", "width", "height", F.col("main.width").alias("w"), F.col("main.height").alias("h"), "rgb", F.col("main.rgb").alias("base"))

    def run(batches):
        for batch in batches:
            shifts = []
            same = [a == b and c == d for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in ("width", "w", "height", "h")), strict=True)]
            kept = batch.filter(pa.array(same))
            pairs = zip(arrays(kept, "rgb"), arrays(kept, "base"), kept.column("frame").to_pylist(), strict=True)
            found = iter([(0, 0) if k == main else shift_of(two.astype(float), one.astype(float)) for one, two, k in pairs])
            shifts = [next(found) if s else (None, None) for s in same]
            yield pa.RecordBatch.from_arrays(
                [batch.column("scene").cast(pa.int64()), batch.column("frame").cast(pa.int64()), *(pa.array([s[k] for s in shifts], pa.int32()) for k in (0, 1))], names=["scene", "frame", "dx", "dy"]
            )

    return met.mapInArrow(run, "scene long, frame long, dx int, dy int")


def shifted(picture: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The picture read at a shift, edges repeated."""
    h, w = picture.shape[:2]
    return picture[np.ix_(np.clip(np.arange(h) + dy, 0, h - 1), np.clip(np.arange(w) + dx, 0, w - 1))]


def aligned(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """``frames`` with each picture moved back by its shift (see ``registered``); null shifts leave it."""
    met = frames.join(shifts.select("scene", "frame", F.coalesce("dx", F.lit(0)).alias("dx"), F.coalesce("dy", F.lit(0)).alias("dy")), ["scene", "frame"])
    met = met.select("scene", "frame", "width", "height", "rgb", "dx", "dy")

    def run(batches):
        for batch in batches:
            for k, (picture, dx, dy) in enumerate(zip(arrays(batch), batch.column("dx").to_pylist(), batch.column("dy").to_pylist(), strict=True)):
                out = shifted(picture, dx, dy).reshape(-1).astype(np.int16)
                cells = pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))
                heads = [batch.column(c).slice(k, 1).cast(t) for c, t in (("scene", pa.int64()), ("frame", pa.int64()), ("width", pa.int32()), ("height", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*heads, cells], names=["scene", "frame", "width", "height", "rgb"])

    return met.mapInArrow(run, "scene long, frame long, width int, height int, rgb array<short>")
