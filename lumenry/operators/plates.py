"""Pictures held whole, one row each: ``(pic, width, height, rgb)`` with ``rgb`` the channels of all pixels, row by row.

Work that looks at a whole picture at once (soft maps, band detectors) runs here as array
products in Arrow tasks. A picture never leaves its row, so there is no shuffle but the one that
gathers a pixel table; JVM batches are bounded in bytes, and a worker turns one picture at a time into arrays.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Long side of the small copy that soft maps are worked out on.
MAP_SIDE = 384
#: A colour of less saturation has no hue to be taken from it.
NO_HUE = 0.08
#: Pixels of pictures of one size that an effect takes at once.
STACK = 1 << 17
PLATE = "pic long, width int, height int, rgb array<short>"


Colour = tuple[int, int, int]
#: The 8 x 8 ordered-dither matrix.
BAYER = [
    [0, 32, 8, 40, 2, 34, 10, 42],
    [48, 16, 56, 24, 50, 18, 58, 26],
    [12, 44, 4, 36, 14, 46, 6, 38],
    [60, 28, 52, 20, 62, 30, 54, 22],
    [3, 35, 11, 43, 1, 33, 9, 41],
    [51, 19, 59, 27, 49, 17, 57, 25],
    [15, 47, 7, 39, 13, 45, 5, 37],
    [63, 31, 55, 23, 61, 29, 53, 21],
]


def scaled(size: float | Column, side: int) -> int | Column:
    if isinstance(size, Column):
        return F.floor(size * side / 1000 + 0.5)
    return int(math.floor(size * side / 1000 + 0.5))


def gathered(px: DataFrame, width: int, height: int) -> DataFrame:
    """Plates of a pixel table; one shuffle by picture."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *[F.col(c).cast("short").alias(c) for c in "rgb"])))
    rows = px.groupBy(F.col("pic").cast("long").alias("pic")).agg(cells.alias("cells"))
    flat = F.flatten(F.transform("cells", lambda p: F.array(p["r"], p["g"], p["b"])))
    return rows.select("pic", F.lit(width).alias("width"), F.lit(height).alias("height"), flat.alias("rgb"))


def spread(plates: DataFrame) -> DataFrame:
    """The pixel table of plates."""
    one = plates.select("pic", "width", "rgb", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("at"))
    channels = [F.get("rgb", 3 * F.col("at") + k).cast("int").alias(c) for k, c in enumerate("rgb")]
    return one.select("pic", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), *channels)


def arrays(batch: pa.RecordBatch, column: str = "rgb", depth: int = 3) -> Iterator[np.ndarray]:
    """Each row's values as (height, width, depth)."""
    values = batch.column(column)
    offsets, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
    sides = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)
    for k, (h, w) in enumerate(sides):
        own = flat[offsets[k] : offsets[k + 1]].reshape(h, w, depth)
        yield own if depth > 1 else own[..., 0]


def listed(values: np.ndarray) -> pa.ListArray:
    """An array (row, value) as a column of lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def table_of(batch: pa.RecordBatch, column: str, rows: list[int] | None = None) -> np.ndarray:
    """Lists of equal length, of all rows or of some, as an array (row, value)."""
    values = batch.column(column)
    offsets, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
    return np.stack([flat[offsets[k] : offsets[k + 1]] for k in (range(len(batch)) if rows is None else rows)])


def repainted_together(plates: DataFrame | None, effect: Callable[..., np.ndarray], **given) -> DataFrame | Callable:
    """As ``repainted`` for an effect that takes pictures of one size at once, as (height, width, .., 3), and ``given``; columns among these are read per row."""
    if plates is None:
        return lambda picture: effect(picture, **given)
    varying = {k: v for k, v in given.items() if isinstance(v, Column)}
    fixed, names = {k: v for k, v in given.items() if k not in varying}, list(varying)

    def run(batches):
        for batch in batches:
            alike = defaultdict(list)
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", *names)), strict=True)):
                alike[key].append(k)
            for (h, w, *own), rows in alike.items():
                step = max(1, STACK // max(1, h * w))
                for at in range(0, len(rows), step):
                    ks = rows[at : at + step]
                    stack = np.ascontiguousarray(table_of(batch, "rgb", ks).reshape(len(ks), h, w, 3).transpose(1, 2, 0, 3), np.float64)
                    out = effect(stack, **fixed, **dict(zip(names, own, strict=True)))
                    out = np.clip(np.floor(out + 0.5), 0, 255).astype(np.int16).transpose(2, 0, 1, 3).reshape(len(ks), -1)
                    heads = [batch.column(c).take(pa.array(ks)) for c in ("pic", "width", "height")]
                    yield pa.RecordBatch.from_arrays([*heads, listed(out)], names=["pic", "width", "height", "rgb"])

    return plates.select("pic", "width", "height", "rgb", *[v.alias(k) for k, v in varying.items()]).mapInArrow(run, PLATE)


def repainted(plates: DataFrame | None, effect: Callable[[np.ndarray], np.ndarray]) -> DataFrame | Callable:
    """Plates with ``effect`` (channels 0 to 255 to channels, rounded here) applied to each; without plates the effect itself."""
    return effect if plates is None else repainted_by(plates, lambda _: effect)


def repainted_by(plates: DataFrame, effect_of: Callable[[int], Callable[[np.ndarray], np.ndarray] | None]) -> DataFrame:
    """Plates with the effect that each one's number names; none leaves a plate as it is."""

    def run(batches):
        for batch in batches:
            for k, (pic, picture) in enumerate(zip(batch.column("pic").to_pylist(), arrays(batch), strict=True)):
                effect = effect_of(pic) or (lambda own: own)
                out = np.clip(np.floor(effect(picture.astype(np.float64)) + 0.5), 0, 255).astype(np.int16).reshape(-1)
                cells = pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("pic", "width", "height")), cells], names=["pic", "width", "height", "rgb"])

    return plates.select("pic", "width", "height", "rgb").mapInArrow(run, PLATE)


def luma(picture: np.ndarray) -> np.ndarray:
    return np.floor((299 * picture[..., 0] + 587 * picture[..., 1] + 114 * picture[..., 2]) / 1000)


def to_hsv(picture: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees (0 for greys), saturation, and value in the range of the channels."""
    r, g, b = (picture[..., k] for k in range(3))
    top, low = picture.max(-1), picture.min(-1)
    spread_ = np.where(top > low, top - low, 1)
    sector = np.where(top == r, ((g - b) / spread_) % 6, np.where(top == g, (b - r) / spread_ + 2, (r - g) / spread_ + 4))
    return np.where(top > low, 60 * sector, 0.0), np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0.0), top


def from_hsv(hue: np.ndarray, saturation: np.ndarray, value: np.ndarray) -> np.ndarray:
    ks = [(n + hue / 60) % 6 for n in (5, 3, 1)]
    return np.stack([value - value * saturation * np.clip(np.minimum(k, 4 - k), 0, 1) for k in ks], -1)


def _smooth(lo: float, hi: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - lo) / (hi - lo), 0, 1)
    return t * t * (3 - 2 * t)


def coloured(saturation: np.ndarray) -> np.ndarray:
    """0 for a grey, 1 for what has a hue."""
    return _smooth(0.02, 0.06, saturation)


def nearness(hue: np.ndarray, centre: float, width: float, soft: float) -> np.ndarray:
    """1 within ``width`` degrees of ``centre``, fading over ``soft`` more; hues count in tenths of a degree."""
    gap = (np.floor(hue * 10 + 0.5) / 10 - centre) % 360
    return 1 - _smooth(width, width + max(soft, 1.0), np.minimum(gap, 360 - gap))


def shrinking(size: int, small: int) -> np.ndarray:
    """Matrix (small, size) that resizes a line by a triangle as wide as a step of the small one."""
    step = size / small
    centre = (np.arange(small) + 0.5) * step
    weight = np.clip(1 - np.abs((np.arange(size)[None, :] + 0.5 - centre[:, None]) / max(step, 1.0)), 0, None)
    return weight / weight.sum(1, keepdims=True)


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture (height, width, channels) made smaller along both sides, not rounded."""
    rows = np.tensordot(shrinking(picture.shape[0], height), picture, 1)
    return shrinking(picture.shape[1], width) @ rows


def blurring(size: int, sigma: float) -> np.ndarray:
    """Matrix (size, size) of a Gaussian cut at three deviations, edges extended."""
    out = np.zeros((size, size))
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    rows = np.arange(size)
    for offset, weight in zip(range(-reach, reach + 1), kernel / kernel.sum(), strict=True):
        np.add.at(out, (rows, np.clip(rows + offset, 0, size - 1)), weight)
    return out


def reading(size: int, small: int, step: float) -> np.ndarray:
    """Matrix (size, small) that reads a line of small cells at every pixel, between two cells in proportion."""
    at = np.maximum((np.arange(size) + 0.5) / step - 0.5, 0)
    low = np.floor(at).astype(int)
    out, rows = np.zeros((size, small)), np.arange(size)
    np.add.at(out, (rows, np.minimum(low, small - 1)), 1 - (at - low))
    np.add.at(out, (rows, np.minimum(low + 1, small - 1)), at - low)
    return out


def soft_map(picture: np.ndarray, smooth: float, weight: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``weight`` of the colours, (height, width, n): of each pixel with ``smooth`` 0, else judged on a small copy, blurred over
    ``smooth`` percent of the long side and read back between its cells, so that an edge is soft and a speck goes with its zone."""
    if smooth <= 0:
        return weight(picture)
    h, w = picture.shape[:2]
    shrink = min(1.0, MAP_SIDE / max(h, w))
    sh, sw = (max(1, math.floor(side * shrink + 0.5)) for side in (h, w))
    small = picture
    if shrink < 1:
        small = np.floor(np.round(resized(picture, sh, sw), 9) + 0.5).clip(0, 255)
    cells, sigma = weight(small), smooth / 100 * max(sh, sw)
    down, across = reading(h, sh, 1 / shrink), reading(w, sw, 1 / shrink)
    if sigma >= 0.3:
        down, across = down @ blurring(sh, sigma), across @ blurring(sw, sigma)
    return np.stack([down @ cells[..., k] @ across.T for k in range(cells.shape[-1])], -1)


def hue_at(picture: np.ndarray, point: tuple[float, float], otherwise: float) -> float:
    """The hue of the mean colour of a small square about a point in percent; ``otherwise`` where that is grey."""
    h, w = picture.shape[:2]
    cx, cy = (math.floor(p / 100 * (side - 1) + 0.5) for p, side in zip(point, (w, h), strict=True))
    reach = max(2, max(h, w) // 400)
    ys, xs = (np.clip(np.arange(c - reach, c + reach + 1), 0, side - 1) for c, side in ((cy, h), (cx, w)))
    mean = np.floor(picture[np.ix_(ys, xs)].mean((0, 1)) + 0.5)
    hue, saturation, _ = to_hsv(mean)
    return math.floor(float(hue) * 10 + 0.5) / 10 % 360 if float(saturation) >= NO_HUE else otherwise


def onepoint(plates: DataFrame, hue: float = 0.0, width: int = 30, soft: int = 30, rest: int = 0, at: tuple[float, float] | None = None, smooth: float = 1.0) -> DataFrame:
    """One hue, or that of the point ``at``, keeps its colour; the rest goes grey as far as ``rest`` percent leaves."""
    smooth = min(max(smooth, 0.0), 10.0)

    def effect(picture):
        centre = hue if at is None else hue_at(picture, at, hue)
        zone = soft_map(picture, smooth, lambda p: _zone(p, centre, width, soft))
        grey = luma(picture)[..., None]
        faded = grey + (picture - grey) * (rest / 100)
        return faded + (picture - faded) * zone

    return repainted(plates, effect)


def _zone(picture: np.ndarray, centre: float, width: float, soft: float) -> np.ndarray:
    hue, saturation, _ = to_hsv(picture)
    return (nearness(hue, centre, width, soft) * coloured(saturation))[..., None]


def falsecolor(plates: DataFrame, order: str = "bgr", invert: str = "", rotate: int = 0, saturation: int = 100, only: float | None = None,
               width: int = 30, soft: int = 30, smooth: float = 1.0, mix: int = 100) -> DataFrame:
    """Channels swapped, inverted and turned in hue; with ``only`` as far as the soft zone of that hue goes."""
    smooth, strength, turn = min(max(smooth, 0.0), 10.0), min(saturation, 400) / 100, max(-180, min(180, rotate))

    def effect(picture):
        share = mix / 100 * (1.0 if only is None else soft_map(picture, smooth, lambda p: _zone(p, only, width, soft)))
        moved = picture[..., ["rgb".index(c) for c in order]]
        moved = np.stack([255 - moved[..., k] if c in invert else moved[..., k] for k, c in enumerate("rgb")], -1)
        if turn or strength != 1:
            hue, own, value = to_hsv(moved)
            moved = from_hsv(hue + turn, np.minimum(own * strength, 1), value)
        return picture + (moved - picture) * share

    return repainted(plates, effect)


def remap(plates: DataFrame, moves: list[tuple[float, float]], width: int = 25, soft: int = 25, smooth: float = 1.0, saturation: int = 100, mix: int = 100) -> DataFrame:
    """Hues near the first of each pair turn towards the second; where zones meet, turns are averaged by nearness."""
    smooth, strength = min(max(smooth, 0.0), 10.0), min(saturation, 400) / 100
    turns = [(a, (b - a) % 360 - (360 if (b - a) % 360 > 180 else 0)) for a, b in moves]

    def pull(picture):
        hue, own, _ = to_hsv(picture)
        near = [nearness(hue, a, width, soft) for a, _ in turns]
        return np.stack([sum(near), sum(n * t for n, (_, t) in zip(near, turns, strict=True))], -1) * coloured(own)[..., None]

    def effect(picture):
        near, turn = np.moveaxis(soft_map(picture, smooth, pull), -1, 0)
        amount = np.minimum(near, 1) * (mix / 100)
        acts = (amount > 1e-4) & (near > 1e-4)
        hue, own, value = to_hsv(picture)
        moved = from_hsv(hue + turn / np.where(acts, near, 1), np.minimum(own * strength, 1), value)
        return np.where(acts[..., None], picture + (moved - picture) * amount[..., None], picture)

    return repainted(plates, effect) if moves else plates
