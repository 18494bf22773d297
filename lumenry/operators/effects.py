"""Effects on pictures held as pixel tables ``(pic, y, x, r, g, b)``.

Pointwise effects are projections. Effects that read other pixels use windows for
constant shifts along a row or column, and work on the whole picture otherwise (``plate_effects``),
so every plan is partitioned by picture and nothing is joined: a pixel table can be far larger than a planner takes it for. Sizes are pixels of a picture 1000 pixels long.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.parameters import defaults
from . import plate_effects, plates
from .plates import BAYER, Colour, scaled
from ..functions.scalars import (
    brightness,
    byte,
    from_hsv,
    hue_distance,
    hue_of,
    hue_turn,
    saturation_of,
    smoothstep,
    zone_weight,
)

def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def larger(a, b):
    """The larger of two parameters, either of which may be a column."""
    return F.greatest(*[F.lit(v) for v in (a, b)]) if isinstance(a, Column) or isinstance(b, Column) else max(a, b)


def smaller(a, b):
    return F.least(*[F.lit(v) for v in (a, b)]) if isinstance(a, Column) or isinstance(b, Column) else min(a, b)


def painted(px: DataFrame, channels) -> DataFrame:
    return px.select("pic", "y", "x", *[byte(c).alias(n) for c, n in zip(channels, "rgb")])


def mixed(channels, share) -> list[Column]:
    return [own + (new - own) * share for own, new in zip(rgb(), channels)]


def duotone(px: DataFrame, dark: Colour = (0, 0, 0), light: Colour = (255, 79, 163)) -> DataFrame:
    t = brightness(*rgb()) / 255
    return painted(px, [d + (u - d) * t for d, u in zip(dark, light)])


def tritone(px: DataFrame, dark: Colour = (20, 5, 43), mid: Colour = (224, 32, 79), light: Colour = (255, 217, 160), mix: int = 100) -> DataFrame:
    t = brightness(*rgb()) / 255
    inks = [F.when(t < 0.5, d + (m - d) * (t * 2)).otherwise(m + (u - m) * ((t - 0.5) * 2)) for d, m, u in zip(dark, mid, light)]
    return painted(px, mixed(inks, mix / 100))


def scanlines(px: DataFrame, side: int, period: int = 4, thickness: int = 1, strength: int = 60) -> DataFrame:
    every = larger(1, scaled(period, side))
    thick = smaller(every, larger(1, scaled(thickness, side)))
    keep = F.when(F.col("y") % every < thick, 1 - strength / 100).otherwise(1.0)
    return painted(px, [c * keep for c in rgb()])


def fade(px: DataFrame, lift: int = 12, saturation: int = 80, tint: Colour = (255, 140, 66), tint_amount: int = 10) -> DataFrame:
    base, grey = lift / 100 * 127.5, brightness(*rgb())
    raised = [base + (grey + (c - grey) * (smaller(saturation, 200) / 100)) * (255 - base) / 255 for c in rgb()]
    return painted(px, [v + (t - v) * (tint_amount / 100) * (1 - v / 255) for v, t in zip(raised, tint)])


def vignette(px: DataFrame, width: int, height: int, strength: int = 50, start: int = 40) -> DataFrame:
    dx, dy = F.col("x") - width / 2, F.col("y") - height / 2
    far = F.sqrt(dx * dx + dy * dy) / math.hypot(width / 2, height / 2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (far - start / 100) / larger(1 - start / 100, 0.01)))
    return painted(px, [c * (1 - strength / 100 * t * t) for c in rgb()])


def falsecolor(px: DataFrame, order: str = "bgr", invert: str = "", rotate: int = 0, saturation: int = 100, mix: int = 100,
               only: float | None = None, width: int = 30, soft: int = 30) -> DataFrame:
    """Channels swapped, inverted, turned in hue; with ``only`` just near that hue."""
    by_name = dict(zip("rgb", rgb()))
    moved = [255 - by_name[c] if n in invert else by_name[c] for n, c in zip("rgb", order)]
    if rotate or saturation != 100:
        rotate, strength = max(-180, min(180, rotate)), min(saturation, 400) / 100
        moved = list(from_hsv(hue_of(*moved) + rotate, F.least(F.lit(1.0), saturation_of(*moved) * strength), F.greatest(*moved).cast("double")))
    share = zone_weight(*rgb(), only, width, soft) * (mix / 100) if only is not None else F.lit(mix / 100)
    return painted(px, mixed(moved, share))


def onepoint(px: DataFrame, hue: float = 0.0, width: int = 30, soft: int = 30, rest: int = 0) -> DataFrame:
    """One hue zone keeps its colour, the rest goes towards grey."""
    grey, kept = brightness(*rgb()), zone_weight(*rgb(), hue, width, soft)
    faded = [grey + (c - grey) * (rest / 100) for c in rgb()]
    return painted(px, [f + (c - f) * kept for c, f in zip(rgb(), faded)])


def remap(px: DataFrame, moves: list[tuple[float, float]], width: int = 25, soft: int = 25, saturation: int = 100, mix: int = 100) -> DataFrame:
    """Hues near the first of each pair turn towards the second; several turns are averaged by nearness."""
    if not moves:
        return px
    # Steps that later ones use more than once are columns, so that they are worked out once and the expressions stay small.
    px = px.select("pic", "y", "x", *"rgb", hue_of(*rgb()).alias("hue"), saturation_of(*rgb()).alias("own"))
    px = px.withColumn("at", F.pmod(F.round("hue", 1), F.lit(360.0)))
    px = px.withColumns({f"zone{k}": 1 - smoothstep(width, width + max(soft, 1), hue_distance(F.col("at"), F.lit(float(a)))) for k, (a, _) in enumerate(moves)})
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    px = px.withColumn("gate", smoothstep(0.02, 0.06, F.col("own")))
    near, turn = [F.col(f"zone{k}") for k in range(len(moves))], [F.col(f"zone{k}") * hue_turn(F.lit(float(a)), F.lit(float(b))) for k, (a, b) in enumerate(moves)]
    px = px.withColumns({"near": total(near) * F.col("gate"), "turn": total(turn) * F.col("gate")})
    px = px.withColumns({
        "amount": F.least(F.col("near"), F.lit(1.0)) * (mix / 100), "hue": F.col("hue") + F.col("turn") / F.when(F.col("near") > 0, F.col("near")),
        "own": F.least(F.lit(1.0), F.col("own") * (min(saturation, 400) / 100)), "top": F.greatest(*rgb()).cast("double"),
    })
    px = px.withColumns(dict(zip(("moved_r", "moved_g", "moved_b"), from_hsv(F.col("hue"), F.col("own"), F.col("top")))))
    acts = (F.col("amount") > 1e-4) & (F.col("near") > 1e-4)
    return painted(px, [F.when(acts, m).otherwise(c) for c, m in zip(rgb(), mixed([F.col(f"moved_{c}") for c in "rgb"], F.col("amount")))])


def dither_ordered(px: DataFrame) -> DataFrame:
    """Black and white by the ordered matrix, one pixel a dot."""
    table = F.array(*[F.lit(v) for row in BAYER for v in row])
    threshold = (F.get(table, F.col("y") % 8 * 8 + F.col("x") % 8) + 0.5) * 4
    ink = F.when(brightness(*rgb()) >= threshold, 255).otherwise(0)
    return painted(px, [ink, ink, ink])


def prism(px: DataFrame, width: int, height: int, kind: str = "linear", angle: float = 0, center=(50, 100), position: int = 30, size: int = 40,
          hue: int = 220, turn: int = -200, strength: int = 80, white: int = 35) -> DataFrame:
    """A rainbow band along a direction or round a centre, screened over the picture."""
    if size == 0:
        return px
    sin, cos = math.sin(math.radians(angle)), math.cos(math.radians(angle))
    start = min(0.0, width * cos, height * sin, width * cos + height * sin)
    x, y = F.col("x"), F.col("y")
    dx, dy = x - center[0] / 100 * width, y - center[1] / 100 * height
    along = (x * cos + y * sin - start) / width if kind == "linear" else F.sqrt(dx * dx + dy * dy) / width
    t = (along - position / 100) / (size / 100)
    bump = F.pow(F.greatest(F.lit(0.0), F.sin(t * math.pi)), F.lit(0.6))
    amount = F.least(F.lit(1.0), bump * (strength / 100))
    band = from_hsv(hue + t * turn, 0.85 * (1 - white / 100 * bump * bump), F.lit(255.0))
    inside = (t >= 0) & (t < 1)
    return painted(px, [F.when(inside, 255 - (255 - c) * (255 - u * amount) / 255).otherwise(c) for c, u in zip(rgb(), band)])


def leak(px: DataFrame, width: int, height: int, edge: str = "left", color: Colour = (255, 150, 60), strength: int = 70, size: int = 50) -> DataFrame:
    """A screened glow from one side."""
    away = {"left": F.col("x"), "right": width - F.col("x"), "top": F.col("y"), "bottom": height - F.col("y")}[edge]
    glow = F.greatest(F.lit(0.0), 1 - away / larger(1.0, width * size / 100))
    glow = glow * glow * (strength / 100)
    return painted(px, [c + (255 - (255 - c) * (255 - u) / 255.0 - c) * glow for c, u in zip(rgb(), color)])


def shifted_channel(name: str, dx: int, dy: int) -> tuple[Column, Column]:
    """The channel moved by (dx, dy), edges repeated: first along rows, then along columns."""
    def along(column: Column, by: str, n: int, order: str) -> Column:
        line = W.partitionBy("pic", by).orderBy(order)
        whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        edge = F.first(column).over(whole) if n > 0 else F.last(column).over(whole)
        return F.coalesce(F.lag(column, n).over(line), edge) if n else column

    return along(F.col(name), "y", dx, "x"), along(F.col(name), "x", dy, "y")


def split(px: DataFrame, side: int, red=(-6, 0), green=(0, 0), blue=(6, 0)) -> DataFrame:
    """Channels at offsets of their own. Rows and columns are windows, so no join is needed."""
    signed = lambda n: int(math.copysign(scaled(abs(n), side), n))
    offsets = {c: (signed(d[0]), signed(d[1])) for c, d in zip("rgb", (red, green, blue))}
    px = px.select("pic", "y", "x", *[shifted_channel(c, offsets[c][0], 0)[0].alias(c) for c in "rgb"])
    return px.select("pic", "y", "x", *[shifted_channel(c, 0, offsets[c][1])[1].alias(c) for c in "rgb"])


def aberration(px: DataFrame, width: int, height: int, amount: float = 0.006) -> DataFrame:
    """Red larger, blue smaller about the centre."""
    return plates.spread(plate_effects.aberration(plates.gathered(px, width, height), amount))


def spin(px: DataFrame, width: int, height: int, angle: float = 10, center=(50, 50), steps: int = 8, mix: int = 100) -> DataFrame:
    """The mean over rotations about a centre."""
    if steps == 1 or not (isinstance(angle, Column) or angle) or not (isinstance(mix, Column) or mix):
        return px
    return plates.spread(plate_effects.spin(plates.gathered(px, width, height), angle, center, steps, mix))


def slices(px: DataFrame, width: int, bands: list[tuple[int, int, int, bool]]) -> DataFrame:
    """Rows ``top`` to ``bottom`` moved by ``dx``, wrapping, perhaps inverted; of overlapping bands the last counts.

    ``bands`` is a short list of (top, bottom, dx, invert), drawn beforehand.
    """
    dx, inverted = F.lit(0), F.lit(False)
    for top, bottom, move, invert in bands:
        inside = (F.col("y") >= top) & (F.col("y") < bottom)
        dx, inverted = F.when(inside, move).otherwise(dx), F.when(inside, invert).otherwise(inverted)
    moved = px.select("pic", "y", F.pmod(F.col("x") + dx, F.lit(width)).cast("int").alias("x"), inverted.alias("inverted"), *"rgb")
    return painted(moved, [F.when(F.col("inverted"), 255 - c).otherwise(c) for c in rgb()])


def stretch(px: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """Row ``line`` repeated down to before row ``end``; of overlapping bands the last counts."""
    column, y = W.partitionBy("pic", "x"), F.col("y")
    own = F.struct(*"rgb")
    held = {line: F.max(F.when(y == line, own)).over(column).alias(f"row{k}") for k, line in enumerate(dict.fromkeys(line for line, _ in bands))}
    px, place = px.select("pic", "y", "x", *"rgb", *held.values()), {line: f"row{k}" for k, line in enumerate(held)}
    for line, end in bands:
        own = F.when((y > line) & (y < end), F.col(place[line])).otherwise(own)
    return px.withColumn("own", own).select("pic", "y", "x", *[F.col(f"own.{c}").alias(c) for c in "rgb"])


def pixel_sort(px: DataFrame, low: int = 40, high: int = 220, reverse: bool = False) -> DataFrame:
    """In every row, runs of pixels whose brightness is in range are sorted by it.

    A run is an island of consecutive pixels in range; ties keep their order (and are
    turned round with ``reverse``). One window sort by position, one by brightness.
    """
    low, high = smaller(low, high), larger(low, high)
    line = W.partitionBy("pic", "y").orderBy("x")
    lit = px.withColumn("l", brightness(*rgb())).withColumn("out", (~F.col("l").between(low, high)).cast("int"))
    runs = lit.withColumn("run", F.sum("out").over(line) * 2 + F.col("out"))
    first = F.min("x").over(W.partitionBy("pic", "y", "run"))
    order = [F.desc("l"), F.desc("x")] if reverse else ["l", "x"]
    at = first + F.row_number().over(W.partitionBy("pic", "y", "run").orderBy(*order)) - 1
    return runs.select("pic", "y", F.when(F.col("out") == 1, F.col("x")).otherwise(at).cast("int").alias("x"), *"rgb")


def neighbourhood(px: DataFrame, width: int, height: int, value: str, radius: int = 1) -> DataFrame:
    """``(pic, y, x, around)``: values of the square around each pixel, edges repeated, as an array in row order.

    Rows first and columns second, both as windows over pictures that are each in one partition, so pixels shuffle once.
    """
    px = px.repartition("pic")

    def line(column: Column, by: str, order: str) -> Column:
        own = W.partitionBy("pic", by).orderBy(order)
        whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        lo, hi = F.first(column).over(whole), F.last(column).over(whole)
        before = [F.coalesce(F.lag(column, n).over(own), lo) for n in range(radius, 0, -1)]
        return F.array(*before, column, *[F.coalesce(F.lead(column, n).over(own), hi) for n in range(1, radius + 1)])

    rows = px.select("pic", "y", "x", line(F.col(value), "y", "x").alias("row"))
    return rows.select("pic", "y", "x", F.flatten(line(F.col("row"), "x", "y")).alias("around"))


def upper_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def median_chroma(px: DataFrame, width: int, height: int) -> DataFrame:
    """3 x 3 medians of red minus green and blue minus green, green kept."""
    cells = px.withColumn("d", F.struct((F.col("r") - F.col("g")).alias("p"), (F.col("b") - F.col("g")).alias("q"), "g"))
    around = neighbourhood(cells, width, height, "d")
    med = lambda f: upper_median(F.transform("around", lambda s: s[f]))
    met = around.withColumn("g", F.element_at("around", 5)["g"])
    return met.select("pic", "y", "x", (F.col("g") + med("p")).cast("int").alias("r"), "g", (F.col("g") + med("q")).cast("int").alias("b"))


def box_blur(px: DataFrame, width: int, height: int, value: str) -> DataFrame:
    around = neighbourhood(px, width, height, value)
    total = F.aggregate("around", F.lit(0.0), lambda s, v: s + v)
    return around.select("pic", "y", "x", (total / 9).alias("blurred"))


def sharpness_tiles(px: DataFrame, width: int, height: int, tile: int = 32) -> DataFrame:
    """``(pic, score)``: root of the mean of the best tenth of tiles' mean squared Laplacians."""
    rows, columns = W.partitionBy("pic", "y").orderBy("x"), W.partitionBy("pic", "x").orderBy("y")
    lit = px.withColumn("l", brightness(*rgb()))
    side = [F.lag("l").over(w) + F.lead("l").over(w) for w in (rows, columns)]
    inner = lit.withColumn("lap", side[0] + side[1] - 4 * F.col("l")).where("lap is not null")
    energy = inner.groupBy("pic", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(F.avg(F.col("lap") * F.col("lap")).alias("e"))
    own = W.partitionBy("pic")
    best = energy.withColumn("at", F.row_number().over(own.orderBy(F.desc("e")))).withColumn("n", F.count("*").over(own))
    return best.where(F.col("at") <= F.ceil(F.col("n") / 10)).groupBy("pic").agg(F.sqrt(F.avg("e")).alias("score"))


#: Effects by name, for recipes: a function of the pixel table and of the picture's size, and its parameters.
REGISTRY: dict[str, Callable] = {
    "duotone": lambda px, w, h, **p: duotone(px, **p),
    "tritone": lambda px, w, h, **p: tritone(px, **p),
    "scanlines": lambda px, w, h, **p: scanlines(px, max(w, h), **p),
    "fade": lambda px, w, h, **p: fade(px, **p),
    "vignette": lambda px, w, h, **p: vignette(px, w, h, **p),
    "falsecolor": lambda px, w, h, **p: falsecolor(px, **p),
    "onepoint": lambda px, w, h, **p: onepoint(px, **p),
    "remap": lambda px, w, h, **p: remap(px, **p),
    "prism": prism,
    "leak": leak,
    "split": lambda px, w, h, **p: split(px, max(w, h), **p),
    "aberration": aberration,
    "spin": spin,
    "sort": lambda px, w, h, **p: pixel_sort(px, **p),
}


def apply_recipe(px: DataFrame, width: int, height: int, steps: list[tuple[str, dict]]) -> DataFrame:
    """The effects of a recipe one after another; parameters that a step leaves out have the values that recipes print for them."""
    for name, params in steps:
        if name not in REGISTRY:
            raise ValueError(f"unknown effect {name}, known are {', '.join(sorted(REGISTRY))}")
        px = REGISTRY[name](px, width, height, **(defaults(name) | params))
    return px
