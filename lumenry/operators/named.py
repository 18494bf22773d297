"""The effects under the names and parameters that recipes use, which differ from this engine's own in places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import plate_effects, plates
from .effects import REGISTRY, Colour, dither_ordered, falsecolor, leak, onepoint, pixel_sort, prism, remap, scaled, spin
from .seeded import SEEDED, drawn_slices, drawn_stretch, streaks


def built(effect: str, **only: tuple) -> None:
    """An error where a parameter has another value than the one that is built; ``only`` holds both."""
    for name, (value, known) in only.items():
        if value != known:
            raise ValueError(f"{effect}: {name}={value} is not built, only {known}")


def turned(px: DataFrame) -> DataFrame:
    """The picture mirrored at its diagonal: rows become columns."""
    return px.select(*[F.col({"x": "y", "y": "x"}.get(c, c)).alias(c) for c in px.columns])


def whole(effect, px: DataFrame, width: int, height: int, **own) -> DataFrame:
    """An effect on plates, for a pixel table; without one, the effect on a single picture, or none where nothing changes."""
    if px is None:
        return effect(None, **own)
    return plates.spread(effect(plates.gathered(px, width, height), **own))


def _slice(px, width, height, slices=12, shift=120, height_=(8, 120), split=False, invert=False, seed=1):
    if split or invert:
        return whole(plate_effects.slices, px, width, height, count=slices, shift=shift, tall=height_, split=split, invert=invert, seed=seed)
    return drawn_slices(px, width, height, slices, shift, height_, seed)


def _stretch(px, width, height, bands=6, length=(20, 200), direction="horizontal", seed=1):
    if direction == "vertical":
        return turned(drawn_stretch(turned(px), height, width, bands, length, seed))
    return drawn_stretch(px, width, height, bands, length, seed)


def _sort(px, width, height, direction="horizontal", **own):
    return turned(pixel_sort(turned(px), **own)) if direction == "vertical" else pixel_sort(px, **own)


def _streaks(px, width, height, color: Colour = (255, 58, 16), width_=28, wobble=0, position="random", **own):
    built("streaks", wobble=(wobble, 0), position=(position, "random"))
    most, least = max(color), min(color)
    red, green, blue = color
    step = max(1, most - least)
    part = (green - blue) / step if most == red else 2 + (blue - red) / step if most == green else 4 + (red - green) / step
    return streaks(px, width, height, hue=60 * part % 360, saturation=(most - least) / max(1, most), wide=width_, **own)


def _dither(px, width, height, method="diffusion", size=2, mid=128):
    if method == "bayer" and mid == 128 and scaled(size, max(width, height)) <= 1:
        return dither_ordered(px)
    return whole(plate_effects.dither, px, width, height, method=method, size=size, mid=mid)


def _leak(px, width, height, edge="random", spread=0, wobble=0, seed=1, **own):
    if edge == "random" or spread or wobble:
        return whole(plate_effects.leak, px, width, height, edge=edge, spread=spread, wobble=wobble, seed=seed, **own)
    return leak(px, width, height, edge=edge, **own)


def _spin(px, width, height, steps=0, **own):
    return spin(px, width, height, steps=steps, **own) if steps else whole(plate_effects.spin, px, width, height, steps=0, **own)


def _prism(px, width, height, range_=-200, wobble=0, **own):
    built("prism", wobble=(wobble, 0))
    return prism(px, width, height, turn=range_, **own)


def _remap(px, width, height, map_=(), width_=25, smooth=1, **own):
    if smooth > 0 and map_:
        return whole(lambda p, **all_: plates.remap(p, list(map_), width_, **all_), px, width, height, smooth=smooth, **own)
    return remap(px, list(map_), width_, **own)


def _onepoint(px, width, height, at=None, smooth=1, width_=30, **own):
    if smooth > 0 or at is not None:
        return whole(lambda p, **all_: plates.onepoint(p, **all_, width=width_), px, width, height, at=at, smooth=smooth, **own)
    return onepoint(px, width=width_, **own)


def _falsecolor(px, width, height, smooth=1, width_=30, only=None, **own):
    if smooth > 0 and only is not None:
        return whole(lambda p, **all_: plates.falsecolor(p, **all_, width=width_), px, width, height, only=only, smooth=smooth, **own)
    return falsecolor(px, width=width_, only=only, **own)


def _renamed(effect, **names):
    """``effect`` for parameters whose names are those of a picture's own arguments or of Python's."""
    return lambda px, w, h, **own: effect(px, w, h, **{names.get(k, k): v for k, v in own.items()})


REGISTRY.update(
    slice=_renamed(_slice, height="height_"), stretch=_stretch, sort=_sort, streaks=_renamed(_streaks, width="width_"), dither=_dither, leak=_leak, spin=_spin,
    prism=_renamed(_prism, range="range_"), remap=_renamed(_remap, map="map_", width="width_"), onepoint=_renamed(_onepoint, width="width_"),
    falsecolor=_renamed(_falsecolor, width="width_"),
)
SEEDED.add("leak")

#: Whether an effect with these parameters (all of them) works on whole pictures.
WHOLE = {
    "slice": lambda p: p["split"] or p["invert"],
    "dither": lambda p: p["method"] != "bayer",
    "leak": lambda p: p["edge"] == "random" or p["spread"] > 0 or p["wobble"] > 0,
    "spin": lambda p: not p["steps"],
    "remap": lambda p: p["smooth"] > 0 and len(p["map"]) > 0,
    "onepoint": lambda p: p["smooth"] > 0 or p["at"] is not None,
    "falsecolor": lambda p: p["smooth"] > 0 and p["only"] is not None,
}
#: Parameters that may be columns where an effect works on the pixel table.
AS_COLUMNS = {
    "duotone": {"dark", "light"}, "tritone": {"dark", "mid", "light", "mix"}, "scanlines": {"period", "thickness", "strength"},
    "fade": {"lift", "saturation", "tint", "tint_amount"}, "vignette": {"strength", "start"}, "falsecolor": {"mix"},
    "prism": {"position", "hue", "range", "strength", "white"}, "leak": {"color", "strength", "size", "seed"}, "aberration": {"amount"},
    "spin": {"angle", "mix"}, "grain": {"strength", "seed"}, "sort": {"low", "high"}, "bloom": {"threshold", "strength"}, "drag": {"mix"},
    "liquid": {"amplitude", "seed"},
}
