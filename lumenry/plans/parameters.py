"""Parameters of every effect as recipes write them: name, kind, default and what it does."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import COLOURS
from .pattern import PatternError, compiled, ends_of, is_pattern, pattern_at

#: Kinds: whole, number, share (0 to 100), flag, color, hue, hue? (or ``none``), pair, point? (or ``none``), map, or names parted by bars.
#: Names and defaults of the parameters that recipes may hold.
PARAMETERS: dict[str, list[tuple[str, str, str, str]]] = {
    "drag": [("kind", "motion|zoom|arc", "motion", "shape of the smear"), ("length", "whole", "60", "reach in pixels"), ("angle", "number", "0", "direction in degrees, clockwise"),
             ("center", "pair", "50,50", "centre of zoom and arc, in percent"), ("mix", "share", "70", "weight of the smear"), ("blend", "lighten|screen|normal", "lighten", "how it is laid over")],
    "aberration": [("amount", "number", "0.006", "how far red and blue grow apart")],
    "grain": [("strength", "share", "30", "depth of the grain"), ("size", "whole", "2", "pixels of a grain"), ("color", "flag", "false", "whether channels differ")],
    "fade": [("lift", "share", "12", "how light black becomes"), ("saturation", "whole", "80", "percent of the colour left"), ("tint", "color", "ff8c42", "what it leans to"), ("tint_amount", "share", "10", "how much")],
    "vignette": [("strength", "share", "50", "how dark corners become"), ("start", "share", "40", "where it begins")],
    "leak": [("color", "color", "ff963c", "of the light"), ("strength", "share", "70", "of the light"), ("size", "share", "50", "reach in percent of the width"),
             ("edge", "random|left|right|top|bottom", "random", "where it comes in"), ("spread", "whole", "0", "degrees of hue it wanders"), ("wobble", "share", "0", "unevenness")],
    "streaks": [("color", "color", "ff3a10", "at half brightness"), ("strength", "share", "85", "of the light"), ("count", "whole", "3", "of streaks"), ("width", "share", "28", "of a streak"),
                ("spread", "whole", "20", "degrees between edge and core"), ("wobble", "share", "0", "unevenness"), ("softness", "share", "40", "of the end"), ("position", "random or share", "random", "of the first")],
    "bloom": [("threshold", "whole", "200", "brightness that glows"), ("radius", "whole", "30", "pixels of the glow"), ("strength", "share", "60", "of the glow")],
    "slice": [("slices", "whole", "12", "number of slices"), ("shift", "whole", "120", "pixels at most"), ("height", "pair", "8,120", "least and most pixels"), ("split", "flag", "false", "channels apart"), ("invert", "flag", "false", "some turned negative")],
    "stretch": [("bands", "whole", "6", "number of lines"), ("length", "pair", "20,200", "least and most pixels"), ("direction", "horizontal|vertical", "horizontal", "rows or columns")],
    "split": [("red", "pair", "-6,0", "pixels right and down"), ("green", "pair", "0,0", "pixels right and down"), ("blue", "pair", "6,0", "pixels right and down")],
    "onepoint": [("hue", "hue", "0", "that stays"), ("width", "whole", "30", "degrees kept whole"), ("soft", "whole", "30", "degrees of fading"), ("rest", "share", "0", "colour of all else"),
                 ("at", "point?", "none", "point that gives the hue, in percent"), ("smooth", "number", "1", "softness of zones, in percent")],
    "tritone": [("dark", "color", "14052b", "of shadows"), ("mid", "color", "e0204f", "of mid tones"), ("light", "color", "ffd9a0", "of lights"), ("mix", "share", "100", "weight")],
    "falsecolor": [("order", "rgb|rbg|grb|gbr|brg|bgr", "bgr", "where channels come from"), ("invert", "channels", "none", "channels turned negative"), ("rotate", "whole", "0", "degrees of hue"), ("saturation", "whole", "100", "percent"),
                   ("only", "hue?", "none", "hue that moves"), ("width", "whole", "30", "degrees moved whole"), ("soft", "whole", "30", "degrees of fading"), ("smooth", "number", "1", "softness of zones, in percent"), ("mix", "share", "100", "weight")],
    "loss": [("generations", "whole", "30", "times saved"), ("quality", "whole", "25", "of a generation"), ("shift", "pair", "1,0", "pixels before each")],
    "bend": [("quality", "whole", "75", "before bending"), ("hits", "whole", "8", "bytes changed")],
    "dither": [("method", "diffusion|bayer", "diffusion", "of dots"), ("size", "whole", "2", "pixels of a dot"), ("mid", "whole", "128", "brightness of mid-grey")],
    "duotone": [("dark", "color", "000000", "of shadows"), ("light", "color", "ff4fa3", "of lights")],
    "scanlines": [("period", "whole", "4", "rows between lines"), ("thickness", "whole", "1", "rows of a line"), ("strength", "share", "60", "of lines")],
    "prism": [("kind", "linear|radial", "linear", "bands or rings"), ("angle", "whole", "0", "direction in degrees"), ("center", "pair", "50,100", "of rings, in percent"), ("position", "share", "30", "of the start"), ("size", "share", "40", "of the spectrum"),
              ("hue", "whole", "220", "of the start"), ("range", "whole", "-200", "degrees gone through"), ("strength", "share", "80", "of the light"), ("white", "share", "35", "of the core"), ("wobble", "share", "0", "unevenness")],
    "remap": [("map", "map", "", "pairs of hues, from and to"), ("width", "whole", "25", "degrees moved whole"), ("soft", "whole", "25", "degrees of fading"), ("smooth", "number", "1", "softness of zones, in percent"), ("saturation", "whole", "100", "percent"), ("mix", "share", "100", "weight")],
    "sort": [("direction", "horizontal|vertical", "horizontal", "rows or columns"), ("low", "whole", "40", "darkest sorted"), ("high", "whole", "220", "brightest sorted"), ("reverse", "flag", "false", "bright first")],
    "spin": [("angle", "number", "10", "degrees"), ("center", "pair", "50,50", "in percent"), ("steps", "whole", "0", "pictures blended, 0 for enough"), ("mix", "share", "100", "weight")],
    "liquid": [("amplitude", "whole", "40", "pixels at most"), ("scale", "whole", "150", "pixels of a wave"), ("octaves", "whole", "2", "layers"), ("drift", "whole", "0", "pixels drifted")],
}


class RecipeError(ValueError):
    pass


def colour(text: str) -> tuple[int, int, int]:
    """A named colour, or ``rgb`` or ``rrggbb`` digits."""
    digits = text.removeprefix("#").lower()
    if text.lower() in COLOURS:
        return COLOURS[text.lower()]
    if not re.fullmatch(r"[0-9a-f]{3}|[0-9a-f]{6}", digits):
        raise RecipeError(f"{text} is no colour")
    digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
    return tuple(bytes.fromhex(digits))


def hue(text: str) -> float:
    """Degrees, or the hue of a colour."""
    degrees = text.strip().removesuffix("deg").removesuffix("\u00b0")
    if re.fullmatch(r"[-+]?[0-9]*[.]?[0-9]+", degrees):
        return float(degrees) % 360
    red, green, blue = (c / 255 for c in colour(text))
    most, least = max(red, green, blue), min(red, green, blue)
    if most == least:
        raise RecipeError(f"{text} is a grey, it has no hue")
    part = {blue: 4 + (red - green) / (most - least), green: 2 + (blue - red) / (most - least), red: (green - blue) / (most - least)}
    return 60 * part[most] % 360


def number(text: str, moment: float) -> float:
    """A number, or that of a range at a moment."""
    low, high = ends_of(text)
    return low + (high - low) * moment


def typed(kind: str, text: str, moment: float = 0.0):
    """The value of a parameter's text; a text that is none of its kind is an error."""
    if kind in ("whole", "share"):
        value = round(number(text, moment))
        if kind == "share" and not 0 <= value <= 100:
            raise RecipeError(f"{text} is not between 0 and 100")
        return value
    if kind == "number":
        return number(text, moment)
    if kind == "random or share":
        return text if text == "random" else typed("share", text, moment)
    if kind == "flag":
        if text not in ("true", "false"):
            raise RecipeError(f"{text} is neither true nor false")
        return text == "true"
    if kind == "color":
        return colour(text)
    if kind in ("hue", "hue?"):
        return None if text == "none" and kind == "hue?" else hue(text)
    if kind in ("pair", "point?"):
        if text == "none" and kind == "point?":
            return None
        both = text.split(",")
        if len(both) != 2:
            raise RecipeError(f"{text} is no pair")
        return tuple(round(number(x, moment)) for x in both)
    if kind == "channels":
        if text != "none" and (not re.fullmatch("[rgb]{1,3}", text) or len(set(text)) < len(text)):
            raise RecipeError(f"{text} names no channels")
        return "" if text == "none" else text
    if kind == "map":
        pairs = [p.split(":") for p in text.split(",") if p]
        if any(len(p) != 2 for p in pairs) or len(pairs) > 8:
            raise RecipeError(f"{text} is no list of at most 8 pairs from:to")
        return [(hue(a), hue(b)) for a, b in pairs]
    if text not in kind.split("|"):
        raise RecipeError(f"{text} is none of {kind.replace('|', ', ')}")
    return text


def value_at(kind: str, text: str, default: str, moment: float = 0.0, cycle: float = 0.0):
    """A parameter's value at a time: its text, or the step of its pattern. All steps are checked; a rest is the default."""
    if is_pattern(text):
        for atom in compiled(text)[1]:
            typed(kind, atom, moment)
        text = pattern_at(text, cycle)
    return typed(kind, default if text is None else text, moment)


def defaults(effect: str) -> dict:
    """The typed values of an effect's parameters where a recipe gives none."""
    return {name: typed(kind, default) for name, kind, default, _ in PARAMETERS.get(effect, ())}


def checked(effect: str, pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The texts of an effect's parameters, all of them, in their order; what is not given has its default. Of repeats the last counts."""
    if effect not in PARAMETERS:
        hint = ": a pattern with blanks keeps its quotes" if re.fullmatch(r"-?[0-9.]+", effect) else ""
        raise RecipeError(f"unknown effect {effect}{hint}")
    known = {name: (kind, default) for name, kind, default, _ in PARAMETERS[effect]}
    out = {name: default for name, (_, default) in known.items()}
    for name, text in pairs:
        if name not in known:
            raise RecipeError(f"{effect} has no parameter {name}")
        try:
            value_at(*[known[name][0], text, known[name][1]])
        except (PatternError, RecipeError) as e:
            raise RecipeError(f"{effect}: {name}: {e}") from None
        out[name] = text
    return out


def describe(spark: SparkSession) -> DataFrame:
    """``(effect, place, parameter, kind, default, help)`` of all parameters."""
    rows = [(effect, k, *own) for effect, params in PARAMETERS.items() for k, own in enumerate(params)]
    return spark.createDataFrame(rows, "effect string, place int, parameter string, kind string, `default` string, help string")
