"""Animations: the frames of a recipe over time, for all pictures in one plan.

A picture's frame is a picture of its own, numbered ``pic * frames + frame``, so effects stay partitioned by picture. A parameter
that changes with time is a column: the frame's entry in a literal array, as short as the animation. Effects on whole pictures pick
the frame's effect in the task. What can be neither (bands drawn from a seed that moves) is a union over the frames that differ.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.effects import REGISTRY
from ..operators.named import AS_COLUMNS, WHOLE
from ..operators.plates import gathered, repainted_by, spread
from .parameters import defaults
from .recipe import parse_recipe

#: How a moment of the ranges follows from one of the animation.
EASINGS = {"smooth": lambda t: t * t * (3 - 2 * t), "linear": lambda t: t, "in": lambda t: t * t, "out": lambda t: 1 - (1 - t) ** 2}


def frame_steps(text: str, frames: int, easing: str = "smooth", jitter: bool = True) -> list[list[tuple[str, dict]]]:
    """The steps of a recipe at each frame: ranges over the frames, patterns once through, with ``jitter`` another seed each."""
    if frames < 1:
        raise ValueError("an animation has at least one frame")
    out = []
    for k in range(frames):
        steps = parse_recipe(text, EASINGS[easing](k / max(frames - 1, 1)), k / frames)
        out.append([(name, defaults(name) | own | ({"seed": own["seed"] + k} if jitter and "seed" in own else {})) for name, own in steps])
    return out


def _by_frame(values: list, number: Column) -> Column | tuple:
    """A value of each frame as a column; colours as a column a channel."""
    if isinstance(values[0], tuple):
        return tuple(_by_frame(list(v), number) for v in zip(*values, strict=True))
    if isinstance(values[0], int):
        values = [(v + 2**63) % 2**64 - 2**63 for v in values]
    return F.get(F.array(*[F.lit(v) for v in values]), number)


def _kind(name: str, params: list[dict]) -> str:
    """How a step is done for all frames: as one effect, on whole pictures, by columns or as a union."""
    changing = {key for key in params[0] if any(p[key] != params[0][key] for p in params)}
    if not changing:
        return "same"
    if name in WHOLE and all(WHOLE[name](p) for p in params):
        return "whole"
    plain = name not in WHOLE or not any(WHOLE[name](p) for p in params)
    return "columns" if plain and changing <= AS_COLUMNS.get(name, set()) else "union"


def plan_kinds(text: str, frames: int = 24, easing: str = "smooth", jitter: bool = True) -> list[str]:
    """How each step of a recipe is done for all frames."""
    return [_kind(step[0][0], [p for _, p in step]) for step in zip(*frame_steps(text, frames, easing, jitter), strict=True)]


def animate(px: DataFrame, width: int, height: int, text: str, frames: int = 24, easing: str = "smooth", boomerang: bool = True, jitter: bool = True) -> DataFrame:
    """``(pic, frame, y, x, r, g, b)``: every picture of ``px`` at every frame of a recipe.

    With ``boomerang`` the frames between the first and the last come again, backwards. An empty table gives no rows.
    """
    at_frame = frame_steps(text, frames, easing, jitter)
    number = F.pmod("pic", F.lit(frames)).cast("int")
    numbered = F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))
    now = px.select(F.col("pic").cast("long").alias("pic"), "y", "x", *"rgb", numbered.alias("frame"))
    now = now.select((F.col("pic") * frames + F.col("frame")).alias("pic"), "y", "x", *"rgb")
    steps = [(_kind(step[0][0], [p for _, p in step]), step) for step in zip(*at_frame, strict=True)]
    for kind, run in groupby(steps, lambda s: s[0]):
        run = [step for _, step in run]
        if kind == "union":
            now = _united(now, width, height, run, number)
            continue
        for step in run:
            name, params = step[0][0], [p for _, p in step]
            if kind == "whole":
                effects = [REGISTRY[name](None, width, height, **p) for p in params]
                now = spread(repainted_by(gathered(now, width, height), lambda pic, own=effects: own[pic % frames]))
            else:
                given = {k: v if all(p[k] == v for p in params) else _by_frame([p[k] for p in params], number) for k, v in params[0].items()}
                now = REGISTRY[name](now, width, height, **given)
    frame = F.pmod("pic", F.lit(frames)).cast("int")
    places = F.array(frame)
    if boomerang and frames > 2:
        places = F.when((frame > 0) & (frame < frames - 1), F.array(frame, 2 * (frames - 1) - frame)).otherwise(places)
    shown = now.select(F.expr(f"(pic - pmod(pic, {frames})) div {frames}").alias("pic"), "y", "x", *"rgb", F.explode(places).alias("frame"))
    return shown.select("pic", "frame", "y", "x", *"rgb")


def _united(px: DataFrame, width: int, height: int, steps: list, number: Column) -> DataFrame:
    """Steps one after another for each set of frames that share all their parameters."""
    alike: dict[str, list[int]] = {}
    for k in range(len(steps[0])):
        alike.setdefault(repr([step[k] for step in steps]), []).append(k)
    parts = []
    for ks in alike.values():
        own = px.where(number.isin(ks))
        for step in steps:
            name, params = step[ks[0]]
            own = REGISTRY[name](own, width, height, **params)
        parts.append(own.select("pic", "y", "x", *"rgb"))
    return reduce(DataFrame.unionByName, parts)
