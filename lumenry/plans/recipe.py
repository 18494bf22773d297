"""Recipe texts, such as ``seed=7 falsecolor order=bgr + every 4 rev spin angle="5 20"``, as lists of effect steps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import named  # noqa: F401  registers the effects under the names that recipes use
from ..operators.seeded import SEEDED
from .parameters import PARAMETERS, RecipeError, checked, value_at
from .pattern import Change, PatternError, is_pattern, pattern_value, range_value, read_change, split_words

__all__ = ["RecipeError", "parse_recipe", "print_recipe", "recipe_frames"]

class Step(NamedTuple):
    effect: str
    given: list[tuple[str, str]]
    texts: dict[str, str]
    changes: list[Change]


def read_recipe(text: str) -> tuple[int, list[Step]]:
    """The seed and the steps of a recipe, their parameters checked but still as texts.

    ``seed=N`` may stand before the first effect; a ``+`` may part effects; changes of the cycle count for
    the next effect only. An unknown effect or parameter, a value that is none, or an empty text is an error.
    """
    words, seed, steps, at = split_words(text), 1, [], 0
    current: tuple[str, list[tuple[str, str]], list[Change]] | None = None
    changes: list[Change] = []

    def closed() -> None:
        if current:
            steps.append(Step(current[0], current[1], checked(current[0], current[1]), current[2]))

    try:
        while at < len(words):
            name, equals, value = words[at].partition("=")
            change = None if equals else read_change(words, at)
            at += change[1] if change else 1
            if change:
                closed()
                current = None
                changes.append(change[0])
            elif equals and current:
                current[1].append((name, value))
            elif equals:
                if name != "seed" or steps or changes:
                    raise RecipeError(f"{name} stands before any effect")
                if not value.isdigit():
                    raise RecipeError(f"seed: {value} is no whole number")
                seed = int(value)
            elif name != "+":
                closed()
                current, changes = (name, [], changes), []
        closed()
    except PatternError as e:
        raise RecipeError(str(e)) from None
    if not steps:
        raise RecipeError("the recipe is empty")
    return seed, steps


def _kinds(effect: str) -> dict[str, tuple[str, str]]:
    return {name: (kind, default) for name, kind, default, _ in PARAMETERS[effect]}


def parse_recipe(text: str, moment: float = 0.0, cycle: float = 0.0) -> list[tuple[str, dict]]:
    """Steps of a recipe at a time, with the parameters that are given, typed.

    Ranges stand at ``moment``, patterns at ``cycle``. Step ``k`` of the effects that draw gets seed ``N + k``.
    """
    seed, steps = read_recipe(text)
    out = []
    for k, step in enumerate(steps):
        now, kinds = cycle, _kinds(step.effect)
        for change in step.changes:
            now = change.plain(now)
        params = {name: value_at(kinds[name][0], value, kinds[name][1], moment, now) for name, value in step.given}
        out.append((step.effect, {**params, "seed": seed + k} if step.effect in SEEDED else params))
    return out


def change_words(change: Change) -> str:
    """A change as recipes write it; the factor is exact, so a slow one may come back as a fast one below 1."""
    often = f"every {change.every} " if change.every > 1 else ""
    return often + ("rev" if change.back else f"fast {change.factor!r}")


def print_recipe(text: str) -> str:
    """The recipe with all parameters of its effects and its changes; it reads back as the same."""
    seed, steps = read_recipe(text)
    parts = [" ".join([*map(change_words, step.changes), step.effect, *(f"{name}={value}" for name, value in step.texts.items() if value)]) for step in steps]
    return f"seed={seed} " + " + ".join(parts)


def recipe_frames(frames: DataFrame, text: str, moment: str = "moment", cycle: str = "cycle") -> DataFrame:
    """``(..., step, effect, parameter, value)``: for each of ``frames`` the texts of all parameters that are given.

    A rest is the default, a range the number at the frame's moment. All frames get their values in one projection.
    """
    _, steps = read_recipe(text)
    rows = []
    for k, step in enumerate(steps):
        now: Column = F.col(cycle).cast("double")
        for change in step.changes:
            now = change.column(now)
        kinds = _kinds(step.effect)
        for name, value in step.given:
            kind, default = kinds[name]
            if is_pattern(value):
                at = F.coalesce(pattern_value(value, now), F.lit(default))
            elif kind in ("whole", "share", "number") and ".." in value:
                at = range_value(value, F.col(moment))
                at = (at if kind == "number" else F.round(at).cast("long")).cast("string")
            else:
                at = F.lit(value)
            rows.append(F.struct(F.lit(k).alias("step"), F.lit(step.effect).alias("effect"), F.lit(name).alias("parameter"), at.alias("value")))
    return frames.select("*", F.inline(F.array(*rows))) if rows else frames.select("*", *[F.lit(None).alias(c) for c in ("step", "effect", "parameter", "value")]).limit(0)
