"""Every frame of an animation equals the recipe applied at its time."""

import pytest

from lumenry.operators.effects import apply_recipe
from lumenry.plans.animation import EASINGS, animate, plan_kinds
from lumenry.plans.recipe import parse_recipe

from .test_whole_pictures import H, W, painted, picture, pixel_table

RECIPES = {
    "tritone mix=20..90 scanlines period=40..160 thickness=50 strength=0..60 fade saturation=20..300 lift=0..30": ["columns"] * 3,
    "vignette strength=0..80 start=20..100 + duotone dark=\"000000 400010\" light=ffd9a0 + sort low=\"30 200\" high=120": ["columns"] * 3,
    "grain strength=10..90 leak edge=left size=0..80 strength=20..70 bloom radius=80 threshold=100..255 strength=30..60": ["columns"] * 3,
    "liquid amplitude=10..90 aberration amount=0.0..0.2 spin steps=3 angle=0..40": ["columns"] * 3,
    "leak spin angle=5..60 onepoint hue=\"0 200\" slice invert=true": ["whole"] * 4,
    "prism hue=0..120 position=10..40 slice slices=3 stretch bands=2 fade": ["columns", "union", "union", "same"],
}


def by_hand(spark, pictures, text, frames, easing, jitter):
    out = []
    for k in range(frames):
        steps = parse_recipe(text, EASINGS[easing](k / max(frames - 1, 1)), k / frames)
        steps = [(n, {**p, "seed": p["seed"] + k} if jitter and "seed" in p else p) for n, p in steps]
        out.append(painted(apply_recipe(pixel_table(spark, pictures), W, H, steps)))
    return out


@pytest.mark.parametrize("text", RECIPES)
def test_frames_equal_the_recipe_at_their_time(spark, text):
    pictures, frames = [picture(5), picture(6)], 3
    assert plan_kinds(text, frames) == RECIPES[text]
    found = animate(pixel_table(spark, pictures), W, H, text, frames).collect()
    want = by_hand(spark, pictures, text, frames, "smooth", True)
    want += want[1:2]
    got = [{} for _ in want]
    for r in found:
        got[r["frame"]][r["pic"], r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert len(found) == len(want) * 2 * W * H
    for g, w in zip(got, want, strict=True):
        assert g == w


def test_without_jitter_or_way_back_and_empty(spark):
    px = pixel_table(spark, [picture(7)])
    still = animate(px, W, H, "grain", frames=3, jitter=False, boomerang=False).collect()
    assert {r["frame"] for r in still} == {0, 1, 2}
    assert len({(r["y"], r["x"], r["r"], r["g"], r["b"]) for r in still}) == W * H
    assert plan_kinds("grain", 3, jitter=False) == ["same"]
    assert animate(px.where("false"), W, H, "leak spin angle=5..60", 3).count() == 0
    with pytest.raises(ValueError):
        animate(px, W, H, "grain", frames=0)
