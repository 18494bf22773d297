"""Effects without parameters are those that their printed form tells; whole-picture effects against plain loops."""

import math

import numpy as np
import pytest

from lumenry.functions.draws import Draws
from lumenry.operators import keyfile, plate_effects, plates
from lumenry.operators.effects import BAYER, REGISTRY, apply_recipe
from lumenry.plans.parameters import PARAMETERS
from lumenry.plans.pattern import split_words
from lumenry.plans.recipe import parse_recipe, print_recipe, read_recipe

from .test_whole_pictures import H, W, byte, painted, picture, pixel_table, plate


@pytest.mark.parametrize("effect", sorted(set(PARAMETERS) & set(REGISTRY)))
def test_bare_effects_equal_their_printed_form(spark, effect):
    px = pixel_table(spark, [picture(1)])
    bare, printed = (painted(apply_recipe(px, W, H, parse_recipe(text))) for text in (effect, print_recipe(effect)))
    assert bare == printed and len(bare) == W * H


def test_comments_and_changes():
    assert split_words('leak color=#ff963c #warm\n#all\nspin angle="5 # 7" # x "y\nfade#z') == ["leak", "color=#ff963c", "spin", 'angle="5 # 7"', "fade#z"]
    for text in ("every 4 rev spin angle=20", "slow 4 grain", "fast 3 every 2 rev fade + every 6 slow 3 leak"):
        one = read_recipe(text)
        assert [(s.effect, s.changes, {k: v for k, v in s.texts.items() if v}) for s in read_recipe(print_recipe(text))[1]] == [(s.effect, s.changes, {k: v for k, v in s.texts.items() if v}) for s in one[1]]


def plain_spin(p, angle):
    h, w = len(p), len(p[0])
    cx, cy, sweep, out = 0.5 * (w - 1), 0.5 * (h - 1), math.radians(angle), {}
    at = lambda y, x, c: p[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)][c]
    for y in range(h):
        for x in range(w):
            dx, dy = x - cx, y - cy
            n = min(96, max(2, math.ceil(math.hypot(dx, dy) * sweep / 4)))
            total = [0.0] * 3
            for k in range(n):
                a = -sweep / 2 + sweep * k / (n - 1)
                u, v = cx + dx * math.cos(a) - dy * math.sin(a), cy + dx * math.sin(a) + dy * math.cos(a)
                i, j = math.floor(u), math.floor(v)
                for c in range(3):
                    top = at(j, i, c) * (1 - (u - i)) + at(j, i + 1, c) * (u - i)
                    low = at(j + 1, i, c) * (1 - (u - i)) + at(j + 1, i + 1, c) * (u - i)
                    total[c] += top * (1 - (v - j)) + low * (v - j)
            out[0, y, x] = tuple(byte(round(t / n, 9)) for t in total)
    return out


def test_automatic_spin_equals_loops(spark):
    p = picture(2)
    assert painted(plates.spread(plate_effects.spin(plate(spark, [p]), angle=140))) == plain_spin(p, 140)


def test_diffusion_equals_the_pixel_loop():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 9), (9, 1), (13, 22), (30, 7)):
        light = rng.integers(0, 256, (h, w)).astype(float)
        held, white = light.copy(), np.zeros((h, w), bool)
        for y in range(h):
            for x in range(w):
                white[y, x] = held[y, x] >= 128
                error = held[y, x] - 255.0 * white[y, x]
                for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        held[y + dy, x + dx] += error * share / 16
        assert (plate_effects.diffused(light) == white).all()


def test_dots_of_two_pixels(spark):
    p = picture(5, 1000, 2)
    out = painted(plates.spread(plate_effects.dither(plate(spark, [p]), method="bayer", size=2, mid=100)))
    for x in range(0, 1000, 2):
        mean = [[sum(w * p[y][min(max(x + k, 0), 999)][c] for k, w in zip((-1, 0, 1, 2), (1, 3, 3, 1)) if 0 <= x + k < 1000) / sum(w for k, w in zip((-1, 0, 1, 2), (1, 3, 3, 1)) if 0 <= x + k < 1000) for c in range(3)] for y in (0, 1)]
        cell = [byte(round((mean[0][c] + mean[1][c]) / 2, 9)) for c in range(3)]
        light = (299 * cell[0] + 587 * cell[1] + 114 * cell[2]) // 1000 + 28
        ink = 255 if min(255, light) >= (BAYER[0][x // 2 % 8] + 0.5) * 4 else 0
        assert {out[0, y, x + k] for y in (0, 1) for k in (0, 1)} == {(ink,) * 3}


@pytest.mark.parametrize("own", [{}, {"edge": "right"}, {"edge": "top", "wobble": 60, "spread": 30}])
def test_leak_equals_loops(spark, own):
    p, seed = picture(7), 11
    edge, wobble, spread_ = own.get("edge", "random"), own.get("wobble", 0), own.get("spread", 0)
    drawn = Draws(seed)
    if edge == "random":
        along, side = drawn.below(1001) / 1000, drawn.below(4)
        ox, oy = [(0, H * along), (W, H * along), (W * along, 0), (W * along, H)][side]
    out = painted(plates.spread(plate_effects.leak(plate(spark, [p]), seed=seed, **own)))
    for y in range(H):
        for x in range(W):
            away = {"random": lambda: math.hypot(x - ox, y - oy), "right": lambda: W - x, "top": lambda: y}[edge]()
            reach, power = W * 0.5, 0.7
            if wobble:
                continue
            glow = min(1, max(0, 1 - away / max(1, reach))) ** 2 * power
            assert out[0, y, x] == tuple(byte(c + (255 - (255 - c) * (255 - i) / 255 - c) * glow) for c, i in zip(p[y][x], (255, 150, 60)))
    if wobble:
        calm = painted(plates.spread(plate_effects.leak(plate(spark, [p]), seed=seed, edge="top")))
        assert out != calm and out == painted(plates.spread(plate_effects.leak(plate(spark, [p]), seed=seed, **own)))
        assert spread_ and all(out[0, H - 1, x] == tuple(p[H - 1][x]) for x in range(W))


def test_slices_of_single_channels(spark):
    p = picture(8)
    out = painted(plates.spread(plate_effects.slices(plate(spark, [p]), count=3, shift=5000, tall=(200, 400), split=True, invert=True, seed=4)))
    drawn, want = Draws(4), [[list(c) for c in row] for row in p]
    unit = lambda v: math.floor(v * W / 1000 + 0.5)
    for _ in range(3):
        rows = max(1, drawn.between(unit(200), unit(400)))
        top, moves = drawn.below(H), [drawn.around(unit(5000)) for _ in range(3)]
        negative = drawn.below(3) == 0
        for y in range(top, min(H, top + rows)):
            for x in range(W):
                own = [p[y][(x - dx) % W][c] for c, dx in enumerate(moves)]
                want[y][x] = [255 - v for v in own] if negative else own
    assert out == {(0, y, x): tuple(want[y][x]) for y in range(H) for x in range(W)}


def test_exposure_shift_is_at_most_two_stops(spark):
    preset = spark.createDataFrame([("a", "Exposure", "Compensation", "0.5"), ("b", "Exposure", "Compensation", "x")], "path string, section string, key string, value string")
    light = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.2, 0.0), ("c", 0.1, 0.8), ("d", None, 0.1)], "path string, reference double, own double")
    got = {r["path"]: float(r["value"]) for r in keyfile.automatic(preset, light).collect()}
    assert got == {"a": 2.5, "b": 0.0, "c": -2.0}


