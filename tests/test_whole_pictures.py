"""Soft maps, light bands and row bands against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry.operators import bands, named, plates  # noqa: F401
from lumenry.operators.effects import REGISTRY
from lumenry.plans.recipe import parse_recipe

W, H = 23, 17


def picture(seed, w=W, h=H):
    rng = random.Random(seed)
    return [[[rng.randrange(256) for _ in range(3)] for _ in range(w)] for _ in range(h)]


def plate(spark, pictures):
    rows = [(k, len(p[0]), len(p), [c for row in p for cell in row for c in cell]) for k, p in enumerate(pictures)]
    return spark.createDataFrame(rows, plates.PLATE)


def pixel_table(spark, pictures):
    rows = [(k, y, x, *cell) for k, p in enumerate(pictures) for y, row in enumerate(p) for x, cell in enumerate(row)]
    return spark.createDataFrame(rows, "pic long, y int, x int, r int, g int, b int")


def painted(df):
    return {(r["pic"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in df.collect()}


def hsv(r, g, b):
    top, low = max(r, g, b), min(r, g, b)
    if top == low:
        return 0.0, 0.0, top
    part = ((g - b) / (top - low)) % 6 if top == r else (b - r) / (top - low) + 2 if top == g else (r - g) / (top - low) + 4
    return 60 * part, (top - low) / top, top


def step(lo, hi, x):
    t = min(1, max(0, (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def zone(cell, centre, width, soft):
    hue, saturation, _ = hsv(*cell)
    gap = abs(math.floor(hue * 10 + 0.5) / 10 - centre) % 360
    return (1 - step(width, width + max(soft, 1), min(gap, 360 - gap))) * step(0.02, 0.06, saturation)


def plain_blur(cells, sigma):
    """Both passes cell by cell, edges extended."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    total, h, w = sum(kernel), len(cells), len(cells[0])
    at = lambda v, n: min(max(v, 0), n - 1)
    rows = [[sum(k * cells[y][at(x + i - reach, w)] for i, k in enumerate(kernel)) / total for x in range(w)] for y in range(h)]
    return [[sum(k * rows[at(y + i - reach, h)][x] for i, k in enumerate(kernel)) / total for x in range(w)] for y in range(h)]


def byte(v):
    return min(255, max(0, math.floor(v + 0.5)))


@pytest.mark.parametrize("smooth", [0, 4])
def test_onepoint_equals_loops(spark, smooth):
    p = picture(1)
    weights = [[zone(c, 200, 40, 30) for c in row] for row in p]
    if smooth:
        weights = plain_blur(weights, smooth / 100 * W)
    out = painted(plates.spread(plates.onepoint(plate(spark, [p]), hue=200, width=40, smooth=smooth, rest=20)))
    for y in range(H):
        for x in range(W):
            grey = (299 * p[y][x][0] + 587 * p[y][x][1] + 114 * p[y][x][2]) // 1000
            faded = [grey + (c - grey) * 0.2 for c in p[y][x]]
            assert out[0, y, x] == tuple(byte(f + (c - f) * weights[y][x]) for f, c in zip(faded, p[y][x]))


def test_soft_and_sharp_forms_agree(spark):
    """With no smoothing the whole-picture forms equal the pixel columns."""
    pictures = [picture(2), picture(3)]
    px, whole = pixel_table(spark, pictures), plate(spark, pictures)
    assert painted(plates.spread(whole)) == painted(px) == painted(plates.spread(plates.gathered(px, W, H)))
    assert painted(REGISTRY["onepoint"](px, W, H, hue=100, smooth=0)) == painted(plates.spread(plates.onepoint(whole, hue=100, smooth=0)))
    sharp = painted(REGISTRY["falsecolor"](px, W, H, only=30, rotate=40, saturation=150, smooth=0, mix=70))
    assert sharp == painted(plates.spread(plates.falsecolor(whole, only=30, rotate=40, saturation=150, smooth=0, mix=70)))
    moves = [(0, 120), (210, 30)]
    assert painted(REGISTRY["remap"](px, W, H, map=moves, smooth=0)) == painted(plates.spread(plates.remap(whole, moves, smooth=0)))
    for name, own in (("onepoint", {}), ("falsecolor", {"only": 30}), ("remap", {"map": moves})):
        assert painted(REGISTRY[name](px, W, H, **own, smooth=9)) != painted(REGISTRY[name](px, W, H, **own, smooth=0))


def test_remap_of_soft_zones_equals_loops(spark):
    p, moves, smooth = picture(4), [(20, 140), (240, 200)], 5
    near, turn = [], []
    for row in p:
        each = [[(1 - step(25, 50, min(g := abs(math.floor(hsv(*c)[0] * 10 + 0.5) / 10 - a) % 360, 360 - g))) * step(0.02, 0.06, hsv(*c)[1]) for a, _ in moves] for c in row]
        near.append([sum(e) for e in each])
        turn.append([e[0] * 120 - e[1] * 40 for e in each])
    near, turn = (plain_blur(cells, smooth / 100 * W) for cells in (near, turn))
    out = painted(plates.spread(plates.remap(plate(spark, [p]), moves, smooth=smooth)))
    for y in range(H):
        for x in range(W):
            hue, saturation, value = hsv(*p[y][x])
            amount = min(near[y][x], 1)
            want = tuple(p[y][x])
            if amount > 1e-4:
                h = hue + turn[y][x] / near[y][x]
                ks = [(n + h / 60) % 6 for n in (5, 3, 1)]
                moved = [value - value * saturation * max(0, min(k, 4 - k, 1)) for k in ks]
                want = tuple(byte(c + (m - c) * amount) for c, m in zip(p[y][x], moved))
            assert out[0, y, x] == want


def test_large_pictures_are_judged_on_a_small_copy():
    big = np.zeros((500, 1000, 3)) + [220, 20, 20]
    big[:, 500:] = [20, 20, 220]
    big[100:102, 200:202] = [20, 20, 220]
    red = lambda p: (p[..., 0] > p[..., 1] + p[..., 2]).astype(float)[..., None]
    soft = plates.soft_map(big, 2.0, red)[..., 0]
    assert soft.shape == (500, 1000) and soft[100, 201] > 0.9 and 0.3 < soft[250, 500] < 0.7 and soft[250, 100] > 0.99 and soft[250, 900] < 0.01
    assert np.allclose(plates.shrinking(1000, 384).sum(1), 1) and np.allclose(plates.reading(1000, 384, 1000 / 384).sum(1), 1)


def test_hue_of_a_point(spark):
    p = [[[10, 10, 10] for _ in range(W)] for _ in range(H)]
    for y in range(6, 12):
        for x in range(9, 15):
            p[y][x] = [20, 200, 20]
    out = painted(plates.spread(plates.onepoint(plate(spark, [p]), hue=0, at=(50, 50), smooth=0)))
    assert out[0, 8, 11] == (20, 200, 20)
    assert plates.hue_at(np.array(p, float), (0, 0), 77.0) == 77.0 and plates.hue_at(np.array(p, float), (50, 50), 0.0) == 120.0


def test_recipes_run_with_soft_zones(spark):
    px = pixel_table(spark, [picture(6)])
    (name, params), = parse_recipe("onepoint hue=red width=20")
    assert painted(REGISTRY[name](px, W, H, **params)) == painted(REGISTRY["onepoint"](px, W, H, hue=0.0, width=20, smooth=1))


def striped(w, h, period=None, depth=0.12, seed=0, across="y"):
    rng = np.random.default_rng(seed)
    ys, xs = np.mgrid[:h, :w]
    light = 90 + rng.integers(0, 23, (h, w)) + 20 * np.sin(xs / 90)
    if period:
        light = light * (1 + depth * np.sin(2 * np.pi * (ys if across == "y" else xs) / period))
    return np.clip(np.floor(light), 0, 255).astype(int)


def plain_light_bands(light):
    """Block by block and period by period."""
    if light.shape[1] < light.shape[0]:
        light = light.T
    (h, w), peaks, count = light.shape, [], 0
    for v in range(0, w - 255, 128):
        for u in range(0, h - 255, 128):
            count += 1
            profile = [math.log(sum(light[u + i, v : v + 256].tolist()) / 256 + 4) for i in range(256)]
            signal = []
            for i in range(256):
                a, b = max(0, i - 8), min(256, i + 9)
                signal.append((profile[i] - sum(profile[a:b]) / (b - a)) * (0.5 - 0.5 * math.cos(2 * math.pi * i / 256)))
            power = {}
            for tenth in range(60, 641):
                period = tenth / 10
                if abs(256 / period - 64) > 2.5 and abs(256 / period - 32) > 2.5 and abs(period - 16) > 0.3:
                    waves = [sum(s * f(2 * math.pi * i / period) for i, s in enumerate(signal)) for f in (math.cos, math.sin)]
                    power[period] = waves[0] ** 2 + waves[1] ** 2
            middle, best = sorted(power.values())[len(power) // 2], max(power, key=power.get)
            if power[best] / middle > 10:
                peaks.append((best, power[best] / middle))
    found, most = (0.0, 0.0, 0.0), 0
    for period, _ in peaks:
        with_it = [r for other, r in peaks if abs(other - period) / period < 0.04]
        if len(with_it) > most:
            most, found = len(with_it), (period, len(with_it) / count, max(with_it))
    return found


def test_light_bands_equal_loops(spark):
    cases = [striped(300, 256), striped(400, 260, 11.3, seed=1), striped(256, 390, 25.0, across="x", seed=2), striped(255, 400, 12.0), striped(520, 400, 40.0, depth=0.03, seed=3)]
    rows = [(k, p.shape[1], p.shape[0], p.ravel().tolist()) for k, p in enumerate(cases)]
    out = {r["pic"]: r for r in bands.light_bands(spark.createDataFrame(rows, "pic long, width int, height int, light array<short>")).collect()}
    assert out[3]["period"] is None and out[3]["banded"] is None
    for k in (0, 1, 2):
        period, coverage, peak = plain_light_bands(cases[k])
        assert (out[k]["period"], out[k]["coverage"]) == (period, coverage) and out[k]["peak"] == pytest.approx(peak, rel=1e-6)
    assert not out[0]["banded"] and out[1]["banded"] and out[2]["banded"]
    assert abs(out[1]["period"] - 11.3) < 0.2 and abs(out[2]["period"] - 25) < 0.5
    grey = plates_of_grey(spark, cases[1])
    assert bands.light_bands(grey).first()["period"] == out[1]["period"]
    assert bands.light_bands(grey.limit(0)).isEmpty()


def plates_of_grey(spark, light):
    return spark.createDataFrame([(0, light.shape[1], light.shape[0], np.repeat(light.ravel(), 3).tolist())], plates.PLATE)


PATTERN, BLACK, WHITE = ((0, 1), (1, 2)), (140.0, 141.0, 142.0, 140.0), (4095.0,) * 4


def raw_picture(period=None, colours=(0,), h=2600, w=64, depth=0.05, seed=0):
    rng = np.random.default_rng(seed)
    ys, xs = np.mgrid[:h, :w]
    colour = np.tile(np.array(PATTERN), (h // 2, w // 2))
    base = np.array([1200, 2000, 900])[colour] * (0.6 + 0.4 * ys / h) * (0.8 + 0.2 * np.cos(xs / 20))
    if period:
        base = base * np.where(np.isin(colour, colours), 1 + depth * np.sin(2 * np.pi * ys / period), 1)
    return np.round(base + rng.integers(-20, 21, (h, w)) + np.array(BLACK)[colour]).astype(int)


def test_row_bands_are_found_and_removed(spark):
    cases = [raw_picture(), raw_picture(101.7, seed=1), raw_picture(62.3, (0, 1, 2), seed=2), raw_picture(150.0, h=400, seed=3), raw_picture(w=20, seed=4)]
    rows = [(k, p.shape[1], p.shape[0], p.ravel().tolist()) for k, p in enumerate(cases)]
    df = spark.createDataFrame(rows, "pic long, width int, height int, raw array<int>")
    out = {r["pic"]: r for r in bands.row_bands(df, PATTERN, BLACK, WHITE).collect()}
    for k in (0, 3, 4):
        assert out[k]["period"] is None and out[k]["raw"] == cases[k].ravel().tolist()
    for k, period, colours in ((1, 101.7, (0,)), (2, 62.3, (0, 1, 2))):
        r = out[k]
        assert abs(r["period"] - period) < 0.3
        for c in range(3):
            if c in colours:
                assert r["peaks"][c] >= bands.ROW_PEAK and 0.03 < r["amplitudes"][c] < 0.07 and r["residual"][c] < r["peaks"][c] / 10
            else:
                assert r["amplitudes"][c] == 0
        changed = np.array(r["raw"]).reshape(cases[k].shape) != cases[k]
        colour = np.tile(np.array(PATTERN), (1300, 32))
        assert not changed[~np.isin(colour, colours)].any() and changed[np.isin(colour, colours)].mean() > 0.5
        clean = raw_picture(seed=k).astype(float)
        own = np.isin(colour, colours)
        assert np.abs(np.array(r["raw"]).reshape(clean.shape) - clean)[own].mean() < np.abs(cases[k] - clean)[own].mean() / 2


def test_parts_of_the_row_model_equal_loops():
    rng = np.random.default_rng(7)
    values = rng.normal(size=90)
    for half in (3, 200):
        assert np.allclose(bands.moving_mean(values, half), [values[max(0, i - half) : i + half + 1].mean() for i in range(90)])
    rows = np.arange(0, 180, 2)
    plain = [sum(v * math.cos(2 * math.pi * r / p) for v, r in zip(values, rows)) ** 2 + sum(v * math.sin(2 * math.pi * r / p) for v, r in zip(values, rows)) ** 2 for p in (20.5, 33.3)]
    assert np.allclose(bands.wave_powers(values[None, :], rows, np.array([20.5, 33.3]))[0], plain)
    powers = rng.random(len(bands.ROW_PERIODS)) + 0.1
    for k in (0, 500, 3809):
        p = bands.ROW_PERIODS[k]
        tenth = lambda q: min(max(math.floor((q - 20) * 10 + 0.5), 0), 3809)
        around = sorted(powers[i] for i in range(tenth(p * 0.75), tenth(p * 4 / 3) + 1) if abs(bands.ROW_PERIODS[i] - p) > 0.03 * p)
        assert bands.ratio_at(powers, k) == pytest.approx(powers[k] / around[len(around) // 2])
    fold = 1 + 0.1 * np.sin(2 * np.pi * np.arange(32) / 32 + 1)
    assert np.allclose(bands.smoothed(np.stack([fold, np.ones(32)])), np.stack([fold, np.ones(32)]), atol=1e-9)


def test_powers_of_signals(spark):
    wave = [1 + 0.1 * math.sin(2 * math.pi * k / 77.7) for k in range(1600)]
    df = spark.createDataFrame([(1, wave), (2, wave[:50])], "id long, values array<double>")
    got = {(r["id"], r["period"]): r["power"] for r in bands.signal_powers(df, [30.0, 77.7]).collect()}
    plain = sum(v * math.cos(2 * math.pi * k / 30.0) for k, v in enumerate(wave)) ** 2 + sum(v * math.sin(2 * math.pi * k / 30.0) for k, v in enumerate(wave)) ** 2
    assert got[1, 30.0] == pytest.approx(plain) and len(got) == 4
    found = {r["id"]: r["period"] for r in bands.signal_periods(df.withColumn("values", F.transform("values", lambda v: v - 1))).collect()}
    assert abs(found[1] - 77.7) < 0.5 and found[2] is None


def test_strongest_ratio_equals_all(monkeypatch):
    """Found without the medians of most periods; a signal that is not finite as well."""
    rng = np.random.default_rng(4)
    rows = np.arange(1600)
    signals = np.stack([rng.normal(size=1600), np.sin(2 * np.pi * rows / 77.7), np.sin(2 * np.pi * rows / 300) + rng.normal(size=1600), np.zeros(1600), rng.random(1600) + 1])
    powers = bands.wave_powers(signals, rows, bands.ROW_PERIODS)
    powers = np.concatenate([powers, np.full((1, len(bands.ROW_PERIODS)), np.nan)])
    ratios, taken, own = bands.all_ratios(powers), [], bands.ratio_at
    monkeypatch.setattr(bands, "ratio_at", lambda p, k: taken.append(k) or own(p, k))
    places, found = bands.strongest(powers[:2])
    assert len(taken) < 1000
    places, found = bands.strongest(powers)
    best = ratios.shape[1] - 1 - ratios[:, ::-1].argmax(1)
    assert (places == best).all() and np.array_equal(found, ratios[np.arange(6), best], equal_nan=True)
