"""Development stage by stage against plain loops over pixels."""

import math
import random
import statistics

import numpy as np
import pytest

from lumenry.operators import develop as D

from .test_whole_pictures import picture, plate

MATRIX = [1.6, -0.5, -0.1, -0.2, 1.5, -0.3, 0.0, -0.4, 1.4]
INPUT = "pic long, width int, height int, camera array<float>, preview array<short>, balance array<double>, matrix array<double>"


def luma(p):
    return 0.2126 * p[0] + 0.7152 * p[1] + 0.0722 * p[2]


def eased(low, high, x):
    t = min(1, max(0, (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def plain_grid(h, w, value, reach):
    """Cell values blurred in two passes; returns the reader."""
    rows, cols = math.ceil(h / 4), math.ceil(w / 4)
    grid = [[value([(y, x) for y in range(4 * j, min(h, 4 * j + 4)) for x in range(4 * i, min(w, 4 * i + 4))]) for i in range(cols)] for j in range(rows)]
    mean = lambda v: sum(v) / len(v)
    grid = [[mean([row[k] for k in range(max(0, i - reach), min(cols, i + reach + 1))]) for i in range(cols)] for row in grid]
    grid = [[mean([grid[k][i] for k in range(max(0, j - reach), min(rows, j + reach + 1))]) for i in range(cols)] for j in range(rows)]

    def read(y, x):
        fx, fy = (min(max((v + 0.5) / 4 - 0.5, 0), n - 1) for v, n in ((x, cols), (y, rows)))
        x0, y0 = int(fx), int(fy)
        x1, y1, tx, ty = min(x0 + 1, cols - 1), min(y0 + 1, rows - 1), fx - x0, fy - y0
        return (grid[y0][x0] * (1 - tx) + grid[y0][x1] * tx) * (1 - ty) + (grid[y1][x0] * (1 - tx) + grid[y1][x1] * tx) * ty

    return read


def gamut(p):
    low = min(p)
    return p if low >= 0 else [max(0, c + min(-low * 0.8, 0.06)) for c in p]


def rolled(p):
    top = max(p)
    bent = top if top <= 0.6 else 0.6 + 0.4 * ((top - 0.6) / 1.2) / (1 + (top - 0.6) / 1.2)
    kept = [c * (bent / top if top > 0 else 1) for c in p]
    white = min(1, max(0, (top - 1) / 6)) * 0.3
    return [c + (bent - c) * white for c in kept]


def curve(v):
    v = min(1, max(0, v))
    return 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055


def back(v):
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def duller(p, v):
    return [c - v * max(0, min(p)) for c in p]


def saturation(pixels):
    kept = [(max(p) - min(p)) / max(p) for p in pixels if max(p) > 0.15]
    return sum(kept) / len(kept) if kept else 0


def plain_noise(x, y):
    h = (x * 0x9E3779B1 ^ y * 0x85EBCA77) & 0xFFFFFFFF
    h ^= h >> 15
    h = h * 0x2C1B3C6D & 0xFFFFFFFF
    h ^= h >> 12
    h = h * 0x297A2D39 & 0xFFFFFFFF
    h ^= h >> 15
    return (h >> 8) / 2**24


def plain(camera, preview, balance, matrix):
    h, w = len(camera), len(camera[0])
    places = [(y, x) for y in range(h) for x in range(w)]
    at = lambda y, x: camera[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    clip = plain_grid(h, w, lambda own: eased(0.8, 0.99, max([0] + [sorted(camera[y][x])[1] for y, x in own])), 3)
    linear = {}
    for y, x in places:
        p = list(camera[y][x])
        if min(h, w) >= 3:
            near = [at(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
            p = [p[1] + statistics.median(q[0] - q[1] for q in near), p[1], p[1] + statistics.median(q[2] - q[1] for q in near)]
        p = [c * b for c, b in zip(p, balance)]
        linear[y, x] = [sum(m * c for m, c in zip(matrix[3 * k : 3 * k + 3], p)) for k in range(3)]
    gain, vividness = 1.0, 0.0
    if preview:
        ours, theirs = (sorted(map(luma, v))[len(v) // 2] for v in (list(linear.values()), [[back(c / 255) for c in p] for p in preview]))
        if ours > 1e-6 and theirs > 1e-6:
            gain = min(8, max(0.5, theirs / ours))
        goal = saturation([[c / 255 for c in p] for p in preview])
        mean = lambda v: saturation([[curve(c) for c in rolled(gamut(duller([c * gain for c in p], v)))] for p in linear.values()])
        if mean(0) < goal:
            low, high = 0.0, 0.45
            if mean(high) <= goal:
                low = high
            else:
                for _ in range(10):
                    middle = (low + high) / 2
                    low, high = (middle, high) if mean(middle) < goal else (low, middle)
            vividness = (low + high) / 2
    bright = {k: [c * gain for c in p] for k, p in linear.items()}
    dark = {k: 1 - eased(0.01, 0.08, luma(p)) for k, p in bright.items()}
    sums = [plain_grid(h, w, lambda own, c=c: sum(dark[k] * (bright[k][c] - luma(bright[k])) for k in own), 2) for c in range(3)]
    weights = plain_grid(h, w, lambda own: sum(dark[k] for k in own), 2)
    out = []
    for y, x in places:
        p, s = bright[y, x], dark[y, x]
        grey, n = luma(p), weights(y, x)
        around = [0, 0, 0] if n < 1e-6 else [f(y, x) / n for f in sums]
        p = gamut(duller([grey + (1 - s) * (c - grey) + s * a for c, a in zip(p, around)], vividness))
        grey = luma(p)
        p = rolled([c + (grey - c) * clip(y, x) * 0.9 for c in p])
        out += [curve(c) * 255 + plain_noise(x, y) - 0.5 for c in p]
    return out, gain, vividness


def raw(seed, h, w, scale, base=0.0):
    rng = random.Random(seed)
    return [[[float(np.float32(base + rng.random() ** 3 * scale)) for _ in range(3)] for _ in range(w)] for _ in range(h)]


def test_development_equals_loops(spark):
    rng = random.Random(4)
    cases = [(1, 17, 22, 1.3, "pale"), (2, 8, 9, 0.05, "strong"), (3, 2, 5, 1.0, "strong"), (4, 5, 2, 3.0, None), (5, 1, 1, 0.0, "pale"), (6, 13, 4, 1.0, "empty"), (7, 30, 30, 0.5, "middle"), (8, 12, 11, 0.1, "soft")]
    rows, want = [], {}
    for pic, h, w, scale, kind in cases:
        camera = raw(pic, h, w, scale, 0.15 if kind == "soft" else 0.0)
        reds = {"pale": (100, 130), "strong": (0, 255), "middle": (40, 200), "soft": (145, 165)}.get(kind, (0, 0))
        preview = None if kind is None else [] if kind == "empty" else [[rng.randint(*reds) for _ in range(3)] for _ in range(70)]
        balance = None if pic in (6, 8) else [2.0, 1.0, float("nan")] if pic == 4 else [2.0, 1.0, 1.5]
        matrix = None if pic in (3, 8) else MATRIX
        rows.append((pic, w, h, [c for row in camera for p in row for c in p], preview and [c for p in preview for c in p] if preview != [] else [], balance, matrix))
        want[pic] = plain(camera, preview, [2.0, 1.0, 1.5] if pic not in (4, 6, 8) else [1.0] * 3, MATRIX if matrix else [1, 0, 0, 0, 1, 0, 0, 0, 1])
    rows += [(90, 3, 3, None, None, None, None), (91, 0, 0, [], [], None, None)]
    found = {r["pic"]: r for r in D.developed(spark.createDataFrame(rows, INPUT)).collect()}
    for pic, (values, gain, vividness) in want.items():
        r = found[pic]
        assert (r["gain"], r["vividness"]) == (pytest.approx(gain), pytest.approx(vividness, abs=1e-9))
        for got, value in zip(r["rgb"], values, strict=True):
            assert abs(got - min(255, max(0, value))) <= 0.5 + 1e-6
    assert {found[p]["vividness"] for p in (1, 4)} == {0.0} and 0 < found[8]["vividness"] < 0.45
    assert found[90]["rgb"] is None and found[91]["rgb"] == [] and found[91]["gain"] is None
    assert D.developed(spark.createDataFrame([], INPUT)).count() == 0


def test_clip_map_and_shadows():
    camera = np.zeros((80, 80, 3))
    camera[36:44, 36:44] = (1.0, 1.0, 0.1)
    camera[:4, :4] = (0.1, 0.2, 5.0)
    clip = D.clipped(camera)
    assert np.isclose(clip[40, 40], clip.max()) and clip.max() > 0.07 and clip[0, 0] == 0 and clip[79, 79] == 0
    rgb = np.full((16, 16, 3), 0.005) * (1 + 0.5 * np.random.default_rng(1).standard_normal((16, 16, 3)))
    calm = D.quiet_shadows(rgb)
    assert np.allclose(calm @ D.LUMA, rgb @ D.LUMA) and np.std(calm - (calm @ D.LUMA)[..., None]) < 0.3 * np.std(rgb - (rgb @ D.LUMA)[..., None])


def test_upright(spark):
    p = picture(3)
    h, w = len(p), len(p[0])
    # Where the pixel shown at (y, x) is stored, by the tag's definition.
    stored = {
        1: lambda y, x: (y, x), 2: lambda y, x: (y, w - 1 - x), 3: lambda y, x: (h - 1 - y, w - 1 - x), 4: lambda y, x: (h - 1 - y, x),
        5: lambda y, x: (x, y), 6: lambda y, x: (h - 1 - x, y), 7: lambda y, x: (h - 1 - x, w - 1 - y), 8: lambda y, x: (x, w - 1 - y),
    }
    one = plate(spark, [p]).crossJoin(spark.createDataFrame([(k,) for k in [*range(10), None]], "orientation int"))
    found = D.upright(one.selectExpr("cast(coalesce(orientation, 99) as long) as pic", "width", "height", "rgb", "orientation")).collect()
    assert len(found) == 11
    for r in found:
        place = stored.get(r["pic"], stored[1])
        sides = (w, h) if r["pic"] in (5, 6, 7, 8) else (h, w)
        assert (r["height"], r["width"]) == sides
        assert r["rgb"] == [c for y in range(sides[0]) for x in range(sides[1]) for c in p[place(y, x)[0]][place(y, x)[1]]]


def test_medians_by_exchanges():
    rng = np.random.default_rng(8)
    for shape in ((3, 3), (4, 9), (12, 7)):
        values = rng.integers(0, 6, shape) / 7 if shape[0] == 4 else rng.normal(size=shape)
        plain = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(values, 1, mode="edge"), (3, 3)), axis=(2, 3))
        assert np.array_equal(D.median3(values), plain)


def test_gains_are_those_of_the_development(spark):
    rng = np.random.default_rng(6)
    some = lambda n: rng.random(n).tolist()
    rows = [(1, 5, 4, some(60), [int(v) for v in rng.integers(0, 256, 30)], [2.0, 1.0, 1.5], some(9)), (2, 5, 4, some(60), None, None, None), (3, 0, 0, [], [], None, None),
            (4, 2, 2, None, [1, 2, 3], None, None), (5, 2, 2, some(12), [], [1.0, None, 1.0], None)]
    df = spark.createDataFrame(rows, "pic long, width int, height int, camera array<float>, preview array<short>, balance array<double>, matrix array<double>")
    assert sorted(map(tuple, D.gains(df).collect())) == sorted((r["pic"], r["gain"]) for r in D.developed(df).collect())
