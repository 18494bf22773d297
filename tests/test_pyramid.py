"""Frames lined up over three sizes."""

import numpy as np

from lumenry.operators import pyramid


def scene(ox, oy, w=480, h=360):
    ys, xs = np.mgrid[:h, :w]
    y, x = ys - oy, xs - ox
    out = np.zeros((h, w, 3), int) + [12, 10, 30]
    out[(x >= 150) & (x < 190) & (y >= 200) & (y < 280)] = [130, 120, 160]
    out[(x - 250) ** 2 + (y - 160) ** 2 < 900] = [250, 250, 248]
    out[(x - 190) ** 2 + (y - 220) ** 2 < 100] = [255, 240, 230]
    return out


def frames(spark, pictures):
    rows = [(s, f, p.shape[1], p.shape[0], p.ravel().tolist()) for (s, f), p in pictures.items()]
    return spark.createDataFrame(rows, "scene long, frame long, width int, height int, rgb array<short>")


def test_planted_shifts_are_found_and_undone(spark):
    planted = {(1, 1): (0, 0), (1, 2): (17, -9), (1, 3): (-33, 28), (2, 1): (5, 5), (2, 2): (5, 5), (3, 2): (0, 0)}
    pictures = {k: scene(*v) for k, v in planted.items()}
    pictures[2, 3] = scene(0, 0, 40, 30)
    df = frames(spark, pictures)
    shifts = pyramid.registered(df, 1)
    found = {(r["scene"], r["frame"]): (r["dx"], r["dy"]) for r in shifts.collect()}
    assert set(found) == {k for k in pictures if k[0] != 3} and found[2, 3] == (None, None)
    assert found[1, 1] == (0, 0) and found[2, 2] == (0, 0)
    for k in ((1, 2), (1, 3)):
        assert abs(found[k][0] - planted[k][0]) <= 1 and abs(found[k][1] - planted[k][1]) <= 1
    back = {(r["scene"], r["frame"]): np.array(r["rgb"]).reshape(r["height"], r["width"], 3) for r in pyramid.aligned(df, shifts).collect()}
    same = (back[1, 3] == pictures[1, 1]).all(-1)
    assert same.mean() > 0.98 and (back[2, 3] == pictures[2, 3]).all()
    assert pyramid.registered(df.limit(0), 1).isEmpty()


def test_large_shifts_of_wide_pictures():
    rng = np.random.default_rng(3)
    wide = np.kron(rng.integers(0, 2, (30, 48)), np.ones((40, 40)))[..., None] * np.array([240.0, 230, 220])
    moved = pyramid.shifted(wide, 60, -44)
    dx, dy = pyramid.shift_of(wide, moved)
    assert abs(dx + 60) <= 2 and abs(dy - 44) <= 2


def test_a_level_equals_loops():
    rng = np.random.default_rng(5)
    one, two = rng.random((30, 40)), rng.random((30, 40))
    costs = {}
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            costs[dy, dx] = np.mean([abs(one[y, x] - two[y + dy, x + dx]) for y in range(9, 24) for x in range(8, 32)])
    dy, dx = min(costs, key=costs.get)
    assert pyramid.least_shift(one, two, (0, 0), 3) == (dx, dy)
    assert pyramid.least_shift(one, two, (200, 0), 3) == (200, 0)
    assert [pyramid.nearest(v) for v in (0.5, -0.5, 1.4, -1.6)] == [1, -1, 1, -2]
