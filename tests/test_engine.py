"""Operators of the engine on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry import queries as engine_queries
from lumenry.functions import scalars as S
from lumenry.functions.draws import Draws, split_mix, value_noise
from lumenry.operators import bursts, effects, frames, keyfile, seeded, similarity, spectral
from lumenry.plans.recipe import RecipeError, parse_recipe
from lumenry.sources import shots
from lumenry.streaming.live import LatestRecipe, follow, newest_versions, recipe_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    ("times", "gap", "expected"),
    [
        ([0, 110, 220, 5000, 5300, 9000], 1000, [(0, 3), (3, 5), (5, 6)]),
        ([0, 110, 220, 5000, 5300, 9000], 100, [(k, k + 1) for k in range(6)]),
        ([0, 300], 300, [(0, 2)]),
        ([0, 301], 300, [(0, 1), (1, 2)]),
        ([0, 100, None, 200, 150], 1000, [(0, 2), (2, 3), (3, 4), (4, 5)]),
        ([None], 1000, [(0, 1)]),
        ([], 1000, []),
    ],
)
def test_bursts(spark, times, gap, expected):
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(times)], "dir string, pos int, taken_ms long")
    found = bursts.burst_ranges(bursts.bursts(df, ["dir"], gap), ["dir"])
    assert sorted((r["start"], r["end"]) for r in found.collect()) == expected


def test_pairing(spark):
    names = ["s/DSCF1.JPG", "s/DSCF1.RAF", "s/a.jpeg", "s/a.JPG", "s/a.Nef", "s/b.cr3", "s/._x.JPG", "s/a.ARW.pp3", "s/README", "s/c.xmp"]
    found = shots.pair(spark.createDataFrame([(n,) for n in names], "path string"))
    assert rows(found) == [("s", "DSCF1", "s/DSCF1.JPG", "s/DSCF1.RAF"), ("s", "a", "s/a.JPG", "s/a.Nef"), ("s", "b", None, "s/b.cr3")]


def test_scan_reads_a_directory(spark, tmp_path):
    for name in ("a.JPG", "a.RW2", "notes.txt", ".hidden.JPG"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "IMG.JPG").mkdir()
    assert [r["stem"] for r in shots.scan(spark, str(tmp_path)).collect()] == ["a"]


def test_sharpest(spark):
    def best(*measured):
        data = [(0, k, s, b) for k, (s, b) in enumerate(measured)]
        df = spark.createDataFrame(data, "burst int, pos int, sharpness double, banded boolean").withColumn("dir", F.lit("d"))
        return [r["best"] for r in bursts.sharpest(df, ["dir"]).collect()]

    assert best((20.0, False), (35.0, True), (25.0, False), (None, False)) == [2]
    assert best((20.0, True), (35.0, True)) == [1]
    assert best((20.0, False), (None, False)) == []


def test_keep_and_reject(spark):
    df = spark.createDataFrame([("d", 0, 0, 0, 0, False), ("d", 0, 1, 3, 3, True), ("d", 0, 2, 2, 1, False)], "dir string, burst int, pos int, rank int, color int, in_trash boolean")
    best = spark.createDataFrame([("d", 0, 1)], "dir string, burst int, best int")
    assert [r[3:] for r in rows(bursts.keep(df, best, ["dir"]))] == [(0, 0, True), (3, 3, False), (2, 1, True)]
    assert all(r["in_trash"] for r in bursts.reject(df, ["dir"]).collect())
    broken = df.withColumn("rank", F.when(F.col("pos") != 2, F.col("rank")))
    assert bursts.keep(broken, best, ["dir"]).isEmpty() and bursts.reject(broken, ["dir"]).isEmpty()


def test_growing_bursts(spark):
    data = [("d", 0, "read", 0), ("d", 1, "read", 100), ("d", 2, "unknown", None), ("d", 3, "read", 9000), ("d", 4, "read", 9100)]
    found = bursts.growing(spark.createDataFrame(data, "dir string, pos int, state string, taken_ms long"), ["dir"])
    assert sorted((r["start"], r["end"], r["complete"]) for r in found.collect()) == [(0, 2, False), (2, 3, False), (3, 5, False)]


def test_key_files(spark):
    text = "[Version]\r\nA=1;2\r\n\r\n[General]\nRank=2\nRank=3\nInTrash=1\n# note\n[Exposure]\nk = value with ; and = signs"
    lines = keyfile.parse(spark.createDataFrame([("p", text), ("q", "k=1\n[A]\njunk"), ("e", "")], "path string, text string"))
    assert dict(rows(keyfile.render(lines)))["p"] == text
    got = {(s, k): v for p, s, k, v in rows(keyfile.get(lines)) if p == "p"}
    assert got == {("Version", "A"): "1;2", ("General", "Rank"): "3", ("General", "InTrash"): "1", ("Exposure", "k"): "value with ; and = signs"}
    assert [r["line"] for r in lines.where("kind = 'bad'").orderBy("line").collect()] == [1, 3]
    assert {r["path"]: (r["rank"], r["color"], r["in_trash"]) for r in keyfile.marks(lines).collect()}["p"] == (3, 0, True)


@pytest.mark.parametrize("bad", ["Rank=6", "Rank=-1", "ColorLabel=9", "InTrash=maybe"])
def test_bad_marks(spark, bad):
    lines = keyfile.parse(spark.createDataFrame([("p", f"[General]\n{bad}\nRank=1\n")], "path string, text string"))
    assert keyfile.marks(lines).first()["error"] == bad


def test_look_and_exposure(spark):
    def profile(*entries):
        return spark.createDataFrame([("p", *e) for e in entries], "path string, section string, key string, value string")

    target = profile(("General", "Rank", "3"), ("Exposure", "Compensation", "0.5"), ("White Balance", "T", "1"), ("Old", "k", "1"))
    reference = profile(("General", "Rank", "1"), ("Exposure", "Compensation", "-0.2"), ("White Balance", "T", "2"), ("New", "k", "2"))
    look = keyfile.apply_look(target, reference)
    assert {r[1:] for r in rows(look)} == {("General", "Rank", "3"), ("White Balance", "T", "1"), ("Exposure", "Compensation", "-0.2"), ("New", "k", "2")}
    shifted = keyfile.compensated(look, target, reference, "shift", 0.75).where("section = 'Exposure'")
    assert [r["value"] for r in shifted.collect()] == ["0.55"]
    kept = keyfile.compensated(look, target, reference, "keep").where("section = 'Exposure'")
    assert [r["value"] for r in kept.collect()] == ["0.5"]


def test_dates_and_texts(spark):
    df = spark.createDataFrame([("2020:08:03 08:03:35", None), ("2020:08:03 08:03:35", "5"), ("2020:08:03 08:03:35", "1234"), ("2000:02:29 23:59:59", ""), ("0000:00:00 00:00:00", None), (" ", None)], "t string, s string")
    assert [r[0] for r in df.select(S.taken_ms(F.col("t"), F.col("s"))).collect()] == [1596441815000, 1596441815500, 1596441815123, 951868799000, None, None]
    df = spark.createDataFrame([(10, 5000), (1, 3), (2, 1), (25, 10), (0, 1), (1, 0)], "n int, d int")
    assert [r[0] for r in df.select(S.exposure_text(F.col("n"), F.col("d"))).collect()] == ["1/500 s", "1/3 s", "2 s", "2.5 s", None, None]
    df = spark.createDataFrame([("Panasonic", "DC-GX9"), ("Canon", "Canon EOS R6"), (" ", "X100V"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.camera(F.col("a"), F.col("b"))).collect()] == ["Panasonic DC-GX9", "Canon EOS R6", "X100V", None]
    df = spark.createDataFrame([("0..100", 0.5), ("0..1.0", 0.25), ("-3..3", 0.0), ("word", 0.3)], "v string, t double")
    assert [r[0] for r in df.select(S.range_at(F.col("v"), F.col("t"))).collect()] == ["50", "0.25", "-3", "word"]
    turn = spark.range(1).select(S.upright(F.lit(0.35), F.lit(0.56), F.lit(6)).alias("p")).select("p.*").first()
    assert (round(turn["x"], 2), round(turn["y"], 2)) == (0.44, 0.35)
    assert spark.range(1).select(S.marks_text(F.lit(3), F.lit(3), F.lit(True))).first()[0] == "★★★☆☆ Green rejected"


def test_average_linkage_matches_plain_version():
    def plain(d, threshold):
        groups = [[i] for i in range(len(d))]
        while len(groups) > 1:
            best = min(((np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])), key=lambda t: round(t[0], 12))
            if best[0] > threshold:
                break
            groups[best[2]] += groups.pop(best[1])
        return sorted(sorted(g) for g in groups)

    rng = np.random.default_rng(1)
    points = rng.random((25, 4))
    d = np.abs(points[:, None] - points[None]).sum(2)
    for threshold in (0.0, 0.5, 1.0, 9.0):
        assert similarity.average_linkage(25, d, threshold) == plain(d, threshold)


def test_time_decay(spark):
    df = spark.createDataFrame([(0.4, 0), (0.4, 30_000), (0.4, -60_000), (0.4, None)], "d double, gap long")
    assert [round(r[0], 6) for r in df.select(similarity.with_time(F.col("d"), F.col("gap"), 0.5, 60_000)).collect()] == [0.2, 0.3, 0.4, 0.4]


@pytest.fixture(scope="module")
def picture(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (10, 14, 3))
    data = [(1, y, x, *map(int, image[y, x])) for y in range(10) for x in range(14)]
    return image, spark.createDataFrame(data, "pic long, y int, x int, r int, g int, b int").cache()


def image_of(df, like):
    out = np.full(like.shape, -1)
    for r in df.collect():
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def test_gathers(picture):
    image, px = picture
    y, x = np.mgrid[0:10, 0:14]
    moved = image_of(effects.split(px, 1000, red=(-3, 1), blue=(2, -2)), image)
    at = lambda c, dx, dy: image[np.clip(y - dy, 0, 9), np.clip(x - dx, 0, 13), c]
    assert (moved[..., 0] == at(0, -3, 1)).all() and (moved[..., 1] == image[..., 1]).all() and (moved[..., 2] == at(2, 2, -2)).all()
    sliced = image_of(effects.slices(px, 14, [(2, 6, 5, False), (4, 8, -3, True)]), image)
    assert (sliced[3] == np.roll(image[3], 5, 0)).all() and (sliced[5] == 255 - np.roll(image[5], -3, 0)).all()
    assert (image_of(effects.stretch(px, [(2, 7)]), image)[3:7] == image[2]).all()

    def bilinear(v, u):
        u0, v0 = np.floor(u).astype(int), np.floor(v).astype(int)
        fu, fv = (u - u0)[..., None], (v - v0)[..., None]
        p = lambda j, i: image[np.clip(v0 + j, 0, 9), np.clip(u0 + i, 0, 13)].astype(float)
        return (p(0, 0) * (1 - fu) + p(0, 1) * fu) * (1 - fv) + (p(1, 0) * (1 - fu) + p(1, 1) * fu) * fv

    bent = image_of(effects.aberration(px, 14, 10, 0.1), image)
    for c, s in enumerate((1.1, 1.0, 0.9)):
        assert np.abs(bent[..., c] - bilinear(5 + (y - 5) / s, 7 + (x - 7) / s)[..., c]).max() <= 0.51
    turned = np.zeros(image.shape)
    for a in np.radians([-15, 0, 15]):
        dx, dy = x - 6.5, y - 4.5
        turned += bilinear(4.5 + dx * np.sin(a) + dy * np.cos(a), 6.5 + dx * np.cos(a) - dy * np.sin(a)) / 3
    assert np.abs(image_of(effects.spin(px, 14, 10, 30, steps=3), image) - turned).max() <= 0.51


def test_sort_keeps_pixels(picture):
    image, px = picture
    done = image_of(effects.pixel_sort(px, 0, 255), image)
    light = done @ np.array([299, 587, 114]) // 1000
    assert (np.diff(light, axis=1) >= 0).all()
    assert all(sorted(map(tuple, a)) == sorted(map(tuple, b)) for a, b in zip(done, image))
    assert (image_of(effects.pixel_sort(px, 0, 255, True), image) == done[:, ::-1]).all()


def test_identities(picture):
    image, px = picture
    for same in (
        effects.falsecolor(px, order="rgb"), effects.remap(px, []), effects.vignette(px, 14, 10, strength=0),
        effects.tritone(px, mix=0), effects.spin(px, 14, 10, angle=0), effects.onepoint(px, rest=100), effects.falsecolor(px, order="rgb", rotate=120, mix=0),
    ):
        assert (image_of(same, image) == image).all()
    back = effects.falsecolor(effects.falsecolor(px, order="rgb", rotate=120), order="rgb", rotate=-120)
    assert np.abs(image_of(back, image) - image).max() <= 2


def test_frames(spark):
    data = [(f, 0, x, v, v, v) for f, own in enumerate([[10, 20], [30, 5], [20, 90]]) for x, v in enumerate(own)]
    px = spark.createDataFrame(data, "frame int, y int, x int, r int, g int, b int")
    assert [r["r"] for r in frames.median_background(px).orderBy("x").collect()] == [20, 20]
    assert [r["r"] for r in frames.ghost(px, 0, "lighten", 100).orderBy("x").collect()] == [30, 90]
    centres = spark.createDataFrame([(0, 1.0, 2.0), (1, None, None)], "frame int, cx double, cy double")
    assert rows(frames.carried(centres)) == [(0, 1.0, 2.0), (1, 1.0, 2.0)]


def test_registration(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (16, 16))
    data = [(f, y, x, *[int(base[(y - 2 * f) % 16, (x + f) % 16])] * 3) for f in (0, 1) for y in range(16) for x in range(16)]
    px = spark.createDataFrame(data, "frame int, y int, x int, r int, g int, b int")
    assert [r[:3] for r in rows(frames.register(px, 0, 16, 16, 3))] == [(0, 0, 0), (1, -1, 2)]


def test_bands(spark):
    signal = spark.range(1600).select(F.lit(1).alias("id"), F.col("id").alias("row"), (1 + 0.04 * F.sin(2 * F.pi() * F.col("id") / 101.7)).alias("v"))
    periods = [round(80 + 0.5 * k, 1) for k in range(100)]
    high = spectral.local_light(signal, 200).withColumn("v", F.col("v") - F.col("local")).drop("local")
    best = spectral.strongest(spectral.prominence(spectral.band_power(high, periods))).first()
    assert abs(best["period"] - 101.7) <= 2
    gains = spectral.smooth_gains(spectral.folded_gains(signal, 101.7))
    flat = spectral.deband(signal, gains, 101.7).agg(F.stddev("v")).first()[0]
    assert flat < 0.004


def test_recipes(picture):
    image, px = picture
    steps = parse_recipe("seed=7 falsecolor order=grb + scanlines period=2 strength=100")
    assert steps == [("falsecolor", {"order": "grb"}), ("scanlines", {"period": 2, "strength": 100})]
    done = image_of(effects.apply_recipe(px, 14, 10, steps), image)
    assert done.shape == image.shape
    for wrong in ("", "blur", "low=3 sort"):
        with pytest.raises(RecipeError):
            parse_recipe(wrong)


def test_live_recipe_stream(spark, tmp_path):
    source, seen, latest = tmp_path / "in", [], LatestRecipe()
    source.mkdir()
    (source / "1.txt").write_text("duotone")
    for name, text in ((None, None), ("2.txt", "no such effect"), ("3.txt", "vignette strength=10")):
        if name:
            (source / name).write_text(text)
        follow(recipe_stream(spark, str(source)), latest, lambda r: seen.append((r.generation, r.steps)), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    assert seen == [(1, [("duotone", {})]), (2, [("vignette", {"strength": 10})])]
    results, registry = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, version int"), spark.createDataFrame([(1, 2), (2, 1)], "id int, version int")
    assert rows(newest_versions(results, registry)) == [(1, 2), (2, 1)]


def test_draws(spark):
    assert (split_mix(7, np.arange(5)) % np.uint64(1000)).tolist() == [487, 804, 346, 203, 674]
    drawn = Draws(7)
    assert [drawn.below(1000), drawn.below(0), drawn.below(1000)] == [487, 0, 804] and 3 <= drawn.between(9, 3) <= 9
    lattice = (split_mix(3, np.arange(12)) % np.uint64(10_001)).astype(float).reshape(3, 4) / 10_000
    df = spark.createDataFrame([(float(x), float(y)) for y in range(3) for x in range(4)], "u double, v double")
    assert [r[0] for r in df.select(value_noise(3, 4, 3, F.col("u"), F.col("v"))).collect()] == lattice.reshape(-1).tolist()


def test_seeded_effects(picture):
    image, px = picture
    for same in (
        seeded.grain(px, 14, 10, strength=0), seeded.liquid(px, 14, 10, amplitude=0), seeded.liquid(px, 14, 10, scale=0), seeded.streaks(px, 14, 10, strength=0),
        seeded.drag(px, 14, 10, mix=0), seeded.bloom(px, 14, 10, strength=0), seeded.drawn_slices(px, 14, 10, shift=0), seeded.drawn_stretch(px, 14, 10, bands=0),
    ):
        assert (image_of(same, image) == image).all()
    one, two = (image_of(seeded.grain(px, 14, 10, size=1, color=True, seed=5), image) for _ in range(2))
    assert (one == two).all() and (one != image).any()
    assert (image_of(seeded.bloom(px, 14, 10), image) >= image).all()
    moved = image_of(seeded.drag(px, 14, 10, length=143, mix=100, blend="normal"), image)
    y, x = np.mgrid[0:10, 0:14]
    steps = 3
    plain = np.zeros(image.shape)
    for k in range(steps):
        u = x + 143 * 14 / 1000 * k / steps
        u0 = np.floor(u).astype(int)
        f = (u - u0)[..., None]
        plain += (image[y, np.clip(u0, 0, 13)] * (1 - f) + image[y, np.clip(u0 + 1, 0, 13)] * f) / steps
    assert np.abs(moved - plain).max() <= 0.51


def test_diffusion_keeps_the_light(spark):
    grey = spark.range(1).select(F.lit(1).cast("long").alias("pic"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("y"))
    grey = grey.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("*", *[F.lit(100).alias(c) for c in "rgb"])
    done = seeded.dither_diffusion(grey, 32, 32).agg(F.avg("r"), F.collect_set("r")).first()
    assert abs(done[0] - 100) < 4 and sorted(done[1]) == [0, 255]


def test_recipe_seeds():
    assert parse_recipe("seed=7 vignette + grain size=3") == [("vignette", {}), ("grain", {"size": 3, "seed": 8})]


@pytest.mark.parametrize("name", ["fx_aberration", "fx_spin", "fx_liquid", "fx_drag", "fx_bloom", "fx_dither_diffusion"])
def test_effects_take_every_picture(spark, tmp_path, name):
    """Pictures beyond the twentieth are worked on too."""
    suppliers = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").where("s_suppkey in (1, 20, 21, 90)")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["pic"] for r in engine_queries.QUERIES[name](spark, str(tmp_path)).select("pic").distinct().collect()} == {1, 20, 21, 90}


def test_band_periods_of_every_signal(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").where("s_suppkey in (1, 20, 21)").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["id"] for r in engine_queries.QUERIES["band_periods"](spark, str(tmp_path)).collect()} == {1, 20, 21}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fx_aberration", "fx_bloom", "fx_drag", "fx_liquid", "fx_spin", "fx_stretch", "register_shift", "track_centroid", "register_pyramid"])
def test_pixels_are_not_joined(spark, name):
    """A table of pixels looks as small as the rows that it is made of; a join would send it all to the driver."""
    assert "Join" not in plan_of(engine_queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("effect", [seeded.liquid, seeded.drag, seeded.bloom, effects.aberration, effects.spin])
def test_effects_on_pixel_tables_do_not_join(picture, effect):
    assert "Join" not in plan_of(effect(picture[1], 14, 10))


@pytest.mark.parametrize("name", ["develop_gain", "develop_pictures", "fx_remap", "fx_streaks", "band_periods", "fx_dither_diffusion", "fx_spin_auto"])
def test_pictures_are_dealt_over_tasks(spark, name):
    assert engine_queries.QUERIES[name](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 8


def test_next_shown_by_running_frames(spark):
    """No frame up to the end of all rows, which is gone through again for every row; no join."""
    marks = [(1, k, "read" if k % 5 else "unread", k % 3 == 0, 0, 0) for k in range(40)]
    df = spark.createDataFrame(marks, "cam int, pos long, state string, in_trash boolean, rank int, color int")
    found = bursts.next_shown(df, "rejected", ["cam"])
    hits = [p for _, p, state, trash, _, _ in marks if state == "read" and trash]
    assert sorted(map(tuple, found.collect())) == [(1, p, min((h for h in hits if h > p), default=None), max((h for h in hits if h < p), default=None)) for p in range(40)]
    assert "unboundedfollowing" not in plan_of(found) and "Join" not in plan_of(found)


@pytest.mark.parametrize("effect", ["remap", "streaks"])
def test_expressions_stay_small(picture, effect):
    """Steps of an effect are columns: not written out again in each place that uses them."""
    out = effects.remap(picture[1], [(0, 120), (210, 30)]) if effect == "remap" else seeded.streaks(picture[1], 14, 10)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 12_000
