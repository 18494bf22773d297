"""Key-file edits, move plans, patterns and recipe parameters on small cases."""

import pytest
from pyspark.sql import functions as F

from lumenry.operators import effects, keyfile
from lumenry.plans import pattern
from lumenry.plans.parameters import PARAMETERS
from lumenry.plans.recipe import RecipeError, parse_recipe, print_recipe, recipe_frames
from lumenry.sources import shots

VALUES = "path string, section string, key string, value string, ord int, add boolean"


def edited(spark, text, *values):
    lines = keyfile.parse(spark.createDataFrame([("p", text)], "path string, text string"))
    table = spark.createDataFrame([("p", s, k, v, n, add) for n, (s, k, v, add) in enumerate(values)], VALUES)
    rows = keyfile.render(keyfile.set_values(lines, table)).collect()
    return rows[0]["text"] if rows else None


def test_values_are_set(spark):
    text = "# top\r\n[A]\r\nx=1\r\n\r\n# more\r\n[B]\r\ny=2\r\n[A]\r\nx = 3"
    assert edited(spark, text, ("A", "x", "9", True)) == text.replace("x=1", "x=9").replace("x = 3", "x=9")
    assert edited(spark, text, ("A", "z", "5", True), ("A", "w", "6", True)) == text.replace("x=1\r\n", "x=1\r\nz=5\r\nw=6\r\n")
    assert edited(spark, text, ("A", "z", "5", False)) == text
    assert edited(spark, text, ("C", "k", "v", True), ("C", "l", "w", True)) == text + "\r\n\r\n[C]\r\nk=v\r\nl=w\r\n"
    assert edited(spark, "[A]\n[B]\n", ("A", "x", "1", True)) == "[A]\nx=1\n[B]\n"
    assert edited(spark, "", ("A", "x", "1", True), ("B", "y", "2", True)) == "[A]\nx=1\n\n[B]\ny=2\n"


def test_sections_are_replaced(spark):
    lines = lambda text: keyfile.parse(spark.createDataFrame([("p", text)], "path string, text string"))
    replaced = lambda a, b: keyfile.render(keyfile.replace_section(lines(a), lines(b), "S")).collect()[0]["text"]
    source = "[S]\r\na=1\r\n# c\r\n[T]\r\n[S]\r\nb=2\r\n"
    assert replaced("[R]\nx=1\n[S]\nold=1\n[Q]\n[S]\ny=2\n[Z]\n", source) == "[R]\nx=1\n[S]\na=1\n# c\n[Q]\n[Z]\n"
    assert replaced("[R]\nx=1", source) == "[R]\nx=1\n[S]\na=1\n# c\n"
    assert replaced("[R]\n[S]\nx=1\n", "[T]\n") == "[R]\n"


def test_adjustments(spark):
    parsed = keyfile.adjustments(spark.createDataFrame([("p", "x.y=1\n[g]\n a.b.c = d=e \n#c\n[h]\nbad\n")], "path string, text string"))
    assert sorted((r["line"], r["group"], r["section"], r["key"], r["value"], r["error"]) for r in parsed.collect()) == [
        (1, None, None, None, None, "line 1: a setting before any [group]"), (2, "g", None, None, None, None), (3, "g", "a.b", "c", "d=e", None),
        (5, "h", None, None, None, None), (6, "h", None, None, None, "line 6: expected Section.Key=value"),
    ]
    assert keyfile.group_settings(parsed, "h").isEmpty() and keyfile.group_settings(parsed, "g").count() == 1


def test_moves_take_the_first_free_folder(spark):
    pictures = spark.createDataFrame([("d", s, f"d/{s}.JPG", f"d/{s}.RW2") for s in ("0001", "0002", "a1", "a2", "b", "c")], "dir string, stem string, jpeg string, raw string")
    members = spark.createDataFrame([("x", "d", "0001", 1), ("x", "d", "0002", 2), ("y", "d", "a1", 3), ("y", "d", "a2", 4), ("", "d", "b", 5), ("", "d", "c", 6)], "label string, dir string, stem string, pos int")
    taken = spark.createDataFrame([("x-0001",), ("y-a1",), ("y-a1-3",), ("b-x",)], "folder string")
    beside = spark.createDataFrame([("d/b.RW2.pp3",), ("d/zzz.pp3",)], "path string")
    plan = shots.move_plan(pictures, members, taken, "d", beside).collect()
    assert {r["target"].split("/")[1] for r in plan} == {"x-0001-2", "y-a1-2", "b"}
    assert {r["source"] for r in plan if r["stem"] == "b"} == {"d/b.JPG", "d/b.RW2", "d/b.RW2.pp3"} and len(plan) == 13


@pytest.mark.parametrize("text", ["0 40 80", "0 [40 80] 3", "<a b c>", "<a [b c]>*2", "0 40*2 80/2", "~ [1 <2 3>]*3 4/2", "[a b]/3"])
def test_patterns_as_columns(spark, text):
    cycles = [k / 16 + 1e-4 for k in range(-40, 120)]
    df = spark.createDataFrame([(c,) for c in cycles], "c double").select("c", pattern.pattern_value(f'"{text}"', F.col("c")).alias("v"))
    for r in df.collect():
        assert r["v"] == pattern.pattern_at(f'"{text}"', r["c"]), r


def test_changes_of_the_cycle(spark):
    words = "every 2 every 3 rev".split()
    change, used = pattern.read_change(words, 0)
    assert used == 5 and change.plain(6.25) == pytest.approx(6.75) and change.plain(2.25) == 2.25
    for text in ("fast 2", "slow 4", "rev", "every 3 fast 2"):
        change = pattern.read_change(text.split(), 0)[0]
        rows = spark.range(40).select((F.col("id") / 8).alias("c")).select("c", change.column(F.col("c")).alias("v")).collect()
        assert all(r["v"] == pytest.approx(change.plain(r["c"])) for r in rows)


def test_recipe_parameters():
    for effect in PARAMETERS:
        text = print_recipe(effect)
        assert print_recipe(text) == text
        parse_recipe(text)
    assert parse_recipe('spin angle="5 20" center=0..100,50', moment=0.5, cycle=0.6) == [("spin", {"angle": 20.0, "center": (50, 50)})]
    assert parse_recipe('spin angle="5 ~"', cycle=0.6) == [("spin", {"angle": 10.0})]
    assert parse_recipe("fade tint=#f80 # warm\n+ onepoint hue=red")[0] == ("fade", {"tint": (255, 136, 0)})
    for wrong in ("40 80", "spin angle=x", 'spin angle="5 x"', "spin nope=1", "fast spin", "every 0 rev spin", "grain color=1", "seed=x spin", 'spin angle="5 [2"', "fade lift=101"):
        with pytest.raises(RecipeError):
            parse_recipe(wrong)


def test_recipe_frames(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.6), (1.0, 1.1)], "moment double, cycle double")
    got = {(r["cycle"], r["parameter"]): r["value"] for r in recipe_frames(df, 'spin angle="5 20" mix=0..100').collect()}
    assert got == {(0.0, "angle"): "5", (0.6, "angle"): "20", (1.1, "angle"): "5", (0.0, "mix"): "0", (0.6, "mix"): "50", (1.1, "mix"): "100"}


def test_effects_by_their_recipe_names(spark):
    px = spark.range(12 * 8).selectExpr("cast(0 as int) pic", "cast(id div 12 as int) y", "cast(id % 12 as int) x", "cast(id * 37 % 256 as int) r", "cast(id * 11 % 256 as int) g", "cast(id * 5 % 256 as int) b")
    for text in ("dither method=bayer size=1", "slice slices=3 height=1,4", "streaks width=10 color=red", "remap map=blue:orange width=40", "sort direction=vertical", "stretch direction=vertical length=1,3",
                 "leak edge=left", "prism range=90", "onepoint hue=red width=20", "falsecolor only=blue width=40"):
        assert effects.apply_recipe(px, 12, 8, parse_recipe(text)).count() == 96
    tall = effects.apply_recipe(px, 12, 8, parse_recipe("sort direction=vertical low=0 high=255")).where("x = 3").orderBy("y").selectExpr("(299 * r + 587 * g + 114 * b) div 1000 v").collect()
    assert [r["v"] for r in tall] == sorted(r["v"] for r in tall)
    with pytest.raises(ValueError, match="not built"):
        effects.apply_recipe(px, 12, 8, parse_recipe("prism wobble=4"))
