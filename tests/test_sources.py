"""Reading metadata from bytes, and writing back."""

import struct

import pytest
from pyspark.sql import functions as F

from lumenry.sources import exif, shots, sinks


def camera_exif(order="<"):
    """A TIFF structure with a root, an Exif and a thumbnail directory."""
    texts = {"make": b"Panasonic\0", "model": b"DC-GX9\0", "date": b"2020:08:03 08:03:35\0", "sub": b"29\0"}
    blob, at = b"", {}
    base = 8 + (2 + 12 * 4 + 4) + (2 + 12 * 6 + 4) + (2 + 12 * 2 + 4)
    for name, text in texts.items():
        at[name] = base + len(blob)
        blob += text + b"\0" * (len(text) % 2)
    for name, pair in (("exposure", (10, 5000)), ("f", (56, 10)), ("focal", (27, 1))):
        at[name] = base + len(blob)
        blob += struct.pack(order + "II", *pair)
    at["thumb"] = base + len(blob)
    blob += b"\xff\xd8tiny"
    entry = lambda tag, kind, n, value: struct.pack(order + "HHII", tag, kind, n, value)
    short = lambda tag, value: struct.pack(order + "HHIHH", tag, 3, 1, value, 0)
    root = [entry(0x10F, 2, 10, at["make"]), entry(0x110, 2, 7, at["model"]), short(0x112, 6), entry(0x8769, 4, 1, 8 + 54)]
    own = [entry(0x829A, 5, 1, at["exposure"]), entry(0x829D, 5, 1, at["f"]), short(0x8827, 1600), entry(0x9003, 2, 20, at["date"]), entry(0x9291, 2, 3, struct.unpack(order + "I", b"29\0\0")[0]), entry(0x920A, 5, 1, at["focal"])]
    thumb = [entry(0x201, 4, 1, at["thumb"]), entry(0x202, 4, 1, 6)]
    pack = lambda rows, after: struct.pack(order + "H", len(rows)) + b"".join(rows) + struct.pack(order + "I", after)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return head + pack(root, 8 + 54 + 78) + pack(own, 0) + pack(thumb, 0) + blob


def as_jpeg(tiff):
    payload = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload + b"\xff\xda\0\2rest"


@pytest.mark.parametrize("data", [camera_exif("<"), camera_exif(">"), as_jpeg(camera_exif("<"))])
def test_exif(spark, tmp_path, data):
    (tmp_path / "a.jpg").write_bytes(data)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8 nothing")
    (tmp_path / "c.rw2").write_bytes(data[:40])
    rows = {r["path"][-5]: r for r in exif.read_exif(spark, str(tmp_path)).collect()}
    a = rows["a"]
    assert (a["taken"], a["taken_ms"], a["camera"], a["iso"], a["orientation"]) == ("2020-08-03 08:03:35", 1596441815290, "Panasonic DC-GX9", 1600, 6)
    assert tuple(a["exposure"]) == (10, 5000) and round(a["f_number"], 1) == 5.6 and a["focal_length"] == 27 and bytes(a["thumbnail"]) == b"\xff\xd8tiny"
    assert rows["b"]["taken"] is None and rows["b"]["camera"] is None and len(rows) == 3


def test_segments_stop_at_the_scan():
    assert [m for m, _, _ in exif.segments(as_jpeg(b"x"))] == [0xE0, 0xE1] and list(exif.segments(b"\xff\xd8\xff")) == []


def test_save_keeps_the_first_version(spark, tmp_path):
    path = tmp_path / "a.pp3"
    path.write_text("one")
    for text in ("two", "three\r\n"):
        sinks.save_profiles(spark.createDataFrame([(str(path), text)], "path string, text string"))
    assert path.read_bytes() == b"three\r\n" and (tmp_path / "a.pp3.bak").read_text() == "one" and len(list(tmp_path.iterdir())) == 2


def test_moves(spark, tmp_path):
    for name in ("a.JPG", "a.RW2", "b.JPG", "c.JPG", "c.RW2"):
        (tmp_path / name).write_text(name)
    found = shots.pair(spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string"))
    members = found.where("stem <> 'b'").select(F.lit("bleu").alias("label"), "dir", "stem", F.col("stem").alias("pos"))
    plan = shots.move_plan(found, members, spark.createDataFrame([("bleu-a",)], "folder string"), str(tmp_path)).cache()
    assert {r["target"].rsplit("/", 2)[1] for r in plan.collect()} == {"bleu-a-2"}
    (tmp_path / "bleu-a-2").mkdir()
    (tmp_path / "bleu-a-2" / "c.RW2").write_text("in the way")
    done = {r["stem"]: r["error"] for r in sinks.apply_moves(plan).collect()}
    assert done["a"] is None and done["c"].startswith("FileExistsError")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.JPG", "bleu-a-2", "c.JPG", "c.RW2"]
    assert sorted(p.name for p in (tmp_path / "bleu-a-2").iterdir()) == ["a.JPG", "a.RW2", "c.RW2"]


def test_cache(spark, tmp_path):
    schema, path = "name string, length long, modified long, taken string", str(tmp_path / "cache")
    assert sinks.open_cache(spark, path, schema).isEmpty()
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "name string, length long, modified long")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    sinks.update_cache(spark, sinks.open_cache(spark, path, schema), files, rows(("a", 1, 1, "x"), ("b", 2, 2, "y")), path)
    changed = spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("c", 3, 3)], "name string, length long, modified long")
    kept, missing = shots.fresh_entries(changed, sinks.open_cache(spark, path, schema))
    assert [r["name"] for r in kept.collect()] == ["a"] and sorted(r["name"] for r in missing.collect()) == ["b", "c"]


def test_sidecars_and_groups(spark):
    found = spark.createDataFrame([("s", "a", "s/a.JPG", "s/a.RAF"), ("s/x", "b", "s/x/b.JPG", None), ("s/.h", "c", "s/.h/c.JPG", None)], "dir string, stem string, jpeg string, raw string")
    existing = spark.createDataFrame([("s/a.JPG.pp3",)], "path string")
    assert {r["stem"]: r["sidecar"] for r in shots.sidecar(found, existing).collect()} == {"a": "s/a.JPG.pp3", "b": "s/x/b.JPG.pp3", "c": "s/.h/c.JPG.pp3"}
    assert [(r["name"], r["stems"]) for r in shots.groups(found, "s").collect()] == [("x", ["b"]), ("@a", ["a"])]
