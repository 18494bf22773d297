"""Byte ranges of files: what is read, what is found, and files that are broken or missing."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from lumenry.sources import ranges
from lumenry.sources.exif import HEAD

PREVIEW = b"\xff\xd8preview of a picture\xff\xd9"


def directory(rows, order="<", after=0):
    return struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHII", *r) for r in rows) + struct.pack(order + "I", after)


def focus_exif(x, y, orientation):
    """Root with orientation and Exif place, Exif directory with maker notes, their directory with the point."""
    root = struct.pack("<H", 2) + struct.pack("<HHIHH", 0x112, 3, 1, orientation, 0) + struct.pack("<HHII", 0x8769, 4, 1, 38) + bytes(4)
    notes_at, point_at = 38 + 18, 38 + 18 + 12 + 18
    exif = directory([(0x927C, 7, 30, notes_at)])
    notes = ranges.MAKER + directory([(0x4D, 5, 2, point_at)])
    return b"II*\0" + struct.pack("<I", 8) + root + exif + notes + struct.pack("<IIII", *x, *y)


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg_with(extra, gap, exif=b"", wrong=0):
    """A JPEG whose index names pictures after ``gap`` bytes of its own: one small, one that is ``extra``."""
    small = b"\xff\xd8s"
    start = b"\xff\xd8" + (segment(0xE1, b"Exif\0\0" + exif) if exif else b"")
    base = len(start) + 4 + 4
    scan = segment(0xDA, b"")
    length = 4 + 8 + 18 + 48
    first = len(start) + 4 + length + len(scan) + gap
    index = b"II*\0" + struct.pack("<I", 8) + directory([(0xB002, 7, 48, 26)])
    index += struct.pack("<IIIHH", 0, first, 0, 0, 0) + struct.pack("<IIIHH", 0, len(small), first - base, 0, 0)
    index += struct.pack("<IIIHH", 0, len(extra), first + len(small) - base + wrong, 0, 0)
    return start + segment(0xE2, b"MPF\0" + index) + scan, small + extra, first


def rw2_with(preview, at=26):
    return b"IIU\0" + struct.pack("<I", 8) + directory([(0x2E, 7, len(preview), at)])


@pytest.fixture
def folder(tmp_path):
    exif = focus_exif((90, 256), (143, 256), 6)
    head, tail, first = jpeg_with(PREVIEW, 3 << 30, exif)
    with open(tmp_path / "a.JPG", "wb") as f:  # 3 GiB, nearly all of it a hole
        f.write(head)
        f.seek(first)
        f.write(tail)
    with open(tmp_path / "b.rw2", "wb") as f:
        f.write(rw2_with(PREVIEW, 1 << 20))
        f.seek(1 << 20)
        f.write(PREVIEW)
        f.truncate(3 << 30)
    head, tail, _ = jpeg_with(PREVIEW, 300_000, wrong=5)
    (tmp_path / "c.jpg").write_bytes(head + bytes(300_000) + tail)
    (tmp_path / "d.jpeg").write_bytes(b"")
    (tmp_path / "e.rw2").write_bytes(rw2_with(PREVIEW)[:20])
    (tmp_path / "f.txt").write_bytes(b"text")
    (tmp_path / ".g.jpg").write_bytes(PREVIEW)
    (tmp_path / "near.jpg").write_bytes(b"".join(jpeg_with(PREVIEW, 0)[:2]))
    os.mkdir(tmp_path / "more.jpg")
    return tmp_path


def test_source_reads_heads_and_previews_only(spark, folder):
    spark.dataSource.register(ranges.HeadSource)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in spark.read.format("heads").load(str(folder)).collect()}
    assert sorted(rows) == ["a.JPG", "b.rw2", "c.jpg", "d.jpeg", "e.rw2", "near.jpg"]
    a, b, c = rows["a.JPG"], rows["b.rw2"], rows["c.jpg"]
    assert (a["preview"], a["preview_from"], a["bytes_read"]) == (PREVIEW, "mpf", HEAD + len(PREVIEW)) and a["length"] > 3 << 30
    assert (b["preview"], b["preview_from"], b["bytes_read"]) == (PREVIEW, "rw2", HEAD + len(PREVIEW)) and b["kind"] == "raw"
    assert c["preview"] == (folder / "c.jpg").read_bytes() and c["preview_from"] == "whole"
    assert rows["near.jpg"]["preview"] == PREVIEW and rows["near.jpg"]["bytes_read"] == rows["near.jpg"]["length"]
    assert a["orientation"] == 6 and (a["focus"]["x"], a["focus"]["y"]) == (143 / 256, 1 - 90 / 256)
    assert c["focus"] is None and all(r["error"] is None for r in rows.values())
    assert rows["d.jpeg"]["preview"] is None and rows["e.rw2"]["preview"] is None and rows["d.jpeg"]["head"] == b""


def test_fewer_columns_read_less(spark, folder):
    spark.dataSource.register(ranges.HeadSource)
    load = lambda schema: {r["path"].rsplit("/", 1)[-1]: r for r in spark.read.format("heads").schema(schema).load(str(folder)).collect()}
    assert all(r["bytes_read"] == 0 for r in load("path string, length long, bytes_read long").values())
    assert load("path string, orientation int, bytes_read long")["a.JPG"]["bytes_read"] == HEAD
    with pytest.raises(Exception, match="no column"):
        load("path string, colour int")


def test_tables_of_paths(spark, folder):
    jpeg, raw, gone = str(folder / "a.JPG"), "file://" + str(folder / "b.rw2"), str(folder / "gone.jpg")
    shots = spark.createDataFrame([("1", jpeg, raw), ("2", gone, None), ("3", None, raw), ("4", None, None)], "stem string, jpeg string, raw string")
    heads = sorted((r["path"], len(r["head"] or b""), r["error"] is None) for r in ranges.shot_heads(shots).collect())
    assert heads == sorted([(raw, HEAD, True), (gone, 0, False), (raw, HEAD, True)])
    previews = {r["path"]: r for r in ranges.shot_previews(shots).collect()}
    assert previews[jpeg]["preview"] == PREVIEW and previews[raw]["preview_from"] == "rw2" and previews[gone]["error"]
    assert ranges.shot_heads(shots.where("false")).count() == 0


def test_focus_points_and_scans(spark):
    assert ranges.focus_point(focus_exif((1, 2), (1, 4), 1)) == (0.5, 0.25)
    for broken in (focus_exif((3, 2), (1, 4), 1), focus_exif((1, 0), (1, 4), 1), focus_exif((1, 2), (1, 4), 1)[:60], b"", None, b"II*\0"):
        assert ranges.focus_point(broken) is None
    assert ranges.focus_point(focus_exif((1, 2), (1, 4), 1).replace(b"Panasonic", b"Olympus\0\0")) is None
    turned = spark.range(1, 9).select(ranges.upright(F.lit(0.35), F.lit(0.56), F.col("id")).alias("p")).collect()
    assert [(round(r["p"]["x"], 9), round(r["p"]["y"], 9)) for r in turned] == [(0.35, 0.56)] * 2 + [(0.65, 0.44)] + [(0.35, 0.56)] * 2 + [(0.56, 0.65), (0.35, 0.56), (0.44, 0.35)]
    assert ranges.scan_start(b"\xff\xd8" + segment(0xE0, b"abc") + segment(0xDA, b"de") + b"data") == 2 + 7 + 6
    for broken in (b"", b"\xff\xd8\xff", b"\xff\xd8abcdef", b"\xff\xd8" + segment(0xE0, b"abc")):
        assert ranges.scan_start(broken) is None
    head, tail, first = jpeg_with(PREVIEW, 9)
    assert ranges.mpf_place(head) == ranges.Place(first + 3, len(PREVIEW)) and ranges.mpf_place(head[:30]) is None
    assert ranges.rw2_place(rw2_with(PREVIEW)) == ranges.Place(26, len(PREVIEW)) and ranges.rw2_place(b"II*\0" + rw2_with(PREVIEW)[4:]) is None
