"""Shooting metadata from the first bytes of JPEG and TIFF-like files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import camera, exif_date, taken_ms

HEAD = 256 * 1024
RAW_TAGS = (
    "make string, model string, date string, sub_second string, exposure struct<num:long,den:long>, f_number float, iso long, "
    "focal_length float, lens string, orientation int, thumbnail binary"
)
#: Tag numbers by name.
TAGS = {
    0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "date",
    0x9291: "sub_second", 0x920A: "focal_length", 0xA434: "lens", 0x0201: "thumbnail_at", 0x0202: "thumbnail_size",
}
EXIF_DIRECTORY = 0x8769
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, offset, payload) of a JPEG's segments before its scan."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA or size < 2:
            return
        yield marker, at + 4, data[at + 4 : at + 2 + size]
        at += 2 + size


def tiff_part(data: bytes) -> bytes | None:
    """The TIFF structure of a head: the whole of a TIFF-like file, a JPEG's Exif payload, else nothing."""
    if data[:4] in (b"II*\0", b"MM\0*", b"IIU\0"):
        return data
    return next((p[6:] for m, _, p in segments(data) if m == 0xE1 and p[:6] == b"Exif\0\0"), None)


def entries(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, object]]:
    """Values of one directory, those that lie within the bytes at hand."""
    count = struct.unpack_from(order + "H", tiff, at)[0]
    for k in range(count):
        tag, kind, n, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * n
        place = at + 10 + 12 * k if size <= 4 else value
        if not size or place + size > len(tiff):
            continue
        if kind == 2:
            yield tag, tiff[place : place + n].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            yield tag, struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, place)
        else:
            yield tag, struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], tiff, place)[0]


def read_tags(data: bytes) -> dict:
    """Known tags of a head; broken or missing parts are left out."""
    found, tiff = {}, tiff_part(data)
    if tiff is None or len(tiff) < 8:
        return found
    order = "<" if tiff[:2] == b"II" else ">"
    queue, seen = [struct.unpack_from(order + "I", tiff, 4)[0]], set()
    while queue:
        at = queue.pop(0)
        if at in seen or not 0 < at <= len(tiff) - 2:
            continue
        seen.add(at)
        try:
            for tag, value in entries(tiff, at, order):
                if tag == EXIF_DIRECTORY:
                    queue.append(value)
                elif tag in TAGS:
                    found.setdefault(TAGS[tag], value)
            count = struct.unpack_from(order + "H", tiff, at)[0]
            queue.append(struct.unpack_from(order + "I", tiff, at + 2 + 12 * count)[0])
        except struct.error:
            continue
    at, size = found.pop("thumbnail_at", 0), found.pop("thumbnail_size", 0)
    if at and size and tiff[at : at + 2] == b"\xff\xd8":
        found["thumbnail"] = tiff[at : at + size]
    return found


def with_tags(heads: DataFrame, content: str = "content") -> DataFrame:
    """``heads`` with a struct ``tags`` read from the first 256 KiB of ``content``."""

    @F.pandas_udf(RAW_TAGS)
    def tags(heads: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in RAW_TAGS.split(", ")]
        rows = []
        for head in heads:
            own = read_tags(head or b"")
            for name in ("f_number", "focal_length"):
                num, den = own.get(name, (0, 0))
                own[name] = num / den if den else None
            num, den = own.get("exposure", (0, 0))
            own["exposure"] = {"num": num, "den": den} if num and den else None
            rows.append([own.get(n) for n in names])
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"f_number": "float32", "focal_length": "float32", "iso": "Int64", "orientation": "Int32"})

    return heads.withColumn("tags", tags(F.substring(content, 1, HEAD)))


def read_exif(spark: SparkSession, directory: str) -> DataFrame:
    """One row of metadata per file right in ``directory``."""
    tagged = with_tags(spark.read.format("binaryFile").load(directory).select("path", "content")).drop("content")
    return tagged.select(
        "path",
        exif_date(F.col("tags.date")).alias("taken"),
        taken_ms(F.col("tags.date"), F.col("tags.sub_second")).alias("taken_ms"),
        "tags.exposure", "tags.f_number", "tags.iso", "tags.focal_length",
        camera(F.coalesce("tags.make", F.lit("")), F.coalesce("tags.model", F.lit(""))).alias("camera"),
        "tags.lens", "tags.orientation", "tags.thumbnail",
    )
