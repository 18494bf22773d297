"""Heads and previews of picture files, read as byte ranges: a file is opened in the task that needs it and never read whole.

``spark.dataSource.register(HeadSource)`` makes ``spark.read.format("heads").load(directory)`` known; ``heads_of`` does the same
for a table of paths. What is read follows the columns asked for: without a preview among them there is one read a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import JPEG_EXTENSIONS, RAW_EXTENSIONS
from .exif import HEAD, read_tags, segments, tiff_part

SCHEMA = (
    "path string, length long, kind string, head binary, orientation int, focus struct<x:double,y:double>, "
    "preview binary, preview_from string, bytes_read long, error string"
)
ARROW = {
    "path": pa.string(), "length": pa.int64(), "kind": pa.string(), "head": pa.binary(), "orientation": pa.int32(),
    "focus": pa.struct([("x", pa.float64()), ("y", pa.float64())]), "preview": pa.binary(), "preview_from": pa.string(), "bytes_read": pa.int64(), "error": pa.string(),
}
#: Bytes of a batch that a task hands on, and files of a task.
BATCH_BYTES, FILES_A_TASK = 16 << 20, 256
#: Tags of the places that are followed, and the mark of the maker notes that hold a focus point.
EXIF_PLACE, MAKER_NOTE, FOCUS_POINT, MPF_ENTRIES, RW2_PREVIEW = 0x8769, 0x927C, 0x004D, 0xB002, 0x002E
MAKER = b"Panasonic\0\0\0"
JPEG_START = b"\xff\xd8"


class Place(NamedTuple):
    start: int
    size: int


class _Numbers:
    """Whole numbers of a TIFF structure; None where the bytes end before."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.order = {b"II*\0": "little", b"IIU\0": "little", b"MM\0*": "big"}.get(bytes(data[:4]))

    def at(self, place: int | None, size: int = 4) -> int | None:
        if self.order is None or place is None or not 0 <= place <= len(self.data) - size:
            return None
        return int.from_bytes(self.data[place : place + size], self.order)

    def tag(self, directory: int | None, tag: int) -> tuple[int, int] | None:
        """(count, value) of a tag in a directory."""
        for k in range(self.at(directory, 2) or 0):
            place = directory + 2 + 12 * k
            if self.at(place, 2) == tag:
                count, value = self.at(place + 4), self.at(place + 8)
                return None if count is None or value is None else (count, value)
        return None


def mpf_place(head: bytes) -> Place | None:
    """Where the largest extra picture of a multi-picture JPEG lies; the index is in the head, the picture after the main one."""
    for marker, offset, payload in segments(head):
        if marker == 0xE2 and payload[:4] == b"MPF\0":
            tiff = _Numbers(payload[4:])
            count, records = tiff.tag(tiff.at(4), MPF_ENTRIES) or (0, 0)
            most = min(count, max(0, len(payload) - 4 - records)) // 16
            found = [(tiff.at(records + 16 * k + 4), tiff.at(records + 16 * k + 8)) for k in range(1, most)]
            places = [Place(offset + 4 + start, size) for size, start in found if size and start is not None]
            return max(reversed(places), key=lambda p: p.size, default=None)
    return None


def rw2_place(head: bytes) -> Place | None:
    """Where the JPEG of an RW2 file lies."""
    tiff = _Numbers(head)
    found = tiff.tag(tiff.at(4), RW2_PREVIEW) if head[:4] == b"IIU\0" else None
    return found and Place(found[1], found[0])


def scan_start(jpeg: bytes) -> int | None:
    """Where the entropy-coded data of a JPEG begins."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xDA:
            return at + 2 + size
        at += 2 + size
    return None


def focus_point(exif: bytes | None) -> tuple[float, float] | None:
    """The focus point of the maker notes as fractions of the sensor's sides."""
    tiff = _Numbers(exif or b"")
    _, own = tiff.tag(tiff.at(4), EXIF_PLACE) or (0, None)
    _, notes = tiff.tag(own, MAKER_NOTE) or (0, None)
    if notes is None or exif[notes : notes + 12] != MAKER:
        return None
    _, place = tiff.tag(notes + 12, FOCUS_POINT) or (0, None)
    parts = [tiff.at(None if place is None else place + 4 * k) for k in range(4)]
    if None in parts or not parts[1] or not parts[3]:
        return None
    x, y = parts[0] / parts[1], parts[2] / parts[3]
    return (x, y) if x <= 1 and y <= 1 else None


def upright(x: Column, y: Column, orientation: Column) -> Column:
    """A focus point of the sensor in the upright picture, as a struct."""
    pair = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(orientation == 3, pair(1 - x, 1 - y)).when(orientation == 6, pair(y, 1 - x)).when(orientation == 8, pair(1 - y, x)).otherwise(pair(x, y))


def _turned(point: tuple[float, float], orientation: int | None) -> dict:
    x, y = point
    x, y = {3: (1 - x, 1 - y), 6: (y, 1 - x), 8: (1 - y, x)}.get(orientation, (x, y))
    return {"x": x, "y": y}


def _kind_of(path: str) -> str | None:
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return "jpeg" if extension in JPEG_EXTENSIONS else "raw" if extension in RAW_EXTENSIONS else None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def read_parts(path: str, columns: Iterable[str]) -> dict:
    """What ``columns`` need of one file. A file that cannot be read gives its error; so does none that is merely not understood."""
    columns, row = set(columns), {"path": path, "kind": _kind_of(path), "bytes_read": 0}
    try:
        system, inner = _opened(path)
        with system.open_input_file(inner) as file:
            row["length"] = file.size()
            if not columns & {"head", "orientation", "focus", "preview", "preview_from"}:
                return row
            head = file.read_at(min(HEAD, file.size()), 0)
            row |= {"head": head, "bytes_read": len(head)}
            inside = rw2_place(head)
            jpeg = head[inside.start : inside.start + inside.size] if inside else head
            exif = tiff_part(jpeg)
            row["orientation"] = read_tags(head).get("orientation") or read_tags(jpeg).get("orientation")
            point = focus_point(exif)
            row["focus"] = point and _turned(point, row["orientation"])
            if columns & {"preview", "preview_from"}:
                _preview(file, head, inside, row)
    except (OSError, pa.ArrowException) as e:
        row["error"] = str(e)
    return row


def _preview(file, head: bytes, inside: Place | None, row: dict) -> None:
    """The embedded preview by one more read at most; a JPEG without a sound one is read whole."""
    place = inside or mpf_place(head)
    if place:
        end, data = place.start + place.size, b""
        if end <= len(head):
            data = head[place.start : end]
        elif end <= row["length"]:
            data = file.read_at(place.size, place.start)
            row["bytes_read"] += len(data)
        if data[:2] == JPEG_START:
            row |= {"preview": data, "preview_from": "rw2" if inside else "mpf"}
            return
    if head[:2] == JPEG_START:
        rest = file.read_at(row["length"] - len(head), len(head)) if row["length"] > len(head) else b""
        row["bytes_read"] += len(rest)
        row |= {"preview": head + rest, "preview_from": "whole"}


def _batches(paths: Iterable[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    schema, held, size = pa.schema([(c, ARROW[c]) for c in columns]), [], 0
    for path in paths:
        row = read_parts(path, columns)
        held.append({c: row.get(c) for c in columns})
        size += sum(len(held[-1].get(c) or b"") for c in ("head", "preview"))
        if size >= BATCH_BYTES or len(held) >= 1024:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _HeadReader(DataSourceReader):
    def __init__(self, directory: str, columns: list[str]) -> None:
        self.directory, self.columns = directory, columns

    def partitions(self) -> list[_Files]:
        system, inner = _opened(self.directory)
        found = system.get_file_info(fs.FileSelector(inner, recursive=False))
        scheme = self.directory.partition("://")[0] + "://" if "://" in self.directory and not self.directory.startswith("file:") else ""
        paths = sorted(scheme + f.path for f in found if f.is_file and not f.base_name.startswith(".") and _kind_of(f.path))
        return [_Files(paths[k : k + FILES_A_TASK]) for k in range(0, len(paths), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.paths, self.columns)


class HeadSource(DataSource):
    """Pictures right in a directory, a row each; a schema of fewer columns reads less. An empty directory gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        unknown = [c for c in schema.names if c not in ARROW]
        if unknown or "path" not in self.options:
            raise ValueError(f"heads: no column {unknown[0]}" if unknown else "heads: load() needs a directory")
        return _HeadReader(self.options["path"], schema.names)


def heads_of(files: DataFrame, path: str = "path", columns: Iterable[str] = ("path", "length", "kind", "head", "orientation", "focus", "error")) -> DataFrame:
    """The same rows for a table of paths, whose tasks open the files; rows without a path are left out."""
    columns = list(columns)
    types = {part.split(" ", 1)[0]: part for part in re.split(r", (?=\w+ )", SCHEMA)}
    own = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"))
    return own.mapInArrow(lambda batches: _batches((p for b in batches for p in b.column("path").to_pylist()), columns), ", ".join(types[c] for c in columns))


def shot_heads(shots: DataFrame) -> DataFrame:
    """Heads of shots ``(.., jpeg, raw)``: of the RAW file, else of the JPEG."""
    return heads_of(shots.select(F.coalesce("raw", "jpeg").alias("path")))


def shot_previews(shots: DataFrame) -> DataFrame:
    """Pictures to browse with: the JPEG's embedded one, else the JPEG, else that of the RAW file (null where it holds none that is found)."""
    return heads_of(shots.select(F.coalesce("jpeg", "raw").alias("path")), columns=("path", "orientation", "preview", "preview_from", "bytes_read", "error"))
