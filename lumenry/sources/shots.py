"""Files to shots: classification, pairing, scanning, sidecars and move plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import JPEG_EXTENSIONS, RAW_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def kind(path: Column) -> Column:
    """``jpeg``, ``raw`` or null, by the extension without regard to case."""
    name = file_name(path)
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    return F.when(extension.isin(JPEG_EXTENSIONS), "jpeg").when(extension.isin(RAW_EXTENSIONS), "raw")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def pair(files: DataFrame, path_col: str = "path") -> DataFrame:
    """One row per (dir, stem): the smallest JPEG and the smallest RAW path.

    A full outer pairing done as one aggregation, so files shuffle once. Other files
    and names that begin with a dot are left out.
    """
    path = F.col(path_col)
    own = files.select(path.alias("path"), kind(path).alias("kind")).where(F.col("kind").isNotNull() & ~file_name(path).startswith("."))
    return own.groupBy(parent(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem")).agg(
        F.min(F.when(F.col("kind") == "jpeg", F.col("path"))).alias("jpeg"),
        F.min(F.when(F.col("kind") == "raw", F.col("path"))).alias("raw"),
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of the files right in ``directory``; contents are not read."""
    return spark.read.format("binaryFile").load(directory).select("path", "length", "modificationTime")


def scan(spark: SparkSession, directory: str) -> DataFrame:
    return pair(list_files(spark, directory)).orderBy("stem")


def shots_of(images: DataFrame, shots: DataFrame) -> DataFrame:
    """Shots of ``images(path, pos)``, each once, by first mention; other paths raise an error."""
    named = images.select(parent(F.col("path")).alias("dir"), stem(F.col("path")).alias("stem"), "path", "pos")
    met = named.join(shots, ["dir", "stem"], "left")
    known = F.coalesce(F.col("path") == F.col("jpeg"), F.lit(False)) | F.coalesce(F.col("path") == F.col("raw"), F.lit(False))
    checked = met.withColumn("pos", F.when(known, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), "path"))))
    return checked.groupBy("dir", "stem", "jpeg", "raw").agg(F.min("pos").alias("pos")).orderBy("pos")


def scan_counts(shots: DataFrame) -> DataFrame:
    both = F.col("jpeg").isNotNull() & F.col("raw").isNotNull()
    return shots.agg(
        F.count("*").alias("shots"),
        F.count_if(both).alias("paired"),
        F.count_if(F.col("raw").isNull()).alias("jpeg_only"),
        F.count_if(F.col("jpeg").isNull()).alias("raw_only"),
    )


def groups(shots: DataFrame, directory: str) -> DataFrame:
    """Sub-folders that hold shots, sorted, then every shot right in ``directory`` as ``@stem``."""
    top = F.col("dir") == directory
    inside = F.col("dir").startswith(directory.rstrip("/") + "/")
    name = F.when(top, F.concat(F.lit("@"), "stem")).otherwise(file_name(F.col("dir")))
    named = shots.where((top | inside) & ~file_name(F.col("dir")).startswith(".")).withColumn("name", name)
    return named.groupBy("name").agg(F.array_sort(F.collect_list("stem")).alias("stems")).orderBy(F.col("name").startswith("@"), "name")


def sidecar(shots: DataFrame, existing: DataFrame) -> DataFrame:
    """``shots`` with ``sidecar``: an existing one of the RAW, else of the JPEG, else the one to create."""
    on_raw, on_jpeg = (existing.select(F.col("path").alias(f"at_{k}")) for k in ("raw", "jpeg"))
    met = shots.join(on_raw, F.concat("raw", F.lit(".pp3")) == F.col("at_raw"), "left")
    met = met.join(on_jpeg, F.concat("jpeg", F.lit(".pp3")) == F.col("at_jpeg"), "left")
    made = F.concat(F.coalesce("raw", "jpeg"), F.lit(".pp3"))
    return met.select(*shots.columns, F.coalesce("at_raw", "at_jpeg", made).alias("sidecar"))


def fresh_entries(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached rows whose name, length and time are unchanged, and the files to read again."""
    key = ["name", "length", "modified"]
    return cache.join(files.select(key), key, "left_semi"), files.join(cache.select(key), key, "left_anti")


def move_plan(shots: DataFrame, members: DataFrame, taken: DataFrame, directory: str, sidecars: DataFrame | None = None) -> DataFrame:
    """``(dir, stem, source, target)`` for batches ``members(label, dir, stem, pos)`` of two or more.

    A batch's folder is label and first stem (the stem alone without a label). If that name is in
    ``taken(folder)`` or is an earlier batch's, it gets the first free number from 2 on. With ``sidecars(path)`` the
    key files of moved pictures go along. Nothing is moved here.
    """
    size = members.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("pos", "stem")).alias("first")).where("n >= 2")
    name = F.when(F.col("label") == "", F.col("first.stem")).otherwise(F.concat_ws("-", "label", "first.stem"))
    base = size.select("label", name.alias("base"), F.col("first.pos").alias("at"))
    # a folder holds its own name as number 1, and the number at its end for the name before it
    held = taken.select("folder").union(base.select("base")).distinct()
    ending = F.regexp_extract("folder", r"^(?s)(.+)-([2-9]|[1-9][0-9]+)$", 2)
    used = held.where(ending != "").select(F.regexp_extract("folder", r"^(?s)(.+)-([2-9]|[1-9][0-9]+)$", 1).alias("base"), ending.cast("long").alias("number"))
    used = used.union(taken.select(F.col("folder").alias("base"), F.lit(1).cast("long"))).distinct()
    used = used.join(base.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("number").alias("used"))
    turn = base.withColumn("turn", F.row_number().over(W.partitionBy("base").orderBy("at", "label")))
    numbered = turn.join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<bigint>")))
    number = F.expr("element_at(array_except(sequence(1L, cast(size(used) + turn as bigint)), used), turn)")
    folder = F.when(number == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string")))
    placed = members.join(numbered.select("label", folder.alias("folder")), "label").join(shots, ["dir", "stem"])
    files = placed.select("dir", "stem", "folder", F.explode(F.array_compact(F.array("jpeg", "raw"))).alias("source"))
    if sidecars is not None:
        beside = files.withColumn("source", F.concat("source", F.lit(".pp3")))
        files = files.unionByName(beside.join(sidecars.select(F.col("path").alias("source")).distinct(), "source", "left_semi"))
    return files.select("dir", "stem", "source", F.concat(F.lit(directory.rstrip("/") + "/"), "folder", F.lit("/"), file_name(F.col("source"))).alias("target"))
