"""Shared-folder tables: the way this subpackage cuts lineage.

A table goes to the folder that the session names in ``spark.checkpoint.dir``, which
all executors of a cluster share, and is read again. Lost executors then cost a
reread, not a recomputation. Where the setting is absent one folder is made, on a
local master only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_024
_OWN = "lumenry.workdir"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def workdir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no shared folder, and {master} has executors on other machines")
        base = tempfile.mkdtemp(prefix="lumenry-")
        spark.conf.set(_OWN, base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/lumenry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold at most ``BATCH_ROWS`` rows, unless the session sets a number of its own.

    By default a batch holds 10,000 rows, which for texts of a few KB are tens of MB, held several times over in an executor and its worker.
    """
    if int(spark.conf.get(_ROWS)) == 10_000:
        spark.conf.set(_ROWS, BATCH_ROWS)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, read no further than needed."""
    return df.limit(rows + 1).count() <= rows


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df``, a table written by ``materialise``, takes at most about ``most`` bytes in memory.

    Counted in one pass: 16 bytes a row and a fixed field, and the length as JSON of all others.
    """
    sizes = [F.lit(16)]
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        sizes.append(F.lit(16) if kind not in ("string", "binary", "array", "struct", "map") else F.coalesce(F.length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0)) + 24)
    return (df.select(sum(sizes[1:], sizes[0]).cast("long").alias("b")).agg(F.sum("b")).first()[0] or 0) <= most


def new_column(name: str, columns: list[str]) -> None:
    """An error if a column is called ``name`` already: nothing of the caller's is overwritten or doubled."""
    if name.lower() in {c.lower() for c in columns}:
        raise ValueError(f"the table has a column {name!r} already; give another out_col")


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
