"""Writing back: key files saved whole, move plans applied or rolled back, a cache kept fresh."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_text(path: str, text: str, backup: bool = False) -> None:
    """Replace a file in one step, keeping its permissions; with ``backup`` its first version stays as ``.bak``."""
    mode = os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644
    if backup and os.path.exists(path) and not os.path.exists(path + ".bak"):
        shutil.copy2(path, path + ".bak")
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(temporary, mode)
    os.replace(temporary, path)


def save_profiles(texts: DataFrame, backup: bool = True) -> None:
    """Write every ``text`` to its ``path``, from the tasks that hold them; paths are on storage that executors share."""

    def save(rows) -> None:
        for row in rows:
            save_text(row["path"], row["text"], backup)

    texts.select("path", "text").foreachPartition(save)


def apply_moves(plan: DataFrame, folder: str | None = None) -> DataFrame:
    """Move the files of ``plan(dir, stem, source, target)``, a shot at a time; ``(dir, stem, error)`` of the shots, kept in ``folder`` (by default one in the shared folder).

    Nothing is overwritten. When one file of a shot cannot move, its others go back.
    A shot's few files are one group, so shots move in parallel. What was done is written to ``folder``, so that
    looking at it again moves nothing; a shot whose task is run again after a lost executor finds its files at their targets.
    """
    shots = plan.groupBy("dir", "stem").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("files"))

    def moved(batches):
        for batch in batches:
            errors = []
            for files in batch.column("files").to_pylist():
                done, error = [], None
                for source, target in ((f["source"], f["target"]) for f in files):
                    try:
                        if os.path.exists(target) and not os.path.exists(source):
                            continue  # an earlier attempt of this task moved it
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        if os.path.exists(target):
                            raise FileExistsError(target)
                        os.rename(source, target)
                        done.append((source, target))
                    except OSError as e:
                        error = f"{type(e).__name__}: {target}"
                        for back, now in reversed(done):
                            os.rename(now, back)
                        break
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("dir"), batch.column("stem"), pa.array(errors, pa.string())], ["dir", "stem", "error"])

    schema = "dir string, stem string, error string"
    if folder is None:
        shared = plan.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", plan.sparkSession.conf.get("spark.master", "local")):
            raise ValueError("name a folder that the executors share, or set spark.checkpoint.dir")
        folder = f"{shared or tempfile.mkdtemp()}/moves-{uuid.uuid4().hex}"
    shots.mapInArrow(moved, schema).write.parquet(folder)
    return plan.sparkSession.read.schema(schema).parquet(folder)


def update_cache(spark: SparkSession, cached: DataFrame, files: DataFrame, made: DataFrame, path: str) -> None:
    """A cache of this ``files`` alone at ``path``: unchanged rows stay, ``made`` rows are added.

    It becomes a new version beside the last one, so that a crash meanwhile loses nothing.
    """
    kept = cached.join(files.select("name", "length", "modified"), ["name", "length", "modified"], "left_semi")
    fresh = kept.join(made.select("name"), "name", "left_anti").unionByName(made)
    held = sorted(int(n) for n in _versions(spark, path))
    fresh.write.parquet(f"{path}/version={held[-1] + 1 if held else 0}")
    for old in held[:-1]:  # the last one stays for readers that have it open
        _folder(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(_folder(spark, f"{path}/version={old}"), True)


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Numbers of the whole versions of a cache; one that a lost driver left half written has no ``_SUCCESS``."""
    folder = _folder(spark, path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(_folder(spark, f"{path}/version=*/_SUCCESS")) if files.exists(folder) else None
    return [f.getPath().getParent().getName().partition("=")[2] for f in found or ()]


def open_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest whole version of the cache at ``path``, empty where there is none."""
    held = sorted(int(n) for n in _versions(spark, path))
    return spark.read.schema(schema).parquet(f"{path}/version={held[-1]}") if held else spark.createDataFrame([], schema)
