"""Tables between the rounds of a job: written to the folder that the cluster shares, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read again, so that a lost executor costs a reread; a folder of its own on a local master."""
    conf = df.sparkSession.conf
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = tempfile.mkdtemp(prefix="lumenry-")
    path = f"{base.rstrip('/')}/lumenry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
