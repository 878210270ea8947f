"""Cutting the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(spark, name: str) -> str:
    """A new folder below the one that the session names for what jobs write in between. Only a local session, as in tests, may name none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="muster-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """A frame written once to the folder that the session names for checkpoints and read from there, so that later rounds neither plan nor compute it again. A checkpoint would compute it twice.

    path: where it is written instead, over what is there.
    """
    path = path or folder(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
