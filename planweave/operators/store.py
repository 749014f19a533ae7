"""Intermediate tables of iterative operators, in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary folder is chosen and remembered, but on one machine only: a cluster's executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="planweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/planweave/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked to be sent whole to all executors where it has at most ``rows`` narrow rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: iterations then don't grow the plan, and lost executors lose nothing. A table that was kept already is returned as it is."""
    if getattr(df, "_kept", False):
        return df
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = True
    return out
