"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators.store import kept, new_path

#: A word is a longest run of characters outside this class (fixed by the data contract).
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text):
    """Number of words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in smaller parts, as Python values take many times their Arrow size. At the end the worker gives back memory that it no longer uses."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    pa.default_memory_pool().release_unused()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``."""
    return new_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, as the files lie in shared storage.
    """
    return kept(df, name, compression="zstd")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
