"""Running sums within groups that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.operators.store import kept


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, tasks: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group up to and with this one, in ``order`` (which must tell rows apart).

    Rows are dealt by ranges of (group, order), so a large group lies in many tasks. Each sums up its part, and what stands before a part comes from a
    table of at most one row per task: a range cuts one group at each end. Null group values are one group. The ranges are kept as a table,
    as sampled ranges may differ from run to run. Columns named ``_part``, ``_ahead`` or like ``name`` are replaced.
    """
    df = df.drop("_part", "_ahead", name)
    tasks = tasks or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept(df.repartitionByRange(tasks, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = dealt.withColumn(name, F.sum(value).over(W.partitionBy("_part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    parts = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    ahead = parts.withColumn("_ahead", before).where("_ahead IS NOT NULL").select("_part", "_ahead", *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)))
    same = own["_part"] == ahead["_part"]
    for i, g in enumerate(group):
        same &= own[g].eqNullSafe(ahead[f"_g{i}"])
    joined = own.join(F.broadcast(ahead), same, "left")  # one row per task at most
    return joined.select(*(own[c] for c in df.columns), (own[name] + F.coalesce(ahead["_ahead"], F.lit(0))).alias(name))
