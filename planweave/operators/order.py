"""Order among siblings: positions, checks, moves, and simple set operators on id tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.functions.canonical import set_digest
from planweave.operators.prefix import running_sum
from planweave.operators.store import kept

GROUP = ["item_type_id", "parent_id"]


def ranked(records: DataFrame, name: str = "rank") -> DataFrame:
    """Place of every record among its siblings (same model and parent) by position, then id, from 1."""
    order = [F.col("position").asc_nulls_last(), F.col("record_id").asc()]
    return running_sum(records, GROUP, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def sibling_order_violations(desired: DataFrame, live: DataFrame) -> DataFrame:
    """Relative mode: records whose place among the siblings that both sides have is not the same on both."""
    keep = ["record_id", *GROUP, "position"]
    a, b = desired.select(keep), live.select(keep)
    pair = ["record_id", *GROUP]
    shared = a.join(b.select("record_id", F.col("item_type_id").alias("_t"), F.col("parent_id").alias("_p")), "record_id").where(
        (F.col("item_type_id") == F.col("_t")) & F.col("parent_id").eqNullSafe(F.col("_p"))
    )
    ids = shared.select("record_id")
    two = ranked(a.join(ids, "record_id", "left_semi"), "desired_rank").select(*pair, "desired_rank").join(
        ranked(b.join(ids, "record_id", "left_semi"), "live_rank").select("record_id", "live_rank"), "record_id"
    )
    return two.where("desired_rank <> live_rank").select("record_id", "desired_rank", "live_rank")


def affected_groups(diff: DataFrame) -> DataFrame:
    """Sibling groups that a create, a delete or a changed place touches, old and new. In: ``diff_entities`` of records."""
    moved = ~F.col("s_parent_id").eqNullSafe(F.col("d_parent_id")) | ~F.col("s_position").eqNullSafe(F.col("d_position"))
    touched = diff.where(F.col("action").isin("create", "delete") | moved)
    ends = F.array(
        F.when(F.col("s_item_type_id").isNotNull(), F.struct(F.col("s_item_type_id").alias("item_type_id"), F.col("s_parent_id").alias("parent_id"))),
        F.when(F.col("d_item_type_id").isNotNull(), F.struct(F.col("d_item_type_id").alias("item_type_id"), F.col("d_parent_id").alias("parent_id"))),
    )
    return touched.select(F.explode(F.array_compact(ends)).alias("g")).select("g.*").distinct()


def target_positions(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Final places within affected groups, with the neighbours on both sides: ``record_id, place, before_id, after_id``."""
    mine = records.alias("r").join(groups.select(F.col("item_type_id").alias("_t"), F.col("parent_id").alias("_p")), (F.col("item_type_id") == F.col("_t")) & F.col("parent_id").eqNullSafe(F.col("_p")), "left_semi")
    placed = kept(ranked(mine, "place").select("record_id", *GROUP, "place"), "places")

    def neighbour(step: int, name: str) -> DataFrame:
        return placed.select(F.col("item_type_id").alias("_t"), F.col("parent_id").alias("_p"), (F.col("place") - step).alias("_place"), F.col("record_id").alias(name))

    out = placed
    for step, name in ((-1, "before_id"), (1, "after_id")):
        on = (F.col("item_type_id") == F.col("_t")) & F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("place") == F.col("_place"))
        out = out.join(neighbour(step, name), on, "left").drop("_t", "_p", "_place")
    return out.select("record_id", "place", "before_id", "after_id")


def next_positions(records: DataFrame) -> DataFrame:
    """The first free position of every sibling group."""
    return records.groupBy(*GROUP).agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next_position"))


def move_priority(diff: DataFrame) -> DataFrame:
    """Moves, the farthest first: distance, 100 more if the parent changed; equal ones by id."""
    gap = F.abs(F.col("s_position") - F.col("d_position")) + F.when(F.col("s_parent_id").eqNullSafe(F.col("d_parent_id")), 0).otherwise(100)
    return diff.where("action = 'update'").select("record_id", gap.alias("priority")).where("priority > 0")


def execution_sequence(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``record_id, seq`` joined to all rows; rows without a place in the plan come last, by id."""
    return rows.select("record_id").join(order, "record_id", "left")


def topology_signature(records: DataFrame) -> DataFrame:
    """``item_type_id, n, digest``: an order-free digest of (id, parent, position) of each model's records; a missing parent or position counts as empty."""
    told = F.sha2(F.concat_ws("|", "record_id", F.coalesce("parent_id", F.lit("")), F.coalesce(F.col("position").cast("string"), F.lit(""))), 256)
    return records.select("item_type_id", told.alias("told")).groupBy("item_type_id").agg(F.count("*").alias("n"), set_digest(F.col("told")).alias("digest"))


def apply_ids(baseline: DataFrame, plan: DataFrame) -> DataFrame:
    """Ids after a plan: the baseline's without deleted ones, and created ones."""
    created, deleted = (plan.where(F.col("action") == a).select("record_id") for a in ("create", "delete"))
    return baseline.select("record_id").join(deleted, "record_id", "left_anti").unionByName(created)


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """``same``: one row that tells whether two id tables hold the same ids as often, whatever their order."""
    side = lambda df, n: df.select(F.col(df.columns[0]).alias("id"), F.lit(n).alias("n"))
    uneven = side(a, 1).unionByName(side(b, -1)).groupBy("id").agg(F.sum("n").alias("n")).where("n <> 0")
    return uneven.agg((F.count("*") == 0).alias("same"))
