"""Integrity of a plan and of snapshots: collisions, ownership, publication boundaries, deletions, labels. Violations are rows; none means that the check passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.operators.order import ranked


def out_of_scope_collisions(source: DataFrame, scoped_destination: DataFrame, visible: DataFrame) -> DataFrame:
    """Ids that only the source has within the scope, but that are visible in the destination outside of it. All tables: ``record_id``."""
    return source.select("record_id").join(scoped_destination.select("record_id"), "record_id", "left_anti").join(visible.select("record_id").distinct(), "record_id", "left_semi")


def shared_ids(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ids that are used for a record and for a block."""
    return records.select(F.col("record_id").alias("id")).intersect(blocks.select(F.col("block_id").alias("id")))


def ownership_moves(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Blocks that both sides have at different sets of locations. In: ``block_id, location``."""
    side = lambda df, n: df.groupBy("block_id").agg(F.sort_array(F.collect_set("location")).alias(n))
    return side(source, "s_locations").join(side(destination, "d_locations"), "block_id").where("s_locations <> d_locations")


def singleton_mismatches(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Singleton models (``item_type_id, record_id``) whose id sets are neither equal nor one against none."""
    side = lambda df, n: df.groupBy("item_type_id").agg(F.count("*").alias(f"{n}_n"), F.sum(F.xxhash64("record_id").cast("decimal(38,0)")).alias(f"{n}_sum"))
    both = side(source, "s").join(side(destination, "d"), "item_type_id", "full_outer").na.fill(0, ["s_n", "d_n"])
    fine = ((F.col("s_n") == F.col("d_n")) & F.col("s_sum").eqNullSafe(F.col("d_sum"))) | ((F.col("s_n") == 1) & (F.col("d_n") == 0))
    return both.where(~fine).select("item_type_id", "s_n", "d_n")


def settings_differences(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Settings (``name, value``) that differ or are on one side only."""
    both = source.withColumnRenamed("value", "s_value").join(destination.withColumnRenamed("value", "d_value"), "name", "full_outer")
    return both.where(~F.col("s_value").eqNullSafe(F.col("d_value")))


def unsafe_tree_children(plan: DataFrame, destination: DataFrame, source: DataFrame) -> DataFrame:
    """Rows that stay below a row that is to be deleted: ``record_id, parent_id``. Rows that the plan moves away or deletes are safe."""
    gone = plan.where("action = 'delete'").select(F.col("record_id").alias("parent_id"))
    below = destination.select("record_id", "parent_id").join(gone, "parent_id", "left_semi").join(gone.withColumnRenamed("parent_id", "record_id"), "record_id", "left_anti")
    after = source.select("record_id", F.col("parent_id").alias("new_parent"))
    return below.join(after, "record_id", "left").where("new_parent IS NULL OR new_parent = parent_id").select("record_id", "parent_id")


def unsafe_published_referrers(published: DataFrame, leaving: DataFrame, desired: DataFrame, gone: DataFrame) -> DataFrame:
    """Live published references (``from_id, to_id``) that stand in the way of rows that are to be unpublished or deleted (``leaving``: ``id``).

    A row that is itself deleted (``gone``: ``record_id``) is safe, and so is one whose desired published references (``desired``) drop the row.
    """
    hit = published.join(leaving.select(F.col("id").alias("to_id")), "to_id", "left_semi").where("from_id <> to_id")
    stays = hit.join(gone.select(F.col("record_id").alias("from_id")), "from_id", "left_anti")
    return stays.join(desired.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_semi").select("from_id", "to_id").distinct()


def unsafe_deletes(deleted: DataFrame, references: DataFrame) -> DataFrame:
    """Things to delete (``id``) that something desired (``from_id, to_id``) still refers to."""
    return deleted.join(references.select(F.col("to_id").alias("id")).distinct(), "id", "left_semi")


def publication_boundary(edges: DataFrame, plan: DataFrame, destination: DataFrame) -> DataFrame:
    """Published references (``from_id, to_id``) to rows outside the plan that are not published in the destination."""
    outside = edges.join(plan.select(F.col("record_id").alias("to_id")), "to_id", "left_anti")
    return outside.join(destination.where("published IS NOT NULL").select(F.col("record_id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id")


def label_occupancy(events: DataFrame) -> DataFrame:
    """Labels that are not free at their turn. In: ``label, seq, claims`` (true: taken at that step, false: given up); steps of one label in order.

    The number of holders before a step is a running sum, so a claim is a violation where it is above 0.
    """
    before = W.partitionBy("label").orderBy("seq", "claims").rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.when(F.col("claims"), 1).otherwise(-1)).over(before), F.lit(0))
    return events.withColumn("holders", held).where("claims AND holders > 0").select("label", "seq")


def structural_issues(blocks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Blocks (``field_id, model_id, ...``) whose model is not in the field's allow-list (``field_id, model_id``); a field without a list allows nothing."""
    return blocks.join(allowed.distinct(), ["field_id", "model_id"], "left_anti")


def skipped_rows(blocked: DataFrame, destination: DataFrame) -> DataFrame:
    """What becomes of skipped rows (``id, blocker, distance``): absent, or preserved with the hash that must stay."""
    there = destination.select(F.col("record_id").alias("id"), F.col("hash").alias("preserved_hash"))
    joined = blocked.join(there, "id", "left")
    return joined.withColumn("disposition", F.when(F.col("preserved_hash").isNull(), "absent").otherwise("preserve target"))


def distinct_reasons(reasons: DataFrame) -> DataFrame:
    """``record_id, reasons``: distinct reasons (``record_id, code, slice``) joined in order of code and slice."""
    listed = F.array_sort(F.collect_set(F.struct("code", "slice")))
    return reasons.groupBy("record_id").agg(F.array_join(F.transform(listed, lambda r: F.concat_ws("/", r["code"], r["slice"])), ",").alias("reasons"))


def default_suppressions(values: DataFrame, defaults: DataFrame) -> DataFrame:
    """Defaults that would overwrite nulls in a create: ``item_type_id, field, n_records``. In: ``record_id, item_type_id, field, value`` with the nulls."""
    hit = values.where("value IS NULL").join(defaults.where("default_value IS NOT NULL"), ["item_type_id", "field"])
    return hit.groupBy("item_type_id", "field").agg(F.countDistinct("record_id").alias("n_records"))


def compact_positions(records: DataFrame, removed: DataFrame) -> DataFrame:
    """Siblings renumbered from 1 after ``removed`` ids are gone: ``record_id, position``."""
    left = records.join(removed.select("record_id"), "record_id", "left_anti")
    return ranked(left, "place").select("record_id", F.col("place").alias("position"))


def execution_steps(plan: DataFrame, levels: DataFrame) -> DataFrame:
    """Ordered steps ``record_id, phase, level``: creates by level, then updates, then deletes by descending level."""
    phase = F.when(F.col("action") == "create", 1).when(F.col("action") == "update", 2).otherwise(3)
    joined = plan.where("action <> 'noop'").join(levels.withColumnRenamed("id", "record_id"), "record_id", "left")
    level = F.coalesce("level", F.lit(0))
    return joined.select("record_id", phase.alias("phase"), F.when(F.col("action") == "delete", -level).when(F.col("action") == "update", 0).otherwise(level).alias("level"))


def first_issue(issues: DataFrame, by: list[str]) -> DataFrame:
    """The issue of the lowest record id of each group."""
    return issues.groupBy(*by).agg(F.min("record_id").alias("record_id"))


def unmet_names(files: DataFrame, done: DataFrame) -> DataFrame:
    """Names not yet recorded as done."""
    return files.select("name").distinct().join(done.select("name"), "name", "left_anti")
