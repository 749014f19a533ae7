"""The writes of a plan, record by record: which versions a row passes through on its way, and what a sanitizer would make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.operators.blocks import unstable_texts
from planweave.operators.explode import explode_document

#: The stages in the order in which an apply goes through them.
STAGES = ("create", "unique-release", "tree-reparent", "published-stage", "current-restore", "delete-release", "position-finalize")


def write_stages(rows: DataFrame) -> DataFrame:
    """``record_id, step, stage, version, hash``: every write of every record with the version that it leaves as the current one; ``step`` is the stage's place in STAGES.

    ``rows``, one a record: ``record_id, action``, versions as canonical texts (``desired_current, desired_published, baseline_current, baseline_published``, null where there is none), ``seed`` (what a create begins with; null: its
    published version, else the current one), ``release`` and ``delete_release`` (projected versions, null where nothing is released), and flags ``draft_mode, publication_seed, tree, reparents, repositions``. A stage that would
    leave the version as it is writes nothing; a published version that is there already is not staged again; without draft mode every write publishes. A move writes the version that stands at that time. One projection, no shuffle.
    """
    create, delete, writes = F.col("action") == "create", F.col("action") == "delete", F.col("action").isin("create", "update")
    begin = F.when(create, F.coalesce("seed", "desired_published", "desired_current")).otherwise(F.col("baseline_current"))
    now = rows.withColumn("_begin", begin).withColumn("_freed", F.coalesce("release", "_begin"))
    released = ~F.col("_freed").eqNullSafe(F.col("_begin"))
    first = F.when(create, F.when(~F.col("draft_mode") | F.col("publication_seed"), F.col("_begin"))).otherwise(F.col("baseline_published"))
    public = F.when(~F.col("draft_mode") & released, F.col("_freed")).otherwise(first)
    stages_it = writes & F.col("desired_published").isNotNull() & ~public.eqNullSafe(F.col("desired_published"))
    now = now.withColumn("_released", released).withColumn("_staged", F.when(stages_it, F.col("desired_published")).otherwise(F.col("_freed")))
    now = now.withColumn("_last", F.when(writes, F.coalesce("desired_current", "_staged")).otherwise(F.col("_staged")))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    made = {
        "create": (create, "_begin"),
        "unique-release": (F.col("_released"), "_freed"),
        "tree-reparent": ((F.col("action") == "update") & F.col("tree") & F.col("reparents"), "_freed"),
        "published-stage": (differs("_staged", "_freed"), "_staged"),
        "current-restore": (writes & differs("_last", "_staged"), "_last"),
        "delete-release": (delete & F.col("delete_release").isNotNull() & differs("delete_release", "baseline_current"), "delete_release"),
        "position-finalize": (writes & F.col("repositions"), "_last"),
    }
    steps = [F.when(made[s][0], F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(made[s][1]).alias("version"))) for i, s in enumerate(STAGES)]
    listed = now.select("record_id", F.inline(F.array_compact(F.array(*steps))))
    return listed.withColumn("hash", F.sha2("version", 256))


def stage_risks(stages: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``record_id, stage, path``: texts of ``fields`` in the versions of ``write_stages`` that a sanitizer would change, so that what is written is not what was planned."""
    versions = stages.select(F.to_json(F.struct("record_id", "stage")).alias("record_id"), F.col("version").alias("value"))
    found = unstable_texts(explode_document(versions), fields)
    return found.select(F.get_json_object("record_id", "$.record_id").alias("record_id"), F.get_json_object("record_id", "$.stage").alias("stage"), "path")
