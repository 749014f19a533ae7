"""Snapshots of an environment: reading versions, pairing slices, schedules, markers that tell whether two reads agree, and plans on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions.canonical import canonical_timestamp, order_free_digest, row_hash, set_digest

#: Order of locales that have a rank; others follow by name.
LOCALES = ("en", "it", "de", "fr", "es")


def read_versions(records: DataFrame, models: list[str], slice_: str) -> DataFrame:
    """``record_id, item_type_id, fields``: one slice (current or published) of the records of some models; records without that slice have no row."""
    return records.where(F.col("item_type_id").isin(*models)).select("record_id", "item_type_id", F.col(slice_).alias("fields")).where("fields IS NOT NULL")


def pair_violations(current: DataFrame, published: DataFrame) -> DataFrame:
    """``rule, record_id``: ids that repeat in a slice, published rows without a current one, and rows whose slices name different models."""
    told = lambda df, rule: df.select(F.lit(rule).alias("rule"), "record_id")
    twice = lambda df: df.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")
    alone = published.join(current.select("record_id"), "record_id", "left_anti")
    other = published.join(current.select("record_id", F.col("item_type_id").alias("_t")), "record_id").where("item_type_id <> _t")
    out = told(twice(current), "current repeats").unionByName(told(twice(published), "published repeats"))
    return out.unionByName(told(alone, "published without current").distinct()).unionByName(told(other, "models differ").distinct())


def attach_schedules(records: DataFrame, schedules: DataFrame) -> DataFrame:
    """Adds ``schedule`` (struct of ``at, kind``) to records with the marker ``scheduled``; null without the marker or a detail.

    Details are read for marked records only: the join sees no others. Of several details of one record, the earliest counts.
    """
    first = schedules.groupBy("record_id").agg(F.min(F.struct("at", "kind")).alias("schedule"))
    marked = records.where("scheduled").select("record_id").join(first, "record_id")
    return records.join(marked, "record_id", "left")


def canonical_schedules(schedules: DataFrame, order: tuple[str, ...] = LOCALES) -> DataFrame:
    """``record_id, at, locales``: times as UTC text with milliseconds, locales distinct and by rank, then by name."""
    rank = F.array(*map(F.lit, order))
    ranked = lambda x: F.struct(F.when(F.array_contains(rank, x), F.array_position(rank, x)).otherwise(len(order) + 1).alias("r"), x.alias("x"))
    locales = F.transform(F.array_sort(F.transform(F.array_distinct("locales"), ranked)), lambda e: e["x"])
    return schedules.select("record_id", canonical_timestamp(F.col("at").cast("string")).alias("at"), locales.alias("locales"))


def validity_violations(records: DataFrame) -> DataFrame:
    """``record_id, slice``: rows whose flag of a slice is not the flag of that slice's own validity. In: ``is_valid, current_valid, published_valid_flag, published_valid``."""
    rule = lambda name, a, b: F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(name))
    found = F.array_compact(F.array(rule("current", "is_valid", "current_valid"), rule("published", "published_valid_flag", "published_valid")))
    return records.select("record_id", F.explode(found).alias("slice"))


def marker(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``n, digest``: one row that tells whether two reads hold the same values of ``columns``, whatever their order; null and empty values differ."""
    told = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return rows.select(told.alias("h")).agg(F.count("*").alias("n"), set_digest(F.col("h")).alias("digest"))


def stable_snapshot(read: Callable[[], DataFrame], columns: list[str], keep: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """Read until the marker before and the marker of what was kept agree; an error after ``attempts``. ``keep`` writes a read to a table."""
    for _ in range(attempts):
        before = marker(read(), columns).first()
        table = keep(read())
        if marker(table, columns).first() == before:
            return table
    raise RuntimeError(f"the source changed during each of {attempts} reads")


def write_plan(plan: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write a plan and a manifest (``n, digest, columns``) below ``path``; refuses to overwrite, and checks ids first. Returns the manifest as it was written."""
    if not plan.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a record has several rows in the plan")
    plan.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(f"{path}/plan")
    spark = plan.sparkSession
    written = spark.read.schema(plan.schema).parquet(f"{path}/plan")
    manifest = marker(written, written.columns).withColumn("columns", F.lit(",".join(written.columns)))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def _part_digests(rows: DataFrame) -> DataFrame:
    """``part, n, digest_xor, digest_sum`` of each file of a table."""
    columns = rows.columns
    named = rows.withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return named.groupBy("part").agg(*order_free_digest(row_hash(*columns)))


def commit_plan(plan: DataFrame, path: str, order: list[str], violations: DataFrame | None = None) -> None:
    """Write a plan so that it counts only as a whole: its parts first, then a manifest with the digest of every part; until the manifest is there, nothing can read it as a plan.

    Refused before anything is written: a record with several rows, rows in ``violations`` (such as of ``plan_violations``), and a path that holds a plan. A write that dies leaves parts without a manifest.
    """
    if not plan.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a record has several rows in the plan")
    if violations is not None and not violations.isEmpty():
        raise ValueError("the plan contradicts itself")
    plan.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(f"{path}/plan")
    written = plan.sparkSession.read.schema(plan.schema).parquet(f"{path}/plan")
    _part_digests(written).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")  # a row a file


def open_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan that ``commit_plan`` wrote. An error if its manifest is missing, or if a part is missing, added or changed since."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        raise ValueError("the plan was not committed") from e
    try:
        plan = spark.read.parquet(f"{path}/plan")
    except AnalysisException as e:
        raise ValueError("the plan is not what was committed: no part is left") from e
    there = _part_digests(plan)
    if not manifest.exceptAll(there.select(manifest.columns)).unionByName(there.select(manifest.columns).exceptAll(manifest)).isEmpty():
        raise ValueError("the plan is not what was committed")
    return plan


def byte_violations(contents: DataFrame, expected: DataFrame) -> DataFrame:
    """``id, problem, sha256``: assets whose bytes (``id, content``) are missing or have another MD5 than expected (``id, md5``), with the SHA-256 of what is there."""
    there = contents.select("id", F.md5("content").alias("_md5"), F.sha2("content", 256).alias("sha256"))
    joined = expected.join(there, "id", "left")
    problem = F.when(F.col("_md5").isNull(), "missing").when(F.col("_md5") != F.col("md5"), "other bytes")
    return joined.select("id", problem.alias("problem"), "sha256").where("problem IS NOT NULL")
