"""Validity: rules on versions, matching of diagnostics, relaxations, defaults, schedules, and what must be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions.canonical import is_blank, validator_of


def validate_versions(values: DataFrame, rules: DataFrame) -> DataFrame:
    """``record_id, field, code``: values (``record_id, item_type_id, field, value``) that break a rule.

    ``rules`` is long: ``item_type_id, field, rule, text, lo, hi``, with rule one of required, enum (values joined by ``|``), format (a pattern), length,
    number_range (``lo``/``hi`` may be null), size (of a list whose items are joined by ``|``), date_range (two times joined by ``|``, either may be empty) and unique.
    Blank values break ``required`` only.
    """
    met = values.join(rules.where("rule <> 'unique'"), ["item_type_id", "field"])
    v, blank = F.col("value"), is_blank(F.col("value"))
    outside = lambda x: F.coalesce(x < F.col("lo"), F.lit(False)) | F.coalesce(x > F.col("hi"), F.lit(False))
    bad = (
        F.when(F.col("rule") == "required", blank)
        .when(blank, False)
        .when(F.col("rule") == "enum", ~F.array_contains(F.split("text", r"\|"), v))
        .when(F.col("rule") == "format", ~F.expr("value RLIKE text"))
        .when(F.col("rule") == "length", outside(F.length(v)))
        .when(F.col("rule") == "number_range", outside(v.try_cast("double")))
        .when(F.col("rule") == "size", outside(F.size(F.split(v, r"\|"))))
        .when(F.col("rule") == "date_range", _outside_dates(v, F.col("text")))
    )
    broken = met.where(bad).select("record_id", "field", F.concat(F.lit("VALIDATION_"), F.upper("rule")).alias("code"))
    key = ["item_type_id", "field", "value"]
    claims = values.join(rules.where("rule = 'unique'").select("item_type_id", "field").distinct(), ["item_type_id", "field"], "left_semi").where(~blank)
    shared = claims.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    return broken.unionByName(claims.join(shared, key, "left_semi").select("record_id", "field", F.lit("VALIDATION_UNIQUE").alias("code")))


def _outside_dates(value: Column, bounds: Column) -> Column:
    at, ends = F.try_to_timestamp(value), F.split(bounds, r"\|")
    before = at < F.try_to_timestamp(F.get(ends, F.lit(0)))
    return at.isNull() | F.coalesce(before, F.lit(False)) | F.coalesce(at > F.try_to_timestamp(F.get(ends, F.lit(1))), F.lit(False))


def match_diagnostics(diagnostics: DataFrame, versions: DataFrame) -> DataFrame:
    """Diagnostics (``record_id, slice, version_hash, ...``) of versions that are still as they were; stale ones are dropped."""
    return diagnostics.join(versions.select("record_id", "slice", "version_hash").distinct(), ["record_id", "slice", "version_hash"], "left_semi")


def map_relaxations(issues: DataFrame, present: DataFrame) -> DataFrame:
    """``record_id, relaxable, keys``: a record may be relaxed only if each of its issues (``record_id, field, code``) names a validator that its field has.

    ``present``: ``field, validator``. ``keys`` lists field:validator, sorted.
    """
    named = issues.withColumn("validator", validator_of(F.col("code")))
    hit = named.join(present.select("field", "validator", F.lit(True).alias("has")).distinct(), ["field", "validator"], "left")
    key = F.concat_ws(":", "field", "validator")
    return hit.groupBy("record_id").agg(
        F.bool_and(F.coalesce("has", F.lit(False))).alias("relaxable"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("has"), key))), ",").alias("keys")
    )


def relaxation_plan(relaxable: DataFrame) -> DataFrame:
    """Per field: validators to drop and how many records need it, from ``map_relaxations`` rows that may be relaxed."""
    one = relaxable.where("relaxable").select("record_id", F.explode(F.split("keys", ",")).alias("key"))
    parts = F.split("key", ":")
    return one.groupBy(parts[0].alias("field"), parts[1].alias("validator")).agg(F.countDistinct("record_id").alias("n_records"))


def write_requirements(changes: DataFrame) -> DataFrame:
    """Which slices are written: ``record_id, writes_current, writes_published``.

    In: ``record_id, action``, flags of what differs from the baseline (``current, published, topology, lifecycle``), ``desired_published`` (whether the desired record has a published
    slice) and ``slices_differ`` (whether its slices differ); ``draft_mode`` if a model may be without drafts. A create with a published slice writes its current one only if that is another;
    an update writes the current slice also when it only moves, publishes or unpublishes. Nothing is published without draft mode.
    """
    create, real = F.col("action") == "create", F.col("action") != "noop"
    drafts = F.col("draft_mode") if "draft_mode" in changes.columns else F.lit(True)
    published = drafts & F.col("desired_published") & (create | F.col("published"))
    current = F.when(create, ~F.col("desired_published") | F.col("slices_differ")).otherwise(F.col("current") | F.col("topology") | F.col("lifecycle"))
    return changes.select("record_id", (current & real).alias("writes_current"), (published & real).alias("writes_published"))


def selective_schedule_safe(failures: DataFrame, schedules: DataFrame) -> DataFrame:
    """``record_id, safe``: whether every failure (``record_id, locale``, null: not localized) lies outside of what is scheduled (``locales, non_localized``)."""
    met = failures.join(schedules, "record_id")
    clear = F.when(F.col("locale").isNull(), ~F.col("non_localized")).otherwise(~F.array_contains("locales", F.col("locale")))
    return met.groupBy("record_id").agg(F.bool_and(clear).alias("safe"))


def apply_defaults(values: DataFrame, defaults: DataFrame) -> DataFrame:
    """Every field of every record with its default where it is missing or null: ``record_id, item_type_id, field, value, defaulted``. Values that are there stay."""
    rows = values.select("record_id", "item_type_id").distinct().join(defaults, "item_type_id")
    joined = rows.join(values.select("record_id", "field", F.col("value").alias("own")), ["record_id", "field"], "left")
    return joined.select("record_id", "item_type_id", "field", F.coalesce("own", "default_value").alias("value"), (F.col("own").isNull() & F.col("default_value").isNotNull()).alias("defaulted"))


def due_schedules(schedules: DataFrame, now: Column, window_seconds: int) -> DataFrame:
    """Violations: schedules (``record_id, at``) that fire within the safety window."""
    return schedules.where(F.col("at") <= now + F.make_dt_interval(secs=F.lit(window_seconds)))
