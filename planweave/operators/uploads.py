"""Assets and folders: canonical rows, what changed, and the rules that their plans keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions.canonical import basename, filename_extension, row_hash
from planweave.operators.diff import violations

# The fields of an asset's default metadata, and the states of a scan that count as healthy.
METADATA_FIELDS = ("alt", "title", "custom_data", "focal_point", "poster_time")
HEALTHY = ("clean", "skipped")


def canonical_metadata(text: Column) -> Column:
    """Default metadata (JSON) as sorted ``field.locale=value`` texts, joined by ``;``; null for null.

    Keyed by field (``alt``, ``title``, ...) then locale, or in the old way by locale then field: if any key of the top is a field, the first.
    """
    top = F.from_json(text, "map<string,map<string,string>>")
    by_field = F.exists(F.map_keys(top), lambda k: k.isin(*METADATA_FIELDS))
    pair = lambda outer, inner: F.when(by_field, F.concat_ws(".", outer, inner)).otherwise(F.concat_ws(".", inner, outer))
    each = F.transform(F.map_entries(top), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.concat(pair(e["key"], x["key"]), F.lit("="), F.coalesce(x["value"], F.lit("")))))
    return F.when(top.isNotNull(), F.array_join(F.array_sort(F.flatten(each)), ";"))


def canonical_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``upload_id, tags, metadata, hash`` of healthy assets (tags distinct and sorted), and the ids of those that a scan did not find healthy."""
    fine = F.coalesce(F.col("scan").isin(*HEALTHY), F.lit(False))
    tags, meta = F.sort_array(F.array_distinct("tags")), canonical_metadata(F.col("metadata"))
    parts = ("upload_id", "md5", "basename", "filename", "tags", "metadata", "collection_id")
    rows = uploads.where(fine).withColumns({"tags": tags, "metadata": meta}).withColumn("hash", row_hash(*parts))
    return rows.select("upload_id", "tags", "metadata", "hash"), uploads.where(~fine).select("upload_id")


def canonical_collections(collections: DataFrame) -> DataFrame:
    """``id, hash`` of folders (``id, label, parent_id``); the position is no part of it."""
    return collections.select("id", row_hash("id", "label", "parent_id").alias("hash"))


def upload_changes(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Flags of assets that both sides have: ``binary`` (bytes or extension), ``metadata`` (base name, tags or default metadata), ``collection``, and what they need:
    ``transfers`` (new bytes) and ``renames`` (a new file name without new bytes)."""
    d = destination.select("upload_id", *(F.col(c).alias(f"d_{c}") for c in destination.columns if c != "upload_id"))
    both = source.join(d, "upload_id")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"d_{c}"))
    extension = ~filename_extension(F.col("filename")).eqNullSafe(filename_extension(F.col("d_filename")))
    bytes_ = differs("md5")
    meta = differs("basename") | (F.sort_array(F.array_distinct("tags")) != F.sort_array(F.array_distinct("d_tags"))) | ~canonical_metadata(F.col("metadata")).eqNullSafe(canonical_metadata(F.col("d_metadata")))
    return both.select(
        "upload_id", (bytes_ | extension).alias("binary"), meta.alias("metadata"), differs("collection_id").alias("collection"), (bytes_ | extension).alias("transfers"), (differs("filename") & ~bytes_ & ~extension).alias("renames")
    )


def basename_mismatches(uploads: DataFrame) -> DataFrame:
    """Assets whose stored base name is not the stem of their file name."""
    return uploads.where(basename(F.col("filename")) != F.col("basename")).select("upload_id", "basename", "filename")


def upload_contract(plan: DataFrame) -> DataFrame:
    """``upload_id, rule`` for every rule that a row of an asset plan breaks.

    In: ``upload_id, action, baseline_hash, desired_hash, basename, filename, focal_x, focal_y, poster_time, mime_type``.
    """
    a, base, want = F.col("action"), F.col("baseline_hash"), F.col("desired_hash")
    outside = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 1), F.lit(False))
    rules = {
        "create has baseline": (a == "create") & base.isNotNull(),
        "delete has desired": (a == "delete") & want.isNotNull(),
        "update changes nothing": (a == "update") & base.eqNullSafe(want),
        "noop changes": (a == "noop") & ~base.eqNullSafe(want),
        "unknown action": ~a.isin("create", "update", "delete", "noop"),
        "base name": basename(F.col("filename")) != F.col("basename"),
        "half a focal point": F.col("focal_x").isNull() != F.col("focal_y").isNull(),
        "focal point outside": outside("focal_x") | outside("focal_y"),
        "poster time without video": F.col("poster_time").isNotNull() & ~F.col("mime_type").startswith("video/"),
        "negative poster time": F.col("poster_time") < 0,
    }
    return violations(plan, "upload_id", rules)


def collection_contract(plan: DataFrame) -> DataFrame:
    """``id, rule`` for every rule that a row of a folder plan breaks. In: ``id, action, parent_id, label, baseline_hash, desired_hash``."""
    a, base, want = F.col("action"), F.col("baseline_hash"), F.col("desired_hash")
    rules = {
        "deletes": a == "delete",
        "create has baseline": (a == "create") & base.isNotNull(),
        "noop changes": (a == "noop") & ~base.eqNullSafe(want),
        "below itself": F.col("parent_id") == F.col("id"),
        "no label": F.coalesce(F.trim("label") == "", F.lit(True)),
    }
    return violations(plan, "id", rules)


def apply_uploads(destination: DataFrame, source: DataFrame, plan: DataFrame) -> DataFrame:
    """Assets after a plan (``upload_id, action``): created and updated ones as in the source, the others as they are, deleted ones gone."""
    act = lambda *kinds: plan.where(F.col("action").isin(*kinds)).select("upload_id")
    stays = destination.join(act("update", "delete"), "upload_id", "left_anti")
    return stays.unionByName(source.join(act("create", "update"), "upload_id", "left_semi"))
