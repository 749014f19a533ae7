"""Nested blocks, assets and texts of exploded documents (``explode_document``), and canonical versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions.canonical import is_stable_text
from planweave.operators.store import small

# Members of a record that are no fields.
RESERVED = (
    "__itemTypeId", "created_at", "creator", "current_version", "editor", "first_published_at", "has_children", "id", "is_current",
    "is_current_version_valid", "is_published", "is_published_version_valid", "is_valid", "item_type", "meta", "parent_id", "position",
    "publication_scheduled_at", "published_at", "published_from", "published_until", "relationships", "stage", "status", "type",
    "unpublishing_scheduled_at", "updated_at",
)


def plain(value: Column) -> Column:
    """The text of a JSON string value."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def block_ids(rows: DataFrame) -> DataFrame:
    """``record_id, block_path, block_model, block_id``: every block at any depth, from exploded rows; rows of ``explode_blocks`` are such."""
    if "block_id" in rows.columns:
        return rows
    own = (F.col("path") == F.concat("block_path", F.lit(".id"))) & (F.col("kind") == "string")
    return rows.where(own).select("record_id", "block_path", "block_model", plain(F.col("value")).alias("block_id"))


def block_locations(rows: DataFrame, localized: tuple[str, ...] = ()) -> DataFrame:
    """``block_id, record_id, block_model, field_path, locale``: where each block stands; names without indexes, and the locale below a ``localized`` top field."""
    names = F.regexp_replace("block_path", r"\[[0-9]+\]", "")
    top = F.regexp_extract(names, r"^\.([^.]+)", 1)
    locale = F.when(top.isin(*localized), F.regexp_extract(names, r"^\.[^.]+\.([^.]+)", 1)) if localized else F.lit(None).cast("string")
    return block_ids(rows).select("block_id", "record_id", "block_model", names.alias("field_path"), locale.alias("locale"))


def nested_ids(rows: DataFrame) -> DataFrame:
    """``record_id, blocks``: the sorted ids of a record's blocks; a document bounds their number."""
    return block_ids(rows).groupBy("record_id").agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))


def allow_list_issues(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """``record_id, owner_model, field, block_model``: blocks whose model the field they stand in does not allow.

    ``allowed``: ``owner_model, field, block_model`` (the owner is the block around, or the record with model null). A field without a list allows nothing.
    """
    found = block_ids(rows)
    if "owner_path" in rows.columns:
        return _not_allowed(found.withColumn("o", F.struct(F.col("owner_path").alias("_path"), "owner_model")), allowed)
    around = found.select("record_id", F.col("block_path").alias("_path"), F.col("block_model").alias("owner_model"))
    inside = F.col("block_path").startswith(F.concat("_path", F.lit("."))) & (F.length("block_path") > F.length("_path"))
    outer = found.join(around.withColumnRenamed("record_id", "_record"), (F.col("record_id") == F.col("_record")) & inside, "left")
    nearest = outer.groupBy("record_id", "block_path", "block_model").agg(F.max_by(F.struct("_path", "owner_model"), F.coalesce(F.length("_path"), F.lit(-1))).alias("o"))
    return _not_allowed(nearest, allowed)


def _not_allowed(nearest: DataFrame, allowed: DataFrame) -> DataFrame:
    """Blocks with the block around them (``o``) whose model is not on its field's list."""
    rest = F.expr("substring(block_path, coalesce(length(o._path), 0) + 1)")
    field = F.regexp_extract(F.regexp_replace(rest, r"^\.attributes(?=\.)", ""), r"^\.([^.\[]+)", 1)
    placed = nearest.select("record_id", F.coalesce("o.owner_model", F.lit("")).alias("owner_model"), field.alias("field"), "block_model")
    lists = allowed.select(F.coalesce("owner_model", F.lit("")).alias("owner_model"), "field", "block_model").distinct()
    return placed.join(F.broadcast(lists), ["owner_model", "field", "block_model"], "left_anti").select("record_id", "owner_model", "field", "block_model").distinct()  # a schema's fields are few


def upload_references(rows: DataFrame) -> DataFrame:
    """``record_id, upload_id``: every asset that a document refers to, at any depth. Rows are exploded ones, or those of ``named_texts`` for ``upload_id``."""
    if "text" in rows.columns:
        return rows.select("record_id", F.col("text").alias("upload_id")).distinct()
    return rows.where("kind = 'string' AND endswith(path, '.upload_id')").select("record_id", plain(F.col("value")).alias("upload_id")).distinct()


def unstable_texts(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``record_id, path``: texts of fields with a sanitizer (last name of the path) that it would not leave alone. Rows are exploded ones, or those of ``named_texts`` for the fields."""
    if "text" in rows.columns:
        return rows.where(~is_stable_text(F.col("text"))).select("record_id", "path")
    name = F.regexp_extract("path", r"\.([^.\[]+)(\[[0-9]+\])?$", 1)
    return rows.where(F.col("kind") == "string").where(name.isin(*fields)).where(~is_stable_text(plain(F.col("value")))).select("record_id", "path")


def block_identity(blocks: DataFrame, value: str = "value") -> DataFrame:
    """``block_id, model_id, problem``: a block's model from any of the three places where it may stand; ``problem`` where they contradict each other or none is there."""
    part = lambda p: F.get_json_object(value, p)
    places = F.array_distinct(F.array_compact(F.array(part("$.item_type.id"), part("$.relationships.item_type.data.id"), part("$.__itemTypeId"))))
    problem = F.when(F.size(places) > 1, "models differ").when(F.size(places) == 0, "no model")
    return blocks.select(part("$.id").alias("block_id"), F.when(F.size(places) == 1, places[0]).alias("model_id"), problem.alias("problem"))


def strip_documents(rows: DataFrame | None, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that stay once references to ``targets`` (``id``) are gone: required ones stay. In and out: ``from_id, to_id, path, required`` (as of ``references``).

    Only edges of the documents of ``rows`` count; without rows, all edges do.
    """
    gone = small(targets.select(F.col("id").alias("_gone")).distinct())
    left = links.join(gone, (F.col("to_id") == F.col("_gone")) & ~F.col("required"), "left_anti")
    if rows is None:
        return left
    return left.join(rows.select(F.col("record_id").alias("from_id")).distinct(), "from_id", "left_semi")


def canonical_versions(versions: DataFrame, fields: DataFrame) -> DataFrame:
    """``record_id, fields``: canonical JSON of a version: the model's fields, and other members but the reserved ones.

    In: ``record_id, item_type_id, value`` (JSON object) and ``item_type_id, api_key``. A field with a reserved name stays; a null member stays, a missing one does not appear.
    """
    known = fields.groupBy("item_type_id").agg(F.collect_set("api_key").alias("_known"))
    met = versions.join(F.broadcast(known), "item_type_id", "left")  # a schema's models are few
    members = F.map_filter(F.expr("cast(try_parse_json(value) AS map<string,variant>)"), lambda k, v: ~k.isin(*RESERVED) | F.coalesce(F.array_contains("_known", k), F.lit(False)))
    listed = F.transform(F.array_sort(F.map_keys(members)), lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.coalesce(F.to_json(F.try_element_at(members, k)), F.lit("null"))))
    return met.select("record_id", F.when(members.isNotNull(), F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))).alias("fields"))
