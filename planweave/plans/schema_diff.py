"""Differences between two schemas: entities with attributes, and role rules, as ordered actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.functions.canonical import set_digest
from planweave.operators.graph import chain_levels, closure, depths
from planweave.operators.store import kept

#: Order of the stages of a schema plan.
STAGES = ("site", "workflow", "plugin", "model", "field", "deleted field", "changed field", "deleted model", "filter", "menu", "role")


def diff_attributes(source: DataFrame, destination: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``id, action, changed``: creates, deletes, and updates with the names of attributes that differ, sorted and joined by commas.

    In: ``id, attributes`` (map of texts). A missing attribute and a null one are the same. Entities without a difference have no row.
    """
    clean = lambda df, n: df.select("id", F.map_filter("attributes", lambda k, v: v.isNotNull() & ~k.isin(*ignored)).alias(n))
    both = clean(source, "s").join(clean(destination, "d"), "id", "full_outer")
    names = F.array_union(F.map_keys("s"), F.map_keys("d"))
    differs = F.array_sort(F.filter(names, lambda k: ~F.try_element_at(F.col("s"), k).eqNullSafe(F.try_element_at(F.col("d"), k))))
    action = F.when(F.col("d").isNull(), "create").when(F.col("s").isNull(), "delete").when(F.size(differs) > 0, "update")
    return both.select("id", action.alias("action"), F.when(F.col("s").isNotNull() & F.col("d").isNotNull(), F.array_join(differs, ",")).alias("changed")).where("action IS NOT NULL")


def new_entities(source: DataFrame, destination: DataFrame) -> DataFrame:
    return source.join(destination.select("id"), "id", "left_anti")


def deleted_fields(source: DataFrame, destination: DataFrame, kept_models: DataFrame) -> DataFrame:
    """Fields (``id, model_id``) that the source lacks, in models that both sides keep; fields of deleted models go with them."""
    return destination.join(source.select("id"), "id", "left_anti").join(kept_models.select(F.col("id").alias("model_id")), "model_id", "left_semi")


def diff_rules(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Permission rules to add and to remove: ``change`` with the rule's columns. Rules that repeat count each."""
    return source.exceptAll(destination).withColumn("change", F.lit("add")).unionByName(destination.exceptAll(source).withColumn("change", F.lit("remove")))


def staged(parts: dict[str, DataFrame]) -> DataFrame:
    """One ordered plan: ``stage, id, action, changed`` of all parts, with the stage's number."""
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(STAGES.index(name)).alias("stage"), "id", "action", "changed")
        out = df if out is None else out.unionByName(df)
    return out


def new_models(source: DataFrame, destination: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """``id, attributes``: source-only models with the attributes that are not a model's defaults (map ``attributes``), as sorted ``name=value`` texts."""
    usual = F.create_map(*(F.lit(x) for pair in sorted(defaults.items()) for x in pair)) if defaults else F.create_map().cast("map<string,string>")
    own = F.map_filter("attributes", lambda k, v: v.isNotNull() & ~v.eqNullSafe(F.try_element_at(usual, k)))
    listed = F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return new_entities(source, destination).select("id", F.array_join(listed, ",").alias("attributes"))


def new_fields(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``stage, id, model_id, kind``: source-only fieldsets (stage 0) and fields (stage 1). In: ``id, model_id, kind``."""
    fresh = source.join(destination.select("id", "kind"), ["id", "kind"], "left_anti")
    return fresh.select(F.when(F.col("kind") == "fieldset", 0).otherwise(1).alias("stage"), "id", "model_id", "kind")


def changed_fields(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``id, stage, changed``: fields that both sides have, by step: a change of type (0) comes before other attributes (1), and those before a move (2).

    In: ``id, type, position, attributes`` (map of texts).
    """
    d = destination.select("id", F.col("type").alias("d_type"), F.col("position").alias("d_position"), F.col("attributes").alias("d"))
    both = source.select("id", "type", "position", F.col("attributes").alias("s")).join(d, "id")
    names = F.array_union(F.map_keys("s"), F.map_keys("d"))
    differs = F.array_sort(F.filter(names, lambda k: ~F.try_element_at(F.col("s"), k).eqNullSafe(F.try_element_at(F.col("d"), k))))
    step = lambda stage, changed, when: F.when(when, F.struct(F.lit(stage).alias("stage"), changed.alias("changed")))
    steps = F.array(
        step(0, F.lit("type"), ~F.col("type").eqNullSafe(F.col("d_type"))),
        step(1, F.array_join(differs, ","), F.size(differs) > 0),
        step(2, F.lit("position"), ~F.col("position").eqNullSafe(F.col("d_position"))),
    )
    return both.select("id", F.explode(F.array_compact(steps)).alias("s")).select("id", "s.stage", "s.changed")


def deleted_models(source: DataFrame, destination: DataFrame, uses: DataFrame) -> DataFrame:
    """``id, level``: destination-only models, those that use others before what they use. ``uses``: ``src`` uses ``dst``; what lies on a cycle has level null and goes last.

    Level 0 goes first. Models that use each other in a long chain take few rounds.
    """
    gone = kept(new_entities(destination, source).select("id"), "deleted-models")
    inner = uses.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
    levels, _ = chain_levels(gone, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return gone.join(levels, "id", "left")


def finalize_models(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``id, attribute, value``: attributes of models that point at fields (columns but ``id``), where the source's value is not the destination's."""
    names = [c for c in source.columns if c != "id"]
    long = lambda df, v: df.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias(v)) for c in names))).alias("a")).select("id", "a.*")
    both = long(source, "value").join(long(destination, "old"), ["id", "attribute"], "left")
    return both.where(~F.col("value").eqNullSafe(F.col("old"))).select("id", "attribute", "value")


def diff_tree(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``id, action, depth``: navigation nodes (``id, parent_id, position, label``): creates and updates go from the root down, deletes from the leaves up (negative depth)."""
    side = lambda df, n: df.select("id", F.struct("parent_id", "position", "label").alias(n))
    both = side(source, "s").join(side(destination, "d"), "id", "full_outer")
    action = F.when(F.col("d").isNull(), "create").when(F.col("s").isNull(), "delete").when(F.col("s") != F.col("d"), "update")
    done = both.select("id", action.alias("action")).where("action IS NOT NULL")
    up = depths(source).withColumnRenamed("depth", "_s")
    down = depths(destination).withColumnRenamed("depth", "_d")
    placed = done.join(up, "id", "left").join(down, "id", "left")
    return placed.select("id", "action", F.when(F.col("action") == "delete", -F.col("_d")).otherwise(F.col("_s")).alias("depth"))


def diff_plugins(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``id, action, changed``: which attributes of a plugin count depends on its kind.

    In: ``id, legacy, public, version, attributes``. A public plugin is its version alone, a legacy one all but the version, another one both.
    """
    shown = F.when(F.col("public"), F.create_map(F.lit("version"), F.col("version"))).when(F.col("legacy"), F.col("attributes"))
    told = F.coalesce(shown, F.map_concat("attributes", F.create_map(F.lit("version"), F.col("version"))))
    return diff_attributes(*(df.select("id", told.alias("attributes")) for df in (source, destination)))


def hide_internal(entities: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (``id, parent_id``) without internal ones (``id``), and violations: visible ones below an internal one."""
    visible = entities.join(internal.select("id"), "id", "left_anti")
    below = visible.join(internal.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return visible, below.select("id", "parent_id")


def recreated_ids(changes: DataFrame) -> DataFrame:
    """Ids that a create may change, per stage: ``stage, id`` from the rows of ``staged``."""
    return changes.where("action = 'create'").select("stage", "id")


def schema_digest(models: DataFrame, fields: DataFrame, ignored: tuple[str, ...] = ("name",)) -> DataFrame:
    """``id, digest``: per model a digest of its attributes and of its fields', whatever their order; names and the like are left out."""
    plain = lambda df: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(df, lambda k, v: ~k.isin(*ignored))))))
    of_fields = fields.select("model_id", F.sha2(F.concat_ws("|", "id", plain("attributes")), 256).alias("h")).groupBy(F.col("model_id").alias("id"))
    own = models.select("id", plain("attributes").alias("own")).join(of_fields.agg(set_digest(F.col("h")).alias("fields")), "id", "left")
    return own.select("id", F.sha2(F.concat_ws("|", "id", "own", F.coalesce(F.col("fields").cast("string"), F.lit(""))), 256).alias("digest"))


def select_models(models: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models (``id, api_key``) that ``selection`` (``name``) names by id or by key, once each, and violations: names that no model has."""
    named = [models.join(selection.select(F.col("name").alias(c)).distinct(), c, "left_semi") for c in ("id", "api_key")]
    known = models.select(F.col("id").alias("name")).unionByName(models.select(F.col("api_key").alias("name")))
    return named[0].unionByName(named[1]).distinct(), selection.select("name").distinct().join(known, "name", "left_anti")


def schema_closure(seeds: DataFrame, fields: DataFrame) -> DataFrame:
    """``id, distance``: the seed models and all that their fields' validators refer to (``model_id, refers_to`` array), directly or not."""
    return closure(seeds.select("id"), fields.select(F.col("model_id").alias("src"), F.explode("refers_to").alias("dst")))


def internal_models(models: DataFrame, fields: DataFrame, shape: dict[str, str]) -> DataFrame:
    """Models (``id``) whose fields (``model_id, api_key, type``) are exactly those of ``shape`` (key -> type): only these may be taken for internal ones."""
    want = F.array_sort(F.array(*(F.lit(f"{k}:{t}") for k, t in shape.items())))
    has = fields.where(F.col("api_key").isin(*shape)).groupBy("model_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "api_key", "type"))).alias("has"))
    size = fields.groupBy("model_id").agg(F.count("*").alias("n")).where(F.col("n") == len(shape))
    exact = has.where(F.col("has") == want).join(size, "model_id", "left_semi").select(F.col("model_id").alias("id"))
    return models.join(exact, "id", "left_semi").select("id")


def links_to(fields: DataFrame, models: DataFrame) -> DataFrame:
    """Violations: fields (``id, refers_to``) that may point at one of ``models`` (``id``)."""
    return fields.select("id", F.explode("refers_to").alias("model")).join(models.select(F.col("id").alias("model")), "model", "left_semi").select("id", "model").distinct()


def required_fields(fields: DataFrame) -> DataFrame:
    """``id, required``: whether a field needs a value: ``required``, or a positive ``min`` or ``eq`` of ``size`` (of ``length`` for structured text). In: ``id, type, validators`` (JSON)."""
    at = lambda p: F.get_json_object("validators", p)
    rule = F.when(F.col("type") == "structured_text", "length").otherwise("size")
    bound = lambda key: F.when(rule == "length", at(f"$.length.{key}")).otherwise(at(f"$.size.{key}")).try_cast("double") > 0
    asked = at("$.required").isNotNull() | F.coalesce(bound("min"), F.lit(False)) | F.coalesce(bound("eq"), F.lit(False))
    return fields.select("id", asked.alias("required"))


def inspection_models(encountered: DataFrame, managed: DataFrame) -> DataFrame:
    """Block models (``model_id``) met in data but outside the managed schema (``id``), each once."""
    return encountered.select(F.col("model_id").alias("id")).distinct().join(managed.select("id"), "id", "left_anti")


def inspection_violations(inspection: DataFrame, managed: DataFrame, issues: DataFrame, fields: DataFrame) -> DataFrame:
    """``rule, subject``: inspected models that repeat or are managed, and issues (``field_id, validator``) without such a field (``id, validators`` JSON)."""
    told = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("subject"))
    twice = inspection.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    both = inspection.select("id").distinct().join(managed.select("id"), "id", "left_semi")
    known = fields.select(F.col("id").alias("field_id"), F.explode(F.json_object_keys("validators")).alias("validator"))
    lost = issues.select("field_id", "validator").distinct().join(known, ["field_id", "validator"], "left_anti")
    return told(twice, "repeats", "id").unionByName(told(both, "is managed", "id")).unionByName(told(lost, "unknown validator", "field_id"))


def table_shape(df: DataFrame, shape: T.StructType) -> DataFrame:
    """``column, problem``: how a table's columns differ from a declared shape (missing, unexpected, other type)."""
    has, want = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (df.schema, shape))
    rows = [(c, "missing") for c in want if c not in has] + [(c, "unexpected") for c in has if c not in want] + [(c, "other type") for c in want if c in has and has[c] != want[c]]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")
