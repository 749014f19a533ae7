"""Differences between two keyed tables: plans, change flags, violations and claims, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions.canonical import canonical_json, is_blank


def sided(df: DataFrame, side: str, key: list[str]) -> DataFrame:
    """The table with every column but the key renamed to ``side_column``."""
    return df.select(*key, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in key))


def diff_entities(source: DataFrame, destination: DataFrame, key: str, hash_: str = "hash", position: str | None = None) -> DataFrame:
    """Full outer join of two snapshots on ``key``: all columns of both sides and ``action`` (create, update, delete, noop).

    Equal hashes are a noop; with ``position``, also the positions must be equal. Keys must be unique on each side (see ``duplicate_ids``).
    """
    joined = sided(source.withColumn("present", F.lit(True)), "s", [key]).join(sided(destination.withColumn("present", F.lit(True)), "d", [key]), key, "full_outer")
    same = F.col(f"s_{hash_}").eqNullSafe(F.col(f"d_{hash_}"))
    if position:
        same = same & F.col(f"s_{position}").eqNullSafe(F.col(f"d_{position}"))
    action = F.when(F.col("d_present").isNull(), "create").when(F.col("s_present").isNull(), "delete").when(same, "noop").otherwise("update")
    return joined.withColumn("action", action).drop("s_present", "d_present")


def plan_records(source: DataFrame, destination: DataFrame, include_deletions: bool = True) -> DataFrame:
    """Record plan: ``record_id, item_type_id, action, baseline_hash, desired_hash, expected_hash``.

    Without deletions, destination-only rows are retained and have no row (``retained_records`` lists them). ``expected_hash`` is what the
    destination must still have when the plan is applied; null for a create.
    """
    plan = diff_entities(source, destination, "record_id", position="position")
    if not include_deletions:
        plan = plan.where("action <> 'delete'")
    return plan.select(
        "record_id", F.coalesce("s_item_type_id", "d_item_type_id").alias("item_type_id"), "action",
        F.col("d_hash").alias("baseline_hash"), F.col("s_hash").alias("desired_hash"), F.col("d_hash").alias("expected_hash"),
    )


def retained_records(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Destination-only records, which a plan without deletions leaves where they are."""
    return destination.join(source.select("record_id"), "record_id", "left_anti").select("record_id", "item_type_id")


def record_changes(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Change flags of records that both sides have: current, published, topology (parent or position), lifecycle (published or not)."""
    both = sided(source, "s", ["record_id"]).join(sided(destination, "d", ["record_id"]), "record_id")
    differs = lambda c: ~F.col(f"s_{c}").eqNullSafe(F.col(f"d_{c}"))
    return both.select(
        "record_id", differs("current").alias("current"), differs("published").alias("published"),
        (differs("parent_id") | differs("position")).alias("topology"),
        (F.col("s_published").isNull() != F.col("d_published").isNull()).alias("lifecycle"),
    )


def model_mismatches(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Violations: one id with different models on both sides."""
    both = sided(source, "s", ["record_id"]).join(sided(destination, "d", ["record_id"]), "record_id")
    return both.where("s_item_type_id <> d_item_type_id").select("record_id", "s_item_type_id", "d_item_type_id")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Violations: keys that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, key: str, *known: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose non-null ``key`` is in none of the ``known`` tables (table, column)."""
    out = rows.where(F.col(key).isNotNull())
    for df, column in known:
        out = out.join(df.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return out


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for every row and rule whose condition (the violation) holds; null conditions do not."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return df.select(key, F.explode(found).alias("rule"))


def claims(versions: DataFrame, unique: dict[str, str]) -> DataFrame:
    """Uniqueness claims: ``item_type_id, field, value, record_id`` of the fields ``unique`` (model -> field) in the JSON column ``fields``; blanks claim nothing."""
    field = F.create_map(*(x for m, f in unique.items() for x in (F.lit(m), F.lit(f))))[F.col("item_type_id")]
    told = versions.where(F.col("item_type_id").isin(*unique)).withColumn("field", field)
    value = F.expr("get_json_object(fields, concat('$.', field))")
    return told.select("item_type_id", "field", value.alias("value"), "record_id").where(~is_blank(F.col("value")))


def claimants(of: DataFrame) -> DataFrame:
    """``item_type_id, field, value, owners``: the sorted distinct claimants of each value."""
    return of.groupBy("item_type_id", "field", "value").agg(F.sort_array(F.collect_set("record_id")).alias("owners"))


def claimant_changes(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Values whose claimants differ between the sides; ``ambiguous`` where the destination has not exactly one owner."""
    key = ["item_type_id", "field", "value"]
    joined = sided(claimants(source), "s", key).join(sided(claimants(destination), "d", key), key, "full_outer")
    empty = F.array().cast("array<string>")
    both = joined.withColumn("s_owners", F.coalesce("s_owners", empty)).withColumn("d_owners", F.coalesce("d_owners", empty))
    return both.where(F.col("s_owners") != F.col("d_owners")).withColumn("ambiguous", F.size("d_owners") != 1)


def field_patch(desired: DataFrame, live: DataFrame) -> DataFrame:
    """Top-level fields whose values differ: ``record_id, field, desired, live``, for records that both sides have. In: ``record_id, fields`` (JSON).

    Values are compared in canonical form, so neither the order of keys nor the notation of a number is a difference; a null and a missing field are none either. Texts are given without quotes.
    """
    forms = lambda df: df.select("record_id", canonical_json(F.col("fields")).alias("text")).select(
        "record_id", F.from_json("text", "map<string,string>").alias("m"), F.expr("transform_values(cast(parse_json(text) AS map<string,variant>), (k, v) -> to_json(v))").alias("v")
    )
    two = sided(forms(desired), "s", ["record_id"]).join(sided(forms(live), "d", ["record_id"]), "record_id")
    names = F.array_union(F.map_keys("s_m"), F.map_keys("d_m"))
    rows = two.select("record_id", F.explode(names).alias("field"), "s_m", "d_m", "s_v", "d_v")
    at = lambda m: F.try_element_at(F.col(m), F.col("field"))
    form = lambda m: F.coalesce(at(m), F.lit("null"))
    return rows.where(form("s_v") != form("d_v")).select("record_id", "field", at("s_m").alias("desired"), at("d_m").alias("live"))


def classify_live(plan: DataFrame, live: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``record_id, state``: pending (still the baseline), converged (already desired), resumable (a known state in between), conflict.

    ``allowed`` lists known states (``record_id, hash``). A row that is absent has a null hash.
    """
    joined = plan.join(live.select("record_id", F.col("hash").alias("live_hash")), "record_id", "left")
    if allowed is None:
        known = F.lit(False)
    else:
        states = allowed.select("record_id", F.col("hash").alias("live_hash"), F.lit(True).alias("known")).distinct()
        joined = joined.join(states, ["record_id", "live_hash"], "left")
        known = F.coalesce("known", F.lit(False))
    live_, want, base = F.col("live_hash"), F.col("desired_hash"), F.col("baseline_hash")
    state = F.when(live_.eqNullSafe(want), "converged").when(live_.eqNullSafe(base), "pending").when(known, "resumable").otherwise("conflict")
    return joined.select("record_id", "action", state.alias("state"))


def apply_plan(destination: DataFrame, source: DataFrame, plan: DataFrame) -> DataFrame:
    """The destination after the plan: created and updated rows as in the source, noops as they are, deleted rows gone."""
    act = plan.select("record_id", "action")
    taken = source.join(act.where("action IN ('create', 'update')").select("record_id"), "record_id", "left_semi")
    stays = destination.join(act.where("action IN ('update', 'delete')").select("record_id"), "record_id", "left_anti")
    return stays.unionByName(taken)


def verify_final(final: DataFrame, desired: DataFrame) -> DataFrame:
    """Mismatches after an apply: ``record_id, problem`` (missing, unexpected, different)."""
    d = diff_entities(desired, final, "record_id", position="position").where("action <> 'noop'")
    return d.select("record_id", F.when(F.col("action") == "create", "missing").when(F.col("action") == "delete", "unexpected").otherwise("different").alias("problem"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts by model and action, one column per action."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(f"n_{a}")
    return plan.groupBy("item_type_id").agg(*(n(a) for a in ("create", "update", "delete", "noop")))
