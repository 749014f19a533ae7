"""Checks of a plan before, while and after it is applied, and what invalid content means for it. Violations are rows; none means that a check passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.functions.canonical import is_stable_text
from planweave.operators.dependencies import ordering_anchors, protected_targets, skip_closure
from planweave.operators.diff import classify_live, sided
from planweave.operators.store import kept, small
from planweave.sources.records import record_hash


def record_operation(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``record_id, noop, topology`` of records that both sides have: whether nothing differs, and whether only parent or position may (content is equal)."""
    two = sided(source, "s", ["record_id"]).join(sided(destination, "d", ["record_id"]), "record_id")
    same = lambda *cs: reduce(lambda a, b: a & b, (F.col(f"s_{c}").eqNullSafe(F.col(f"d_{c}")) for c in cs))
    place, content = same("parent_id", "position"), same("current", "published")
    return two.select("record_id", (place & content).alias("noop"), (~place & content).alias("topology"))


def fresh_nested_updates(versions: DataFrame) -> DataFrame:
    """``record_id, stage, block_id``: blocks that a write brings in that the state just before it lacks; the smallest one per stage.

    In: ``record_id, action, current, published, published_changed, baseline`` with arrays of block ids. A create starts from the published blocks if there are any, else from the
    current ones. An update writes a changed published version over the baseline first, and then the current one over what is there.
    """
    seed = F.coalesce("published", "current")
    before = F.when(F.col("action") == "create", seed).when(F.col("published_changed"), F.coalesce("published", "baseline")).otherwise(F.col("baseline"))
    first = lambda new, old: F.array_min(F.array_except(new, old))
    staged = F.when((F.col("action") == "update") & F.col("published_changed"), first(F.col("published"), F.col("baseline")))
    each = F.array(
        F.struct(F.lit("published").alias("stage"), staged.alias("block_id")),
        F.struct(F.lit("current").alias("stage"), first(F.col("current"), before).alias("block_id")),
    )
    return versions.select("record_id", F.inline(each)).where("block_id IS NOT NULL")


def identity_mismatches(plan: DataFrame) -> DataFrame:
    """Plan rows whose baseline or desired snapshot has another id. In: ``record_id, baseline_id, desired_id``."""
    return plan.where("baseline_id <> record_id OR desired_id <> record_id").select("record_id")


def known_states(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``record_id, hash``: every state that a row can be in while it is written: its seed, its new published version over the old current one, and its new
    current version, each in the old and the new place."""
    two = sided(source, "s", ["record_id"]).join(sided(destination.withColumn("there", F.lit(True)), "d", ["record_id"]), "record_id", "left")
    old, model = F.coalesce("d_current", "s_current"), F.col("s_item_type_id")
    state = lambda parent, current, published: record_hash(parent, current, published, model)
    s_pub, s_cur = F.col("s_published"), F.col("s_current")
    seed = F.coalesce("s_published", "s_current")
    none = F.lit(None).cast("string")
    places = [F.col("s_parent_id"), F.when(F.col("d_there"), F.col("d_parent_id")).otherwise(F.col("s_parent_id"))]
    versions = [(seed, none), (seed, s_pub), (old, s_pub), (s_cur, s_pub), (s_cur, F.col("d_published"))]
    return two.select("record_id", F.explode(F.array(*(state(p, c, q) for p in places for c, q in versions))).alias("hash")).distinct()


def already_converged(plan: DataFrame, live: DataFrame) -> DataFrame:
    """``converged``: one row, whether every planned row is live as desired."""
    return classify_live(plan, live).agg(F.coalesce(F.bool_and(F.col("state") == "converged"), F.lit(True)).alias("converged"))


def live_block_ownership(planned: DataFrame, baseline: DataFrame, live: DataFrame, records: DataFrame) -> DataFrame:
    """``block_id, problem``: planned blocks (``block_id, location``) whose id is that of a record (``record_id``), or that the baseline lacks and that are live elsewhere."""
    clash = planned.select("block_id").distinct().join(records.select(F.col("record_id").alias("block_id")).distinct(), "block_id", "left_semi")
    fresh = planned.join(baseline.select("block_id").distinct(), "block_id", "left_anti")
    there = live.join(fresh.select("block_id").distinct(), "block_id", "left_semi").select("block_id", "location").distinct()
    moved = there.join(fresh.select("block_id", "location").distinct(), ["block_id", "location"], "left_anti").select("block_id").distinct()
    return clash.withColumn("problem", F.lit("is a record")).unionByName(moved.withColumn("problem", F.lit("is live elsewhere")))


def draft_create_violations(creates: DataFrame, edges: DataFrame, published: DataFrame) -> DataFrame:
    """References of always-published creates (``id, level, always``) to something that is neither published (``id``) nor an always-published create before them."""
    a = creates.where("always").select(F.col("id").alias("from_id"), F.struct("level", "id").alias("_a"))
    b = creates.where("always").select(F.col("id").alias("to_id"), F.struct("level", "id").alias("_b"))
    met = edges.select("from_id", "to_id").distinct().join(a, "from_id").join(published.select(F.col("id").alias("to_id")), "to_id", "left_anti").join(b, "to_id", "left")
    return met.where("_b IS NULL OR _b >= _a").select("from_id", "to_id")


def skipped_rows_changed(skipped: DataFrame, live: DataFrame) -> DataFrame:
    """``record_id, problem``: skipped rows (``record_id, hash, position``; a null hash: absent) that are no longer as recorded."""
    now = live.select("record_id", F.col("hash").alias("_hash"), F.col("position").alias("_position"))
    joined = skipped.join(now, "record_id", "left")
    problem = (
        F.when(F.col("hash").isNull() & F.col("_hash").isNotNull(), "appeared").when(F.col("hash").isNotNull() & F.col("_hash").isNull(), "is gone")
        .when(~F.col("hash").eqNullSafe(F.col("_hash")), "changed").when(~F.col("position").eqNullSafe(F.col("_position")), "moved")
    )
    return joined.select("record_id", problem.alias("problem")).where("problem IS NOT NULL")


def plan_violations(plan: DataFrame, create_order: DataFrame, edges: DataFrame, destination: DataFrame) -> DataFrame:
    """``rule, subject`` of a plan that contradicts itself: an order without a create or with another row, a repeated row, a reference to what neither plan nor destination has."""
    told = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject")).distinct()
    creates = plan.where("action = 'create'").select(F.col("record_id").alias("id"))
    stays = plan.where("action <> 'delete'").select(F.col("record_id").alias("to_id")).unionByName(destination.select(F.col("record_id").alias("to_id"))).distinct()
    gone = plan.where("action = 'delete'").select(F.col("record_id").alias("to_id"))
    return reduce(DataFrame.unionByName, [
        told(creates.join(create_order.select("id"), "id", "left_anti"), "not in the order", "id"),
        told(create_order.select("id").join(creates, "id", "left_anti"), "in the order without a create", "id"),
        told(plan.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1"), "repeats", "record_id"),
        told(edges.join(stays.join(gone, "to_id", "left_anti"), "to_id", "left_anti"), "refers to nothing", "from_id"),
    ])


def item_type_mismatches(expected: DataFrame, records: DataFrame) -> DataFrame:
    """``id, expected, found``: ids that resolve to another model than expected (``id, item_type_id``), or to nothing (null)."""
    there = records.select(F.col("record_id").alias("id"), F.col("item_type_id").alias("found"))
    met = expected.select("id", F.col("item_type_id").alias("expected")).distinct().join(there, "id", "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("found")))


def conflict_outcomes(conflicts: DataFrame, relaxable: DataFrame) -> DataFrame:
    """``record_id, outcome``: rows of a uniqueness conflict (``consumer``) are relaxed where their uniqueness may be, else skipped. ``relaxable``: ``record_id``."""
    rows = conflicts.select(F.col("consumer").alias("record_id")).distinct()
    able = relaxable.select("record_id", F.lit("relax").alias("outcome")).distinct()
    return rows.join(able, "record_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skip")))


def unsupported_unique_issues(issues: DataFrame, claims: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rows (``record_id``) that are invalid through uniqueness alone, though no row that stays shares a value with them.

    ``issues``: ``record_id, code``; ``claims``: ``item_type_id, field, value, record_id``; ``skipped``: ``record_id``.
    """
    key = ["item_type_id", "field", "value"]
    alone = issues.groupBy("record_id").agg(F.bool_and(F.col("code") == "VALIDATION_UNIQUE").alias("only")).where("only").select("record_id")
    stays = claims.join(skipped.select("record_id"), "record_id", "left_anti").select(*key, "record_id").distinct()
    shared = stays.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    supported = stays.join(shared, key, "left_semi").select("record_id").distinct()
    return alone.join(skipped.select("record_id"), "record_id", "left_anti").join(supported, "record_id", "left_anti")


def scheduled_skips(skipped: DataFrame, schedules: DataFrame) -> DataFrame:
    """``scheduled``: one row, whether any skipped row that the destination keeps has a schedule."""
    hit = skipped.where("disposition = 'preserve target'").select(F.col("id").alias("record_id")).join(schedules.select("record_id").distinct(), "record_id", "left_semi")
    return hit.agg((F.count("*") > 0).alias("scheduled"))


def rows_to_validate(source: DataFrame, changes: DataFrame, invalid: DataFrame, known: DataFrame) -> DataFrame:
    """``record_id, slice, version_hash``: versions whose validity must be asked for: changed ones and known invalid ones, without those that already have an issue.

    ``source``: ``record_id, current, published``; ``changes``: ``record_id, current, published`` (flags); ``invalid``: ``record_id``; ``known``: ``record_id, slice``.
    """
    asked = changes.select("record_id", F.col("current").alias("c"), F.col("published").alias("p")).unionByName(invalid.select("record_id", F.lit(True).alias("c"), F.lit(True).alias("p")))
    asked = asked.groupBy("record_id").agg(F.bool_or("c").alias("c"), F.bool_or("p").alias("p"))
    version = lambda s, flag: F.when(F.col(flag), F.struct(F.lit(s).alias("slice"), F.sha2(s, 256).alias("version_hash")))
    rows = source.join(asked, "record_id").select("record_id", F.explode(F.array_compact(F.array(version("current", "c"), version("published", "p")))).alias("v"))
    return rows.select("record_id", "v.*").where("version_hash IS NOT NULL").join(known.select("record_id", "slice").distinct(), ["record_id", "slice"], "left_anti")


def default_corrections(values: DataFrame, filled: DataFrame) -> DataFrame:
    """Creates (``record_id``) whose fields differ once defaults are filled in. Both tables: ``record_id, field, value``; a null and a missing field are the same."""
    side = lambda df, n: df.where("value IS NOT NULL").groupBy("record_id").agg(F.bit_xor(F.xxhash64("field", "value")).alias(f"{n}_x"), F.count("*").alias(f"{n}_n"))
    both = side(values, "a").join(side(filled, "b"), "record_id", "full_outer")
    return both.where(~F.struct("a_x", "a_n").eqNullSafe(F.struct("b_x", "b_n"))).select("record_id")


def sanitizer_risks(writes: DataFrame, values: DataFrame) -> DataFrame:
    """``record_id, stage, field``: texts that a write would send through a sanitizer that does not leave them alone. In: ``record_id, stage, field`` and ``record_id, field, value``."""
    unstable = values.where(F.coalesce(~is_stable_text(F.col("value")), F.lit(False))).select("record_id", "field").distinct()
    return writes.select("record_id", "stage", "field").distinct().join(unstable, ["record_id", "field"], "left_semi")


def classify_invalid(invalid: DataFrame, relaxable: DataFrame, edges: DataFrame, writes: DataFrame, source: DataFrame, destination: DataFrame, destination_edges: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Skipped rows (``id, reason``: invalid, dependency or order) and destination-only rows (``id``) that they protect.

    Invalid rows that cannot be relaxed are skipped; then whatever waits for a skipped row, and whatever would be inserted or moved next to one that keeps its place. This
    goes on until no row is added. A protected row keeps its place too.
    """
    tree = ["record_id", "item_type_id", "parent_id", "position"]
    skipped = kept(invalid.select(F.col("record_id").alias("id")).distinct().join(relaxable.select(F.col("record_id").alias("id")), "id", "left_anti").withColumn("reason", F.lit("invalid")), "skipped")
    only = destination.join(source.select("record_id"), "record_id", "left_anti").select(F.col("record_id").alias("id"))
    for _ in range(max_rounds):
        reached = skip_closure(skipped.select("id"), edges, writes, destination).where("distance > 0").select("id", F.lit("dependency").alias("reason"))
        now = kept(skipped.unionByName(reached), "reached")
        protected = kept(protected_targets(now.select("id"), destination_edges, only), "protected")
        held = now.select(F.col("id").alias("record_id")).unionByName(protected.select(F.col("id").alias("record_id")))
        beside = ordering_anchors(held, destination.select(tree), source.select(tree))[0]
        beside = beside.select(F.col("record_id").alias("id"), F.lit("order").alias("reason")).distinct().join(now.select("id"), "id", "left_anti")
        more = kept(now.unionByName(beside), "skipped")
        if more.count() == skipped.count():
            return more, protected
        skipped = more
    raise RuntimeError(f"skips did not settle within {max_rounds} rounds")


def relaxation_state(planned: DataFrame, live: DataFrame) -> DataFrame:
    """``field, state``: whether a field's validators (``field, validators``) are still original, relaxed as planned, or neither. ``planned``: ``field, original, relaxed``."""
    met = planned.join(live, "field", "left")
    v = F.col("validators")
    return met.select("field", F.when(v.eqNullSafe(F.col("original")), "original").when(v.eqNullSafe(F.col("relaxed")), "relaxed").otherwise("unknown").alias("state"))


def finalize_mapping(entries: DataFrame, kept_ids: DataFrame, skipped: DataFrame, referenced: DataFrame) -> DataFrame:
    """Adds ``state, reason`` to ledger entries (``namespace, source_id, target_id``): kept if a row that stays has the id or, for external ones, refers to it; else skipped.

    ``kept_ids``: ``namespace, id``; ``skipped``: ``namespace, id, reason``; ``referenced``: ``namespace, id``.
    """
    key = lambda df, *more: df.select("namespace", F.col("id").alias("source_id"), *more)
    used = key(kept_ids).unionByName(key(referenced)).distinct().withColumn("used", F.lit(True))
    why = key(skipped, "reason").groupBy("namespace", "source_id").agg(F.min("reason").alias("why"))
    joined = entries.join(used, ["namespace", "source_id"], "left").join(why, ["namespace", "source_id"], "left")
    state = F.when(F.col("used"), "kept").otherwise("skipped")
    return joined.select(*entries.columns, state.alias("state"), F.when(F.col("used").isNull(), F.coalesce("why", F.lit("unused"))).alias("reason"))


def mapping_availability(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``target_id, current, published``: in which slices a mapped id must exist, by the references to it (``to_id, slice``)."""
    m = mapping.select(F.col("source_id").alias("to_id"), "target_id").distinct()
    return edges.join(m, "to_id").groupBy("target_id").agg(F.bool_or(F.col("slice") == "current").alias("current"), F.bool_or(F.col("slice") == "published").alias("published"))


def ledger_mismatches(planned: DataFrame, live: DataFrame, live_ids: DataFrame) -> DataFrame:
    """``rule, source_id``: planned entries that the live ledger lacks or has otherwise, and source ids that still exist live (``id``)."""
    there = live.select("namespace", "source_id", F.col("target_id").alias("_target"))
    met = planned.join(there, ["namespace", "source_id"], "left")
    rule = F.when(F.col("_target").isNull(), "missing").when(F.col("_target") != F.col("target_id"), "other target")
    old = planned.join(live_ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return met.select(rule.alias("rule"), "source_id").where("rule IS NOT NULL").unionByName(old.select(F.lit("source id is live").alias("rule"), "source_id"))


def issues_from_errors(errors: DataFrame) -> DataFrame:
    """``id, place, code, field``: issues in the order of an error payload (``id, payload`` JSON with ``data`` array); a nested code wins over the one at the top.

    An entry without a readable code, or with only the generic one, has the code VALIDATION_CONTRACT_CHANGED.
    """
    entry = "struct<attributes:struct<code:string,details:struct<code:string,field:string>>>"
    rows = errors.select("id", F.posexplode(F.from_json(F.get_json_object("payload", "$.data"), f"array<{entry}>")).alias("place", "e"))
    code = F.coalesce("e.attributes.details.code", F.when(F.col("e.attributes.code") != "INVALID_FIELD", F.col("e.attributes.code")), F.lit("VALIDATION_CONTRACT_CHANGED"))
    return rows.select("id", "place", code.alias("code"), F.col("e.attributes.details.field").alias("field"))


def contains_string(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents (``record_id``) of exploded rows, or rows of ``all_texts``, with a string that is exactly one of ``targets`` (``value``), and which."""
    wanted = small(targets.select("value").distinct())
    if "text" in rows.columns:
        return rows.select("record_id", F.col("text").alias("value")).join(wanted, "value", "left_semi").distinct()
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    return rows.where("kind = 'string'").select("record_id", text.alias("value")).join(wanted, "value", "left_semi").distinct()
