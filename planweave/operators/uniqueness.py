"""Unique values over the phases of an apply: who claims what when, who has to wait for whom, and what no order can solve; and which invalid rows still have a peer.

A claim is ``item_type_id, field, locale, value, record_id`` (locale ``value`` where a field is not localized). Work grows with claims, not with pairs of claimants: a value that many hold or want has one row a claimant,
and graphs go through one node a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.operators.graph import MAX_ROUNDS, cyclic_edges
from planweave.operators.store import kept

KEY = ("item_type_id", "field", "locale", "value")


def _contend(incoming: DataFrame, holders: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Claims that have to wait and claims that conflict, of ``incoming`` (KEY, record_id, phase, may_wait) against ``holders`` (KEY, owner, frees)."""
    two = lambda when, c: [F.min(F.when(when, F.col("owner"))).alias(f"{c}_first"), F.max(F.when(when, F.col("owner"))).alias(f"{c}_last")]
    frees = F.col("frees")
    held = holders.groupBy(*KEY).agg(*two(~frees, "keep"), *two(F.lit(True), "any"), F.min(F.when(frees, F.col("owner"))).alias("free_first"), F.sum(frees.cast("long")).alias("n"))
    met = kept(incoming.join(held, [*KEY]), name)
    other = lambda c: F.when(F.col(f"{c}_first") != F.col("record_id"), F.col(f"{c}_first")).when(F.col(f"{c}_last") != F.col("record_id"), F.col(f"{c}_last"))
    holder = F.when(F.col("may_wait"), other("keep")).otherwise(other("any"))
    keeps = met.withColumn("holder", holder).where("holder IS NOT NULL").select(*KEY, "record_id", "phase", "holder", F.lit("holder keeps the value").alias("reason"))
    waits = met.where("may_wait AND n > 0").select(*KEY, "record_id", "phase", F.col("free_first").alias("holder"), "n")
    node = F.sha2(F.to_json(F.struct(*KEY)), 256)
    to_value = waits.select(F.concat(F.lit("r:"), "record_id").alias("src"), F.concat(F.lit("v:"), node).alias("dst"))
    from_value = holders.where("frees").join(waits.select(*KEY).distinct(), [*KEY], "left_semi").select(F.concat(F.lit("v:"), node).alias("src"), F.concat(F.lit("r:"), "owner").alias("dst"))
    edges = kept(to_value.unionByName(from_value).distinct(), "wait-edges")
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    ring = cyclic_edges(nodes, edges).select("src", "dst", F.lit(True).alias("ring"))
    marked = waits.withColumn("src", F.concat(F.lit("r:"), "record_id")).withColumn("dst", F.concat(F.lit("v:"), node)).join(ring.distinct(), ["src", "dst"], "left").drop("src", "dst")
    rings = marked.where("ring").select(*KEY, "record_id", "phase", "holder", F.lit("ring").alias("reason"))
    return marked.where("ring IS NULL").drop("ring"), keeps.unionByName(rings)


def unique_phases(records: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waits (KEY, ``record_id, phase, holder, n``) and conflicts (KEY, ``record_id, phase, holder, reason``) of unique values while a plan is applied.

    ``records``: ``record_id, in_source, in_target, has_published`` (the desired record has a published slice), ``stage_changes`` (that slice is not the destination's), ``equal_slices`` (both desired slices are equal),
    ``current_kept`` (the desired current slice is the destination's). ``claims``: KEY, ``record_id``, and ``version``: ``before`` (the destination's current slice), ``current``, ``published`` (desired). Blanks claim nothing.

    First, the only holder of a value that it gives up and that another row will want takes its desired current version. Then new rows are created with their published slice, or the current one without such (phase ``create-seed``), and
    changed published slices pass through the current one (``published-stage``); a stage waits for a holder whose own stage gives the value up. At last current slices are restored (``current-restore``); a row waits for a holder
    whose desired current slice does not have the value. A wait that lies on a cycle of waits is a conflict, and so is every holder that keeps the value. ``holder`` is the smallest one in the way (of the row's own value, the largest), ``n`` counts those waited for.
    """
    claims = kept(claims.select(*KEY, "record_id", "version").distinct(), "claims")
    rows = kept(records.withColumn("_create", F.col("in_source") & ~F.col("in_target")).withColumn("_staged", F.col("in_source") & F.col("in_target") & F.col("has_published") & F.col("stage_changes")), "rows")
    of = lambda version, when: claims.where(F.col("version") == version).drop("version").join(rows.where(when).select("record_id"), "record_id", "left_semi").select(*KEY, "record_id")
    before, current = of("before", "in_target"), of("current", "in_source")
    stage = of("published", "_staged")
    seeds = of("published", "_create AND has_published").unionByName(of("current", "_create AND NOT has_published"))
    future = current.unionByName(stage).unionByName(of("published", "_create"))

    sole = before.groupBy(*KEY).agg(F.min("record_id").alias("record_id"), F.max("record_id").alias("_last")).where("record_id = _last").drop("_last")
    rivals = future.groupBy(*KEY).agg(F.min("record_id").alias("_a"), F.max("record_id").alias("_b"))
    wanted = sole.join(rivals, [*KEY]).where("_a <> record_id OR _b <> record_id").select(*KEY, "record_id")
    given_up = wanted.join(current, [*KEY, "record_id"], "left_anti").join(rows.where("in_source").select("record_id"), "record_id", "left_semi")
    place = ["record_id", "item_type_id", "field"]
    released = kept(given_up.select(*place).distinct(), "released")
    start = before.join(released, place, "left_anti").unionByName(current.join(released, place, "left_semi").select(*KEY, "record_id")).unionByName(seeds)
    start = kept(start.select(*KEY, F.col("record_id").alias("owner")).distinct(), "phase-start")
    staged = rows.where("_staged").select(F.col("record_id").alias("owner"))

    def marked(holders: DataFrame, able: DataFrame, keeps: DataFrame) -> DataFrame:
        """Holders with ``frees``: whether they are among ``able`` and ``keeps`` does not have the claim."""
        still = keeps.select(*KEY, F.col("record_id").alias("owner"), F.lit(True).alias("_still"))
        able = able.select("owner", F.lit(True).alias("_able"))
        met = holders.join(able, "owner", "left").join(still, [*KEY, "owner"], "left")
        return met.select(*KEY, "owner", (F.col("_able").isNotNull() & F.col("_still").isNull()).alias("frees"))

    first = seeds.select(*KEY, "record_id", F.lit("create-seed").alias("phase"), F.lit(False).alias("may_wait"))
    first = first.unionByName(stage.select(*KEY, "record_id", F.lit("published-stage").alias("phase"), F.lit(True).alias("may_wait")))
    waits, conflicts = _contend(first, marked(start, staged, stage), "published-stage")

    end = start.join(staged, "owner", "left_anti").unionByName(stage.withColumnRenamed("record_id", "owner"))
    moves = rows.where("(_staged OR _create AND has_published) AND NOT equal_slices").select("record_id")
    plain = rows.where("in_source AND in_target AND NOT _staged AND NOT current_kept").select("record_id")
    restored = current.join(moves, "record_id", "left_semi").unionByName(current.join(plain, "record_id", "left_semi").join(released, place, "left_anti"))
    last = restored.select(*KEY, "record_id", F.lit("current-restore").alias("phase"), F.lit(True).alias("may_wait"))
    able = rows.where("in_source").select(F.col("record_id").alias("owner"))
    more, others = _contend(last, marked(end, able, current), "current-restore")
    return waits.unionByName(more), conflicts.unionByName(others)


def unsupported_uniqueness(rows: DataFrame, claims: DataFrame, preserved: DataFrame) -> DataFrame:
    """``record_id, slice, round``: rows whose only fault is a value that is not unique, and that no peer shares any more once other such rows have gone.

    ``rows``: ``record_id, slice, checked`` (an invalid row that will be written and has no other fault), ``supports`` (it will stay invalid, so it is a peer). ``claims``: KEY, ``record_id, slice`` of all rows. ``preserved``: the same for
    rows of the destination that stay as they are and are invalid. A row needs one peer in the same slice, for any of its values. Rows without go in rounds; each round only follows values whose peers fell to one,
    by their counts. ``round`` 0 never had a peer.
    """
    place = [*KEY, "slice"]
    mine = kept(claims.select(*place, "record_id").distinct().join(rows.where("checked").select("record_id", "slice"), ["record_id", "slice"], "left_semi"), "claims")
    others = claims.join(rows.where("supports").select("record_id", "slice"), ["record_id", "slice"], "left_semi").select(*place, "record_id").unionByName(preserved.select(*place, "record_id")).distinct()
    peers = kept(others.groupBy(*place).agg(F.count("*").alias("n")), "peers")
    own = others.withColumn("_own", F.lit(1))
    open_ = kept(rows.where("checked").select("record_id", "slice"), "open")
    gone = []
    for step in range(MAX_ROUNDS):
        held = mine.join(open_, ["record_id", "slice"], "left_semi").join(peers, place, "left").join(own, [*place, "record_id"], "left")
        backed = held.where(F.coalesce("n", F.lit(0)) - F.coalesce("_own", F.lit(0)) > 0).select("record_id", "slice").distinct()
        out = kept(open_.join(backed, ["record_id", "slice"], "left_anti").withColumn("round", F.lit(step)), "unsupported")
        if out.isEmpty():
            break
        gone.append(out)
        open_ = kept(open_.join(out, ["record_id", "slice"], "left_anti"), "open")
        fewer = own.join(out, ["record_id", "slice"], "left_semi").groupBy(*place).agg(F.count("*").alias("_less"))
        peers = kept(peers.join(fewer, place, "left").select(*place, (F.col("n") - F.coalesce("_less", F.lit(0))).alias("n")), "peers")
    else:
        raise RuntimeError(f"rows did not settle within {MAX_ROUNDS} rounds")
    out = open_.limit(0).withColumn("round", F.lit(0))
    for g in gone:
        out = out.unionByName(g)
    return out
