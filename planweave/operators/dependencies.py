"""Orders of a plan from its dependencies: creates, updates, deletes, publications, and who must give up a unique value first.

Edges are ``from_id, to_id, path, required`` (``from_id`` depends on ``to_id``; path ``parent`` is the tree); orders are levels, in which equal levels go by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.operators.graph import closure, connected_by, cyclic_edges, strongly_connected_components, topological_levels
from planweave.operators.ledger import reserve_ids
from planweave.operators.store import kept


def _within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (``id``)."""
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def _as_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def cyclic_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component, cyclic``: components by their smallest member; cyclic if several members or a reference to itself."""
    comp = kept(strongly_connected_components(ids, _as_graph(edges)), "components")
    large = comp.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    selfish = edges.where("from_id = to_id").select(F.col("from_id").alias("id")).distinct().join(comp, "id").select("component")
    cyclic = large.unionByName(selfish).distinct().withColumn("cyclic", F.lit(True))
    return kept(comp.join(cyclic, "component", "left").select("id", "component", F.coalesce("cyclic", F.lit(False)).alias("cyclic")), "cyclic-components")


def _inside(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges with ``component`` and ``inside``: whether both ends are in one cyclic component."""
    a = comp.select(F.col("id").alias("from_id"), F.col("component"), F.col("cyclic"))
    b = comp.select(F.col("id").alias("to_id"), F.col("component").alias("_other"))
    met = edges.join(a, "from_id").join(b, "to_id")
    return met.withColumn("inside", (F.col("component") == F.col("_other")) & F.col("cyclic")).drop("_other", "cyclic")


def shell_components(edges: DataFrame) -> DataFrame:
    """``component`` of inner edges that lie on a cycle of required ones, or lead from a row to itself: its rows are created as empty shells first."""
    inner = edges.where("inside AND required").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "component")
    ids = inner.select(F.col("src").alias("id")).unionByName(inner.select(F.col("dst").alias("id"))).distinct()
    ring = cyclic_edges(ids, inner.select("src", "dst")).distinct()
    return inner.join(ring, ["src", "dst"], "left_semi").select("component").unionByName(edges.where("inside AND from_id = to_id").select("component")).distinct()


def _placed(levels: DataFrame, name: str) -> DataFrame:
    return levels.select("id", F.col("level").alias(name))


def dependency_plan(created: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component, shell, create_level, update_level, temporary_seed, publication_seed`` of created rows (``id``).

    Inside a cyclic component optional edges do not order creates, nor do any edges inside a shell component; no edge inside a cyclic component orders
    updates. A temporary seed is a shell, or a row that refers to a later create. Publication seeds are the rows of cyclic components that are no
    shells, with all created rows that they depend on. A cycle of parents leaves rows without a level (``parent_cycles`` lists it).
    """
    created = kept(created.select("id").distinct(), "created")
    edges = kept(_within(edges, created).distinct(), "created-edges")
    comp = cyclic_components(created, edges)
    edges = kept(_inside(edges, comp), "placed-edges")
    shells = kept(shell_components(edges).withColumn("shell", F.lit(True)), "shells")
    known = edges.join(shells, "component", "left").withColumn("shell", F.coalesce("shell", F.lit(False)))
    order = kept(topological_levels(created, _as_graph(known.where("NOT (inside AND (shell OR NOT required))")))[0], "create-levels")
    update = topological_levels(created, _as_graph(known.where("NOT inside")))[0]
    seq = order.select("id", F.struct("level", "id").alias("seq"))
    late = edges.join(seq.select(F.col("id").alias("from_id"), F.col("seq").alias("a")), "from_id").join(seq.select(F.col("id").alias("to_id"), F.col("seq").alias("b")), "to_id")
    rows = comp.join(shells, "component", "left").withColumn("shell", F.coalesce("shell", F.lit(False)))
    late = late.where("b > a").select(F.col("from_id").alias("id")).distinct().withColumn("late", F.lit(True))
    published = closure(rows.where("cyclic AND NOT shell").select("id"), _as_graph(edges)).select("id", F.lit(True).alias("publication_seed"))
    out = rows.join(_placed(order, "create_level"), "id", "left").join(_placed(update, "update_level"), "id", "left").join(late, "id", "left").join(published, "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select("id", "component", "shell", "create_level", "update_level", (F.col("shell") | flag("late")).alias("temporary_seed"), flag("publication_seed").alias("publication_seed"))


def parent_cycles(edges: DataFrame) -> DataFrame:
    """Violations: tree edges that lie on a cycle of parents."""
    tree = edges.where("path = 'parent'")
    ids = tree.select(F.col("from_id").alias("id")).unionByName(tree.select(F.col("to_id").alias("id"))).distinct()
    return cyclic_edges(ids, _as_graph(tree)).distinct()


def cycle_candidates(created: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component, removed, topology``: members of cyclic components, how many references within it they lose, and whether their parent is one of them."""
    comp = cyclic_components(created.select("id").distinct(), kept(_within(edges, created).distinct(), "created-edges"))
    inner = _inside(_within(edges, created).distinct(), comp).where("inside")
    lost = inner.groupBy(F.col("from_id").alias("id"), "component").agg(F.count("*").alias("removed"), F.bool_or(F.col("path") == "parent").alias("topology"))
    return lost


def seed_references(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """``from_id, to_id, path``: references that a temporary seed leaves out, as they lead to a later create. In: ``dependency_plan``."""
    seq = plan.select("id", F.struct("create_level", "id").alias("seq"), "temporary_seed")
    a = seq.where("temporary_seed").select(F.col("id").alias("from_id"), F.col("seq").alias("a"))
    met = edges.join(a, "from_id").join(seq.select(F.col("id").alias("to_id"), F.col("seq").alias("b")), "to_id")
    return met.where("b > a").select("from_id", "to_id", "path").distinct()


def delete_plan(deleted: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete levels (``id, level``; the lowest goes first), edges to unlink before, and rows of cycles that remain (``id``).

    A row goes before what it depends on. Self-links do not count. Inside a cyclic component all optional edges but parents are unlinked first.
    """
    deleted = kept(deleted.select("id").distinct(), "deleted")
    edges = kept(_within(edges, deleted).where("from_id <> to_id").distinct(), "deleted-edges")
    placed = kept(_inside(edges, cyclic_components(deleted, edges)), "placed-edges")
    unlink = placed.where("inside AND NOT required AND path <> 'parent'")
    stays = placed.where("NOT (inside AND NOT required AND path <> 'parent')")
    levels, stuck = topological_levels(deleted, _as_graph(stays).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return levels, unlink.select("from_id", "to_id", "path"), stuck


def delete_cycles(deleted: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, kind, members``: cycles among deleted rows, of required references (kind required) or only closed by optional ones (optional)."""
    deleted = kept(deleted.select("id").distinct(), "deleted")
    edges = kept(_within(edges, deleted).where("from_id <> to_id").distinct(), "deleted-edges")
    comp = cyclic_components(deleted, edges).where("cyclic")
    hard = shell_components(_inside(edges, cyclic_components(deleted, edges)))
    sized = comp.groupBy("component").agg(F.count("*").alias("members"))
    joined = sized.join(hard.withColumn("hard", F.lit(True)), "component", "left")
    return joined.select("component", F.when(F.col("hard"), "required").otherwise("optional").alias("kind"), "members")


def unsupported_cycles(cycles: DataFrame, members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Required cycles with a member (``id, component``) whose published version holds blocks (``record_id``): unlinking it would need new block ids."""
    hit = members.join(blocks.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi").select("component").distinct()
    return cycles.where("kind = 'required'").join(hit, "component", "left_semi").select("component", "members")


def delete_releases(edges: DataFrame, targets: DataFrame, forced: bool = False) -> DataFrame:
    """``record_id, base, removed, leftover``: for rows that refer to ``targets`` (``id``): the slice to start from (published if it holds such a reference),
    how many references go, and how many required ones stay in the way (none if ``forced``). In: edges with ``slice``."""
    hit = edges.join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi").where("from_id <> to_id")
    base = F.when(F.bool_or(F.col("slice") == "published"), "published").otherwise("current")
    per = hit.groupBy(F.col("from_id").alias("record_id")).agg(base.alias("base"))
    mine = hit.withColumnRenamed("from_id", "record_id").join(per, "record_id").where("slice = base")
    stays = F.col("required") & F.lit(not forced)
    return mine.groupBy("record_id", "base").agg(F.count_if(~stays).alias("removed"), F.count_if(stays).alias("leftover"))


def rekey_blocks(blocks: DataFrame, reserved: DataFrame, site: str) -> DataFrame:
    """``block_id, new_id``: a deterministic new id for every block, none of them among ``reserved`` (``id``)."""
    wanted = blocks.select(F.lit("block").alias("namespace"), F.col("block_id").alias("source_id"))
    made = reserve_ids(wanted, reserved.select(F.lit("block").alias("namespace"), F.col("id").alias("target_id")), site)
    return made.select(F.col("source_id").alias("block_id"), F.col("target_id").alias("new_id"))


def publish_order(rows: DataFrame, edges: DataFrame, published_edges: DataFrame, children: DataFrame | None = None, unique: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Publication levels (``id, level``) and violations (``rule, from_id, to_id``).

    ``rows``: ``id, publishes, unpublishes, deletes, seed, was_published`` of all managed rows. A row publishes after what it refers to, if that also publishes and
    is neither a seed nor published in the destination already. A row unpublishes after every row whose published version refers to it.
    A reference to a deleted row, or to a managed one that will not be published, is a violation.

    ``edges`` are of desired published versions, ``published_edges`` of those in the destination. ``children`` (``id, parent_id, desired_parent_id``): published rows of trees in the destination; a
    row unpublishes after its children, unless they move away first. ``unique`` (``from_id, to_id``): who publishes after whom because of a unique value. A referrer or child that is not managed,
    that goes only later, or that stays published as it is stands in the way of an unpublishing: a violation. Rows that a cycle leaves without a level are violations too (``to_id`` null).
    """
    side = lambda name: rows.select(F.col("id").alias(name), *(F.col(c).alias(f"{name[0]}_{c}") for c in rows.columns if c != "id"))
    met = kept(edges.select("from_id", "to_id").distinct().join(side("from_id"), "from_id").join(side("to_id"), "to_id"), "publish-edges")
    waits = met.where("f_publishes AND t_publishes AND NOT t_seed AND NOT t_was_published").select("from_id", "to_id")
    leaving = rows.where("unpublishes").select(F.col("id").alias("to_id"))
    desired = edges.select("from_id", "to_id", F.lit(True).alias("still")).distinct()
    referrers = published_edges.where("from_id <> to_id").select("from_id", "to_id").distinct().join(leaving, "to_id", "left_semi").join(desired, ["from_id", "to_id"], "left")
    up = referrers.select("from_id", "to_id", F.coalesce("still", F.lit(False)).alias("still"), F.lit("referrer").alias("what"))
    if children is not None:
        below = children.where("id <> parent_id AND desired_parent_id <=> parent_id").select(F.col("id").alias("from_id"), F.col("parent_id").alias("to_id")).distinct()
        up = up.unionByName(below.join(leaving, "to_id", "left_semi").select("from_id", "to_id", F.lit(True).alias("still"), F.lit("child").alias("what")))
    up = kept(up.join(side("from_id"), "from_id", "left"), "unpublish-edges")
    reason = (
        F.when(F.col("f_publishes").isNull(), F.concat("what", F.lit(" is not managed")))
        .when(F.col("f_deletes"), F.concat("what", F.lit(" is deleted later")))
        .when(F.col("still") & (F.col("f_publishes") | (F.col("f_was_published") & ~F.col("f_unpublishes"))), F.concat("what", F.lit(" stays published")))
    )
    up = up.withColumn("rule", reason)
    moving = rows.where("publishes OR unpublishes").select("id")
    after = up.where("rule IS NULL").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    for other in [after] + ([] if unique is None else [unique.select("from_id", "to_id")]):
        waits = waits.unionByName(_within(other, moving))
    levels, stuck = topological_levels(moving, _as_graph(waits))
    bad = lambda rule, when: met.where(when).select(F.lit(rule).alias("rule"), "from_id", "to_id")
    found = bad("dependency is deleted", "f_publishes AND t_deletes")
    found = found.unionByName(bad("dependency is not published", "f_publishes AND NOT t_deletes AND NOT t_publishes AND (t_unpublishes OR NOT t_was_published)"))
    found = found.unionByName(up.where("rule IS NOT NULL").select("rule", "from_id", "to_id"))
    return levels, found.unionByName(stuck.select(F.lit("cycle").alias("rule"), F.col("id").alias("from_id"), F.lit(None).cast(rows.schema["id"].dataType).alias("to_id")))


def claim_transfers(desired: DataFrame, live: DataFrame) -> DataFrame:
    """``item_type_id, field, value, consumer, owner, frees``: values that a row is to claim while another row still holds them, and whether that owner's own desired version drops it.

    In: claims ``item_type_id, field, value, record_id``. An owner that is to go frees all it holds.
    """
    key = ["item_type_id", "field", "value"]
    fresh = desired.join(live, [*key, "record_id"], "left_anti").distinct()
    held = live.select(*key, F.col("record_id").alias("owner")).distinct()
    met = fresh.withColumnRenamed("record_id", "consumer").join(held, key).where("owner <> consumer")
    keeps = desired.select(*key, F.col("record_id").alias("owner"), F.lit(True).alias("keeps")).distinct()
    return met.join(keeps, [*key, "owner"], "left").select(*key, "consumer", "owner", F.col("keeps").isNull().alias("frees"))


def unique_releases(transfers: DataFrame) -> DataFrame:
    """``owner, fields, consumers``: owners that must give up values first, the fields that they patch, and how many rows wait for them."""
    able = transfers.where("frees")
    fields = F.array_join(F.array_sort(F.collect_set("field")), ",")  # fields of one model: few
    return able.groupBy("owner").agg(fields.alias("fields"), F.countDistinct("consumer").alias("consumers"))


def unique_edges(transfers: DataFrame) -> DataFrame:
    """Ordering edges: the consumer waits for the owner that frees its value."""
    path = F.concat_ws(":", F.lit("unique"), "field")
    return transfers.where("frees").select(F.col("consumer").alias("from_id"), F.col("owner").alias("to_id"), path.alias("path"), F.lit(True).alias("required")).distinct()


def unique_transitions(transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordering edges that can be kept, and conflicts (``consumer, owner, reason``): the owner keeps the value, or the rows swap values in a ring."""
    edges = kept(unique_edges(transfers), "unique-edges")
    ids = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct()
    ring = kept(cyclic_edges(ids, _as_graph(edges)).distinct().select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), "rings")
    told = lambda df, a, b, why: df.select(F.col(a).alias("consumer"), F.col(b).alias("owner"), F.lit(why).alias("reason")).distinct()
    conflicts = told(transfers.where("NOT frees"), "consumer", "owner", "owner keeps the value").unionByName(told(ring, "from_id", "to_id", "ring"))
    return edges.join(ring, ["from_id", "to_id"], "left_anti"), conflicts


def unique_value_cycles(transfers: DataFrame) -> DataFrame:
    """``item_type_id, field, component, members``: rings of rows that pass values on, per model and field."""
    able = transfers.where("frees")
    node = lambda c: F.concat_ws("|", "item_type_id", "field", c)
    edges = kept(able.select(node("consumer").alias("src"), node("owner").alias("dst"), "item_type_id", "field").distinct(), "value-edges")
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    comp = strongly_connected_components(ids, edges.select("src", "dst")).groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.split("component", r"\|")
    return comp.select(parts[0].alias("item_type_id"), parts[1].alias("field"), parts[2].alias("component"), "members")


def blocking_edges(edges: DataFrame, writes: DataFrame, destination: DataFrame) -> DataFrame:
    """Edges (``from_id, to_id, slice``; slice current, published or parent) that make a row wait for another: only if that slice is written, and the destination has no such row.

    ``writes``: ``record_id, item_type_id, writes_current, writes_published, moves``. ``destination``: ``record_id, item_type_id, published``; a published reference needs a published row of the same model.
    """
    w = writes.select(F.col("record_id").alias("from_id"), "writes_current", "writes_published", "moves")
    t = writes.select(F.col("record_id").alias("to_id"), F.col("item_type_id").alias("_model"))
    d = destination.select(F.col("record_id").alias("to_id"), F.col("item_type_id").alias("_there"), F.col("published").isNotNull().alias("_live"))
    s = F.col("slice")
    writing = F.when(s == "current", F.col("writes_current")).when(s == "published", F.col("writes_published")).otherwise(F.col("moves"))
    met = edges.join(w, "from_id").where(writing).join(t, "to_id", "left").join(d, "to_id", "left")
    satisfied = F.coalesce((F.col("_there") == F.coalesce("_model", "_there")) & ((s != "published") | F.col("_live")), F.lit(False))
    return met.where(~satisfied).select("from_id", "to_id", "slice").distinct()


def skip_closure(blocked: DataFrame, edges: DataFrame, writes: DataFrame, destination: DataFrame) -> DataFrame:
    """``id, blocker, distance``: rows that cannot be written as something they refer to is skipped, and it is not in the destination either. Rows that write nothing never are."""
    waiting = kept(_as_graph(blocking_edges(edges, writes, destination)), "blocking-edges")
    return connected_by(waiting, writes.where("writes_current OR writes_published OR moves").select(F.col("record_id").alias("id")), blocked)


def skip_chains(skips: DataFrame) -> DataFrame:
    """``id, chain``: for each skipped row (``id, blocker, distance``, as of ``skip_closure``; a blocked row is its own blocker) the ids from it to the row that everything began with.

    Pointers to blockers are doubled, so a chain of n rows takes a logarithmic number of joins.
    """
    begin = F.when(F.col("distance") == 0, F.array("id")).otherwise(F.array("id", "blocker"))
    done = F.col("distance") == 0
    open_ = kept(skips.select("id", begin.alias("chain"), F.when(~done, F.col("blocker")).alias("next")), "chains")
    root = skips.where(done).select(F.col("id").alias("_root"))
    open_ = kept(open_.join(root, F.col("next") == F.col("_root"), "left").withColumn("next", F.when(F.col("_root").isNull(), F.col("next"))).drop("_root"), "chains")
    while not open_.where("next IS NOT NULL").isEmpty():
        on = open_.select(F.col("id").alias("_id"), F.col("chain").alias("_more"), F.col("next").alias("_next"))
        met = open_.join(on, F.col("next") == F.col("_id"), "left")
        longer = F.concat("chain", F.expr("slice(_more, 2, size(_more))"))
        open_ = kept(met.select("id", F.when(F.col("_id").isNull(), F.col("chain")).otherwise(longer).alias("chain"), F.col("_next").alias("next")), "chains")
    return open_.select("id", "chain")


def ordering_anchors(skipped: DataFrame, destination: DataFrame, source: DataFrame, models: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that a skipped sibling holds (``record_id, anchor``) and destination-only siblings that it protects (``record_id, anchor``).

    A skipped row (``record_id``) that the destination has keeps its place, so siblings can neither enter, leave nor move within its group (model, parent); the anchor is the
    smallest such row of the groups that a row is in before or after. All tables: ``record_id, item_type_id, parent_id, position``. ``models``: ``item_type_id, tree, sortable``;
    rows of a sortable model that is no tree are one group, those of other models have no order. Without it every model is a tree.
    """
    group = ["item_type_id", "parent_id"]
    if models is not None:
        ordered = F.broadcast(models.where("tree OR sortable").select("item_type_id", "tree"))  # a schema's models are few
        of = lambda df: df.join(ordered, "item_type_id").withColumn("parent_id", F.when(F.col("tree"), F.col("parent_id"))).drop("tree")
        destination, source = of(destination), of(source)
    held = destination.join(skipped.select("record_id"), "record_id", "left_semi")
    anchors = held.groupBy(*group).agg(F.min("record_id").alias("anchor")).withColumnsRenamed({c: f"_{c}" for c in group})
    near = lambda df: df.join(anchors, (F.col("item_type_id") == F.col("_item_type_id")) & F.col("parent_id").eqNullSafe(F.col("_parent_id")))
    d = destination.select("record_id", F.struct(*group, "position").alias("_was"))
    moved = source.join(d, "record_id", "left").where(~F.struct(*group, "position").eqNullSafe(F.col("_was"))).drop("_was")
    moved = moved.join(skipped.select("record_id"), "record_id", "left_anti")
    left = moved.select("record_id").join(destination, "record_id")  # the group that a row is in now
    touched = near(moved).select("record_id", "anchor").unionByName(near(left).select("record_id", "anchor"))
    only = destination.join(source.select("record_id"), "record_id", "left_anti")
    return touched.groupBy("record_id").agg(F.min("anchor").alias("anchor")), near(only).select("record_id", "anchor")


def protected_targets(skipped: DataFrame, destination_edges: DataFrame, destination_only: DataFrame) -> DataFrame:
    """Destination-only rows (``id``) that a skipped row (``id``) still reaches in the destination: they must not be deleted."""
    reached = closure(skipped, _as_graph(destination_edges))
    return reached.join(destination_only.select("id"), "id", "left_semi").select("id")


def protected_uploads(references: DataFrame, held: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets that skipped or protected rows (``held``: ``record_id``) refer to, and planned rows (``record_id``) whose assets among them would change: these are skipped too.

    ``references``: ``record_id, upload_id``; ``changes``: ``upload_id`` of assets that the plan updates or deletes.
    """
    kept_ = references.join(held.select("record_id"), "record_id", "left_semi").select("upload_id").distinct()
    clash = kept_.join(changes.select("upload_id").distinct(), "upload_id", "left_semi")
    users = references.join(clash, "upload_id", "left_semi").join(held.select("record_id"), "record_id", "left_anti")
    return kept_, users.select("record_id").distinct()
