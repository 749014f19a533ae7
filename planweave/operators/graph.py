"""Graph operators over edge tables ``src, dst``: closures, components, topological levels and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.operators.store import kept

#: Rounds after which an iteration that has not ended is an error.
MAX_ROUNDS = 10_000


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``id, distance``: all nodes that ``seeds`` (``id``) reach over ``edges``, with the least number of steps (0 for seeds). Only the frontier is joined."""
    edges = kept(edges.select("src", "dst").distinct(), "edges")
    frontier = kept(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "closure")
    seen = frontier
    for step in range(1, max_rounds):
        new = frontier.join(edges, frontier.id == edges.src).select(F.col("dst").alias("id")).distinct()
        frontier = kept(new.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"closure did not end within {max_rounds} rounds")


def _trimmed(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Edges of which both ends have edges in and out: whatever is in a cycle is left."""
    edges = kept(edges.where("src <> dst").select("src", "dst").distinct(), "trim")
    n = edges.count()
    for _ in range(max_rounds):
        inner = edges.select(F.col("src").alias("id")).distinct().intersect(edges.select(F.col("dst").alias("id")).distinct())
        inner = kept(inner, "inner")
        left = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = kept(left.select("src", "dst"), "trim")
        m = edges.count()
        if m == n:
            return edges
        n = m
    raise RuntimeError(f"trimming did not end within {max_rounds} rounds")


def _spread(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """``id, label``: the smallest starting label that reaches each node over ``edges``."""
    labels = kept(nodes, "labels")
    for _ in range(max_rounds):
        moved = edges.join(labels, edges.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        joined = labels.join(moved, "id", "left").select("id", F.least("label", F.coalesce("new", "label")).alias("label"), (F.col("new") < F.col("label")).alias("changed"))
        labels = kept(joined, "labels")
        changed = labels.where("changed").isEmpty()
        labels = labels.select("id", "label")
        if changed:
            return labels
    raise RuntimeError(f"labels did not settle within {max_rounds} rounds")


def strongly_connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``id, component``: components by their smallest member. ``nodes`` has ``id``; edges to other nodes are ignored, self edges too.

    Colouring rounds: sources and sinks are trimmed away, every node gets the smallest node that reaches it, and what reaches that node
    back within its colour is a component. Nodes outside all cycles are components of their own. Rounds that don't end raise an error.
    """
    ids = nodes.select("id").distinct()
    inside = edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    left, found = inside.select("src", "dst"), None
    for _ in range(max_rounds):
        left = _trimmed(left, max_rounds)
        if left.isEmpty():
            break
        members = left.select(F.col("src").alias("id")).distinct()
        colour = _spread(members.withColumn("label", F.col("id")), left, max_rounds)
        a = colour.select(F.col("id").alias("src"), F.col("label").alias("a"))
        b = colour.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        same = kept(left.join(a, "src").join(b, "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a"), "same-colour")
        roots = colour.where("id = label")
        back = _reach_within(roots, same, max_rounds)
        done = kept(back, "component")
        found = done if found is None else found.unionByName(done)
        gone = done.select("id")
        left = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    if found is None:
        return ids.select("id", F.col("id").alias("component"))
    least = found.groupBy("component").agg(F.min("id").alias("smallest"))
    named = found.join(least, "component").select("id", F.col("smallest").alias("component"))
    return ids.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _reach_within(roots: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """``id, component``: nodes that a root reaches over edges (``src, dst, a``) of its own colour ``a``."""
    frontier = kept(roots.select("id", F.col("label").alias("component")), "roots")
    seen = frontier
    for _ in range(max_rounds):
        on = (frontier.id == edges.src) & (frontier.component == edges.a)
        new = frontier.join(edges, on).select(F.col("dst").alias("id"), "component").distinct()
        frontier = kept(new.join(seen.select("id"), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"search did not end within {max_rounds} rounds")


def cyclic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside a component, and self edges: those that lie on a cycle."""
    c = kept(strongly_connected_components(nodes, edges), "components")
    two = edges.join(c.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    return two.where("a = b").select("src", "dst")


def topological_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Levels (``id, level``) and what is left (``id``). An edge says that ``src`` depends on ``dst``; self edges are ignored.

    Level 0 depends on nothing, level n on something of level n-1. Ends of edges that are not in ``nodes`` are nodes too. Whatever depends on a cycle
    is left, so an empty second table means that there is an order.
    """
    edges = kept(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    ids = nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    needs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("open"))
    rest, out = kept(ids.join(needs, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open")), "rest"), []
    for level in range(max_rounds):  # a node is ready when none of what it depends on is open
        ready = rest.where("open = 0").select("id", F.lit(level).alias("level"))
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, out or [ready]), rest.select("id")
        out.append(ready)
        met = edges.join(ready.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("met"))
        rest = kept(rest.where("open > 0").join(met, "id", "left").select("id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "rest")
    raise RuntimeError(f"levels did not end within {max_rounds} rounds")


def chain_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """As ``topological_levels``, for graphs with long chains: rounds grow with the logarithm of a chain's length, and with the number of nodes on a path that depend on several others.

    A node that depends on one other only is as far above the first node that does not as there are steps between them; these are counted by pointer doubling. The others are peeled.
    """
    edges = kept(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    ids = nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    needs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    known = kept(ids.join(needs, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "next"), "nodes")
    ends = known.select(F.col("id").alias("next"), (F.col("n") == 1).alias("open"))
    walk = kept(known.where("n = 1").select("id", "next", F.lit(1).cast("long").alias("dist")).join(ends, "next").select("id", "next", "dist", "open"), "chains")
    total, span = walk.count(), 1
    while span <= total and not walk.where("open").isEmpty():  # a pointer over more steps than there are such nodes goes round a cycle
        hop = walk.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("dist").alias("_dist"), F.col("open").alias("_open"))
        moved = walk.where("open").join(hop, "next").select("id", F.col("_next").alias("next"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_open").alias("open"))
        walk, span = kept(walk.where("NOT open").unionByName(moved), "chains"), span * 2
    walk = walk.where("NOT open")

    forks = edges.join(known.where("n > 1").select(F.col("id").alias("src")), "src", "left_semi")
    far = forks.join(walk.select(F.col("id").alias("dst"), "next", "dist"), "dst", "left")
    steps = kept(far.select("src", F.coalesce("next", "dst").alias("dst"), (F.coalesce("dist", F.lit(0)) + 1).alias("step")), "steps")
    rest = kept(known.where("n <> 1").select("id", F.col("n").alias("open"), F.lit(0).cast("long").alias("level")), "rest")
    out: list[DataFrame] = []
    for _ in range(max_rounds):
        ready = rest.where("open = 0").select("id", "level")
        if ready.isEmpty():
            break
        out.append(ready)
        met = steps.join(ready.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("step")).alias("up"))
        left = rest.where("open > 0").join(met, "id", "left")
        rest = kept(left.select("id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", F.coalesce("up", "level")).alias("level")), "rest")
    else:
        raise RuntimeError(f"levels did not end within {max_rounds} rounds")
    peeled = reduce(DataFrame.unionByName, out or [ready])
    above = walk.join(peeled.withColumnRenamed("id", "next"), "next").select("id", (F.col("level") + F.col("dist")).alias("level"))
    levels = kept(peeled.unionByName(above).select("id", F.col("level").cast("int").alias("level")), "levels")
    return levels, known.select("id").join(levels, "id", "left_anti")


def depths(nodes: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``id, depth`` in a tree given by ``id, parent_id``: 0 for roots and for nodes whose parent is not there. Nodes in a cycle of parents have depth null."""
    tree = nodes.select("id", "parent_id")
    inner = tree.join(tree.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    found = closure(tree.join(inner.select("id"), "id", "left_anti").select("id"), inner.select(F.col("parent_id").alias("src"), F.col("id").alias("dst")), max_rounds)
    return tree.select("id").join(found.withColumnRenamed("distance", "depth"), "id", "left")


def connected_by(edges: DataFrame, start: DataFrame, blocked: DataFrame) -> DataFrame:
    """Skip closure: nodes that depend, directly or not, on ``blocked`` ids, with the smallest blocker at the least distance.

    ``start`` (``id``) are the nodes that may be skipped; ``edges`` say ``src`` depends on ``dst``. Returns ``id, blocker, distance``.
    """
    frontier = kept(blocked.select(F.col("id"), F.col("id").alias("blocker"), F.lit(0).alias("distance")), "blocked")
    seen = frontier
    deps = edges.select("src", "dst").distinct().join(start.select(F.col("id").alias("src")), "src", "left_semi")
    deps = kept(deps, "dependencies")
    for step in range(1, MAX_ROUNDS):
        hit = frontier.join(deps, frontier.id == deps.dst).groupBy(F.col("src").alias("id")).agg(F.min(frontier.id).alias("blocker"))
        frontier = kept(hit.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)), "skipped")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("skips did not end")
