"""Registered queries of greedy ledger chunks, chains of skips, and plans that are committed as a whole, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.operators import dependencies as E
from planweave.operators import diff as D
from planweave.operators import ledger as L
from planweave.operators import snapshot as N
from planweave.operators import stages as W
from planweave.operators.graph import connected_by
from planweave.operators.store import kept, new_path
from planweave.plans.dependency_queries import _DEPENDENCIES, _edges
from planweave.plans.queries import PLAN_SQL, query
from planweave.sources.records import both, read_table

_LEDGER = """z AS MATERIALIZED (SELECT *, strlen(namespace || ':' || source_id || ':' || target_id) + 3 AS size FROM (SELECT o_orderpriority AS namespace, CAST(o_orderkey AS VARCHAR) AS source_id, repeat('t', CAST(o_orderkey % 7 AS INT)) || o_custkey AS target_id FROM orders)),
y AS MATERIALIZED (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS i FROM z WINDOW w AS (PARTITION BY namespace ORDER BY source_id, target_id)),
b AS (SELECT namespace, 1 AS i, 0 AS chunk, 0 AS before FROM y WHERE i = 1
  UNION ALL SELECT n.namespace, n.i, b.chunk + 1, n.upto - n.size FROM b JOIN y n ON n.namespace = b.namespace AND n.upto > b.before + 3584 AND n.upto - n.size <= b.before + 3584),
k AS (SELECT y.*, b.chunk FROM y JOIN b ON b.namespace = y.namespace AND y.upto - y.size >= b.before AND y.upto <= b.before + 3584)"""


def _entries(spark, sf):
    target = F.concat(F.expr("repeat('t', cast(o_orderkey % 7 AS int))"), F.col("o_custkey").cast("string"))
    return read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("namespace"), F.col("o_orderkey").cast("string").alias("source_id"), target.alias("target_id"))


@query("h6_greedy_chunks", f"WITH RECURSIVE {_LEDGER} SELECT namespace, source_id, target_id, CAST(chunk AS BIGINT) AS chunk FROM k", records=False)
def h6_greedy_chunks(spark, sf):
    """Orders of a priority, one entry after another, in chunks of at most 3584 bytes."""
    return L.greedy_chunks(_entries(spark, sf), limit=4096)


@query("h6_batch_chunks", f"WITH RECURSIVE {_LEDGER} SELECT namespace, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY 1, 2", records=False)
def h6_batch_chunks(spark, sf):
    """Chunks of each batch with their sizes; the ids are tested apart."""
    return L.ledger_batches(kept(L.greedy_chunks(_entries(spark, sf), limit=4096), "chunks")).select("namespace", "chunk", "n", "bytes")


@query("e7_skip_chains", f"""WITH RECURSIVE {_DEPENDENCIES},
sd AS (SELECT id, 0 AS d FROM n WHERE id % 60 = 7 UNION SELECT e.from_id, sd.d + 1 FROM sd JOIN e ON e.to_id = sd.id WHERE sd.d < 60),
ds AS MATERIALIZED (SELECT id, min(d) AS d FROM sd GROUP BY 1),
pr AS MATERIALIZED (SELECT from_id AS id, min(to_id) AS up FROM e JOIN ds a ON a.id = from_id JOIN ds b ON b.id = to_id WHERE b.d = a.d - 1 GROUP BY 1),
ch AS (SELECT id, CAST(id AS VARCHAR) AS chain, id AS cur FROM ds UNION ALL SELECT ch.id, ch.chain || '>' || pr.up, pr.up FROM ch JOIN pr ON pr.id = ch.cur)
SELECT id, chain FROM ch WHERE cur NOT IN (SELECT id FROM pr)""", records=False)
def e7_skip_chains(spark, sf):
    """One row of every block is blocked; rows that depend on it, directly or not, name their way to it."""
    ids, edges = _edges(spark, sf)
    graph = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    skips = kept(connected_by(graph, ids, ids.where("id % 60 = 7")), "skips")
    return E.skip_chains(skips).select("id", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


@query("a16_committed_plan", f"WITH {PLAN_SQL} SELECT record_id, item_type_id, action FROM p")
def a16_committed_plan(spark, sf):
    """A plan that was committed part by part and read back against its manifest."""
    path = new_path(spark, "committed-plan")
    N.commit_plan(D.plan_records(*both(spark, sf)).select("record_id", "item_type_id", "action"), path, ["record_id"])
    return N.open_plan(spark, path)


_STAGES = f"""{PLAN_SQL},
t AS MATERIALIZED (SELECT p.record_id, action, s.current AS dc, s.published AS dp, d.current AS bc, d.published AS bp, p.item_type_id <> 'part' AS draft, coalesce(s.position, d.position) % 5 = 0 AS pseed, p.item_type_id = 'customer' AS tree,
  s.parent_id IS DISTINCT FROM d.parent_id AS rep, p.item_type_id = 'customer' AND coalesce(s.position, d.position) % 4 = 0 AS pos, CASE WHEN coalesce(s.position, d.position) % 9 = 0 AND action <> 'delete' THEN '{{"name":"<free>"}}' END AS rel,
  CASE WHEN coalesce(s.position, d.position) % 20 = 0 AND action = 'delete' THEN '{{"name":null}}' END AS del FROM p LEFT JOIN src s USING (record_id) LEFT JOIN dst d USING (record_id)),
t1 AS (SELECT *, CASE WHEN action = 'create' THEN coalesce(dp, dc) ELSE bc END AS b0 FROM t), t2 AS (SELECT *, coalesce(rel, b0) AS v2 FROM t1),
t3 AS (SELECT *, v2 IS DISTINCT FROM b0 AS released, CASE WHEN NOT draft AND v2 IS DISTINCT FROM b0 THEN v2 WHEN action = 'create' THEN CASE WHEN NOT draft OR pseed THEN b0 END ELSE bp END AS pub, action IN ('create', 'update') AS w FROM t2),
t4 AS (SELECT *, CASE WHEN w AND dp IS NOT NULL AND pub IS DISTINCT FROM dp THEN dp ELSE v2 END AS v4 FROM t3), t5 AS MATERIALIZED (SELECT *, CASE WHEN w THEN coalesce(dc, v4) ELSE v4 END AS v5 FROM t4),
st AS MATERIALIZED (SELECT record_id, 0 AS step, 'create' AS stage, b0 AS version FROM t5 WHERE action = 'create' UNION ALL SELECT record_id, 1, 'unique-release', v2 FROM t5 WHERE released
  UNION ALL SELECT record_id, 2, 'tree-reparent', v2 FROM t5 WHERE action = 'update' AND tree AND rep UNION ALL SELECT record_id, 3, 'published-stage', v4 FROM t5 WHERE v4 IS DISTINCT FROM v2
  UNION ALL SELECT record_id, 4, 'current-restore', v5 FROM t5 WHERE w AND v5 IS DISTINCT FROM v4 UNION ALL SELECT record_id, 5, 'delete-release', del FROM t5 WHERE action = 'delete' AND del IS NOT NULL AND del IS DISTINCT FROM bc
  UNION ALL SELECT record_id, 6, 'position-finalize', v5 FROM t5 WHERE w AND pos)"""


def _stages(spark, sf):
    """Every ninth row releases its name first, every second deleted one at last; customers are a tree, and parts have no drafts."""
    s, d = both(spark, sf)
    two = D.diff_entities(s, d, "record_id", position="position")
    k, kind = F.coalesce("s_position", "d_position"), F.coalesce("s_item_type_id", "d_item_type_id")
    gone = F.col("action") == "delete"
    return W.write_stages(two.select(
        "record_id", "action", F.col("s_current").alias("desired_current"), F.col("s_published").alias("desired_published"), F.col("d_current").alias("baseline_current"), F.col("d_published").alias("baseline_published"),
        F.lit(None).cast("string").alias("seed"), F.when((k % 9 == 0) & ~gone, '{"name":"<free>"}').alias("release"), F.when((k % 20 == 0) & gone, '{"name":null}').alias("delete_release"), (kind != "part").alias("draft_mode"),
        (k % 5 == 0).alias("publication_seed"), (kind == "customer").alias("tree"), (~F.col("s_parent_id").eqNullSafe(F.col("d_parent_id"))).alias("reparents"), ((kind == "customer") & (k % 4 == 0)).alias("repositions"),
    ))


@query("g15_write_stages", f"WITH {_STAGES} SELECT record_id, step, stage, sha256(version) AS hash FROM st")
def g15_write_stages(spark, sf):
    """All seven stages of all rows, each with the hash of what it writes."""
    return _stages(spark, sf).select("record_id", "step", "stage", "hash")


@query("g15_stage_risks", f"WITH {_STAGES} SELECT record_id, stage, '.name' AS path FROM st WHERE json_extract_string(version, '$.name') LIKE '%<%'")
def g15_stage_risks(spark, sf):
    """Released names hold markup: each stage that writes one is a risk."""
    return W.stage_risks(_stages(spark, sf), ("name",))
