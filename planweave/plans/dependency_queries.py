"""Registered queries of dependency orders, unique values and skips, with DuckDB SQL for the same rows.

The graph is over all customers: within every 60 keys, k refers to k * k + 7 (optional for every seventh), every fourth also to 5k + 1 (optional), and every fifth has k / 2 as parent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.functions.canonical import deterministic_id
from planweave.operators import dependencies as E
from planweave.operators import diff as D
from planweave.operators import explode as X
from planweave.operators.validity import write_requirements
from planweave.plans.queries import query, write_changes
from planweave.sources.records import both, read_table

_DEPENDENCIES = """n AS (SELECT c_custkey AS id FROM customer),
e AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT c_custkey AS from_id, c_custkey // 60 * 60 + (c_custkey % 60 * (c_custkey % 60) + 7) % 60 AS to_id, 'a' AS path, c_custkey % 7 <> 0 AS required FROM customer
  UNION ALL SELECT c_custkey, c_custkey // 60 * 60 + (c_custkey % 60 * 5 + 1) % 60, 'b', false FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, c_custkey // 60 * 60 + c_custkey % 60 // 2, 'parent', true FROM customer WHERE c_custkey % 5 = 0) WHERE to_id IN (FROM n)),
r AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT r.a, e.to_id FROM r JOIN e ON r.b = e.from_id),
m AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS least FROM r x JOIN r y ON x.b = y.a AND y.b = x.a GROUP BY 1),
c AS MATERIALIZED (SELECT n.id, least(n.id, coalesce(m.least, n.id)) AS component FROM n LEFT JOIN m USING (id)),
big AS MATERIALIZED (SELECT component FROM c GROUP BY 1 HAVING count(*) > 1),
y AS MATERIALIZED (FROM big UNION SELECT component FROM c JOIN e ON from_id = id WHERE from_id = to_id),
i AS MATERIALIZED (SELECT e.*, p.component, p.component = q.component AND p.component IN (FROM y) AS inside FROM e JOIN c p ON p.id = from_id JOIN c q ON q.id = to_id),
rr AS (SELECT from_id AS a, to_id AS b FROM i WHERE inside AND required UNION SELECT rr.a, i.to_id FROM rr JOIN i ON rr.b = i.from_id WHERE inside AND required),
sh AS MATERIALIZED (SELECT DISTINCT component FROM i WHERE inside AND (from_id = to_id OR required AND (to_id, from_id) IN (SELECT (a, b) FROM rr)))"""

_PLAN = f"""{_DEPENDENCIES},
oe AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM i WHERE from_id <> to_id AND NOT (inside AND (component IN (FROM sh) OR NOT required))),
ue AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM i WHERE from_id <> to_id AND NOT inside),
ol AS (SELECT id, 0 AS level FROM n UNION SELECT oe.from_id, ol.level + 1 FROM ol JOIN oe ON oe.to_id = ol.id),
ul AS (SELECT id, 0 AS level FROM n UNION SELECT ue.from_id, ul.level + 1 FROM ul JOIN ue ON ue.to_id = ul.id),
o AS MATERIALIZED (SELECT id, max(level) AS level FROM ol GROUP BY 1), u AS (SELECT id, max(level) AS level FROM ul GROUP BY 1),
late AS MATERIALIZED (SELECT DISTINCT from_id, to_id, path FROM e JOIN o a ON a.id = from_id JOIN o b ON b.id = to_id WHERE (b.level, b.id) > (a.level, a.id)),
ps AS (SELECT id FROM c WHERE component IN (FROM y) AND component NOT IN (FROM sh)), pub AS (FROM ps UNION SELECT b FROM r WHERE a IN (FROM ps)),
plan AS (SELECT c.id, component, component IN (FROM sh) AS shell, o.level AS create_level, u.level AS update_level, component IN (FROM sh) OR c.id IN (SELECT from_id FROM late) AS temporary_seed, c.id IN (FROM pub) AS publication_seed
  FROM c JOIN o ON o.id = c.id JOIN u ON u.id = c.id)"""


def _edges(spark, sf):
    """Ids and edges of the graph."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k, base = F.col("k") % 60, F.floor(F.col("k") / 60) * 60
    edge = lambda df, to, path, required: df.select(F.col("k").alias("from_id"), (base + to).cast("long").alias("to_id"), F.lit(path).alias("path"), required.alias("required"))
    out = edge(c, (k * k + 7) % 60, "a", F.col("k") % 7 != 0).unionByName(edge(c.where("k % 4 = 0"), (k * 5 + 1) % 60, "b", F.lit(False)))
    out = out.unionByName(edge(c.where("k % 5 = 0"), F.floor(k / 2), "parent", F.lit(True)))
    ids = c.select(F.col("k").alias("id"))
    return ids, out.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "path", "required").distinct()


@query("f4_dependency_plan", f"WITH RECURSIVE {_PLAN} SELECT * FROM plan", records=False)
def f4_dependency_plan(spark, sf):
    return E.dependency_plan(*_edges(spark, sf))


@query("f4_parent_cycles", f"WITH RECURSIVE {_DEPENDENCIES} SELECT from_id AS src, to_id AS dst FROM e WHERE path = 'parent' AND from_id = to_id", records=False)
def f4_parent_cycles(spark, sf):
    return E.parent_cycles(_edges(spark, sf)[1])


@query("f5_cycle_candidates", f"WITH RECURSIVE {_DEPENDENCIES} SELECT from_id AS id, component, count(*) AS removed, bool_or(path = 'parent') AS topology FROM i WHERE inside GROUP BY 1, 2", records=False)
def f5_cycle_candidates(spark, sf):
    return E.cycle_candidates(*_edges(spark, sf))


@query("f6_seed_references", f"WITH RECURSIVE {_PLAN} SELECT * FROM late WHERE from_id IN (SELECT id FROM plan WHERE temporary_seed)", records=False)
def f6_seed_references(spark, sf):
    ids, edges = _edges(spark, sf)
    return E.seed_references(E.dependency_plan(ids, edges), edges)


_DELETES = f"""{_DEPENDENCIES},
j AS MATERIALIZED (SELECT * EXCLUDE inside, inside AND component IN (FROM big) AS inside FROM i WHERE from_id <> to_id),
st AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM j WHERE NOT (inside AND NOT required AND path <> 'parent')),
sr AS (SELECT from_id AS a, to_id AS b FROM st UNION SELECT sr.a, st.to_id FROM sr JOIN st ON sr.b = st.from_id),
cy AS MATERIALIZED (SELECT a AS id FROM sr WHERE a = b), stuck AS MATERIALIZED (FROM cy UNION SELECT b FROM sr WHERE a IN (FROM cy)),
dl AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (FROM stuck) UNION SELECT st.to_id, dl.level + 1 FROM dl JOIN st ON st.from_id = dl.id WHERE st.to_id NOT IN (FROM stuck))"""


@query("f7_delete_plan", f"WITH RECURSIVE {_DELETES} SELECT id, max(level) AS level FROM dl GROUP BY 1 UNION ALL SELECT id, NULL FROM stuck", records=False)
def f7_delete_plan(spark, sf):
    """Levels of deletes; rows without one are in or behind a cycle of required references."""
    levels, _, stuck = E.delete_plan(*_edges(spark, sf))
    return levels.unionByName(stuck.select("id", F.lit(None).cast("int").alias("level")))


@query("f7_unlink_steps", f"WITH RECURSIVE {_DELETES} SELECT DISTINCT from_id, to_id, path FROM j WHERE inside AND NOT required AND path <> 'parent'", records=False)
def f7_unlink_steps(spark, sf):
    return E.delete_plan(*_edges(spark, sf))[1]


_CYCLES = f"""{_DELETES}, jr AS (SELECT from_id AS a, to_id AS b FROM j WHERE inside AND required UNION SELECT jr.a, j.to_id FROM jr JOIN j ON jr.b = j.from_id WHERE inside AND required),
hard AS MATERIALIZED (SELECT DISTINCT component FROM j WHERE inside AND required AND (to_id, from_id) IN (SELECT (a, b) FROM jr)),
dc AS (SELECT component, CASE WHEN component IN (FROM hard) THEN 'required' ELSE 'optional' END AS kind, count(*) AS members FROM c WHERE component IN (FROM big) GROUP BY 1)"""


@query("f8_delete_cycles", f"WITH RECURSIVE {_CYCLES} SELECT * FROM dc", records=False)
def f8_delete_cycles(spark, sf):
    return E.delete_cycles(*_edges(spark, sf))


@query("f9_unsupported_cycles", f"WITH RECURSIVE {_CYCLES} SELECT component, members FROM dc WHERE kind = 'required' AND component IN (SELECT component FROM c WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))", records=False)
def f9_unsupported_cycles(spark, sf):
    """Customers with a finished order are those whose published version holds blocks."""
    ids, edges = _edges(spark, sf)
    blocks = read_table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("record_id"))
    members = E.cyclic_components(ids, edges.where("from_id <> to_id")).select("id", "component")
    return E.unsupported_cycles(E.delete_cycles(ids, edges), members, blocks)


_SLICES = """sl AS MATERIALIZED (SELECT record_id AS from_id, json_extract_string(current, '$.customer') AS to_id, 'current' AS slice, position FROM {t} WHERE item_type_id = 'order'
  UNION ALL SELECT record_id, json_extract_string(published, '$.customer'), 'published', position FROM {t} WHERE item_type_id = 'order' AND published IS NOT NULL)"""


def _sliced(records):
    orders = X.slices(records.where("item_type_id = 'order'"))
    return orders.select(F.col("record_id").alias("from_id"), F.get_json_object("fields", "$.customer").alias("to_id"), "slice")


@query("f10_delete_releases", f"""WITH {_SLICES.format(t='dst')}, h AS (SELECT * FROM sl WHERE to_id IN (SELECT record_id FROM dst WHERE record_id NOT IN (SELECT record_id FROM src))),
b AS (SELECT from_id, max(slice) AS base FROM h GROUP BY 1)
SELECT from_id AS record_id, base, count(*) FILTER (WHERE position % 4 <> 0) AS removed, count(*) FILTER (WHERE position % 4 = 0) AS leftover FROM h JOIN b USING (from_id) WHERE slice = base GROUP BY 1, 2""")
def f10_delete_releases(spark, sf):
    """Orders that refer to customers that are to be deleted; every fourth order's reference is required."""
    s, d = both(spark, sf)
    edges = _sliced(d).withColumn("required", F.substring("from_id", 2, 20).cast("long") % 4 == 0)
    return E.delete_releases(edges, D.retained_records(s, d).select(F.col("record_id").alias("id")))


@query("f11_rekey_blocks", """WITH s AS (SELECT 'b' || p_partkey AS id, p_size > 40 AS taken, upper(substr(sha256('planweave-id:site:block:b' || p_partkey || CASE WHEN p_size > 40 THEN ':1' ELSE '' END), 1, 32)) AS x FROM part),
u AS (SELECT id, substr(x, 1, 12) || '4' || substr(x, 14, 3) || substr('89AB', CAST(CAST('0x' || substr(x, 17, 1) AS INT) % 4 + 1 AS INT), 1) || substr(x, 18, 15) AS y FROM s)
SELECT id AS block_id, translate(rtrim(to_base64(unhex(y)), '='), '+/', '-_') AS new_id FROM u""", records=False)
def f11_rekey_blocks(spark, sf):
    """The first choice of ids of large parts' blocks is reserved already, so they take the second."""
    p = read_table(spark, sf, "part").select(F.concat(F.lit("b"), "p_partkey").alias("block_id"), "p_size")
    reserved = p.where("p_size > 40").select(deterministic_id(F.concat(F.lit("planweave-id:site:block:"), "block_id")).alias("id"))
    return E.rekey_blocks(p.select("block_id"), reserved, "site")


_PUBLISH = """w AS MATERIALIZED (SELECT c_custkey AS id, c_custkey % 3 = 0 AS publishes, c_custkey % 6 = 4 AS unpublishes, c_custkey % 6 = 5 AS deletes, c_custkey % 11 = 0 AS seed, c_custkey % 2 = 0 AS was_published FROM customer WHERE c_custkey % 13 <> 0),
pe AS MATERIALIZED (SELECT c_custkey AS from_id, c_custkey - 7 AS to_id FROM customer WHERE c_custkey % 60 >= 7 UNION SELECT c_custkey, c_custkey - c_custkey % 60 + c_custkey % 60 // 2 FROM customer WHERE c_custkey % 60 > 0),
q AS MATERIALIZED (SELECT from_id, to_id, f.publishes AS f_publishes, t.publishes AS t_publishes, t.seed AS t_seed, t.was_published AS t_was, t.unpublishes AS t_un, t.deletes AS t_del FROM pe JOIN w f ON f.id = from_id JOIN w t ON t.id = to_id),
rc AS (SELECT c_custkey AS from_id, c_custkey - 5 AS to_id, (c_custkey, c_custkey - 5) IN (SELECT (from_id, to_id) FROM pe) AS still, 'referrer' AS what FROM customer WHERE c_custkey % 60 >= 5
  UNION ALL SELECT c_custkey, c_custkey - 2, true, 'child' FROM customer WHERE c_custkey % 60 >= 2 AND c_custkey % 2 = 0 AND c_custkey % 4 <> 0),
up AS MATERIALIZED (SELECT rc.from_id, rc.to_id, CASE WHEN f.id IS NULL THEN what || ' is not managed' WHEN f.deletes THEN what || ' is deleted later' WHEN still AND (f.publishes OR f.was_published AND NOT f.unpublishes) THEN what || ' stays published' END AS rule
  FROM rc JOIN w t ON t.id = rc.to_id AND t.unpublishes LEFT JOIN w f ON f.id = rc.from_id),
mv AS MATERIALIZED (SELECT id FROM w WHERE publishes OR unpublishes),
un AS (SELECT c_custkey AS from_id, c_custkey + CASE WHEN c_custkey % 60 = 12 THEN 3 ELSE -3 END AS to_id FROM customer WHERE c_custkey % 60 IN (12, 15)),
d AS MATERIALIZED (SELECT from_id, to_id FROM q WHERE f_publishes AND t_publishes AND NOT t_seed AND NOT t_was AND from_id <> to_id
  UNION SELECT to_id, from_id FROM up WHERE rule IS NULL AND from_id IN (FROM mv) UNION SELECT from_id, to_id FROM un WHERE from_id IN (FROM mv) AND to_id IN (FROM mv)),
dr AS (SELECT from_id AS a, to_id AS b FROM d UNION SELECT dr.a, d.to_id FROM dr JOIN d ON dr.b = d.from_id),
cy AS MATERIALIZED (SELECT a AS id FROM dr WHERE a = b), stuck AS MATERIALIZED (FROM cy UNION SELECT a FROM dr WHERE b IN (FROM cy)),
l AS (SELECT id, 0 AS level FROM mv WHERE id NOT IN (FROM stuck) UNION SELECT d.from_id, l.level + 1 FROM l JOIN d ON d.to_id = l.id WHERE d.from_id NOT IN (FROM stuck))"""


def _publishing(spark, sf):
    """Every 13th customer is not managed; published referrers are 5 keys on, children 2 keys on, and two rows of each block wait for each other's unique value."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id")
    rows = c.where("id % 13 <> 0").select("id", (k % 3 == 0).alias("publishes"), (k % 6 == 4).alias("unpublishes"), (k % 6 == 5).alias("deletes"), (k % 11 == 0).alias("seed"), (k % 2 == 0).alias("was_published"))
    down = c.where("id % 60 >= 7").select(k.alias("from_id"), (k - 7).alias("to_id")).unionByName(c.where("id % 60 > 0").select(k.alias("from_id"), (k - k % 60 + F.floor(k % 60 / 2)).alias("to_id")))
    children = c.where("id % 60 >= 2 AND id % 2 = 0").select("id", (k - 2).alias("parent_id"), F.when(k % 4 == 0, k - 3).otherwise(k - 2).alias("desired_parent_id"))
    unique = c.where("id % 60 IN (12, 15)").select(k.alias("from_id"), F.when(k % 60 == 12, k + 3).otherwise(k - 3).alias("to_id"))
    return E.publish_order(rows, down, c.where("id % 60 >= 5").select(k.alias("from_id"), (k - 5).alias("to_id")), children, unique)


@query("f12_publish_order", f"WITH RECURSIVE {_PUBLISH} SELECT id, max(level) AS level FROM l GROUP BY 1", records=False)
def f12_publish_order(spark, sf):
    return _publishing(spark, sf)[0]


@query("f12_publish_violations", f"""WITH RECURSIVE {_PUBLISH} SELECT 'dependency is deleted' AS rule, from_id, to_id FROM q WHERE f_publishes AND t_del
UNION ALL SELECT 'dependency is not published', from_id, to_id FROM q WHERE f_publishes AND NOT t_del AND NOT t_publishes AND (t_un OR NOT t_was)
UNION ALL SELECT rule, from_id, to_id FROM up WHERE rule IS NOT NULL UNION ALL SELECT 'cycle', id, NULL FROM stuck""", records=False)
def f12_publish_violations(spark, sf):
    return _publishing(spark, sf)[1]


def _transfer_sql(a: int, b: int) -> str:
    return f"""cd AS MATERIALIZED (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE p_partkey // 60 * 60 + (p_partkey % 60 * {a} + {b}) % 60 END AS v FROM part),
t AS MATERIALIZED (SELECT d.k AS consumer, p_partkey AS owner, p_partkey NOT IN (SELECT k FROM cd x WHERE x.v = x.k) AS frees FROM cd d JOIN part ON d.v = p_partkey WHERE d.k <> p_partkey),
f AS MATERIALIZED (SELECT * FROM t WHERE frees),
r AS (SELECT consumer AS a, owner AS b FROM f UNION SELECT r.a, f.owner FROM r JOIN f ON r.b = f.consumer),
ring AS MATERIALIZED (SELECT consumer, owner FROM f WHERE (owner, consumer) IN (SELECT (a, b) FROM r))"""


def _transfers(spark, sf, a: int, b: int):
    """Every part holds its own key as value and wants another one of its block of 60, but every fifth stays."""
    p, k = read_table(spark, sf, "part").select(F.col("p_partkey").alias("k")), F.col("k")
    claim = lambda value: p.select(F.lit("part").alias("item_type_id"), F.lit("slug").alias("field"), value.cast("string").alias("value"), k.alias("record_id"))
    return E.claim_transfers(claim(F.when(k % 5 == 0, k).otherwise((F.floor(k / 60) * 60 + (k % 60 * a + b) % 60).cast("long"))), claim(k))


@query("f13_unique_releases", f"WITH RECURSIVE {_transfer_sql(7, 3)} SELECT owner, 'slug' AS fields, count(DISTINCT consumer) AS consumers FROM f GROUP BY 1", records=False)
def f13_unique_releases(spark, sf):
    return E.unique_releases(_transfers(spark, sf, 7, 3))


@query("f14_published_unique_edges", f"WITH RECURSIVE {_transfer_sql(11, 1)} SELECT consumer AS from_id, owner AS to_id, 'unique:slug' AS path, true AS required FROM f", records=False)
def f14_published_unique_edges(spark, sf):
    return E.unique_edges(_transfers(spark, sf, 11, 1))


@query("f15_unique_transitions", f"""WITH RECURSIVE {_transfer_sql(2, 3)} SELECT consumer, owner, 'order' AS reason FROM f WHERE (consumer, owner) NOT IN (SELECT (consumer, owner) FROM ring)
UNION ALL SELECT consumer, owner, 'owner keeps the value' FROM t WHERE NOT frees UNION ALL SELECT consumer, owner, 'ring' FROM ring""", records=False)
def f15_unique_transitions(spark, sf):
    order, conflicts = E.unique_transitions(_transfers(spark, sf, 2, 3))
    return order.select(F.col("from_id").alias("consumer"), F.col("to_id").alias("owner"), F.lit("order").alias("reason")).unionByName(conflicts)


@query("f16_unique_value_cycles", f"""WITH RECURSIVE {_transfer_sql(7, 3)}, m AS (SELECT x.a AS id, min(CAST(x.b AS VARCHAR)) AS c FROM r x JOIN r y ON x.b = y.a AND y.b = x.a GROUP BY 1)
SELECT 'part' AS item_type_id, 'slug' AS field, c AS component, count(*) AS members FROM m GROUP BY c HAVING count(*) > 1""", records=False)
def f16_unique_value_cycles(spark, sf):
    return E.unique_value_cycles(_transfers(spark, sf, 7, 3))


_WRITES = """wr AS MATERIALIZED (SELECT s.record_id, s.item_type_id, CASE WHEN d.record_id IS NULL THEN s.published IS NULL OR s.published <> s.current ELSE s.hash IS DISTINCT FROM d.hash AND (s.current IS DISTINCT FROM d.current OR s.parent_id IS DISTINCT FROM d.parent_id OR (s.published IS NULL) <> (d.published IS NULL)) OR s.position <> d.position END AS writes_current,
  s.published IS NOT NULL AND (d.record_id IS NULL OR s.published IS DISTINCT FROM d.published) AS writes_published, d.record_id IS NULL OR s.parent_id IS DISTINCT FROM d.parent_id AS moves FROM src s LEFT JOIN dst d USING (record_id)),
ed AS (SELECT from_id, to_id, slice FROM sl UNION ALL SELECT record_id, parent_id, 'parent' FROM src WHERE parent_id IS NOT NULL),
be AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM ed JOIN wr f ON f.record_id = from_id LEFT JOIN wr t ON t.record_id = to_id LEFT JOIN dst x ON x.record_id = to_id
  WHERE CASE slice WHEN 'current' THEN f.writes_current WHEN 'published' THEN f.writes_published ELSE f.moves END
  AND NOT coalesce(x.item_type_id = coalesce(t.item_type_id, x.item_type_id) AND (slice <> 'published' OR x.published IS NOT NULL), false)),
bl AS (SELECT record_id AS id FROM wr WHERE writes_current AND item_type_id = 'customer')"""


def _writes(s, d):
    parents = s.select("record_id", "item_type_id", F.col("parent_id").alias("_p")).join(d.select("record_id", F.struct("parent_id").alias("_d")), "record_id", "left")
    moves = F.col("_d").isNull() | ~F.col("_p").eqNullSafe(F.col("_d.parent_id"))
    return write_requirements(write_changes(s, d)).join(parents.select("record_id", "item_type_id", moves.alias("moves")), "record_id")


def _waiting(s):
    parents = X.parent_edges(s).select("from_id", "to_id", F.lit("parent").alias("slice"))
    return _sliced(s).unionByName(parents)


@query("f17_blocking_edges", f"WITH {_SLICES.format(t='src')}, {_WRITES} SELECT from_id, to_id FROM be")
def f17_blocking_edges(spark, sf):
    s, d = both(spark, sf)
    return E.blocking_edges(_waiting(s), _writes(s, d), d).select("from_id", "to_id").distinct()


@query("f17_skip_unsatisfied", f"""WITH {_SLICES.format(t='src')}, {_WRITES}, l1 AS (SELECT from_id AS id, min(to_id) AS blocker FROM be WHERE to_id IN (FROM bl) AND from_id NOT IN (FROM bl) GROUP BY 1),
l2 AS (SELECT from_id AS id, min(to_id) AS blocker FROM be WHERE to_id IN (SELECT id FROM l1) AND from_id NOT IN (FROM bl) AND from_id NOT IN (SELECT id FROM l1) GROUP BY 1)
SELECT id, id AS blocker, 0 AS distance FROM bl UNION ALL SELECT id, blocker, 1 FROM l1 UNION ALL SELECT id, blocker, 2 FROM l2""")
def f17_skip_unsatisfied(spark, sf):
    """All customers that would be written are skipped; orders go with those that the destination lacks."""
    s, d = both(spark, sf)
    writes = _writes(s, d)
    return E.skip_closure(writes.where("writes_current AND item_type_id = 'customer'").select(F.col("record_id").alias("id")), _waiting(s), writes, d)


_ANCHOR = """sk AS (SELECT record_id FROM src WHERE item_type_id = 'customer' AND json_extract_string(current, '$.segment') = 'MACHINERY'),
an AS MATERIALIZED (SELECT item_type_id, parent_id, min(record_id) AS anchor FROM dst WHERE record_id IN (FROM sk) GROUP BY 1, 2)"""


@query("f18_ordering_anchors", f"""WITH {_ANCHOR} SELECT s.record_id, min(anchor) AS anchor, 'held' AS state FROM src s LEFT JOIN dst d USING (record_id) JOIN an ON an.item_type_id = s.item_type_id AND (an.parent_id IS NOT DISTINCT FROM s.parent_id OR d.record_id IS NOT NULL AND an.parent_id IS NOT DISTINCT FROM d.parent_id)
WHERE s.record_id NOT IN (FROM sk) AND (d.record_id IS NULL OR (s.item_type_id, s.parent_id, s.position) IS DISTINCT FROM (d.item_type_id, d.parent_id, d.position)) GROUP BY 1
UNION ALL SELECT d.record_id, anchor, 'protected' FROM dst d JOIN an ON an.item_type_id = d.item_type_id AND an.parent_id IS NOT DISTINCT FROM d.parent_id WHERE d.record_id NOT IN (SELECT record_id FROM src)""")
def f18_ordering_anchors(spark, sf):
    """Customers of one segment are skipped."""
    s, d = both(spark, sf)
    keep = ["record_id", "item_type_id", "parent_id", "position"]
    skipped = s.where("item_type_id = 'customer'").where(F.get_json_object("current", "$.segment") == "MACHINERY").select("record_id")
    held, protected = E.ordering_anchors(skipped, d.select(keep), s.select(keep))
    return held.withColumn("state", F.lit("held")).unionByName(protected.withColumn("state", F.lit("protected")))


@query("f19_protected_targets", f"""WITH {_SLICES.format(t='dst')}, sk AS (SELECT from_id AS id FROM sl JOIN dst ON record_id = from_id WHERE json_extract_string(current, '$.priority') = '1-URGENT'),
l1 AS (SELECT DISTINCT to_id AS id FROM sl WHERE from_id IN (FROM sk)), l2 AS (SELECT parent_id AS id FROM dst WHERE record_id IN (FROM l1) OR record_id IN (FROM sk)), al AS (FROM sk UNION FROM l1 UNION FROM l2)
SELECT id FROM al WHERE id IN (SELECT record_id FROM dst) AND id NOT IN (SELECT record_id FROM src)""")
def f19_protected_targets(spark, sf):
    """Urgent orders are skipped; what they reach in the destination must stay."""
    s, d = both(spark, sf)
    edges = _sliced(d).select("from_id", "to_id").unionByName(X.parent_edges(d).select("from_id", "to_id"))
    urgent = d.where("item_type_id = 'order'").where(F.get_json_object("current", "$.priority") == "1-URGENT").select(F.col("record_id").alias("id"))
    return E.protected_targets(urgent, edges, D.retained_records(s, d).select(F.col("record_id").alias("id")))


@query("f20_protected_uploads", """WITH x AS (SELECT page_id, page_id * 2 AS u FROM pages UNION ALL SELECT page_id, page_id * 3 FROM pages), h AS (SELECT page_id FROM pages WHERE url LIKE 'https:%'), k AS (SELECT DISTINCT u FROM x WHERE page_id IN (FROM h)),
g AS (SELECT u FROM k WHERE u IN (SELECT doc_id FROM documents WHERE lang <> 'en'))
SELECT u AS id, 'protected' AS state FROM k UNION ALL SELECT DISTINCT page_id, 'skipped' FROM x WHERE u IN (FROM g) AND page_id NOT IN (FROM h)""", records=False)
def f20_protected_uploads(spark, sf):
    """Pages under https are held; documents in other languages than English would change."""
    p = read_table(spark, sf, "pages")
    refs = p.select(F.col("page_id").alias("record_id"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 3)).alias("upload_id"))
    held = p.where("url LIKE 'https:%'").select(F.col("page_id").alias("record_id"))
    stays, users = E.protected_uploads(refs, held, read_table(spark, sf, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("upload_id")))
    return stays.select(F.col("upload_id").alias("id"), F.lit("protected").alias("state")).unionByName(users.select(F.col("record_id").alias("id"), F.lit("skipped").alias("state")))
