"""Registered queries of the integrity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.operators import diff as D
from planweave.operators import explode as X
from planweave.operators import graph as G
from planweave.operators import integrity as I
from planweave.operators import ledger as L
from planweave.operators import order as O
from planweave.operators import validity as V
from planweave.plans.queries import _CLAIMS, _EDGES_SQL, _ISSUES, PLAN_SQL, _claims, _edges, _issues, query
from planweave.sources.records import both, read_table


@query("d9_out_of_scope_collisions", "SELECT record_id FROM src WHERE item_type_id <> 'part' AND record_id NOT IN (SELECT record_id FROM dst WHERE item_type_id = 'order') AND record_id IN (SELECT record_id FROM dst)")
def d9_out_of_scope_collisions(spark, sf):
    s, d = both(spark, sf)
    return I.out_of_scope_collisions(s.where("item_type_id <> 'part'"), d.where("item_type_id = 'order'"), d)


@query("d10_record_block_collisions", "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem)", records=False)
def d10_record_block_collisions(spark, sf):
    records = read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"))
    return I.shared_ids(records, read_table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("block_id")))


@query("d12_ownership_moves", """WITH s AS (SELECT l_partkey AS block_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS a FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1),
d AS (SELECT l_partkey AS block_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS b FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
SELECT block_id, a AS s_locations, b AS d_locations FROM s JOIN d USING (block_id) WHERE a <> b""", records=False)
def d12_ownership_moves(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("block_id"), F.col("l_returnflag").alias("location"), "l_orderkey")
    return I.ownership_moves(*(li.where(F.col("l_orderkey") % 2 == k) for k in (0, 1))).withColumns({c: F.array_join(c, ",") for c in ("s_locations", "d_locations")})


@query("d16_singleton_mismatches", """WITH s AS (SELECT p_brand AS t, list(p_partkey ORDER BY p_partkey) AS a, count(*) AS n FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1),
d AS (SELECT p_brand AS t, list(p_partkey ORDER BY p_partkey) AS b, count(*) AS m FROM part WHERE p_partkey % 10 <> 1 GROUP BY 1)
SELECT coalesce(s.t, d.t) AS item_type_id, coalesce(n, 0) AS s_n, coalesce(m, 0) AS d_n FROM s FULL JOIN d ON s.t = d.t WHERE NOT (a IS NOT DISTINCT FROM b OR (coalesce(n, 0) = 1 AND m IS NULL))""", records=False)
def d16_singleton_mismatches(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("item_type_id"), F.col("p_partkey").alias("record_id"))
    return I.singleton_mismatches(*(p.where(F.col("record_id") % 10 != drop) for drop in (0, 1)))


@query("d17_schema_compat", """WITH s AS (SELECT n_name AS name, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0),
d AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'none' ELSE r_name END AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 1)
SELECT coalesce(s.name, d.name) AS name, s.value AS s_value, d.value AS d_value FROM s FULL JOIN d ON s.name = d.name WHERE s.value IS DISTINCT FROM d.value""", records=False)
def d17_schema_compat(spark, sf):
    n = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), F.col("r_name").alias("value"))
    d = n.where("n_nationkey % 5 <> 1").select(F.col("n_name").alias("name"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'none' ELSE r_name END").alias("value"))
    return I.settings_differences(s, d)


_TREE = "SELECT CAST(c_custkey AS VARCHAR) AS record_id, CAST(c_custkey // 10 AS VARCHAR) AS parent_id, c_custkey AS k FROM customer"


@query("d24_unsafe_tree_children", f"""WITH t AS ({_TREE}), d AS (FROM t WHERE k % 10 <> 1), s AS (SELECT record_id, CASE WHEN k % 7 = 3 THEN 'elsewhere' ELSE parent_id END AS parent_id FROM t WHERE k % 9 <> 4),
gone AS (SELECT record_id FROM d WHERE record_id NOT IN (SELECT record_id FROM s))
SELECT d.record_id, d.parent_id FROM d LEFT JOIN s USING (record_id) WHERE d.parent_id IN (FROM gone) AND d.record_id NOT IN (FROM gone) AND (s.parent_id IS NULL OR s.parent_id = d.parent_id)""", records=False)
def d24_unsafe_tree_children(spark, sf):
    t = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), F.floor(F.col("c_custkey") / 10).cast("string").alias("parent_id"), F.col("c_custkey").alias("k"))
    d = t.where("k % 10 <> 1")
    s = t.where("k % 9 <> 4").withColumn("parent_id", F.expr("CASE WHEN k % 7 = 3 THEN 'elsewhere' ELSE parent_id END"))
    plan = d.join(s, "record_id", "left_anti").select("record_id", F.lit("delete").alias("action"))
    return I.unsafe_tree_children(plan, d, s)


@query("d25_unsafe_upload_deletes", "SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 0 AND doc_id IN (SELECT page_id * 4 FROM pages)", records=False)
def d25_unsafe_upload_deletes(spark, sf):
    gone = read_table(spark, sf, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"))
    return I.unsafe_deletes(gone, read_table(spark, sf, "pages").select(F.col("page_id").alias("from_id"), (F.col("page_id") * 4).alias("to_id")))


@query("d26_publication_boundary", """SELECT record_id AS from_id, json_extract_string(published, '$.customer') AS to_id FROM src WHERE item_type_id = 'order' AND published IS NOT NULL
AND json_extract_string(published, '$.customer') NOT IN (SELECT record_id FROM src WHERE position % 2 = 0) AND json_extract_string(published, '$.customer') NOT IN (SELECT record_id FROM dst WHERE published IS NOT NULL)""")
def d26_publication_boundary(spark, sf):
    s, d = both(spark, sf)
    edges = s.where("item_type_id = 'order' AND published IS NOT NULL").select(F.col("record_id").alias("from_id"), F.get_json_object("published", "$.customer").alias("to_id"))
    return I.publication_boundary(edges, s.where("position % 2 = 0"), d)


@query("d36_label_occupancy", """WITH e AS (SELECT event_type || user_id AS label, event_id AS seq, value > 5 AS claims FROM events),
h AS (SELECT label, seq, claims, coalesce(sum(CASE WHEN claims THEN 1 ELSE -1 END) OVER (PARTITION BY label ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS holders FROM e)
SELECT label, seq FROM h WHERE claims AND holders > 0""", records=False)
def d36_label_occupancy(spark, sf):
    e = read_table(spark, sf, "events")
    return I.label_occupancy(e.select(F.concat("event_type", "user_id").alias("label"), F.col("event_id").alias("seq"), (F.col("value") > 5).alias("claims")))


@query("d37_reserved_ids_free", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS record_id FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)", records=False)
def d37_reserved_ids_free(spark, sf):
    reserved = read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("record_id")).distinct()
    return reserved.join(read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("record_id")), "record_id", "left_semi")


@query("c3_published_references", """SELECT record_id AS from_id, json_extract_string(published, '$.customer') AS to_id FROM src WHERE item_type_id = 'order' AND published IS NOT NULL""")
def c3_published_references(spark, sf):
    long = X.slices(both(spark, sf)[0].where("item_type_id = 'order'")).where("slice = 'published'").select("record_id", F.col("fields").alias("value"))
    links = spark.createDataFrame([("customer", True)], "field string, required boolean")
    return X.references(X.explode_document(long), links).select("from_id", "to_id")


@query("c6_nested_block_ids", "SELECT l_orderkey AS record_id, string_agg(DISTINCT l_linenumber, ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS blocks FROM (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem) GROUP BY 1", records=False)
def c6_nested_block_ids(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.array_join(F.sort_array(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("blocks"))


@query("c7_structural_issues", "SELECT l_orderkey, l_linestatus AS field_id, l_returnflag AS model_id FROM lineitem WHERE NOT ((l_linestatus = 'F' AND l_returnflag IN ('A', 'R')) OR (l_linestatus = 'O' AND l_returnflag = 'N'))", records=False)
def c7_structural_issues(spark, sf):
    allowed = spark.createDataFrame([("F", "A"), ("F", "R"), ("O", "N")], "field_id string, model_id string")
    return I.structural_issues(read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("field_id"), F.col("l_returnflag").alias("model_id")), allowed).select("l_orderkey", "field_id", "model_id")


@query("c9_strip_references", "SELECT l_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_partkey % 5 <> 0), '') AS parts FROM lineitem GROUP BY 1", records=False)
def c9_strip_references(spark, sf):
    """Links of orders to parts, without links to parts that are to go, in order."""
    li = read_table(spark, sf, "lineitem")
    links = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("links"))
    gone = F.filter("links", lambda x: x % 5 == 0)
    return links.select("l_orderkey", F.array_join(X.strip_values(F.col("links"), gone).cast("array<string>"), ",").alias("parts"))


@query("e4_ambiguous_owners", f"WITH {_CLAIMS} SELECT item_type_id, value, d_owners FROM o WHERE s_owners <> d_owners AND n <> 1")
def e4_ambiguous_owners(spark, sf):
    s, d = both(spark, sf)
    return D.claimant_changes(_claims(s), _claims(d)).where("ambiguous").select("item_type_id", "value", F.array_join("d_owners", ",").alias("d_owners"))


@query("e7_distinct_reasons", f"WITH {_ISSUES} SELECT record_id, string_agg(DISTINCT code || '/current', ',' ORDER BY code || '/current') AS reasons FROM i GROUP BY record_id")
def e7_distinct_reasons(spark, sf):
    return I.distinct_reasons(_issues(spark, both(spark, sf)[0]).withColumn("slice", F.lit("current")))


@query("e8_default_suppressions", "SELECT 'customer' AS item_type_id, 'segment' AS field, count(*) AS n_records FROM customer WHERE c_custkey % 5 = 0 HAVING count(*) > 0", records=False)
def e8_default_suppressions(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.lit("customer").alias("item_type_id"), F.lit("segment").alias("field"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END").alias("value"))
    return I.default_suppressions(c, spark.createDataFrame([("customer", "segment", "NONE")], "item_type_id string, field string, default_value string"))


@query("e9_merge_dependencies", f"WITH {_EDGES_SQL} SELECT from_id, string_agg(DISTINCT to_id, ',' ORDER BY to_id) AS to_ids FROM e GROUP BY from_id")
def e9_merge_dependencies(spark, sf):
    return _edges(spark, both(spark, sf)[0]).groupBy("from_id").agg(F.array_join(F.sort_array(F.collect_set("to_id")), ",").alias("to_ids"))


_SKIPS = """b AS (SELECT record_id AS id FROM src WHERE item_type_id = 'nation' AND position % 9 = 4),
l1 AS (SELECT from_id AS id, min(to_id) AS blocker, 1 AS distance FROM e JOIN b ON to_id = b.id WHERE from_id NOT IN (FROM b) GROUP BY 1),
l2 AS (SELECT from_id AS id, min(to_id) AS blocker, 2 AS distance FROM e JOIN l1 ON to_id = l1.id WHERE from_id NOT IN (FROM b) AND from_id NOT IN (SELECT id FROM l1) GROUP BY 1),
k AS (SELECT id, id AS blocker, 0 AS distance FROM b UNION ALL FROM l1 UNION ALL FROM l2)"""


def _skips(spark, s):
    edges = _edges(spark, s).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.connected_by(edges, s.select(F.col("record_id").alias("id")), s.where("item_type_id = 'nation' AND position % 9 = 4").select(F.col("record_id").alias("id")))


@query("g8_skipped_rows", f"WITH {_EDGES_SQL}, {_SKIPS} SELECT k.id, blocker, distance, hash AS preserved_hash, CASE WHEN hash IS NULL THEN 'absent' ELSE 'preserve target' END AS disposition FROM k LEFT JOIN dst ON record_id = k.id")
def g8_skipped_rows(spark, sf):
    s, d = both(spark, sf)
    return I.skipped_rows(_skips(spark, s), d).select("id", "blocker", "distance", "preserved_hash", "disposition")


@query("g9_filter_skipped", f"WITH {_EDGES_SQL}, {_SKIPS}, {PLAN_SQL} SELECT record_id, action FROM p WHERE record_id NOT IN (SELECT id FROM k)")
def g9_filter_skipped(spark, sf):
    s, d = both(spark, sf)
    return D.plan_records(s, d).join(_skips(spark, s).select(F.col("id").alias("record_id")), "record_id", "left_anti").select("record_id", "action")


@query("g3_match_diagnostics", "SELECT record_id, 'current' AS slice, sha256(d.current) AS version_hash FROM src s JOIN dst d USING (record_id) WHERE s.current = d.current")
def g3_match_diagnostics(spark, sf):
    """Diagnostics of all destination versions that are still the same in the source."""
    s, d = both(spark, sf)
    told = lambda df: df.select("record_id", F.lit("current").alias("slice"), F.sha2("current", 256).alias("version_hash"))
    return V.match_diagnostics(told(d), told(s))


@query("i4_compact_positions", "SELECT record_id, CAST(row_number() OVER (PARTITION BY item_type_id, parent_id ORDER BY position, record_id) AS INT) AS position FROM dst WHERE record_id IN (SELECT record_id FROM src)")
def i4_compact_positions(spark, sf):
    s, d = both(spark, sf)
    return I.compact_positions(d, D.retained_records(s, d))


@query("i9_first_issue", f"WITH {_ISSUES} SELECT field, code, min(record_id) AS record_id FROM i GROUP BY 1, 2")
def i9_first_issue(spark, sf):
    return I.first_issue(_issues(spark, both(spark, sf)[0]), ["field", "code"])


@query("l4_execution_steps", f"WITH {PLAN_SQL} SELECT record_id, CASE action WHEN 'create' THEN 1 WHEN 'update' THEN 2 ELSE 3 END AS phase, CASE WHEN action = 'update' THEN 0 ELSE (CASE WHEN action = 'delete' THEN -1 ELSE 1 END) * CASE item_type_id WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 ELSE 0 END END AS level FROM p WHERE action <> 'noop'")
def l4_execution_steps(spark, sf):
    """Steps by depth in the tree of regions, nations and customers."""
    s, d = both(spark, sf)
    tree = s.unionByName(D.retained_records(s, d).join(d, ["record_id", "item_type_id"]).select(s.columns)).select(F.col("record_id").alias("id"), "parent_id")
    return I.execution_steps(D.plan_records(s, d), G.depths(tree).withColumnRenamed("depth", "level"))


@query("j1_id_sets", "SELECT item_type_id, count(*) FILTER (WHERE d IS NULL) AS n_created, count(*) FILTER (WHERE s IS NULL) AS n_deleted, count(*) FILTER (WHERE s IS NOT NULL AND d IS NOT NULL) AS n_kept FROM (SELECT coalesce(s.item_type_id, d.item_type_id) AS item_type_id, s.record_id AS s, d.record_id AS d FROM src s FULL JOIN dst d USING (record_id)) GROUP BY 1")
def j1_id_sets(spark, sf):
    s, d = (df.select("item_type_id", "record_id") for df in both(spark, sf))
    part = lambda df, n: df.groupBy("item_type_id").agg(F.count("*").alias(n))
    counts = part(s.exceptAll(d), "n_created").join(part(d.exceptAll(s), "n_deleted"), "item_type_id", "full_outer").join(part(s.intersect(d), "n_kept"), "item_type_id", "full_outer")
    return counts.na.fill(0)


@query("h5_ledger_violations", """WITH e AS (SELECT o_orderpriority AS n, o_custkey AS s, o_orderkey AS t FROM orders)
SELECT 'source claimed twice' AS rule, CAST(s AS VARCHAR) AS subject FROM e GROUP BY n, s HAVING count(*) > 1""", records=False)
def h5_ledger_violations(spark, sf):
    """Orders as ledger entries from customers to orders: customers with several orders of one priority are claimed twice."""
    o = read_table(spark, sf, "orders")
    return L.ledger_violations(o.select(F.col("o_orderpriority").alias("namespace"), F.col("o_custkey").cast("string").alias("source_id"), F.col("o_orderkey").cast("string").alias("target_id"), F.lit(0).cast("long").alias("chunk")), limit=1 << 40)


@query("h11_namespace_ids", "SELECT record_id AS id FROM src UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem")
def h11_namespace_ids(spark, sf):
    blocks = read_table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("id"))
    return both(spark, sf)[0].select(F.col("record_id").alias("id")).unionByName(blocks).distinct()


@query("i7_execution_sequence", "SELECT record_id, CASE WHEN position % 2 = 0 THEN position ELSE -1 END AS seq FROM src")
def i7_execution_sequence(spark, sf):
    s = both(spark, sf)[0]
    placed = O.execution_sequence(s, s.where("position % 2 = 0").select("record_id", F.col("position").alias("seq")))
    return placed.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))


@query("l8_pending_migrations", "SELECT DISTINCT url AS name FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)", records=False)
def l8_pending_migrations(spark, sf):
    p = read_table(spark, sf, "pages").select(F.col("url").alias("name"), "page_id")
    return I.unmet_names(p, p.where("page_id % 3 = 0"))
