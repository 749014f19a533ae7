"""Registered queries of plan checks, invalid content and the id ledger's life cycle, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.functions.canonical import semantic_hash
from planweave.operators import checks as H
from planweave.operators import diff as D
from planweave.operators import explode as X
from planweave.operators.dependencies import unique_transitions
from planweave.operators.integrity import unsafe_published_referrers
from planweave.operators.ledger import chunk_ledger, ledger_violations
from planweave.operators.validity import validate_versions
from planweave.plans.dependency_queries import _SLICES, _WRITES, _sliced, _transfer_sql, _transfers, _waiting, _writes
from planweave.plans.queries import _EDGES_SQL, PLAN_SQL, _edges, query
from planweave.sources.records import both, read_table


@query("d3_record_operation", """SELECT record_id, s.parent_id IS NOT DISTINCT FROM d.parent_id AND s.position = d.position AND s.current = d.current AND s.published IS NOT DISTINCT FROM d.published AS noop,
 (s.parent_id IS DISTINCT FROM d.parent_id OR s.position <> d.position) AND s.current = d.current AND s.published IS NOT DISTINCT FROM d.published AS topology FROM src s JOIN dst d USING (record_id)""")
def d3_record_operation(spark, sf):
    return H.record_operation(*both(spark, sf))


@query("d13_fresh_nested_updates", """WITH l AS (SELECT l_orderkey AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS b, * FROM lineitem),
g AS (SELECT k, coalesce(list(DISTINCT b) FILTER (WHERE l_quantity > 5), []) AS c, list(DISTINCT b) FILTER (WHERE l_linestatus = 'F') AS p, coalesce(list(DISTINCT b) FILTER (WHERE l_discount < 0.08), []) AS z FROM l GROUP BY 1),
j AS (SELECT k, c, p, z, o_orderstatus = 'O' AS creates, o_totalprice > 100000 AS changed FROM g JOIN orders ON k = o_orderkey),
w AS (SELECT k, CASE WHEN NOT creates AND changed THEN list_min(list_filter(p, lambda x: NOT list_contains(z, x))) END AS a,
  CASE WHEN creates THEN list_min(list_filter(c, lambda x: NOT list_contains(coalesce(p, c), x))) WHEN changed THEN list_min(list_filter(c, lambda x: NOT list_contains(coalesce(p, z), x))) ELSE list_min(list_filter(c, lambda x: NOT list_contains(z, x))) END AS b FROM j)
SELECT CAST(k AS VARCHAR) AS record_id, 'published' AS stage, a AS block_id FROM w WHERE a IS NOT NULL UNION ALL SELECT CAST(k AS VARCHAR), 'current', b FROM w WHERE b IS NOT NULL""", records=False)
def d13_fresh_nested_updates(spark, sf):
    """Line items as blocks of their orders; open orders are created, the others updated."""
    li = read_table(spark, sf, "lineitem").withColumn("b", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    some = lambda when: F.collect_set(F.when(when, F.col("b")))
    finished = some(F.col("l_linestatus") == "F")
    sets = li.groupBy("l_orderkey").agg(some(F.col("l_quantity") > 5).alias("current"), F.when(F.size(finished) > 0, finished).alias("published"), some(F.col("l_discount") < 0.08).alias("baseline"))
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", "create").otherwise("update").alias("action"), (F.col("o_totalprice") > 100000).alias("published_changed"))
    return H.fresh_nested_updates(sets.join(o, "l_orderkey").withColumn("record_id", F.col("l_orderkey").cast("string")))


@query("d15_identity_mismatches", "SELECT record_id FROM src FULL JOIN dst USING (record_id) WHERE (src.position % 19 = 4 AND src.position > 4) OR dst.position % 23 = 7")
def d15_identity_mismatches(spark, sf):
    """A plan in which some snapshots have got another row's id."""
    s, d = both(spark, sf)
    ids = lambda df, n, bad: df.select("record_id", F.when(bad, F.concat("record_id", F.lit("x"))).otherwise(F.col("record_id")).alias(n))
    k = F.col("position")
    return H.identity_mismatches(ids(s, "desired_id", (k % 19 == 4) & (k > 4)).join(ids(d, "baseline_id", k % 23 == 7), "record_id", "full_outer"))


@query("d20_known_states", """WITH j AS (SELECT record_id, s.item_type_id AS t, coalesce(d.current, s.current) AS o, s.current AS c, s.published AS p, d.published AS q, coalesce(s.published, s.current) AS e, s.parent_id AS a, CASE WHEN d.record_id IS NULL THEN s.parent_id ELSE d.parent_id END AS b FROM src s LEFT JOIN dst d USING (record_id)),
v AS (SELECT record_id, t, a AS parent, unnest([{'c': e, 'p': NULL}, {'c': e, 'p': p}, {'c': o, 'p': p}, {'c': c, 'p': p}, {'c': c, 'p': q}]) AS x FROM j UNION ALL SELECT record_id, t, b, unnest([{'c': e, 'p': NULL}, {'c': e, 'p': p}, {'c': o, 'p': p}, {'c': c, 'p': p}, {'c': c, 'p': q}]) FROM j)
SELECT DISTINCT record_id, sha256(concat_ws('|', t, coalesce(parent, ''), x.c, coalesce(x.p, ''))) AS hash FROM v""")
def d20_known_states(spark, sf):
    return H.known_states(*both(spark, sf))


@query("d21_already_converged", f"WITH {PLAN_SQL} SELECT 'applied' AS state, true AS converged UNION ALL SELECT 'pending', (SELECT count(*) FROM p WHERE action <> 'noop' AND desired_hash IS DISTINCT FROM baseline_hash) = 0")
def d21_already_converged(spark, sf):
    s, d = both(spark, sf)
    plan = D.plan_records(s, d)
    state = lambda live, n: H.already_converged(plan, live).withColumn("state", F.lit(n))
    return state(D.apply_plan(d, s, plan), "applied").unionByName(state(d, "pending"))


@query("d28_live_block_ownership", """WITH pl AS (SELECT l_partkey AS b, CAST(l_orderkey AS VARCHAR) AS loc FROM lineitem WHERE l_returnflag = 'A'), ba AS (SELECT l_partkey AS b FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05), li AS (SELECT l_partkey AS b, CAST(l_orderkey AS VARCHAR) AS loc FROM lineitem WHERE l_returnflag IN ('N', 'A') AND l_tax < 0.02),
fr AS (SELECT * FROM pl WHERE b NOT IN (FROM ba))
SELECT DISTINCT b AS block_id, 'is a record' AS problem FROM pl WHERE b IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT DISTINCT b, 'is live elsewhere' FROM li WHERE b IN (SELECT b FROM fr) AND (b, loc) NOT IN (SELECT (b, loc) FROM fr)""", records=False)
def d28_live_block_ownership(spark, sf):
    """Parts as blocks of the orders they are in: returned lines are planned, others are the baseline and the live state; suppliers are records."""
    li = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("block_id"), F.col("l_orderkey").cast("string").alias("location"), "l_returnflag", "l_discount", "l_tax")
    records = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("record_id"))
    return H.live_block_ownership(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R' AND l_discount > 0.05"), li.where("l_returnflag IN ('N', 'A') AND l_tax < 0.02"), records)


@query("d29_draft_create_violations", """WITH w AS (SELECT c_custkey AS id, CAST(c_custkey % 4 AS INT) AS level, c_custkey % 3 = 0 AS always, c_acctbal > 5000 AS pub FROM customer),
e AS (SELECT c_custkey AS f, c_custkey - 7 AS t FROM customer WHERE c_custkey >= 7 UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 0)
SELECT f AS from_id, t AS to_id FROM e JOIN w a ON a.id = f JOIN w b ON b.id = t WHERE a.always AND NOT b.pub AND NOT (b.always AND (b.level, b.id) < (a.level, a.id))""", records=False)
def d29_draft_create_violations(spark, sf):
    c, k = read_table(spark, sf, "customer"), F.col("c_custkey")
    creates = c.select(k.alias("id"), (k % 4).cast("int").alias("level"), (k % 3 == 0).alias("always"))
    edges = c.where(k >= 7).select(k.alias("from_id"), (k - 7).alias("to_id")).unionByName(c.where(k > 0).select(k.alias("from_id"), F.floor(k / 2).alias("to_id")))
    return H.draft_create_violations(creates, edges, c.where("c_acctbal > 5000").select(k.alias("id")))


@query("d34_skipped_rows_changed", """WITH k AS (SELECT record_id, hash, position FROM dst WHERE item_type_id = 'customer' UNION ALL SELECT record_id, NULL, NULL FROM src WHERE item_type_id = 'part' AND record_id NOT IN (SELECT record_id FROM dst)),
v AS (SELECT record_id, hash, position + CASE WHEN position % 12 = 5 THEN 1 ELSE 0 END AS position FROM src),
j AS (SELECT k.record_id, CASE WHEN k.hash IS NULL AND v.hash IS NOT NULL THEN 'appeared' WHEN k.hash IS NOT NULL AND v.hash IS NULL THEN 'is gone' WHEN k.hash IS DISTINCT FROM v.hash THEN 'changed' WHEN k.position IS DISTINCT FROM v.position THEN 'moved' END AS problem FROM k LEFT JOIN v USING (record_id)) FROM j WHERE problem IS NOT NULL""")
def d34_skipped_rows_changed(spark, sf):
    """Customers of the destination and new parts are skipped; live is the source, in which some rows have moved on."""
    s, d = both(spark, sf)
    absent = s.where("item_type_id = 'part'").join(d.select("record_id"), "record_id", "left_anti").select("record_id", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("position"))
    skipped = d.where("item_type_id = 'customer'").select("record_id", "hash", "position").unionByName(absent)
    return H.skipped_rows_changed(skipped, s.withColumn("position", F.col("position") + F.when(F.col("position") % 12 == 5, 1).otherwise(0)))


@query("d35_plan_violations", f"""WITH {PLAN_SQL}, {_EDGES_SQL}, co AS (SELECT record_id AS id FROM src WHERE item_type_id <> 'part'), cr AS (SELECT record_id AS id FROM p WHERE action = 'create')
SELECT 'not in the order' AS rule, id AS subject FROM cr WHERE id NOT IN (FROM co) UNION ALL SELECT 'in the order without a create', id FROM co WHERE id NOT IN (FROM cr)
UNION ALL SELECT DISTINCT 'refers to nothing', from_id FROM e WHERE to_id NOT IN (SELECT record_id FROM src)""")
def d35_plan_violations(spark, sf):
    """A plan whose create order lacks all parts and has all else."""
    s, d = both(spark, sf)
    order = s.where("item_type_id <> 'part'").select(F.col("record_id").alias("id"))
    return H.plan_violations(D.plan_records(s, d), order, _edges(spark, s), d)


@query("d38_item_type_mismatches", """WITH x AS (SELECT DISTINCT json_extract_string(current, '$.customer') AS id, CASE WHEN position % 5 = 0 THEN 'nation' ELSE 'customer' END AS expected FROM src WHERE item_type_id = 'order')
SELECT id, expected, item_type_id AS found FROM x LEFT JOIN dst ON record_id = id WHERE expected IS DISTINCT FROM item_type_id""")
def d38_item_type_mismatches(spark, sf):
    s, d = both(spark, sf)
    o = s.where("item_type_id = 'order'")
    return H.item_type_mismatches(o.select(F.get_json_object("current", "$.customer").alias("id"), F.when(F.col("position") % 5 == 0, "nation").otherwise("customer").alias("item_type_id")), d)


@query("g5_conflict_outcomes", f"""WITH RECURSIVE {_transfer_sql(2, 3)}, c AS (SELECT consumer AS k FROM t WHERE NOT frees UNION SELECT consumer FROM ring)
SELECT k AS record_id, CASE WHEN k IN (SELECT p_partkey FROM part WHERE p_size > 20) THEN 'relax' ELSE 'skip' END AS outcome FROM c""", records=False)
def g5_conflict_outcomes(spark, sf):
    """Parts above a size may be relaxed."""
    conflicts = unique_transitions(_transfers(spark, sf, 2, 3))[1]
    return H.conflict_outcomes(conflicts, read_table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("record_id")))


@query("g6_unsupported_unique_issues", """WITH c AS (SELECT p_partkey AS k, p_name || p_brand AS v, p_size > 25 AS skipped, p_type = 'ECONOMY' AS more FROM part), n AS (SELECT v FROM c WHERE NOT skipped GROUP BY 1 HAVING count(*) > 1)
SELECT k AS record_id FROM c WHERE NOT more AND NOT skipped AND v NOT IN (FROM n)""", records=False)
def g6_unsupported_unique_issues(spark, sf):
    """All parts are invalid through their names, some also otherwise; large ones are skipped."""
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.concat("p_name", "p_brand").alias("value"), "p_size", "p_type")
    issues = p.select("record_id", F.lit("VALIDATION_UNIQUE").alias("code")).unionByName(p.where("p_type = 'ECONOMY'").select("record_id", F.lit("VALIDATION_REQUIRED").alias("code")))
    claims = p.select(F.lit("part").alias("item_type_id"), F.lit("name").alias("field"), "value", "record_id")
    return H.unsupported_unique_issues(issues, claims, p.where("p_size > 25").select("record_id"))


@query("g10_scheduled_skips", """SELECT count(*) > 0 AS scheduled FROM dst WHERE item_type_id = 'customer' AND record_id IN (SELECT 'c' || user_id FROM events WHERE event_type = 'signup')""")
def g10_scheduled_skips(spark, sf):
    d = both(spark, sf)[1].where("item_type_id = 'customer'").select(F.col("record_id").alias("id"), F.lit("preserve target").alias("disposition"))
    return H.scheduled_skips(d, read_table(spark, sf, "events").where("event_type = 'signup'").select(F.concat(F.lit("c"), "user_id").alias("record_id")))


@query("g11_rows_to_validate", """WITH ch AS (SELECT record_id, s.current <> d.current AS c, s.published IS DISTINCT FROM d.published AS p FROM src s JOIN dst d USING (record_id)), iv AS (SELECT record_id FROM src WHERE json_extract_string(current, '$.segment') = 'MACHINERY'),
a AS (SELECT record_id, bool_or(c) AS c, bool_or(p) AS p FROM (FROM ch UNION ALL SELECT record_id, true, true FROM iv) GROUP BY 1)
SELECT record_id, 'current' AS slice, sha256(current) AS version_hash FROM src JOIN a USING (record_id) WHERE c AND item_type_id <> 'part' UNION ALL SELECT record_id, 'published', sha256(published) FROM src JOIN a USING (record_id) WHERE p AND published IS NOT NULL""")
def g11_rows_to_validate(spark, sf):
    """Changed versions and all of one segment; the current versions of parts have issues already."""
    s, d = both(spark, sf)
    changes = D.record_changes(s, d).select("record_id", "current", "published")
    known = s.where("item_type_id = 'part'").select("record_id", F.lit("current").alias("slice"))
    return H.rows_to_validate(s.select("record_id", "current", "published"), changes, s.where(F.get_json_object("current", "$.segment") == "MACHINERY").select("record_id"), known)


@query("g14_default_corrections", "SELECT c_custkey AS record_id FROM customer WHERE c_mktsegment = 'BUILDING'", records=False)
def g14_default_corrections(spark, sf):
    """The segment of some customers is missing and gets a default."""
    c = read_table(spark, sf, "customer")
    rows = lambda segment: c.select(F.col("c_custkey").alias("record_id"), F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), segment)).alias("field", "value"))
    own = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return H.default_corrections(rows(own), rows(F.coalesce(own, F.lit("none"))))


@query("g15_sanitizer_risks", """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'create' ELSE 'current-restore' END AS stage FROM documents WHERE doc_id % 10 = 1 OR doc_id % 7 = 3)
SELECT w.doc_id AS record_id, stage, 'text' AS field FROM w JOIN documents USING (doc_id) WHERE regexp_matches(text, '[<>&\\r\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}\\x{A0}\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]')""", records=False)
def g15_sanitizer_risks(spark, sf):
    """Documents of the plan that creates and updates them."""
    d, k = read_table(spark, sf, "documents"), F.col("doc_id")
    writes = d.where((k % 10 == 1) | (k % 7 == 3)).select(k.alias("record_id"), F.when(k % 10 == 1, "create").otherwise("current-restore").alias("stage"), F.lit("text").alias("field"))
    return H.sanitizer_risks(writes, d.select(k.alias("record_id"), F.lit("text").alias("field"), F.col("text").alias("value")))


@query("g1_classify_invalid", f"""WITH RECURSIVE {_SLICES.format(t='src')}, {_WRITES},
ds AS (SELECT record_id AS a, json_extract_string(current, '$.customer') AS b FROM dst WHERE item_type_id = 'order' UNION SELECT record_id, json_extract_string(published, '$.customer') FROM dst WHERE item_type_id = 'order' AND published IS NOT NULL UNION SELECT record_id, parent_id FROM dst WHERE parent_id IS NOT NULL),
base AS (SELECT record_id FROM src WHERE json_extract_string(current, '$.segment') = 'MACHINERY' AND CAST(json_extract_string(current, '$.balance') AS BIGINT) >= 500000),
mv AS (SELECT s.record_id, s.item_type_id || '|' || coalesce(s.parent_id, '') AS g FROM src s LEFT JOIN dst d USING (record_id) WHERE d.record_id IS NULL OR (s.item_type_id, s.parent_id, s.position) IS DISTINCT FROM (d.item_type_id, d.parent_id, d.position)),
step AS MATERIALIZED (SELECT 's:' || to_id AS a, 's:' || from_id AS b FROM be UNION ALL SELECT 's:' || record_id, 'r:' || record_id FROM (SELECT record_id FROM src UNION SELECT record_id FROM dst)
  UNION ALL SELECT 'r:' || a, 'r:' || b FROM ds UNION ALL SELECT 'r:' || record_id, 'p:' || record_id FROM dst WHERE record_id NOT IN (SELECT record_id FROM src)
  UNION ALL SELECT unnest(['s:', 'p:']) || record_id, 'g:' || item_type_id || '|' || coalesce(parent_id, '') FROM dst UNION ALL SELECT 'g:' || g, 's:' || record_id FROM mv),
z AS (SELECT 's:' || record_id AS x FROM base UNION SELECT b FROM z JOIN step ON a = x)
SELECT substr(x, 3) AS id, CASE WHEN x LIKE 's:%' THEN 'skipped' ELSE 'protected' END AS state FROM z WHERE x LIKE 's:%' OR x LIKE 'p:%'""")
def g1_classify_invalid(spark, sf):
    """Customers of one segment are invalid; those with a small balance can be relaxed."""
    s, d = both(spark, sf)
    invalid = s.where(F.get_json_object("current", "$.segment") == "MACHINERY")
    relaxable = invalid.where(F.get_json_object("current", "$.balance").cast("long") < 500000).select("record_id")
    edges = _sliced(d).select("from_id", "to_id").unionByName(X.parent_edges(d).select("from_id", "to_id"))
    skipped, protected = H.classify_invalid(invalid.select("record_id"), relaxable, _waiting(s), _writes(s, d), s, d, edges)
    return skipped.select("id", F.lit("skipped").alias("state")).distinct().unionByName(protected.select("id", F.lit("protected").alias("state")))


@query("l7_relaxation_state", """SELECT p_partkey AS field, CASE WHEN p_size > 40 THEN 'unknown' WHEN p_size > 20 THEN 'relaxed' ELSE 'original' END AS state FROM part""", records=False)
def l7_relaxation_state(spark, sf):
    p = read_table(spark, sf, "part")
    planned = p.select(F.col("p_partkey").alias("field"), F.col("p_type").alias("original"), F.lit("").alias("relaxed"))
    return H.relaxation_state(planned, p.select(F.col("p_partkey").alias("field"), F.when(F.col("p_size") > 40, "other").when(F.col("p_size") > 20, "").otherwise(F.col("p_type")).alias("validators")))


@query("h7_finalize_mapping", """WITH en AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'item' ELSE 'external' END AS namespace, 'c' || c_custkey AS source_id, 't' || c_custkey AS target_id FROM customer),
ok AS (SELECT CASE WHEN position % 2 = 0 THEN 'item' ELSE 'external' END AS n, record_id FROM dst WHERE item_type_id = 'customer' AND json_extract_string(current, '$.segment') <> 'MACHINERY'), rf AS (SELECT DISTINCT json_extract_string(current, '$.customer') AS c FROM dst WHERE item_type_id = 'order' AND json_extract_string(current, '$.priority') = '1-URGENT')
SELECT namespace, source_id, target_id, CASE WHEN u THEN 'kept' ELSE 'skipped' END AS state, CASE WHEN NOT u THEN CASE WHEN source_id IN (SELECT record_id FROM src WHERE json_extract_string(current, '$.segment') = 'MACHINERY') AND namespace = 'item' THEN 'invalid' ELSE 'unused' END END AS reason
FROM (SELECT *, (namespace, source_id) IN (SELECT (n, record_id) FROM ok) OR (namespace = 'external' AND source_id IN (FROM rf)) AS u FROM en)""")
def h7_finalize_mapping(spark, sf):
    """Customers in the ledger: one segment is skipped as invalid, urgent orders refer to external ones."""
    s, d = both(spark, sf)
    space = lambda k: F.when(k % 2 == 0, "item").otherwise("external").alias("namespace")
    k = F.col("c_custkey")
    entries = read_table(spark, sf, "customer").select(space(k), F.concat(F.lit("c"), k).alias("source_id"), F.concat(F.lit("t"), k).alias("target_id"))
    machinery = F.get_json_object("current", "$.segment") == "MACHINERY"
    stays = d.where("item_type_id = 'customer'").where(~machinery).select(space(F.col("position")), F.col("record_id").alias("id"))
    gone = s.where(machinery).select(F.lit("item").alias("namespace"), F.col("record_id").alias("id"), F.lit("invalid").alias("reason"))
    urgent = d.where("item_type_id = 'order'").where(F.get_json_object("current", "$.priority") == "1-URGENT").select(F.lit("external").alias("namespace"), F.get_json_object("current", "$.customer").alias("id"))
    return H.finalize_mapping(entries, stays, gone, urgent)


@query("h8_mapping_availability", f"""WITH {_SLICES.format(t='src')} SELECT 't' || c_custkey AS target_id, bool_or(slice = 'current') AS current, bool_or(slice = 'published') AS published FROM sl JOIN customer ON to_id = 'c' || c_custkey WHERE c_acctbal > 0 GROUP BY 1""")
def h8_mapping_availability(spark, sf):
    c = read_table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("t"), "c_custkey").alias("target_id"))
    return H.mapping_availability(_sliced(both(spark, sf)[0]), c)


@query("h9_ledger_mismatches", """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing' ELSE 'other target' END AS rule, 'c' || c_custkey AS source_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'source id is live', 'c' || c_custkey FROM customer WHERE 'c' || c_custkey IN (SELECT record_id FROM dst)""")
def h9_ledger_mismatches(spark, sf):
    c = read_table(spark, sf, "customer")
    row = lambda target: (F.lit("item").alias("namespace"), F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit(target), "c_custkey").alias("target_id"))
    live = c.where("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')").select(*row("t")).unionByName(c.where("c_mktsegment = 'MACHINERY'").select(*row("u")))
    return H.ledger_mismatches(c.select(*row("t")), live, both(spark, sf)[1].select(F.col("record_id").alias("id")))


@query("b23_issues_from_errors", """SELECT event_id AS id, CAST(0 AS INT) AS place, CASE event_type WHEN 'click' THEN 'VALIDATION_REQUIRED' WHEN 'view' THEN 'SERVER_BUSY' ELSE 'VALIDATION_CONTRACT_CHANGED' END AS code, CASE WHEN event_type IN ('click', 'signup') THEN 'k' || user_id END AS field FROM events WHERE event_type <> 'purchase'
UNION ALL SELECT event_id, 1, 'VALIDATION_LENGTH', 'second' FROM events WHERE event_type = 'click'""", records=False)
def b23_issues_from_errors(spark, sf):
    """Error payloads by kind of event: a nested code, a top code, the generic code, no code at all, and no payload."""
    e, t = read_table(spark, sf, "events"), F.col("event_type")
    field = F.concat(F.lit('"field":"k'), "user_id", F.lit('"'))
    one = F.concat(F.lit('{"data":[{"attributes":{"code":"INVALID_FIELD","details":{"code":"VALIDATION_REQUIRED",'), field, F.lit('}}},{"attributes":{"code":"INVALID_FIELD","details":{"code":"VALIDATION_LENGTH","field":"second"}}}]}'))
    generic = F.concat(F.lit('{"data":[{"attributes":{"code":"INVALID_FIELD","details":{'), field, F.lit("}}}]}"))
    payload = F.when(t == "click", one).when(t == "view", '{"data":[{"attributes":{"code":"SERVER_BUSY"}}]}').when(t == "signup", generic).when(t == "error", '{"data":[{"type":"?"}]}').otherwise("oops")
    return H.issues_from_errors(e.select(F.col("event_id").alias("id"), payload.alias("payload")))


@query("b6_canonical_records", """SELECT record_id, sha256('{"current":' || current || ',"id":"' || record_id || '","model":"' || item_type_id || '","parent":' || coalesce('"' || parent_id || '"', 'null') || ',"published":' || coalesce(published, 'null') || '}') AS hash FROM src""")
def b6_canonical_records(spark, sf):
    """A record as one canonical document: both slices, model and parent, without position and validity."""
    s = both(spark, sf)[0]
    text = lambda c: F.coalesce(F.to_json(F.create_map(F.lit("v"), F.col(c))), F.lit('{"v":null}'))
    inner = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(text(c), r'^\{"v":(.*)\}$', 1))
    parts = {"published": F.coalesce("published", F.lit("null")), "id": inner("record_id"), "parent": inner("parent_id"), "model": inner("item_type_id"), "current": F.col("current")}
    whole = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))
    return s.select("record_id", semantic_hash(whole).alias("hash"))


@query("d24_unsafe_published_referrers", """WITH o AS (SELECT record_id AS f, json_extract_string(published, '$.customer') AS t FROM dst WHERE item_type_id = 'order' AND published IS NOT NULL), w AS (SELECT record_id AS f, json_extract_string(published, '$.customer') AS t FROM src WHERE item_type_id = 'order' AND published IS NOT NULL)
SELECT f AS from_id, t AS to_id FROM o WHERE t NOT IN (SELECT record_id FROM src WHERE published IS NOT NULL) AND f IN (SELECT record_id FROM src) AND (f, t) IN (SELECT (f, t) FROM w)""")
def d24_unsafe_published_referrers(spark, sf):
    """Published orders whose customer is to be deleted or unpublished."""
    s, d = both(spark, sf)
    published = lambda df: _sliced(df).where("slice = 'published'").select("from_id", "to_id")
    lost = d.select("record_id").join(s.where("published IS NOT NULL").select("record_id"), "record_id", "left_anti")
    refs = published(d)
    leaving = refs.select(F.col("to_id").alias("id")).distinct().join(s.where("published IS NOT NULL").select(F.col("record_id").alias("id")), "id", "left_anti")
    gone = lost.join(s.select("record_id"), "record_id", "left_anti")
    return unsafe_published_referrers(refs, leaving, published(s), gone)


@query("g12_more_rules", """SELECT p_partkey AS record_id, 'name' AS field, 'VALIDATION_UNIQUE' AS code FROM part WHERE p_name || p_brand IN (SELECT p_name || p_brand FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT p_partkey, 'tags', 'VALIDATION_SIZE' FROM part WHERE p_size % 5 > 2 UNION ALL SELECT o_orderkey, 'date', 'VALIDATION_DATE_RANGE' FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2000-06-30'""", records=False)
def g12_more_rules(spark, sf):
    """Unique names, lists of at most three items, and dates within a range."""
    p, o = read_table(spark, sf, "part"), read_table(spark, sf, "orders")
    tags = F.array_join(F.array_repeat(F.lit("t"), (F.col("p_size") % 5 + 1).cast("int")), "|")
    row = lambda df, key, model, field, value: df.select(F.col(key).alias("record_id"), F.lit(model).alias("item_type_id"), F.lit(field).alias("field"), value.alias("value"))
    values = row(p, "p_partkey", "part", "name", F.concat("p_name", "p_brand")).unionByName(row(p, "p_partkey", "part", "tags", tags)).unionByName(row(o, "o_orderkey", "order", "date", F.col("o_orderdate").cast("string")))
    rules = [("part", "name", "unique", None, None, None), ("part", "tags", "size", None, 1.0, 3.0), ("order", "date", "date_range", "1996-01-01|2000-06-30", None, None)]
    return validate_versions(values, spark.createDataFrame(rules, "item_type_id string, field string, rule string, text string, lo double, hi double"))


_CHUNKS = """e AS (SELECT DISTINCT o_orderpriority AS n, CAST(o_orderkey AS VARCHAR) AS s, 't' || o_orderkey AS t FROM orders), z AS (SELECT *, strlen(n || ':' || s || ':' || t) + 3 AS size FROM e),
k AS (SELECT *, CAST(floor((sum(size) OVER (PARTITION BY n ORDER BY s, t) - size) / (4096 - 512 - max(size) OVER (PARTITION BY n))) AS BIGINT) AS chunk FROM z), g AS MATERIALIZED (SELECT * FROM k WHERE NOT (n = '1-URGENT' AND chunk = 1)),
c AS (SELECT n, chunk, sum(size) AS bytes FROM g GROUP BY 1, 2)"""


@query("h5_chunk_violations", f"""WITH {_CHUNKS} SELECT 'chunk too long' AS rule, CAST(chunk AS VARCHAR) AS subject FROM c WHERE bytes > 3500 UNION ALL SELECT 'chunks not contiguous', n FROM c GROUP BY n HAVING max(chunk) <> count(*) - 1""", records=False)
def h5_chunk_violations(spark, sf):
    """Orders as a ledger in chunks, one of which is lost; a limit below the one that they were cut for finds chunks that are too long."""
    o = read_table(spark, sf, "orders")
    e = o.select(F.col("o_orderpriority").alias("namespace"), F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("t"), "o_orderkey").alias("target_id")).distinct()
    return ledger_violations(chunk_ledger(e, limit=4096).where("NOT (namespace = '1-URGENT' AND chunk = 1)"), limit=3500)
