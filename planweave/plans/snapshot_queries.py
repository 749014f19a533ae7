"""Registered queries of snapshots, assets and folders, with DuckDB SQL for the same rows. Assets are documents, schedules are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.functions import canonical as C
from planweave.operators import diff as D
from planweave.operators import ledger as L
from planweave.operators import order as O
from planweave.operators import snapshot as N
from planweave.operators import uploads as U
from planweave.operators.store import kept, new_path
from planweave.plans.queries import query
from planweave.sources.records import both, read_table

_UPLOADS = """su AS MATERIALIZED (SELECT doc_id AS k, 'u' || doc_id AS upload_id, md5(CASE WHEN doc_id % 7 = 3 THEN 'x' ELSE '' END || text) AS md5, 'doc-' || doc_id AS basename, 'doc-' || doc_id || '.' || lang AS filename, [lang, source, lang] AS tags, source AS collection_id,
  CASE doc_id % 9 WHEN 0 THEN 'infected' WHEN 1 THEN 'skipped' WHEN 2 THEN NULL ELSE 'clean' END AS scan FROM documents WHERE doc_id % 10 <> 0),
du AS MATERIALIZED (SELECT doc_id AS k, 'u' || doc_id AS upload_id, md5(text) AS md5, CASE WHEN doc_id % 13 = 5 THEN 'old-' ELSE 'doc-' END || doc_id AS basename, CASE WHEN doc_id % 19 = 8 THEN 'dir/' ELSE '' END || 'doc-' || doc_id || '.' || CASE WHEN doc_id % 11 = 4 THEN 'TXT' ELSE upper(lang) END AS filename,
  [source, lang] AS tags, CASE WHEN doc_id % 17 = 6 THEN 'moved' ELSE source END AS collection_id, 'clean' AS scan FROM documents WHERE doc_id % 10 <> 1)"""


def _uploads(spark, sf, source: bool):
    d, k = read_table(spark, sf, "documents"), F.col("doc_id")
    other = lambda n, r: (k % n == r) & F.lit(not source)
    text = F.concat(F.when((k % 7 == 3) & F.lit(source), "x").otherwise(""), "text")
    lang = F.when(other(11, 4), "TXT").otherwise(F.col("lang") if source else F.upper("lang"))
    scan = F.when(k % 9 == 0, "infected").when(k % 9 == 1, "skipped").when(k % 9 == 2, None).otherwise("clean") if source else F.lit("clean")
    old = F.concat(F.lit('{"en":{"alt":"'), F.col("lang"), F.lit('","title":"t"},"it":{"alt":"i"}}'))
    new = F.concat(F.lit('{"title":{"en":"t"},"alt":{"it":"i","en":"'), F.col("lang"), F.lit('"}}'))
    return d.where(k % 10 != (0 if source else 1)).select(
        k.alias("k"), F.concat(F.lit("u"), k).alias("upload_id"), F.md5(text).alias("md5"), F.concat(F.when(other(13, 5), "old-").otherwise("doc-"), k).alias("basename"),
        F.concat(F.when(other(19, 8), "dir/").otherwise(""), F.lit("doc-"), k, F.lit("."), lang).alias("filename"),
        (F.array("lang", "source", "lang") if source else F.array("source", "lang")).alias("tags"), F.when(other(17, 6), "moved").otherwise(F.col("source")).alias("collection_id"),
        scan.alias("scan"), F.when(k % 3 == 0, old if source else new).otherwise(F.when(k % 3 == 1, new)).alias("metadata"),
    )


_META = "CASE WHEN k % 3 < 2 THEN 'alt.en=' || lang || ';alt.it=i;title.en=t' END"


@query("a1_read_versions", "SELECT record_id, item_type_id, published AS fields FROM src WHERE item_type_id IN ('customer', 'order') AND published IS NOT NULL")
def a1_read_versions(spark, sf):
    return N.read_versions(both(spark, sf)[0], ["customer", "order"], "published")


@query("a2_read_uploads", f"WITH {_UPLOADS} SELECT upload_id, md5, filename, collection_id FROM su", records=False)
def a2_read_uploads(spark, sf):
    return _uploads(spark, sf, True).select("upload_id", "md5", "filename", "collection_id")


@query("a3_pair_violations", """WITH c AS (SELECT l_orderkey AS id, l_returnflag AS t FROM lineitem WHERE l_linenumber = 1), p AS (SELECT l_orderkey AS id, l_returnflag AS t FROM lineitem WHERE l_linenumber = 2)
SELECT 'current repeats' AS rule, CAST(id AS VARCHAR) AS record_id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'published repeats', CAST(id AS VARCHAR) FROM p GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'published without current', CAST(id AS VARCHAR) FROM p WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT DISTINCT 'models differ', CAST(p.id AS VARCHAR) FROM p JOIN c USING (id) WHERE p.t <> c.t""", records=False)
def a3_pair_violations(spark, sf):
    """First line items as current rows and second ones as published rows of their orders."""
    li = read_table(spark, sf, "lineitem")
    side = lambda n: li.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").cast("string").alias("record_id"), F.col("l_returnflag").alias("item_type_id"))
    return N.pair_violations(side(1), side(2))


@query("a4_attach_schedules", """WITH f AS (SELECT 'c' || user_id AS record_id, min(ts) AS t FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
SELECT s.record_id, CASE WHEN s.position % 2 = 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS at FROM src s LEFT JOIN f USING (record_id) WHERE item_type_id = 'customer'""")
def a4_attach_schedules(spark, sf):
    """Every second customer is marked; signups and purchases are the details."""
    c = both(spark, sf)[0].where("item_type_id = 'customer'").select("record_id", (F.col("position") % 2 == 0).alias("scheduled"))
    e = read_table(spark, sf, "events").where("event_type IN ('signup', 'purchase')").select(F.concat(F.lit("c"), "user_id").alias("record_id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return N.attach_schedules(c, e).select("record_id", F.date_format("schedule.at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("a10_scope_all_uploads", f"WITH {_UPLOADS} SELECT upload_id FROM su", records=False)
def a10_scope_all_uploads(spark, sf):
    """Mode ``all``: every asset is in scope."""
    return _uploads(spark, sf, True).select("upload_id")


@query("a13_snapshot_marker", """WITH h AS (SELECT item_type_id, sha256('{"record_id":"' || record_id || '","parent_id":' || coalesce('"' || parent_id || '"', 'null') || ',"position":' || position || ',"hash":"' || hash || '"}') AS h FROM src)
SELECT item_type_id, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) % 2305843009213693951 AS BIGINT) AS digest FROM h GROUP BY 1""")
def a13_snapshot_marker(spark, sf):
    s = both(spark, sf)[0]
    marks = [N.marker(s.where(F.col("item_type_id") == m), ["record_id", "parent_id", "position", "hash"]).withColumn("item_type_id", F.lit(m)) for m in ("region", "nation", "customer", "order", "part")]
    return marks[0].unionByName(marks[1]).unionByName(marks[2]).unionByName(marks[3]).unionByName(marks[4])


@query("a14_stable_snapshot", "SELECT record_id, hash FROM src")
def a14_stable_snapshot(spark, sf):
    return N.stable_snapshot(lambda: both(spark, sf)[0].select("record_id", "hash"), ["record_id", "hash"], lambda df: kept(df, "snapshot"))


@query("a16_write_plan", "SELECT count(*) AS n, 'record_id,item_type_id,action' AS columns FROM src FULL JOIN dst USING (record_id)")
def a16_write_plan(spark, sf):
    """The manifest of a plan that was written and read back."""
    plan = D.plan_records(*both(spark, sf)).select("record_id", "item_type_id", "action")
    return N.write_plan(plan, new_path(spark, "plan-files"), ["record_id"]).select("n", "columns")


@query("a17_byte_violations", """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'missing' ELSE 'other bytes' END AS problem, CASE WHEN doc_id % 10 <> 0 THEN sha256('x' || text) END AS sha256 FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 3""", records=False)
def a17_byte_violations(spark, sf):
    """Bytes of every document against the expected MD5: some are missing, some differ."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    content = F.encode(F.concat(F.when(F.col("id") % 7 == 3, "x").otherwise(""), "text"), "UTF-8").alias("content")
    return N.byte_violations(d.where("id % 10 <> 0").select("id", content), d.select("id", F.md5("text").alias("md5")))


@query("b7_validity_flags", """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, unnest(list_filter([CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 6 = 0) THEN 'current' END, CASE WHEN (o_orderstatus = 'F') <> (o_totalprice > 250000) THEN 'published' END], lambda x: x IS NOT NULL)) AS slice FROM orders""", records=False)
def b7_validity_flags(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select(k.cast("string").alias("record_id"), (k % 3 == 0).alias("is_valid"), (k % 6 == 0).alias("current_valid"), (F.col("o_orderstatus") == "F").alias("published_valid_flag"), (F.col("o_totalprice") > 250000).alias("published_valid"))
    return N.validity_violations(rows)


@query("b8_canonical_uploads", f"""WITH {_UPLOADS}, m AS (SELECT su.*, lang, {_META.replace('k % 3', 'su.k % 3')} AS meta FROM su JOIN documents ON doc_id = su.k)
SELECT upload_id, array_to_string(list_sort([lang, collection_id]), ',') AS tags, sha256(json_object('upload_id', upload_id, 'md5', md5, 'basename', basename, 'filename', filename, 'tags', list_sort([lang, collection_id]), 'metadata', meta, 'collection_id', collection_id)::VARCHAR) AS hash FROM m WHERE scan IN ('clean', 'skipped')""", records=False)
def b8_canonical_uploads(spark, sf):
    return U.canonical_uploads(_uploads(spark, sf, True))[0].select("upload_id", F.array_join("tags", ",").alias("tags"), "hash")


@query("b8_unhealthy_uploads", f"WITH {_UPLOADS} SELECT upload_id FROM su WHERE scan IS NULL OR scan = 'infected'", records=False)
def b8_unhealthy_uploads(spark, sf):
    return U.canonical_uploads(_uploads(spark, sf, True))[1]


@query("b9_upload_metadata", f"WITH u AS (SELECT doc_id AS k, lang FROM documents WHERE doc_id % 10 <> 0) SELECT 'u' || k AS upload_id, {_META} AS metadata FROM u", records=False)
def b9_upload_metadata(spark, sf):
    """Two shapes of metadata, by field and by locale, become one."""
    return _uploads(spark, sf, True).select("upload_id", U.canonical_metadata(F.col("metadata")).alias("metadata"))


@query("b10_canonical_collections", "SELECT record_id AS id, sha256(json_object('id', record_id, 'label', json_extract_string(current, '$.name'), 'parent_id', parent_id)::VARCHAR) AS hash FROM src WHERE item_type_id IN ('region', 'nation', 'customer')")
def b10_canonical_collections(spark, sf):
    s = both(spark, sf)[0].where("item_type_id IN ('region', 'nation', 'customer')")
    return U.canonical_collections(s.select(F.col("record_id").alias("id"), F.get_json_object("current", "$.name").alias("label"), "parent_id"))


@query("b11_canonical_schedules", """SELECT event_id AS record_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, CASE WHEN event_type IN ('click', 'error') THEN 'en,it,' || event_type ELSE 'it,' || event_type END AS locales FROM events""", records=False)
def b11_canonical_schedules(spark, sf):
    """Locales come in any order and repeat; those with a rank go first."""
    e = read_table(spark, sf, "events")
    locales = F.when(F.col("event_type").isin("click", "error"), F.array(F.col("event_type"), F.lit("it"), F.lit("en"), F.lit("it"))).otherwise(F.array(F.lit("it"), F.col("event_type"), F.col("event_type")))
    rows = N.canonical_schedules(e.select(F.col("event_id").alias("record_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), locales.alias("locales")))
    return rows.withColumn("locales", F.array_join("locales", ","))


@query("d5_upload_changes", f"""WITH {_UPLOADS}, j AS (SELECT s.upload_id, s.md5 <> d.md5 AS b, s.k % 11 = 4 AS e, s.basename <> d.basename AS n, s.k % 17 = 6 AS c, s.filename <> d.filename AS f FROM su s JOIN du d USING (upload_id))
SELECT upload_id, b OR e AS binary, n AS metadata, c AS collection, b OR e AS transfers, f AND NOT b AND NOT e AS renames FROM j""", records=False)
def d5_upload_changes(spark, sf):
    return U.upload_changes(_uploads(spark, sf, True), _uploads(spark, sf, False))


@query("d30_basename_mismatches", f"WITH {_UPLOADS} SELECT upload_id, basename, filename FROM du WHERE k % 13 = 5", records=False)
def d30_basename_mismatches(spark, sf):
    return U.basename_mismatches(_uploads(spark, sf, False))


@query("d31_upload_contract", f"""WITH {_UPLOADS}, p AS (SELECT coalesce(s.k, d.k) AS k, upload_id, CASE WHEN coalesce(s.k, d.k) % 23 = 5 THEN 'replace' WHEN d.md5 IS NULL THEN 'create' WHEN s.md5 IS NULL THEN 'delete' WHEN s.md5 = d.md5 THEN 'noop' ELSE 'update' END AS action, s.md5 AS want, d.md5 AS base,
  coalesce(s.basename, d.basename) AS b FROM su s FULL JOIN du d USING (upload_id)),
r AS (SELECT upload_id, 'unknown action' AS rule FROM p WHERE action = 'replace' UNION ALL SELECT upload_id, 'base name' FROM p WHERE b LIKE 'old-%' UNION ALL SELECT upload_id, 'half a focal point' FROM p WHERE k % 29 = 1
  UNION ALL SELECT upload_id, 'focal point outside' FROM p WHERE k % 31 = 2 AND k % 29 <> 1 OR k % 31 = 2 UNION ALL SELECT upload_id, 'poster time without video' FROM p WHERE k % 5 = 0 UNION ALL SELECT upload_id, 'negative poster time' FROM p WHERE k % 37 = 0 AND (k % 5 = 0 OR k % 5 = 1)) SELECT * FROM r""", records=False)
def d31_upload_contract(spark, sf):
    """A plan of the assets in which some rows break a rule."""
    s, d = _uploads(spark, sf, True), _uploads(spark, sf, False)
    joined = D.diff_entities(s.select("upload_id", "k", "md5", "basename", "filename"), d.select("upload_id", "k", "md5", "basename", "filename"), "upload_id", hash_="md5")
    k = F.coalesce("s_k", "d_k")
    plan = joined.select(
        "upload_id", F.when(k % 23 == 5, "replace").otherwise(F.col("action")).alias("action"), F.col("d_md5").alias("baseline_hash"), F.col("s_md5").alias("desired_hash"),
        F.coalesce("s_basename", "d_basename").alias("basename"), F.coalesce("s_filename", "d_filename").alias("filename"),
        F.when(k % 31 == 2, 1.5).otherwise(0.5).alias("focal_x"), F.when(k % 29 != 1, 0.25).alias("focal_y"),
        F.when(k % 5 < 2, F.when(k % 37 == 0, -1).otherwise(3)).alias("poster_time"), F.when(k % 5 == 1, "video/mp4").otherwise("image/png").alias("mime_type"),
    )
    return U.upload_contract(plan)


@query("d32_collection_contract", """WITH p AS (SELECT record_id AS id, CASE WHEN s.position % 9 = 4 THEN 'delete' WHEN d.hash IS NULL THEN 'create' WHEN s.hash = d.hash AND s.position % 8 <> 5 THEN 'noop' WHEN s.position % 8 = 5 THEN 'noop' ELSE 'update' END AS action, s.position, s.hash AS want, d.hash AS base
  FROM src s LEFT JOIN dst d USING (record_id) WHERE s.item_type_id IN ('nation', 'customer'))
SELECT id, 'deletes' AS rule FROM p WHERE action = 'delete' UNION ALL SELECT id, 'noop changes' FROM p WHERE action = 'noop' AND base IS DISTINCT FROM want UNION ALL SELECT id, 'below itself' FROM p WHERE position % 25 = 7 UNION ALL SELECT id, 'no label' FROM p WHERE position % 12 = 1""")
def d32_collection_contract(spark, sf):
    s, d = (df.where("item_type_id IN ('nation', 'customer')").select("record_id", "position", "parent_id", "hash") for df in both(spark, sf))
    k = F.col("s_position")
    rows = D.diff_entities(s, d, "record_id").where(k.isNotNull())
    action = F.when(k % 9 == 4, "delete").when(F.col("d_hash").isNull(), "create").when((k % 8 == 5) | (F.col("s_hash") == F.col("d_hash")), "noop").otherwise("update")
    parent = F.when(k % 25 == 7, F.col("record_id")).otherwise(F.col("s_parent_id"))
    return U.collection_contract(rows.select(F.col("record_id").alias("id"), action.alias("action"), parent.alias("parent_id"), F.when(k % 12 != 1, "label").alias("label"), F.col("d_hash").alias("baseline_hash"), F.col("s_hash").alias("desired_hash")))


@query("l2_apply_uploads", f"WITH {_UPLOADS} SELECT upload_id, md5, filename FROM su", records=False)
def l2_apply_uploads(spark, sf):
    """Once the plan is applied the destination's assets are the source's."""
    s, d = (_uploads(spark, sf, x).select("upload_id", "md5", "filename") for x in (True, False))
    told = F.sha2(F.concat_ws("|", "md5", "filename"), 256)
    plan = D.diff_entities(s.withColumn("hash", told), d.withColumn("hash", told), "upload_id").select("upload_id", "action")
    return U.apply_uploads(d, s, plan)


@query("i8_topology_signature", """WITH h AS (SELECT item_type_id, sha256(record_id || '|' || coalesce(parent_id, '') || '|' || position) AS h FROM src)
SELECT item_type_id, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) % 2305843009213693951 AS BIGINT) AS digest FROM h GROUP BY 1""")
def i8_topology_signature(spark, sf):
    return O.topology_signature(both(spark, sf)[0])


@query("j4_same_set", """SELECT 'copy' AS pair, true AS same UNION ALL SELECT 'environments', (SELECT count(*) FROM (SELECT record_id FROM src EXCEPT SELECT record_id FROM dst)) = 0 AND (SELECT count(*) FROM (SELECT record_id FROM dst EXCEPT SELECT record_id FROM src)) = 0""")
def j4_same_set(spark, sf):
    s, d = both(spark, sf)
    a = O.same_set(s.select("record_id"), s.orderBy(F.desc("record_id")).select("record_id")).withColumn("pair", F.lit("copy"))
    return a.unionByName(O.same_set(s.select("record_id"), d.select("record_id")).withColumn("pair", F.lit("environments")))


@query("a15_read_ledger", """WITH d AS (SELECT c_custkey // 50 AS id, '{"batch":"b' || c_custkey // 50 || '","entries":[' || string_agg('{"source":"c' || c_custkey || '","target":"t' || c_custkey || '"}', ',' ORDER BY c_custkey) || ']}' AS text FROM customer GROUP BY 1, c_custkey // 50)
SELECT 'c' || c_custkey AS source_id, 't' || c_custkey AS target_id, sha256(text) AS hash, NULL AS problem FROM customer JOIN d ON id = c_custkey // 50 WHERE id % 5 > 1 UNION ALL SELECT CAST(id AS VARCHAR), NULL, NULL, CASE id % 5 WHEN 0 THEN 'not canonical' ELSE 'unreadable' END FROM d WHERE id % 5 < 2""", records=False)
def a15_read_ledger(spark, sf):
    """Ledger documents of 50 customers each; some are not in canonical form, some are no JSON."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 50).alias("id"))
    entry = lambda x: F.concat(F.lit('{"source":"c'), x, F.lit('","target":"t'), x, F.lit('"}'))
    docs = c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), entry), ",").alias("e"))
    text = F.concat(F.when(F.col("id") % 5 == 0, " ").otherwise(""), F.lit('{"batch":"b'), F.col("id"), F.lit('","entries":['), F.col("e"), F.when(F.col("id") % 5 == 1, "}").otherwise("]}"))
    entries, problems = L.read_ledger(docs.select("id", text.alias("text")))
    none = F.lit(None).cast("string")
    return entries.select("source_id", "target_id", "hash", none.alias("problem")).unionByName(problems.select(F.col("id").cast("string").alias("source_id"), none.alias("target_id"), none.alias("hash"), "problem"))


@query("b4_sort_localized", "SELECT c_custkey, 'en,it,' || lower(c_mktsegment) AS locales FROM customer", records=False)
def b4_sort_localized(spark, sf):
    c = read_table(spark, sf, "customer")
    texts = F.map_from_arrays(F.array(F.lower("c_mktsegment"), F.lit("it"), F.lit("en")), F.array("c_name", "c_mktsegment", "c_name"))
    return c.select("c_custkey", F.array_join(F.map_keys(C.sort_localized(texts, ["en", "it", "de"])), ",").alias("locales"))


@query("b19_filename_fixed_point", """SELECT page_id, regexp_full_match(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '[a-z0-9]+([-_][a-z0-9]+)*') AS plain FROM pages""", records=False)
def b19_filename_fixed_point(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", C.is_plain_filename(F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1)).alias("plain"))


@query("b21_unique_claims", """SELECT p_partkey, 'value:' || sha256(p_name) AS name_key, lower(p_type) || ':' || sha256(p_brand) AS brand_key FROM part""", records=False)
def b21_unique_claims(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", C.claim_key(None, F.col("p_name")).alias("name_key"), C.claim_key(F.lower("p_type"), F.col("p_brand")).alias("brand_key"))


@query("b22_issue_scope", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN lang END AS locale FROM documents", records=False)
def b22_issue_scope(spark, sf):
    """Failing paths of documents, with a locale behind the field for some."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", C.issue_scope(F.concat(F.lit("current.text"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("."), "lang")).otherwise(""))).alias("locale"))


@query("b24_pretty_json", """WITH t AS (SELECT record_id, '{' || chr(10) || '  "brand": "' || json_extract_string(current, '$.brand') || '",' || chr(10) || '  "name": "' || json_extract_string(current, '$.name') || '",' || chr(10) || '  "size": "' || json_extract_string(current, '$.size') || '"' || chr(10) || '}' AS pretty FROM src WHERE item_type_id = 'part')
SELECT record_id, pretty, CAST(strlen(pretty) AS INT) AS bytes FROM t""")
def b24_pretty_json(spark, sf):
    s = both(spark, sf)[0].where("item_type_id = 'part'").select("record_id", C.pretty_json(F.col("current")).alias("pretty"))
    return s.withColumn("bytes", F.octet_length("pretty"))


@query("b25_normal_text", "SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) = html AND NOT regexp_matches(html, '[\\x00-\\x1F\\x7F]') AS normal FROM pages", records=False)
def b25_normal_text(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", C.is_normal_text(F.col("html")).alias("normal"))
