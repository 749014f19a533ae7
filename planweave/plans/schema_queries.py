"""Registered queries over two schemas that Spark makes of suppliers (models) and parts (fields), with DuckDB SQL for the same rows.

The drift: the source lacks keys that end in 0 and the destination those that end in 1; names of models and types of fields differ where a key is 3 modulo 7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.operators import diff as D
from planweave.operators import graph as G
from planweave.plans import schema_diff as S
from planweave.plans.queries import query
from planweave.sources.records import both, read_table

_SCHEMA = """sm AS (SELECT s_suppkey AS k, 'm' || s_suppkey AS id, CASE WHEN s_suppkey % 7 = 3 THEN 'x' ELSE '' END || s_name AS name, s_suppkey % 4 = 0 AS modular, s_suppkey % 5 = 0 AS tree FROM supplier WHERE s_suppkey % 10 <> 0),
dm AS (SELECT s_suppkey AS k, 'm' || s_suppkey AS id, s_name AS name, s_suppkey % 4 = 0 AS modular, s_suppkey % 6 = 0 AS tree FROM supplier WHERE s_suppkey % 10 <> 1),
sf AS (SELECT p_partkey AS k, 'f' || p_partkey AS id, 'm' || p_partkey % 100 AS model_id, 'm' || p_partkey * 7 % 100 AS refers, p_name AS label, CASE WHEN p_partkey % 7 = 3 THEN 'TEXT' ELSE p_type END AS type, p_size AS size, p_partkey % 50 AS position,
  CASE WHEN p_size % 5 = 0 THEN 'fieldset' ELSE 'field' END AS kind FROM part WHERE p_partkey % 10 <> 0),
df AS (SELECT p_partkey AS k, 'f' || p_partkey AS id, 'm' || p_partkey % 100 AS model_id, 'm' || p_partkey * 7 % 100 AS refers, p_name AS label, p_type AS type, p_size + CASE WHEN p_partkey % 9 = 2 THEN 1 ELSE 0 END AS size, p_partkey % 50 + CASE WHEN p_partkey % 11 = 4 THEN 1 ELSE 0 END AS position,
  CASE WHEN p_size % 5 = 0 THEN 'fieldset' ELSE 'field' END AS kind FROM part WHERE p_partkey % 10 <> 1)"""


def _bool(c: Column) -> Column:
    return c.cast("string")


def _attributes(**columns: Column) -> Column:
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v.cast("string")))).alias("attributes")


def _models(spark, sf, source: bool) -> DataFrame:
    s, k = read_table(spark, sf, "supplier"), F.col("s_suppkey")
    name = F.concat(F.when((k % 7 == 3) & F.lit(source), "x").otherwise(""), "s_name")
    attributes = _attributes(name=name, modular=k % 4 == 0, tree=k % (5 if source else 6) == 0)
    return s.where(k % 10 != (0 if source else 1)).select(k.alias("k"), F.concat(F.lit("m"), k).alias("id"), F.col("s_name").alias("api_key"), attributes)


def _fields(spark, sf, source: bool) -> DataFrame:
    p, k = read_table(spark, sf, "part"), F.col("p_partkey")
    type_ = F.when((k % 7 == 3) & F.lit(source), "TEXT").otherwise(F.col("p_type"))
    size = F.col("p_size") + F.when((k % 9 == 2) & F.lit(not source), 1).otherwise(0)
    place = k % 50 + F.when((k % 11 == 4) & F.lit(not source), 1).otherwise(0)
    model = lambda n: F.concat(F.lit("m"), k * n % 100)
    kind = F.when(F.col("p_size") % 5 == 0, "fieldset").otherwise("field")
    return p.where(k % 10 != (0 if source else 1)).select(
        k.alias("k"), F.concat(F.lit("f"), k).alias("id"), model(1).alias("model_id"), F.array(model(7)).alias("refers_to"), F.col("p_name").alias("api_key"),
        type_.alias("type"), place.alias("position"), kind.alias("kind"), _attributes(label=F.col("p_name"), size=size),
    )


@query("a5_read_schema", f"WITH {_SCHEMA} SELECT m.id, count(f.id) AS n_fields, coalesce(string_agg(f.id, ',' ORDER BY f.position, f.id), '') AS fields FROM sm m LEFT JOIN sf f ON f.model_id = m.id GROUP BY 1", records=False)
def a5_read_schema(spark, sf):
    """Models with their fields in order of position; the fields of one model are few."""
    fields = _fields(spark, sf, True).groupBy(F.col("model_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("f"))
    joined = _models(spark, sf, True).join(fields, "id", "left")
    return joined.select("id", F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n_fields"), F.coalesce(F.array_join(F.transform("f", lambda x: x["id"]), ","), F.lit("")).alias("fields"))


@query("a6_select_models", f"""WITH {_SCHEMA}, w AS (SELECT 'm' || (c_custkey * 3 % 150) AS name FROM customer UNION SELECT 'Supplier#' || lpad(CAST(c_custkey % 40 AS VARCHAR), 9, '0') FROM customer)
SELECT id, 'selected' AS state FROM sm WHERE id IN (FROM w) OR 'Supplier#' || lpad(CAST(k AS VARCHAR), 9, '0') IN (FROM w)
UNION ALL SELECT name, 'unknown' FROM w WHERE name NOT IN (SELECT id FROM sm) AND name NOT IN (SELECT 'Supplier#' || lpad(CAST(k AS VARCHAR), 9, '0') FROM sm)""", records=False)
def a6_select_models(spark, sf):
    c, k = read_table(spark, sf, "customer"), F.col("c_custkey")
    names = c.select(F.concat(F.lit("m"), k * 3 % 150).alias("name")).unionByName(c.select(F.concat(F.lit("Supplier#"), F.lpad((k % 40).cast("string"), 9, "0")).alias("name")))
    chosen, unknown = S.select_models(_models(spark, sf, True).select("id", "api_key"), names)
    return chosen.select("id", F.lit("selected").alias("state")).unionByName(unknown.select(F.col("name").alias("id"), F.lit("unknown").alias("state")))


@query("a7_schema_closure", f"""WITH RECURSIVE {_SCHEMA}, r AS (SELECT id FROM sm WHERE k % 20 = 3 UNION SELECT f.refers FROM r JOIN sf f ON f.model_id = r.id) SELECT id FROM r""", records=False)
def a7_schema_closure(spark, sf):
    return S.schema_closure(_models(spark, sf, True).where("k % 20 = 3"), _fields(spark, sf, True)).select("id")


@query("a8_internal_models", """WITH g AS (SELECT l_orderkey, string_agg('l' || l_linenumber || ':' || l_returnflag, ',' ORDER BY 'l' || l_linenumber || ':' || l_returnflag) AS has FROM lineitem GROUP BY 1)
SELECT 'o' || o_orderkey AS id FROM orders JOIN g ON l_orderkey = o_orderkey WHERE has = 'l1:N,l2:N'""", records=False)
def a8_internal_models(spark, sf):
    """Orders as models and their lines as fields: models of exactly two fields, both of one type."""
    id_ = lambda c: F.concat(F.lit("o"), c)
    fields = read_table(spark, sf, "lineitem").select(id_("l_orderkey").alias("model_id"), F.concat(F.lit("l"), "l_linenumber").alias("api_key"), F.col("l_returnflag").alias("type"))
    return S.internal_models(read_table(spark, sf, "orders").select(id_("o_orderkey").alias("id")), fields, {"l1": "N", "l2": "N"}).select("id")


@query("a18_inspection_models", f"WITH {_SCHEMA} SELECT DISTINCT 'm' || l_suppkey AS id FROM lineitem WHERE 'm' || l_suppkey NOT IN (SELECT id FROM sm)", records=False)
def a18_inspection_models(spark, sf):
    return S.inspection_models(read_table(spark, sf, "lineitem").select(F.concat(F.lit("m"), "l_suppkey").alias("model_id")), _models(spark, sf, True))


@query("a19_inspection_violations", f"""WITH {_SCHEMA}, i AS (SELECT 'm' || s_suppkey AS id FROM supplier UNION ALL SELECT 'm' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 7)
SELECT 'repeats' AS rule, id AS subject FROM i GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'is managed', id FROM sm UNION ALL
SELECT 'unknown validator', 'f' || p_partkey FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 3 <> 0""", records=False)
def a19_inspection_violations(spark, sf):
    """Inspected models are all suppliers, some of them twice; an issue of every part names a validator that only every third field has."""
    s = read_table(spark, sf, "supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("k"))
    issues = read_table(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("field_id"), F.lit("rich_text_blocks").alias("validator"))
    fields = _fields(spark, sf, True).select("id", F.when(F.col("k") % 3 == 0, '{"rich_text_blocks":{}}').otherwise('{"required":{}}').alias("validators"))
    return S.inspection_violations(s.select("id").unionByName(s.where("k % 10 = 7").select("id")), _models(spark, sf, True), issues, fields)


@query("b15_schema_digest", f"""WITH {_SCHEMA}, h AS (SELECT model_id, sha256(id || '|{{"label":"' || label || '","size":"' || size || '"}}') AS h FROM sf),
g AS (SELECT model_id, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) % 2305843009213693951 AS BIGINT) AS fields FROM h GROUP BY 1)
SELECT id, sha256(id || '|{{"modular":"' || modular || '","tree":"' || tree || '"}}|' || coalesce(CAST(fields AS VARCHAR), '')) AS digest FROM sm LEFT JOIN g ON model_id = id""", records=False)
def b15_schema_digest(spark, sf):
    return S.schema_digest(_models(spark, sf, True), _fields(spark, sf, True))


@query("c8_required_fields", """SELECT 'f' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN p_size > 20 WHEN 2 THEN p_type = 'ECONOMY' ELSE false END AS required FROM part""", records=False)
def c8_required_fields(spark, sf):
    """Fields with ``required``, a minimal size that may be 0, a minimal length that counts for structured text only, or a maximum."""
    k = F.col("p_partkey")
    low = F.concat(F.lit('{"size":{"min":'), F.when(F.col("p_size") > 20, 1).otherwise(0).cast("string"), F.lit("}}"))
    v = F.when(k % 5 == 0, '{"required":{}}').when(k % 5 == 1, low).when(k % 5 == 2, '{"length":{"eq":3}}').otherwise('{"size":{"max":4}}')
    type_ = F.when((k % 5 == 2) & (F.col("p_type") == "ECONOMY"), "structured_text").otherwise("links")
    return S.required_fields(read_table(spark, sf, "part").select(F.concat(F.lit("f"), k).alias("id"), type_.alias("type"), v.alias("validators")))


@query("f23_sort_by_depth", "SELECT record_id AS id, CASE item_type_id WHEN 'customer' THEN 2 WHEN 'nation' THEN 1 ELSE 0 END AS depth FROM src")
def f23_sort_by_depth(spark, sf):
    return G.depths(both(spark, sf)[0].select(F.col("record_id").alias("id"), "parent_id"))


@query("h10_links_to_ledger", f"WITH {_SCHEMA} SELECT id, refers AS model FROM sf WHERE refers IN (SELECT id FROM sm WHERE k % 20 = 7)", records=False)
def h10_links_to_ledger(spark, sf):
    return S.links_to(_fields(spark, sf, True), _models(spark, sf, True).where("k % 20 = 7"))


@query("k2_diff_site", """WITH s AS (SELECT r_name AS id, 'theme' || r_regionkey AS theme, r_regionkey AS pos FROM region), d AS (SELECT r_name AS id, 'old' AS theme, r_regionkey + CASE WHEN r_regionkey = 2 THEN 1 ELSE 0 END AS pos FROM region)
SELECT id, 'update' AS action, 'position' AS changed FROM s JOIN d USING (id) WHERE s.pos <> d.pos""", records=False)
def k2_diff_site(spark, sf):
    """Site attributes per region; the theme is one of those that do not count."""
    r, k = read_table(spark, sf, "region"), F.col("r_regionkey")
    s = r.select(F.col("r_name").alias("id"), _attributes(theme=F.concat(F.lit("theme"), k), position=k))
    d = r.select(F.col("r_name").alias("id"), _attributes(theme=F.lit("old"), position=k + F.when(k == 2, 1).otherwise(0)))
    return S.diff_attributes(s, d, ignored=("theme", "last_data_change_at", "global_seo"))


_PLUGIN = "SELECT c_custkey AS k, 'p' || c_custkey AS id, c_custkey % 3 = 0 AS public, c_custkey % 3 = 1 AS legacy FROM customer"


@query("k4_diff_plugins", f"""WITH p AS ({_PLUGIN}), j AS (SELECT *, k % 10 <> 0 AS s, k % 10 <> 1 AS d, k % 5 = 2 AS v, k % 7 = 3 AS n FROM p),
c AS (SELECT id, CASE WHEN s AND NOT d THEN 'create' WHEN d AND NOT s THEN 'delete' ELSE 'update' END AS action,
 CASE WHEN s AND d THEN concat_ws(',', CASE WHEN n AND NOT public THEN 'name' END, CASE WHEN v AND NOT legacy THEN 'version' END) END AS changed FROM j) SELECT * FROM c WHERE action <> 'update' OR changed <> ''""", records=False)
def k4_diff_plugins(spark, sf):
    c, k = read_table(spark, sf, "customer"), F.col("c_custkey")

    def side(source):
        version = F.when((k % 5 == 2) & F.lit(source), "2").otherwise("1")
        name = F.when((k % 7 == 3) & F.lit(source), "new").otherwise(F.col("c_name"))
        return c.where(k % 10 != (0 if source else 1)).select(F.concat(F.lit("p"), k).alias("id"), (k % 3 == 1).alias("legacy"), (k % 3 == 0).alias("public"), version.alias("version"), _attributes(name=name))

    return S.diff_plugins(side(True), side(False))


@query("k5_diff_upload_filters", """SELECT 'f' || c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN 'create' WHEN c_custkey % 10 = 0 THEN 'delete' ELSE 'update' END AS action FROM customer
WHERE c_custkey % 4 <> 0 AND (c_custkey % 10 IN (0, 1) OR c_custkey % 7 = 3)""", records=False)
def k5_diff_upload_filters(spark, sf):
    """Shared filters only; any difference writes all attributes anew."""
    c, k = read_table(spark, sf, "customer"), F.col("c_custkey")
    side = lambda source: c.where((k % 10 != (0 if source else 1)) & (k % 4 != 0)).select(
        F.concat(F.lit("f"), k).alias("id"), _attributes(name=F.col("c_name"), segment=F.when((k % 7 == 3) & F.lit(source), "other").otherwise(F.col("c_mktsegment")))
    )
    return S.diff_attributes(side(True), side(False)).select("id", "action")


@query("k6_new_models", f"WITH {_SCHEMA} SELECT id, concat_ws(',', CASE WHEN modular THEN 'modular=true' END, 'name=' || name, CASE WHEN tree THEN 'tree=true' END) AS attributes FROM sm WHERE id NOT IN (SELECT id FROM dm)", records=False)
def k6_new_models(spark, sf):
    return S.new_models(_models(spark, sf, True), _models(spark, sf, False), {"modular": "false", "tree": "false"})


@query("k7_new_fields", f"WITH {_SCHEMA} SELECT CASE WHEN kind = 'fieldset' THEN 0 ELSE 1 END AS stage, id, model_id, kind FROM sf WHERE id NOT IN (SELECT id FROM df)", records=False)
def k7_new_fields(spark, sf):
    return S.new_fields(_fields(spark, sf, True).select("id", "model_id", "kind"), _fields(spark, sf, False).select("id", "model_id", "kind"))


@query("k9_changed_fields", f"""WITH {_SCHEMA}, j AS (SELECT s.id, s.type <> d.type AS t, s.size <> d.size AS z, s.position <> d.position AS p FROM sf s JOIN df d USING (id))
SELECT id, 0 AS stage, 'type' AS changed FROM j WHERE t UNION ALL SELECT id, 1, 'size' FROM j WHERE z UNION ALL SELECT id, 2, 'position' FROM j WHERE p""", records=False)
def k9_changed_fields(spark, sf):
    return S.changed_fields(_fields(spark, sf, True), _fields(spark, sf, False))


@query("k10_deleted_models", f"""WITH {_SCHEMA}, g AS (SELECT k, id FROM dm WHERE id NOT IN (SELECT id FROM sm))
SELECT id, CASE WHEN k >= 10 AND 'm' || (k - 10) IN (SELECT id FROM g) THEN CAST(k // 10 AS INT) ELSE 0 END AS level FROM g""", records=False)
def k10_deleted_models(spark, sf):
    """Every deleted model m(k) uses m(k + 10), so a chain goes from the first to the last."""
    s, d = _models(spark, sf, True), _models(spark, sf, False)
    uses = d.select(F.col("id").alias("src"), F.concat(F.lit("m"), F.col("k") + 10).alias("dst"))
    return S.deleted_models(s, d, uses)


@query("k11_finalize_models", f"""WITH {_SCHEMA}, t AS (SELECT model_id AS id, min(k) AS a, max(k) AS b FROM sf GROUP BY 1), u AS (SELECT model_id AS id, min(k) AS a, max(k) AS b FROM df GROUP BY 1)
SELECT t.id, 'title_field' AS attribute, 'f' || t.a AS value FROM t LEFT JOIN u USING (id) WHERE t.a IS DISTINCT FROM u.a UNION ALL SELECT t.id, 'ordering_field', 'f' || t.b FROM t LEFT JOIN u USING (id) WHERE t.b IS DISTINCT FROM u.b""", records=False)
def k11_finalize_models(spark, sf):
    """The first field of a model is its title and the last one its order."""
    f = lambda c: F.concat(F.lit("f"), c.cast("string"))
    side = lambda source: _fields(spark, sf, source).groupBy(F.col("model_id").alias("id")).agg(f(F.min("k")).alias("title_field"), f(F.max("k")).alias("ordering_field"))
    return S.finalize_models(side(True), side(False))


@query("k12_diff_menu", f"""WITH s AS (SELECT record_id AS id, parent_id, position, item_type_id AS t FROM src WHERE item_type_id IN ('region', 'nation', 'customer')),
d AS (SELECT record_id AS id, parent_id, position, item_type_id AS t FROM dst WHERE item_type_id IN ('region', 'nation', 'customer')),
j AS (SELECT id, coalesce(s.t, d.t) AS t, CASE WHEN d.id IS NULL THEN 'create' WHEN s.id IS NULL THEN 'delete' WHEN s.parent_id IS DISTINCT FROM d.parent_id OR s.position <> d.position THEN 'update' END AS action FROM s FULL JOIN d USING (id))
SELECT id, action, CASE t WHEN 'customer' THEN 2 WHEN 'nation' THEN 1 ELSE 0 END * CASE action WHEN 'delete' THEN -1 ELSE 1 END AS depth FROM j WHERE action IS NOT NULL""")
def k12_diff_menu(spark, sf):
    tree = lambda df: df.where("item_type_id IN ('region', 'nation', 'customer')").select(F.col("record_id").alias("id"), "parent_id", "position", F.col("item_type_id").alias("label"))
    return S.diff_tree(*map(tree, both(spark, sf)))


@query("k14_hide_internal", """SELECT record_id AS id, 'visible' AS state FROM src WHERE item_type_id <> 'order' AND item_type_id <> 'part' AND NOT (item_type_id = 'nation' AND position % 6 = 1)
UNION ALL SELECT record_id, 'below internal' FROM src WHERE item_type_id = 'customer' AND parent_id IN (SELECT record_id FROM src WHERE item_type_id = 'nation' AND position % 6 = 1)""")
def k14_hide_internal(spark, sf):
    s = both(spark, sf)[0].where("item_type_id NOT IN ('order', 'part')")
    nodes = s.select(F.col("record_id").alias("id"), "parent_id")
    visible, below = S.hide_internal(nodes, s.where("item_type_id = 'nation' AND position % 6 = 1").select(F.col("record_id").alias("id")))
    return visible.select("id", F.lit("visible").alias("state")).unionByName(below.select("id", F.lit("below internal").alias("state")))


_STAGED = f"""WITH {_SCHEMA}, c AS (
SELECT 3 AS stage, coalesce(s.id, d.id) AS id, CASE WHEN d.id IS NULL THEN 'create' WHEN s.id IS NULL THEN 'delete' ELSE 'update' END AS action,
  CASE WHEN s.id IS NOT NULL AND d.id IS NOT NULL THEN concat_ws(',', CASE WHEN s.name <> d.name THEN 'name' END, CASE WHEN s.tree <> d.tree THEN 'tree' END) END AS changed FROM sm s FULL JOIN dm d ON s.id = d.id
UNION ALL SELECT 4, id, 'create', NULL FROM sf WHERE id NOT IN (SELECT id FROM df) UNION ALL SELECT 5, id, 'delete', NULL FROM df WHERE id NOT IN (SELECT id FROM sf) AND model_id IN (SELECT id FROM sm) AND model_id IN (SELECT id FROM dm)
UNION ALL SELECT 6, s.id, 'update', 'type' FROM sf s JOIN df d ON s.id = d.id WHERE s.type <> d.type)"""


def _staged(spark, sf):
    s, d, fs, fd = _models(spark, sf, True), _models(spark, sf, False), _fields(spark, sf, True), _fields(spark, sf, False)
    none = F.lit(None).cast("string").alias("changed")
    both = s.select("id").intersect(d.select("id"))
    return S.staged({
        "model": S.diff_attributes(s.select("id", "attributes"), d.select("id", "attributes")),
        "field": S.new_fields(fs, fd).select("id", F.lit("create").alias("action"), none),
        "deleted field": S.deleted_fields(fs, fd, both).select("id", F.lit("delete").alias("action"), none),
        "changed field": S.changed_fields(fs, fd).where("stage = 0").select("id", F.lit("update").alias("action"), "changed"),
    })


@query("k1_diff_schema", f"{_STAGED} SELECT * FROM c WHERE action <> 'update' OR changed <> ''", records=False)
def k1_diff_schema(spark, sf):
    return _staged(spark, sf)


@query("k15_recreated_ids", f"{_STAGED} SELECT stage, id FROM c WHERE action = 'create'", records=False)
def k15_recreated_ids(spark, sf):
    return S.recreated_ids(_staged(spark, sf))


@query("d17_digest_mismatches", f"""WITH {_SCHEMA}, a AS (SELECT model_id AS id, sum(CAST('0x' || substr(sha256(id || label || size), 1, 15) AS HUGEINT)) AS h FROM sf GROUP BY 1), b AS (SELECT model_id AS id, sum(CAST('0x' || substr(sha256(id || label || size), 1, 15) AS HUGEINT)) AS h FROM df GROUP BY 1)
SELECT sm.id FROM sm JOIN dm ON sm.id = dm.id LEFT JOIN a ON a.id = sm.id LEFT JOIN b ON b.id = sm.id WHERE sm.tree <> dm.tree OR a.h IS DISTINCT FROM b.h""", records=False)
def d17_digest_mismatches(spark, sf):
    """Models that both schemas have with another digest: compatible schemas have none."""
    a, b = (S.schema_digest(_models(spark, sf, x), _fields(spark, sf, x)) for x in (True, False))
    return D.sided(a, "s", ["id"]).join(D.sided(b, "d", ["id"]), "id").where("s_digest <> d_digest").select("id")
