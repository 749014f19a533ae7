"""Records of two environments, source and destination, from the given tables, and the same rows as SQL.

Models: region <- nation <- customer (a tree by parent), order (links a customer, has draft and published slices), part (unique names).
A record is ``record_id, item_type_id, parent_id, position, current, published, hash``: slices are JSON objects, published may be null, and the
hash covers all but the position. The drift between the environments is arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVIRONMENTS = ("source", "destination")
MODELS = ("region", "nation", "customer", "order", "part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.cast("string").alias(k) for k, c in sorted(fields.items()))))


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def record_hash(parent: Column, current: Column, published: Column, type_: Column) -> Column:
    """Hash of a record: model, parent and both slices. A missing parent or slice counts as empty text."""
    return F.sha2(F.concat_ws("|", type_, F.coalesce(parent, F.lit("")), current, F.coalesce(published, F.lit(""))), 256)


def records(spark: SparkSession, sf_dir: str, env: str) -> DataFrame:
    """All records of one environment."""
    src = env == "source"
    drop = 0 if src else 1
    none = F.lit(None).cast("string")

    def model(table: str, key: str, type_: str, prefix: str, parent: Column, current: Column, published, thin: bool = True) -> DataFrame:
        df = read_table(spark, sf_dir, table)
        if thin:
            df = df.where(F.col(key) % 10 != drop)
        return df.select(
            F.concat(F.lit(prefix), F.col(key)).alias("record_id"), F.lit(type_).alias("item_type_id"), parent.alias("parent_id"),
            F.col(key).cast("long").alias("position"), current.alias("current"), published(current).alias("published"),
        )

    changed = lambda key: (F.col(key) % 7 == 3) & F.lit(src)
    same = lambda c: c
    nation_parent = F.concat(F.lit("r"), F.when(changed("n_nationkey"), (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey")))
    cust_parent = F.concat(F.lit("n"), F.when((F.col("c_custkey") % 11 == 5) & F.lit(src), (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")))
    customer = lambda extra: _json(balance=_cents("c_acctbal") + extra, name=F.col("c_name"), segment=F.col("c_mktsegment"))
    order = lambda priority: _json(customer=F.concat(F.lit("c"), F.col("o_custkey")), priority=priority, status=F.col("o_orderstatus"), total=_cents("o_totalprice"))
    third = F.col("c_custkey") % 3
    parts = [
        model("region", "r_regionkey", "region", "r", none, _json(name=F.col("r_name")), same, thin=False),
        model("nation", "n_nationkey", "nation", "n", nation_parent, _json(name=F.col("n_name")), same, thin=False),
        model(
            "customer", "c_custkey", "customer", "c", cust_parent, customer(F.when(changed("c_custkey"), 100).otherwise(0)),
            lambda c: F.when(third == 0, c).when(third == 2, customer(F.lit(0))),
        ),
        model(
            "orders", "o_orderkey", "order", "o", none, order(F.when(changed("o_orderkey"), "changed").otherwise(F.col("o_orderpriority"))),
            lambda c: F.when(F.col("o_orderstatus") == "F", c).when(F.col("o_orderstatus") == "P", order(F.lit("none"))),
        ),
        model("part", "p_partkey", "part", "p", none, _json(brand=F.col("p_brand"), name=F.col("p_name"), size=F.col("p_size") + F.when(changed("p_partkey"), 1).otherwise(0)), same),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("hash", record_hash(F.col("parent_id"), F.col("current"), F.col("published"), F.col("item_type_id")))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of the source and of the destination."""
    return records(spark, sf_dir, "source"), records(spark, sf_dir, "destination")


def _sql(env: str) -> str:
    src = env == "source"
    drop = 0 if src else 1
    ch = lambda key, yes, no: f"CASE WHEN {key} % 7 = 3 THEN {yes} ELSE {no} END" if src else no
    cents = lambda c: f"CAST(round({c} * 100) AS BIGINT)"
    obj = lambda **f: "json_object(" + ", ".join(f"'{k}', CAST({v} AS VARCHAR)" for k, v in sorted(f.items())) + ")::VARCHAR"
    customer = lambda extra: obj(balance=f"{cents('c_acctbal')} + {extra}", name="c_name", segment="c_mktsegment")
    order = lambda p: obj(customer="'c' || o_custkey", priority=p, status="o_orderstatus", total=cents("o_totalprice"))
    cust_parent = "CASE WHEN c_custkey % 11 = 5 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END" if src else "c_nationkey"
    rows = [
        ("region", "r_regionkey", "region", "r", "NULL", obj(name="r_name"), "cur", "true"),
        ("nation", "n_nationkey", "nation", "n", f"'r' || ({ch('n_nationkey', '(n_regionkey + 1) % 5', 'n_regionkey')})", obj(name="n_name"), "cur", "true"),
        ("customer", "c_custkey", "customer", "c", f"'n' || ({cust_parent})", customer(f"({ch('c_custkey', '100', '0')})"),
         f"CASE c_custkey % 3 WHEN 0 THEN cur WHEN 2 THEN {customer('0')} END", f"c_custkey % 10 <> {drop}"),
        ("orders", "o_orderkey", "order", "o", "NULL", order(ch("o_orderkey", "'changed'", "o_orderpriority")),
         f"CASE o_orderstatus WHEN 'F' THEN cur WHEN 'P' THEN {order(chr(39) + 'none' + chr(39))} END", f"o_orderkey % 10 <> {drop}"),
        ("part", "p_partkey", "part", "p", "NULL", obj(brand="p_brand", name="p_name", size=f"p_size + ({ch('p_partkey', '1', '0')})"), "cur", f"p_partkey % 10 <> {drop}"),
    ]
    parts = [
        f"SELECT '{p}' || {key} AS record_id, '{t}' AS item_type_id, CAST({parent} AS VARCHAR) AS parent_id, CAST({key} AS BIGINT) AS position, "
        f"cur AS current, CAST({pub} AS VARCHAR) AS published FROM (SELECT *, {cur} AS cur FROM {table}) WHERE {where}"
        for table, key, t, p, parent, cur, pub, where in rows
    ]
    return (
        "SELECT *, sha256(concat_ws('|', item_type_id, coalesce(parent_id, ''), current, coalesce(published, ''))) AS hash FROM (" + " UNION ALL ".join(parts) + ")"
    )


#: SQL tables ``src`` and ``dst``, the same rows as ``both``; for the start of a WITH list.
RECORDS_SQL = f"src AS MATERIALIZED ({_sql('source')}), dst AS MATERIALIZED ({_sql('destination')})"
