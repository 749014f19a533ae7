"""Snapshots, plans on disk, shapes of tables, running sums and numbers: small cases and laws."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.functions import canonical as C
from planweave.operators import snapshot as N
from planweave.operators.dependencies import delete_plan, dependency_plan
from planweave.operators.prefix import running_sum
from planweave.operators.store import kept, new_path
from planweave.plans.schema_diff import table_shape


def test_one_form_for_a_number(spark):
    told = lambda t: spark.createDataFrame([(t,)], "v string").select(C.canonical_json(F.col("v")).alias("r")).first().r
    assert told('{"a":1e-7}') == told('{"a":0.0000001}') and told('{"a":[1e2,-3.50,"1e2"]}') == '{"a":[100,-3.5,"1e2"]}'
    assert told('{"a":1e10}') == told('{"a":10000000000}') == '{"a":10000000000}'


def test_plan_files(spark):
    plan = spark.createDataFrame([("a", "create"), ("b", "delete")], "record_id string, action string")
    path = new_path(spark, "test-plan")
    manifest = N.write_plan(plan, path, ["record_id"]).first()
    assert manifest.n == 2 and manifest.columns == "record_id,action"
    assert N.marker(spark.read.parquet(f"{path}/plan"), ["record_id", "action"]).first().digest == manifest.digest
    with pytest.raises(Exception, match="(?i)exist"):
        N.write_plan(plan, path, ["record_id"])
    with pytest.raises(ValueError):
        N.write_plan(plan.union(plan), new_path(spark, "test-plan"), ["record_id"])


def test_unstable_source_is_an_error(spark):
    reads = iter(range(100))
    changing = lambda: spark.createDataFrame([(next(reads),)], "id long")
    with pytest.raises(RuntimeError):
        N.stable_snapshot(changing, ["id"], lambda df: kept(df, "snapshot"), attempts=2)
    assert N.stable_snapshot(lambda: spark.range(3), ["id"], lambda df: kept(df, "snapshot")).count() == 3


def test_table_shape(spark):
    want = T.StructType().add("id", "long").add("text", "string").add("extra", "integer")
    df = spark.createDataFrame([], "id string, text string, more int")
    assert {tuple(r) for r in table_shape(df, want).collect()} == {("id", "other type"), ("extra", "missing"), ("more", "unexpected")}


def test_running_sums(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", None, "b"]) if i % 3 else "a", i, rnd.randrange(5)) for i in range(300)]
    got = running_sum(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], [F.col("i")], F.col("v"), "total", tasks=7)
    seen = {}
    want = set()
    for g, i, v in rows:
        seen[g] = seen.get(g, 0) + v
        want.add((g, i, v, seen[g]))
    assert {tuple(r) for r in got.collect()} == want
    assert running_sum(got.drop("total").limit(0), ["g"], [F.col("i")], F.col("v"), "total").collect() == []


def test_orders_of_small_graphs(spark):
    ids = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    edges = [("a", "b", "x", True), ("b", "a", "x", False), ("c", "a", "x", True), ("d", "e", "x", True), ("e", "d", "x", True), ("f", "gone", "x", True)]
    table = spark.createDataFrame(edges, "from_id string, to_id string, path string, required boolean")
    plan = {r.id: r for r in dependency_plan(ids, table).collect()}
    assert [plan[c].create_level for c in "abcdef"] == [1, 0, 2, 0, 0, 0]  # b is first, as its reference to a is optional
    assert {c for c in plan if plan[c].shell} == {"d", "e"} and {c for c in plan if plan[c].publication_seed} == {"a", "b"}
    assert {c for c in plan if plan[c].temporary_seed} == {"b", "d", "e"}
    levels, unlink, stuck = delete_plan(ids, table)
    assert {tuple(r) for r in unlink.collect()} == {("b", "a", "x")} and {r.id for r in stuck.collect()} == {"d", "e"}
    assert {r.id: r.level for r in levels.collect()} == {"c": 0, "f": 0, "a": 1, "b": 2}
