"""Laws and small cases of operators that the query tests do not reach."""

import base64
import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from planweave.functions import canonical as C
from planweave.operators import diff as D
from planweave.operators import explode as X
from planweave.operators import graph as G
from planweave.operators import ledger as L
from planweave.operators import validity as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b": 1, "a": [3, 1, {"z": null, "y": -0.0}]}', '{"a":[3,1,{"y":0,"z":null}],"b":1}'),
        ("[1.0, 1e2, 0.5]", "[1,100,0.5]"), ('"1.0, 2.0]"', '"1.0, 2.0]"'), ("not json", None), (None, None), ("{}", "{}"),
    ],
)
def test_canonical_json(spark, text, want):
    assert one(spark, text, C.canonical_json) == want


def test_ids(spark):
    rnd = random.Random(1)
    for _ in range(20):
        u = uuid.UUID(int=rnd.getrandbits(128), version=4)
        assert one(spark, base64.urlsafe_b64encode(u.bytes).decode().rstrip("="), C.is_portable_id)
    for bad in ("", "123", None, "A" * 22, "é" * 22, base64.urlsafe_b64encode(uuid.uuid1().bytes).decode().rstrip("=")):
        assert one(spark, bad, C.is_portable_id) is False
    b = bytearray(hashlib.sha256(b"seed").digest()[:16])
    b[6], b[8] = b[6] & 0x0F | 0x40, b[8] & 0x3F | 0x80
    assert one(spark, "seed", C.deterministic_id) == base64.urlsafe_b64encode(bytes(b)).decode().rstrip("=")
    assert [one(spark, t, C.is_legacy_id) for t in ("0", "17", "017", "x", None)] == [True, True, False, False, False]


def test_texts(spark):
    assert [one(spark, t, C.filename_extension) for t in ("a/b.tar.GZ", ".hidden", "x", "a.b/c", "a.")] == ["gz", "", "", "", ""]
    assert [one(spark, t, C.basename) for t in ("a/b.tar.gz", ".hidden", "x", "a.b/c")] == ["b.tar", ".hidden", "x", "c"]
    assert [one(spark, t, C.is_plain_filename) for t in ("a-b_c1", "A", "a--b", "-a", None)] == [True, False, False, False, False]
    assert [one(spark, t, C.is_stable_text) for t in ("fine\n", "a&b", " ", "\x07")] == [True, False, False, False]
    assert one(spark, "2020-01-02 03:04:05", C.canonical_timestamp) == "2020-01-02T03:04:05.000Z"
    assert one(spark, "no time", C.canonical_timestamp) is None
    assert one(spark, "current.title.en", C.issue_scope) == "en" and one(spark, "current.title", C.issue_scope) is None


def test_sort_localized(spark):
    df = spark.createDataFrame([({"zz": "1", "it": "2", "en": "3", "aa": "4"},)], "m map<string,string>")
    got = df.select(F.map_entries(C.sort_localized(F.col("m"), ["en", "it"])).alias("e")).first().e
    assert [r.key for r in got] == ["en", "it", "aa", "zz"]


def test_explode(spark):
    docs = spark.createDataFrame([("r", '{"a": {"en": [1, {"b": "x"}], "it": null}, "t": true}'), ("n", None), ("bad", "{")], "id string, value string")
    got = {(r.path, r.depth, r.kind, r.value) for r in X.explode_document(docs).collect()}
    assert got == {
        ("", 0, "object", None), (".a", 1, "object", None), (".t", 1, "boolean", "true"), (".a.en", 2, "array", None), (".a.it", 2, "null", "null"), (".a.en[0]", 3, "number", "1"),
        (".a.en[1]", 3, "object", None),
        (".a.en[1].b", 4, "string", '"x"'),
    }


def components(nodes, edges):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in reach and b in reach:
                for s in reach.values():
                    if a in s:
                        s.add(b)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(25))
    edges = [(rnd.randrange(27), rnd.randrange(27)) for _ in range(35)]
    got = G.strongly_connected_components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == components(nodes, edges)


def test_levels_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("d", "e"), ("e", "d"), ("f", "d")], "src string, dst string")
    levels, left = G.topological_levels(edges.selectExpr("src AS id"), edges)
    assert {(r.id, r.level) for r in levels.collect()} == {("c", 0), ("b", 1), ("a", 2)}
    assert {r.id for r in left.collect()} == {"d", "e", "f"}
    assert {tuple(r) for r in G.cyclic_edges(edges.selectExpr("src AS id"), edges).collect()} == {("a", "a"), ("d", "e"), ("e", "d")}


def test_depths(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "gone"), ("p", "q"), ("q", "p")], "id string, parent_id string")
    assert {r.id: r.depth for r in G.depths(tree).collect()} == {"r": 0, "a": 1, "b": 2, "x": 0, "p": None, "q": None}


def test_reserved_ids_avoid_what_is_taken(spark):
    want = spark.createDataFrame([("item", "1"), ("item", "2"), ("item", "1")], "namespace string, source_id string")
    none = spark.createDataFrame([], "namespace string, target_id string")
    first = {r.source_id: r.target_id for r in L.reserve_ids(want, none, "s").collect()}
    again = {r.source_id: r.target_id for r in L.reserve_ids(want, spark.createDataFrame([("item", first["1"])], "namespace string, target_id string"), "s").collect()}
    assert set(first) == {"1", "2"} and again["2"] == first["2"] and again["1"] != first["1"]


def test_ledger_violations(spark):
    rows = [("n", "a", "x", 0), ("n", "a", "y", 2), ("n", "b", "y", 2)]
    got = {tuple(r) for r in L.ledger_violations(spark.createDataFrame(rows, "namespace string, source_id string, target_id string, chunk long")).collect()}
    assert got == {("source claimed twice", "a"), ("target claimed twice", "y"), ("chunks not contiguous", "n")}


def test_second_plan_is_all_noop(spark):
    cols = "record_id string, item_type_id string, parent_id string, position long, current string, published string, hash string"
    s = spark.createDataFrame([("a", "m", None, 1, "{}", None, "1"), ("b", "m", None, 2, "{}", None, "2"), ("c", "m", None, 3, "{}", None, "3")], cols)
    d = spark.createDataFrame([("b", "m", None, 2, "{}", None, "x"), ("c", "m", None, 9, "{}", None, "3"), ("z", "m", None, 4, "{}", None, "4")], cols)
    plan = D.plan_records(s, d)
    assert {r.record_id: r.action for r in plan.collect()} == {"a": "create", "b": "update", "c": "update", "z": "delete"}
    done = D.apply_plan(d, s, plan)
    assert {r.action for r in D.plan_records(s, done).collect()} == {"noop"}
    assert D.verify_final(done, s).collect() == []
    allowed = spark.createDataFrame([("b", "mid")], "record_id string, hash string")
    live = d.withColumn("hash", F.when(F.col("record_id") == "b", "mid").otherwise(F.col("hash")))
    assert {r.record_id: r.state for r in D.classify_live(plan, live, allowed).collect()} == {"a": "pending", "b": "resumable", "c": "converged", "z": "pending"}


def test_stale_diagnostics_are_dropped(spark):
    d = spark.createDataFrame([("a", "current", "1"), ("a", "published", "1")], "record_id string, slice string, version_hash string")
    v = spark.createDataFrame([("a", "current", "1"), ("a", "published", "2")], "record_id string, slice string, version_hash string")
    assert [r.slice for r in V.match_diagnostics(d, v).collect()] == ["current"]
