"""What is picked from documents without unfolding them is what their rows say."""

import gc
import json
import random

import pytest
from test_rebuild import FIELDS, page

from planweave.operators import blocks as B
from planweave.operators import checks as H
from planweave.operators import explode as X
from planweave.plans.queries import _nested_orders

ODD = ['{"a":1,"a":{"note":"<"}}', "[]", '["t1",{"note":"&"}]', '"t1"', "3", "null", "nope", '{"note":["<","ok",{"upload_id":"\\ud800"}],"n":1e400}', '{"note":["<","ok"],"target":["t1",["t2"]]}',
       '{"target":{"en":{"id":7,"type":"item","item_type":{"id":"card"},"meta":{"target":"t1"},"target":{"x":[["t3"]]},"hero":{"id":"i","type":"item","__itemTypeId":"hero","image":{"upload_id":"u1"}}}}}']


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [json.dumps(page(rng) | {"note": rng.choice(["<b>", "ok", "a&b"]), "image": {"upload_id": f"u{i % 7}"}}) for i in range(80)]
    return spark.createDataFrame([(f"r{i}", "page", t) for i, t in enumerate([*texts, *ODD, None])], "record_id string, item_type_id string, value string")


def same(a, b):
    a, b = (sorted(map(repr, x.select(sorted(x.columns)).collect())) for x in (a, b))
    assert a and a == b


def test_all_texts(spark, docs):
    targets = spark.createDataFrame([("t1",), ("t3",), ("&",), ("none",)], "value string")
    same(H.contains_string(X.all_texts(docs), targets), H.contains_string(X.explode_document(docs), targets))


def test_texts_of_fields(docs):
    same(B.unstable_texts(X.named_texts(docs, ("note", "value"), lists=True), ("note", "value")), B.unstable_texts(X.explode_document(docs), ("note", "value")))


def test_links(spark, docs):
    fields = spark.createDataFrame(FIELDS, "item_type_id string, field string, required boolean, kind string")
    names = tuple(f[1] for f in FIELDS if f[3] == "link")
    same(X.references(X.link_texts(docs, names), fields), X.references(X.explode_document(docs), fields))
    same(X.references(X.link_texts(docs, names), fields, unique=True), X.references(X.explode_document(docs), fields))


def test_orders_that_lack_something_are_left_to_the_library(spark, tmp_path):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
    spark.createDataFrame([(1, 2, 3, 1), (1, None, 3, 2), (1, 2, None, 3), (2, 9, 3, None)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5), (2, None), (3, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, 4)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.record_id: json.loads(r.value) for r in _nested_orders(spark, str(tmp_path)).collect()}
    attributes = [m["attributes"] for m in got["o1"]["modules"]]
    assert got["o3"] == {"customer": "c6"} and "customer" not in got["o2"] and [m["id"] for m in got["o1"]["modules"]] == ["1-1", "1-2", "1-3"]
    assert attributes[0]["note"] == "<b>even</b>" and "part" not in attributes[1] and attributes[1]["hero"]["supplier"] == "s3" and attributes[2]["hero"]["image"] == {"alt": "supplier"}
    assert got["o2"]["modules"][0]["id"] == "2" and "note" not in got["o2"]["modules"][0]["attributes"]
    assert attributes[0]["hero"] == {"id": "1-1-s", "type": "item", "item_type": {"id": "supply"}, "supplier": "s3", "image": {"upload_id": "u3", "alt": "supplier"}}


def test_uploads(docs):
    same(B.upload_references(X.named_texts(docs, ("upload_id",))), B.upload_references(X.explode_document(docs)))


def test_block_locations(docs):
    same(B.block_locations(X.explode_blocks(docs), ("body",)), B.block_locations(X.explode_document(docs), ("body",)))


def test_nested_ids(docs):
    same(B.nested_ids(X.explode_blocks(docs)), B.nested_ids(X.explode_document(docs)))


def test_allow_lists(spark, docs):
    allowed = spark.createDataFrame([(None, "blocks", "card"), ("card", "body", "hero"), ("hero", "target", "card")], "owner_model string, field string, block_model string")
    same(B.allow_list_issues(X.explode_blocks(docs), allowed), B.allow_list_issues(X.explode_document(docs), allowed))


def test_stripped_edges(spark, docs):
    fields = spark.createDataFrame(FIELDS, "item_type_id string, field string, required boolean, kind string")
    rows, names = X.explode_document(docs), tuple(f[1] for f in FIELDS if f[3] == "link")
    targets = spark.createDataFrame([("t1",), ("t2",)], "id string")
    got = B.strip_documents(None, X.references(X.link_texts(docs, names), fields, unique=True), targets)
    same(got, B.strip_documents(rows, X.references(rows, fields), targets))
    assert got.where("NOT required AND to_id IN ('t1', 't2')").isEmpty() and not got.where("required AND to_id = 't1'").isEmpty()


def test_the_collector_rests_during_a_pass():
    seen = []
    before = gc.isenabled()
    assert list(X.without_cycles(lambda batches: (seen.append(gc.isenabled()) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert seen == [False, False] and gc.isenabled() == before
