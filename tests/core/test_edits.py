"""Documents edited as trees are what their rows make of them."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_rebuild import FIELDS, IDS, dumps, page, walk_fields

from planweave.operators import edits as A
from planweave.operators import explode as X
from planweave.operators import rebuild as R
from planweave.operators.store import kept

ODD = ['{"a":1,"a":[]}', "[]", "{}", '"x"', "3", "null", '[{"z":{},"a":[[],[{}]]},1e-7,1.50,-0,1E2]', '{"a.b":{"[0]":"\\u0001\\u00e9\\""},"":1}', "nope", '{"x":1e400}', '{"n":12345678901234567890123456789012345678901}', '{"s":"\\\\u00ab \\ud800","b":[true,false,null,1.5]}']
DEEP = '{"a":[' * 700 + "1.0" + "]}" * 700


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(23)
    docs = [page(rng) for _ in range(120)]
    df = spark.createDataFrame([(f"r{i}", "page", json.dumps(d)) for i, d in enumerate(docs)], "record_id string, item_type_id string, value string")
    return docs, df, kept(X.explode_document(df), "rows")


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(FIELDS, "item_type_id string, field string, required boolean, kind string")


def texts(df):
    return {r.record_id: (r.value, r.hash) for r in df.select("record_id", "value", "hash").collect()}


def test_documents_are_written_again(spark, pages):
    _, df, _ = pages
    docs = df.union(spark.createDataFrame([(f"o{i}", "x", t) for i, t in enumerate(ODD)] + [("none", "x", None)], df.schema))
    got = texts(A.edit_documents(docs))
    assert got == texts(R.fold_documents(X.explode_document(docs))) and "o8" not in got and got["o6"][0].endswith("1.0E-7,1.5,0,100]")
    deep = A.edit_documents(spark.createDataFrame([("d", DEEP)], "record_id string, value string")).first()
    assert deep.value == DEEP.replace("1.0", "1")


@pytest.mark.parametrize("force", [False, True])
def test_references_are_taken_out(spark, pages, fields, force):
    docs, df, rows = pages
    targets = spark.createDataFrame([("t0",), ("t1",), ("t2",)], "to_id string")
    got = texts(A.strip_texts(df, fields, targets, force=force))
    assert got == texts(R.fold_documents(R.strip_references(rows, fields, targets, force=force)))
    assert all(got[f"r{i}"][0] == dumps(walk_fields("page", d, {"t0", "t1", "t2"}, force)) for i, d in enumerate(docs))


def test_many_targets_are_met_by_rows(spark, pages, fields, monkeypatch):
    _, df, _ = pages
    targets = spark.createDataFrame([("t1",), ("t4",)], "to_id string")
    got = texts(A.strip_texts(df, fields, targets))
    monkeypatch.setattr(A, "SMALL_ROWS", 1)
    assert A.sent(targets) is None and got == texts(A.strip_texts(df, fields, targets))


def test_required_references_stay(spark, pages, fields):
    _, df, rows = pages
    targets = spark.createDataFrame([(t,) for t in IDS[:4]], "to_id string")
    both = A.strip_texts(df, fields, targets, leftover=True)
    versions, stay = R.project_versions(rows, fields, targets)
    assert texts(both) == texts(versions)
    mine = both.select("record_id", F.explode("leftover").alias("x")).select("record_id", "x.path", "x.to_id")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, stay.select("record_id", "path", "to_id").collect()))


def test_defaults(spark):
    docs = {
        "a": {"blocks": [{"id": "b", "type": "item", "item_type": {"id": "card"}, "note": 1}, {"id": "c", "type": "item", "relationships": {"item_type": {"data": {"id": "card"}}}, "attributes": {}}]},
        "b": {"title": {"en": "x"}, "flag": None, "x": 2.50}, "c": {"title": {}}, "d": [{"title": 1}], "e": {"body": {"id": "e", "type": "item", "item_type": {"id": "card"}, "attributes": {"tag": {"id": "f", "type": "item", "__itemTypeId": "page", "title": {"it": 1}}}}},
    }
    df = spark.createDataFrame([(k, "page", json.dumps(v)) for k, v in docs.items()], "record_id string, item_type_id string, value string")
    rows = [("page", "title", '"t"', ["en", "it"]), ("page", "flag", "true", None), ("card", "note", "7", None), ("card", "tag", "null", None), ("card", "list", "[]", ["en"])]
    defaults = spark.createDataFrame(rows, "item_type_id string, field string, value string, locales array<string>")
    assert texts(A.fill_texts(df, defaults)) == texts(R.fold_documents(R.fill_defaults(X.explode_document(df), defaults)))


def test_ids_of_records(spark, pages, fields):
    _, df, rows = pages
    links = X.link_texts(df.select("item_type_id", "value"), tuple(f[1] for f in FIELDS if f[3] == "link"), once=True)
    want = R.typed_ids(rows, fields).where("kind = 'record'").select("kind", "id").distinct()
    got = R.record_ids(links, fields)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and links.count() < rows.where("kind = 'string'").count() / 2
    mapping = spark.createDataFrame([("record", "t4", "t5"), ("record", "t3", "t5"), ("block", "t1", "t2"), ("record", "t0", "n0")], "kind string, old_id string, new_id string")
    assert [tuple(r) for r in R.merged_ids(got, mapping).collect()] == [("record", "t5", 3)]


def test_ids_are_rewritten(spark, pages, fields):
    _, df, rows = pages
    mapping = [("record", "t1", "R-1"), ("record", "t2", 'R"2'), ("block", "t1", "B-1"), ("upload", "u1", "U-1"), ("other", "t3", "no")]
    mapping = spark.createDataFrame(mapping, "kind string, old_id string, new_id string")
    extra = spark.createDataFrame([("up", "page", '{"image":{"upload_id":"u1","alt":"u1"},"target":{"upload_id":"u2"},"id":"t1"}')], df.schema)
    got = texts(A.rewrite_texts(df.union(extra), fields, mapping))
    assert got == texts(R.fold_documents(R.rewrite_ids(rows.union(X.explode_document(extra)), fields, mapping))) and '"upload_id":"U-1"' in got["up"][0]
