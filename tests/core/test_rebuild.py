"""Documents taken apart and put together: laws on random documents, and references taken out against a walk over the JSON tree."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from planweave.functions.canonical import canonical_json
from planweave.operators import explode as X
from planweave.operators import rebuild as R
from planweave.operators.store import kept

FIELDS = [
    ("page", "target", False, "link"), ("page", "owner", True, "link"), ("page", "peers", False, "link"), ("page", "body", False, "text"), ("page", "strict", True, "text"),
    ("card", "target", False, "link"), ("card", "body", False, "text"), ("hero", "target", True, "link"),
]
IDS = [f"t{i}" for i in range(6)]


def dumps(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def span(rng):
    out = {"type": "span", "value": rng.choice(["", "", "a", "b ", 'q"uote', "é"])}
    if rng.random() < 0.4:
        out["marks"] = rng.choice([["strong"], ["strong", "code"], ["code", "strong"], []])
    return out


def inline(rng, depth):
    kind = rng.choice(["span", "span", "span", "inlineItem", "itemLink", "link", "inlineBlock"])
    if kind == "span":
        return span(rng)
    if kind == "inlineItem":
        return {"type": kind, "item": rng.choice(IDS)}
    if kind == "inlineBlock":
        return {"type": kind, "item": block(rng, depth + 1)}
    out = {"type": kind, "children": [inline(rng, depth) if rng.random() < 0.3 and depth < 3 else span(rng) for _ in range(rng.randint(0, 3))]}
    return out | ({"item": rng.choice(IDS)} if kind == "itemLink" else {"url": "https://x"})


def branch(rng, depth):
    kind = rng.choice(["paragraph", "paragraph", "list", "list", "blockquote", "block"] if depth < 3 else ["paragraph"])
    if kind == "paragraph":
        return {"type": kind, "children": [inline(rng, depth) for _ in range(rng.randint(0, 5))]}
    if kind == "block":
        return {"type": kind, "item": block(rng, depth + 1)}
    if kind == "blockquote":
        return {"type": kind, "children": [branch(rng, depth + 2) for _ in range(rng.randint(0, 2))]}
    items = [{"type": "listItem", "children": [branch(rng, depth + 1) for _ in range(rng.randint(0, 2))]} for _ in range(rng.randint(0, 3))]
    return {"type": "list", "style": rng.choice(["bulleted", "numbered"]), "children": items}


def text(rng, depth=0):
    return {"schema": "dast", "document": {"type": "root", "children": [branch(rng, depth) for _ in range(rng.randint(0, 4))]}}


def block(rng, depth):
    model = rng.choice(["card", "hero"])
    fields = {"target": rng.choice([*IDS, None]), "n": rng.choice([1, 2.5, "t1"])}
    if model == "card" and depth < 3:
        fields["body"] = text(rng, depth + 1)
    own = {"id": rng.choice(IDS), "type": "item"}
    if rng.random() < 0.5:
        return own | {"relationships": {"item_type": {"data": {"id": model, "type": "item_type"}}}, "attributes": fields}
    return own | {"item_type": {"id": model}} | fields


def page(rng):
    return {
        "target": rng.choice([{"en": "t1", "it": rng.choice(IDS)}, "t0", None]), "owner": rng.choice(IDS), "peers": rng.choices(IDS, k=rng.randint(0, 4)), "plain": rng.choice(["t1", ["t2"], {"x": []}]),
        "body": text(rng) if rng.random() < 0.7 else {"en": text(rng), "it": text(rng)}, "strict": text(rng), "blocks": [block(rng, 1) for _ in range(rng.randint(0, 3))],
    }


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(17)
    docs = [page(rng) for _ in range(120)]
    df = spark.createDataFrame([(f"r{i}", "page", json.dumps(d)) for i, d in enumerate(docs)], "record_id string, item_type_id string, value string")
    return docs, df, kept(X.explode_document(df), "rows")


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(FIELDS, "item_type_id string, field string, required boolean, kind string")


# A walk over the tree, as the rules say it: what a node leaves in its parent's list is a list of nodes.


def required_of(model, field, kind):
    return {(m, f, k): r for m, f, r, k in FIELDS}.get((model, field, kind))


def tidy(children):
    void = lambda c: c.get("type") == "span" and c.get("value") == ""
    full = [c for c in children if not void(c)] or children[-1:]
    out = []
    for c in full:
        last = out[-1] if out else None
        if last and c["type"] == last["type"] == "span" and sorted(last.get("marks", [])) == sorted(c.get("marks", [])):
            out[-1] = last | {"value": last["value"] + c["value"]}
        elif last and c["type"] == last["type"] == "list" and last["style"] == c["style"]:
            out[-1] = last | {"children": last["children"] + c["children"]}
        else:
            out.append(c)
    return out


def walk_node(node, targets, required, force):
    free = node.get("item") in targets if isinstance(node.get("item"), str) else False
    free = free and (force or not required)
    if node["type"] == "inlineItem":
        return [] if free else [node]
    if isinstance(node.get("item"), dict):
        return [node | {"item": walk_block(node["item"], targets, force)}]
    if "children" not in node:
        return [{"type": "span", "value": ""}] if node["type"] == "span" and node["value"] == "" else [node]
    children = tidy([x for c in node["children"] for x in walk_node(c, targets, required, force)])
    if node["type"] == "itemLink" and free:
        return children
    if not children:
        return []
    if node["type"] in ("link", "itemLink") and children == [{"type": "span", "value": ""}]:
        return children
    return [node | {"children": children}]


def walk_text(value, targets, required, force):
    left = walk_node(value["document"], targets, required, force)
    return value | {"document": left[0] if left else json.loads(R.EMPTY_ROOT)}


def walk_fields(model, fields, targets, force):
    out = {}
    for name, value in fields.items():
        link, in_text = required_of(model, name, "link"), required_of(model, name, "text")

        def one(v, link=link, in_text=in_text):
            if isinstance(v, dict) and v.get("schema") == "dast":
                return walk_text(v, targets, bool(in_text) if in_text is not None else False, force)
            if isinstance(v, str) and link is not None:
                return None if v in targets and (force or not link) else v
            if isinstance(v, list) and link is not None:
                return [x for x in v if x not in targets or not (force or not link)]
            if isinstance(v, list):
                return [walk_block(b, targets, force) if isinstance(b, dict) else b for b in v]
            return v

        localized = isinstance(value, dict) and "schema" not in value and (link is not None or in_text is not None)
        out[name] = {k: one(v) for k, v in value.items()} if localized else one(value)
    return out


def walk_block(value, targets, force):
    if "attributes" in value:
        return value | {"attributes": walk_fields(value["relationships"]["item_type"]["data"]["id"], value["attributes"], targets, force)}
    own = {k: v for k, v in value.items() if k in X.RESERVED}
    return own | walk_fields(value["item_type"]["id"], {k: v for k, v in value.items() if k not in X.RESERVED}, targets, force)


def folded(rows):
    return {r.record_id: r.value for r in R.fold_documents(rows).collect()}


def test_fold_is_the_inverse(spark, pages):
    _, df, rows = pages
    odd = ['{"a":1,"a":[]}', "[]", "{}", '"x"', "3", "null", '[{"z":{},"a":[[],[{}]]},1e-7,1.50]', '{"a.b":{"[0]":"\\u0001\\u00e9\\""},"":1}', "nope", '{"x":1e400}']
    more = spark.createDataFrame([(f"o{i}", "x", t) for i, t in enumerate(odd)] + [("none", "x", None)], df.schema)
    got = folded(X.explode_document(df.union(more)))
    want = {r.record_id: r.c for r in df.union(more).select("record_id", canonical_json(F.col("value")).alias("c")).where("c IS NOT NULL").collect()}
    assert got == want and "o8" not in got and "o9" not in got and got["o0"] == '{"a":[]}'
    assert {r.record_id for r in X.unreadable_documents(df.union(more)).collect()} == {"o8", "o9"}
    one = R.fold_documents(rows).where("record_id = 'r1'").first()
    assert one.hash == hashlib.sha256(one.value.encode()).hexdigest()


@pytest.mark.parametrize("force", [False, True])
def test_references_are_taken_out(spark, pages, fields, force):
    docs, _, rows = pages
    targets = {"t0", "t1", "t2", "t3"}
    got = folded(R.strip_references(rows, fields, spark.createDataFrame([(t,) for t in targets], "to_id string"), force=force))
    for i, doc in enumerate(docs):
        assert got[f"r{i}"] == dumps(walk_fields("page", doc, targets, force)), i


def test_without_targets_texts_get_their_normal_form(spark, pages, fields):
    docs, _, rows = pages
    got = folded(R.strip_references(rows, fields, spark.createDataFrame([], "to_id string")))
    assert all(got[f"r{i}"] == dumps(walk_fields("page", d, set(), False)) for i, d in enumerate(docs))
    once = spark.createDataFrame([(k, "page", v) for k, v in got.items()], "record_id string, item_type_id string, value string")
    twice = folded(R.strip_references(X.explode_document(once), fields, spark.createDataFrame([], "to_id string")))
    assert sum(twice[k] != v for k, v in got.items()) <= len(got) // 10  # merged lists may leave lists to merge in them


def test_each_document_has_its_own_targets(spark, pages, fields):
    docs, _, rows = pages
    mine = {f"r{i}": {IDS[i % 6], IDS[i % 4]} for i in range(len(docs))}
    targets = spark.createDataFrame([(r, t) for r, ts in mine.items() for t in ts], "record_id string, to_id string")
    versions, stay = R.project_versions(rows, fields, targets)
    got = {r.record_id: r for r in versions.collect()}
    left = {}
    for r in stay.collect():
        left.setdefault(r.record_id, set()).add((r.path, r.to_id))
    for i, doc in enumerate(docs):
        want = dumps(walk_fields("page", doc, mine[f"r{i}"], False))
        assert got[f"r{i}"].value == want and got[f"r{i}"].hash == hashlib.sha256(want.encode()).hexdigest()
        assert ((".owner", doc["owner"]) in left.get(f"r{i}", set())) == (doc["owner"] in mine[f"r{i}"])


def test_ids_are_rewritten_by_their_kind(spark, pages, fields):
    docs, _, rows = pages
    mapping = spark.createDataFrame([("record", "t1", "R-1"), ("record", "t2", 'R"2'), ("block", "t1", "B-1"), ("upload", "t1", "U-1")], "kind string, old_id string, new_id string")
    records, blocks = {"t1": "R-1", "t2": 'R"2'}, {"t1": "B-1"}

    def walk(value, model, where=None):
        if isinstance(value, dict):
            if value.get("type") == "item":
                m = value["item_type"]["id"] if "item_type" in value else value["relationships"]["item_type"]["data"]["id"]
                inner = value.get("attributes")
                body = {"attributes": walk_fields_(inner, m)} if inner else walk_fields_({k: v for k, v in value.items() if k not in X.RESERVED}, m)
                return value | body | {"id": blocks.get(value["id"], value["id"])}
            out = {k: walk(v, model) for k, v in value.items()}
            if value.get("type") in ("itemLink", "inlineItem"):
                out["item"] = records.get(value["item"], value["item"])
            return out
        return [walk(v, model) for v in value] if isinstance(value, list) else value

    def walk_fields_(fields_, model):
        out = {}
        for k, v in fields_.items():
            link = required_of(model, k, "link") is not None
            swap = lambda x: records.get(x, x) if isinstance(x, str) else x
            out[k] = ({a: swap(b) for a, b in v.items()} if isinstance(v, dict) else [swap(x) for x in v] if isinstance(v, list) else swap(v)) if link else walk(v, model)
        return out

    got = folded(R.rewrite_ids(rows, fields, mapping))
    for i, doc in enumerate(docs):
        assert got[f"r{i}"] == dumps(walk_fields_(doc, "page")), i
    ids = R.typed_ids(rows, fields)
    clash = mapping.union(spark.createDataFrame([("record", "t4", "t5"), ("record", "t3", "t5")], mapping.schema))
    assert {(r.kind, r.id, r.n) for r in R.merged_ids(ids, clash).collect()} == {("record", "t5", 3)}


def test_defaults_fill_what_is_missing(spark):
    docs = {
        "a": {"blocks": [{"id": "b", "type": "item", "item_type": {"id": "card"}, "note": 1}, {"id": "c", "type": "item", "relationships": {"item_type": {"data": {"id": "card"}}}, "attributes": {}}]},
        "b": {"title": {"en": "x"}, "flag": None}, "c": {"title": {}},
    }
    df = spark.createDataFrame([(k, "page", json.dumps(v)) for k, v in docs.items()], "record_id string, item_type_id string, value string")
    defaults = spark.createDataFrame([("page", "title", '"t"', ["en", "it"]), ("page", "flag", "true", None), ("card", "note", "7", None), ("card", "tag", "null", None)], "item_type_id string, field string, value string, locales array<string>")
    got = {k: json.loads(v) for k, v in folded(R.fill_defaults(X.explode_document(df), defaults)).items()}
    both = {"en": "t", "it": "t"}
    assert got["a"] == {
        "title": both, "flag": True,
        "blocks": [docs["a"]["blocks"][0] | {"tag": None}, docs["a"]["blocks"][1] | {"attributes": {"note": 7, "tag": None}}],
    }
    assert got["b"] == {"title": {"en": "x", "it": "t"}, "flag": None} and got["c"] == {"title": both, "flag": True}
