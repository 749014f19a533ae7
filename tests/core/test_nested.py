"""Deep documents are unfolded to the end, and links count wherever they stand."""

import json

from planweave.operators import explode as X


def nested(levels):
    block = {"target": "t0"}
    for i in range(1, levels + 1):
        shape = {"attributes": block, "relationships": {"item_type": {"data": {"id": "hero"}}}} if i % 2 else {"item_type": {"id": "card"}, **block}
        block = {"modules": [{"id": f"b{i}", "type": "item", **shape}], "target": f"t{i}"}
    return block


def leaves(value):
    if isinstance(value, dict | list) and value:
        return sum(map(leaves, value.values() if isinstance(value, dict) else value))
    return 1


def test_deep_blocks_lose_no_node(spark):
    doc = nested(7)
    rows = X.explode_document(spark.createDataFrame([("r", json.dumps(doc))], "record_id string, value string"))
    got = rows.collect()
    assert sum(r.kind not in ("object", "array") or r.value in ("{}", "[]") for r in got) == leaves(doc)
    assert max(r.depth for r in got) > 12
    edges = X.references(rows, spark.createDataFrame([("target", True)], "field string, required boolean")).collect()
    assert {r.to_id for r in edges} == {f"t{i}" for i in range(8)} and len(edges) == 8


def test_links_of_models_locales_and_texts(spark):
    link = {"type": "itemLink", "item": "x", "children": [{"type": "span", "value": "word"}]}
    inner = {"id": "b", "type": "item", "item_type": {"id": "hero"}, "target": "h", "other": "no"}
    body = {"schema": "dast", "document": {"type": "root", "children": [{"type": "paragraph", "children": [link]}, {"type": "block", "item": inner}]}}
    doc = {"target": {"en": "e", "it": None}, "peers": ["a", "b"], "body": body, "hero": inner | {"id": "c", "item_type": {"id": "card"}}}
    rows = X.explode_document(spark.createDataFrame([("r", json.dumps(doc))], "record_id string, value string"))
    links = [(None, "target", True, "link"), (None, "peers", False, "link"), ("hero", "target", False, "link"), (None, "body", True, "text"), ("hero", "id", True, "link")]
    got = X.references(rows, spark.createDataFrame(links, "item_type_id string, field string, required boolean, kind string")).collect()
    assert {(r.to_id, r.path, r.required) for r in got} == {
        ("e", ".target.en", True), ("a", ".peers[0]", False), ("b", ".peers[1]", False), ("h", ".body.document.children[1].item.target", False),
        ("x", ".body.document.children[0].children[0].item", True),
    }
