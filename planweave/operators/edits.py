"""Documents edited as trees, each in one step: taken apart, changed and written again by the task that has them. Their rows are never dealt, so nothing but the texts is stored.

``rebuild`` does the same on rows of exploded documents; it is for targets that differ by document and for tables that are too large to be sent to every executor.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from operator import is_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.functions.canonical import normal_numbers
from planweave.operators import explode as X
from planweave.operators.rebuild import EMPTY_ROOT

#: Rows of a table that is sent whole to all executors.
SMALL_ROWS = 1_000_000
_DUMP = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode


class _Odd(Exception):
    """A number that Python does not write as it has to be written."""


def _whole(text: str) -> int:
    if len(text) > 38:
        raise _Odd
    return int(text)


def _fraction(text: str):
    raise _Odd


_DECODE = json.JSONDecoder(parse_int=_whole, parse_float=_fraction, parse_constant=X._constant).decode



def _tree(text: str) -> tuple:
    """The value of a JSON text, and whether its numbers are kept as texts."""
    try:
        return _DECODE(text), False
    except _Odd:
        return X._DECODE(text), True


def _write(value) -> str:
    """JSON text of a value of any depth, with numbers as they stand."""
    out: list[str] = []
    open_: list = [value]
    while open_:
        x = open_.pop()
        if x.__class__ is tuple:
            out.append(x[0])
        elif x.__class__ is dict and x:
            open_.append(("}",))
            for i, (k, v) in reversed(list(enumerate(sorted(x.items())))):
                open_.extend([v, (("," if i else "{") + X._quoted(k) + ":",)])
        elif x.__class__ is list and x:
            open_.append(("]",))
            for i, v in reversed(list(enumerate(x))):
                open_.extend([v, ("," if i else "[",)])
        elif x.__class__ is int:
            out.append(str(x))
        else:
            out.append(X._leaf(x)[1])
    return "".join(out)


def _text(value) -> str:
    try:
        out = _DUMP(value)
        if "\\u00" in out:
            out = X._upper_escapes(out)
        return out if out.isascii() else out.encode("utf-8", "replace").decode()
    except RecursionError:
        return _write(value)


def edit_documents(docs: DataFrame, edit: Callable | None = None, value: str = "value", more: T.StructType | None = None) -> DataFrame:
    """The documents (JSON texts in column ``value``, other columns stay) as canonical texts behind ``edit``, with their ``hash``. Null and what is no JSON give no rows.

    ``edit`` takes the model (column ``item_type_id``, or null) and the document's tree, and returns the new tree, which may share parts with the old one; with ``more``, a pair
    of it and a list of values for the columns in ``more``. Numbers in trees are ints, or, where their text has to be kept, of a class of their own.
    """
    keys = [c for c in docs.columns if c != value]
    schema = docs.select(*keys).schema.add("value", "string").add("_odd", "boolean")
    extra = list(more.fields) if more else []
    for f in extra:
        schema = schema.add(f)
    names = [f.name for f in schema.fields]
    at_model = keys.index("item_type_id") if "item_type_id" in keys else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # edits call themselves once or twice a level
        types = [to_arrow_type(f.dataType) for f in extra]
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            models = batch.column(at_model).to_pylist() if at_model is not None else [None] * len(texts)
            owners: list[int] = []
            made: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                at = pa.array(owners, pa.int32())  # noqa: B023
                cells = list(zip(*made, strict=True))  # noqa: B023
                columns = [batch.column(i).take(at) for i in range(len(keys))]  # noqa: B023
                columns += [pa.array(c, t) for c, t in zip(cells, [pa.string(), pa.bool_(), *types], strict=True)]
                return pa.RecordBatch.from_arrays(columns, names)

            for i, text in enumerate(texts):
                if text is None:
                    continue
                try:
                    root, odd = _tree(text)
                except (ValueError, RecursionError):
                    continue
                rest: list = []
                if edit is not None:
                    root = edit(models[i], root)
                    if more is not None:
                        root, rest = root
                owners.append(i)
                made.append((_write(root) if odd else _text(root), odd, *rest))
                size += len(text)
                if size > 8_000_000:
                    yield flush()
                    owners, made, size = [], [], 0
            if made:
                yield flush()

    out = docs.select(*keys, value).mapInArrow(X.without_cycles(run), schema)
    text = F.when(F.col("_odd"), normal_numbers(F.col("value"))).otherwise(F.col("value"))
    return out.select(*keys, text.alias("value"), *(f.name for f in extra)).withColumn("hash", F.sha2("value", 256))


def sent(df: DataFrame):
    """A table of few rows as something that tasks can read (see ``_cells``); None if it has more than ``SMALL_ROWS`` rows."""
    if df.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return None
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


#: What a worker has read, by broadcast and use; a worker serves many tasks.
_READ: dict[tuple, object] = {}


def _cells(broadcast, use: str, make: Callable):
    key = (id(broadcast.value), use)
    if key not in _READ:
        _READ.clear()
        columns = pa.ipc.open_stream(broadcast.value).read_all().columns
        _READ[key] = (broadcast.value, make(*(c.to_pylist() for c in columns)))
    return _READ[key][1]


def _block(value: dict, around: bool) -> tuple[str, bool] | None:
    """The model of an object if it is a block, and whether its fields stand apart in ``attributes``."""
    model = X._model_of(value) if around else None
    return (model, value.get("attributes").__class__ is dict) if model else None


def _below(k: str, field, beside: bool):
    """The field of member ``k`` of an object: its own name where the object holds the fields, else the field around."""
    if field != X._HOLDS:
        return field
    name = k if "." not in k and "[" not in k else X._FIELD(k)[0]
    return None if beside and name in X.RESERVED else name


def _marks(node: dict) -> frozenset[str]:
    marks = node.get("marks")
    if not marks:
        return frozenset()
    each = marks.values() if marks.__class__ is dict else marks if marks.__class__ is list else ()
    return frozenset(_write(m) for m in each if m.__class__ not in (dict, list) or not m)


def _is_void(x) -> bool:
    return x.__class__ is dict and x.get("type") == "span" and x.get("value") == "" and x.get("children").__class__ is not list


def _tidy(children: list) -> list:
    """A list of nodes in normal form: an empty text only where nothing else is, neighbouring texts of equal marks and neighbouring lists of one style as one."""
    if len(children) < 2:
        return children
    full = [c for c in children if not _is_void(c)] or children[-1:]
    out: list = []
    for c in full:
        last = out[-1] if out else None
        if last.__class__ is dict and c.__class__ is dict and last.get("type") == c.get("type"):
            kind = c.get("type")
            if kind == "span" and c.get("value").__class__ is str and last.get("value").__class__ is str and _marks(c) == _marks(last):
                out[-1] = last | {"value": last["value"] + c["value"]}
                continue
            if kind == "list" and c.get("children").__class__ is list and last.get("children").__class__ is list and _style(c) == _style(last):
                out[-1] = last | {"children": last["children"] + c["children"]}
                continue
        out.append(c)
    return out


def _style(node: dict) -> str | None:
    style = node.get("style")
    return style if style.__class__ is str else None


def stripper(fields: list[tuple], targets, force: bool) -> Callable:
    """An edit that takes references to ``targets`` out, as ``rebuild.strip_references`` does: ``(model, tree) -> tree``. ``fields``: ``item_type_id, field, required, kind``."""
    links = {(m, f): bool(r) for m, f, r, kind in fields if kind != "text"}
    texts = {(m, f): bool(r) for m, f, r, kind in fields if kind == "text"}

    def goes(x: str, model, field) -> bool:
        return x in targets and (model, field) in links and (force or not links[model, field])

    def leaf(v, model, field):
        c = v.__class__
        return walk(v, model, field, True) if c is dict else listed(v, model, field) if c is list else v

    def listed(v: list, model, field) -> list:
        out = [leaf(x, model, field) for x in v if x.__class__ is not str or not goes(x, model, field)]
        return v if len(out) == len(v) and all(map(is_, out, v)) else out

    def head(v: dict, model, field, around: bool):
        block = _block(v, around) if v.get("type") == "item" else None
        if block is None:
            return model, field, False, False
        model, apart = block
        return model, None if apart else X._HOLDS, apart, not apart

    def members(v: dict, model, field, apart: bool, beside: bool, but: str | None = None) -> dict:
        own = v.get("type")
        in_text = own == "itemLink" or own == "inlineItem"
        starts = v.get("schema") == "dast"
        out = v  # copied when a member changes
        for k, x in v.items():
            c = x.__class__
            if c is str:
                if x not in targets or in_text and k == "item" or not goes(x, model, _below(k, field, beside)):
                    continue
                new = None
            elif c is not dict and c is not list or k == but:
                continue
            else:
                below = X._HOLDS if apart and k == "attributes" else field if field != X._HOLDS else _below(k, field, beside)
                if c is list:
                    new = listed(x, model, None if below == X._HOLDS else below)
                elif starts and k == "document":
                    left = node(x, model, below)
                    new = left[0] if left else json.loads(EMPTY_ROOT)
                else:
                    new = walk(x, model, below, True)
                if new is x:
                    continue
            if out is v:
                out = dict(v)
            out[k] = new
        return out

    def walk(v: dict, model, field, around: bool) -> dict:
        model, field, apart, beside = head(v, model, field, around)
        return members(v, model, field, apart, beside)

    def node(v: dict, model, field) -> list:
        """What a node of structured text leaves in its parent's list."""
        own = v.get("type")
        item = v.get("item")
        model, field, apart, beside = head(v, model, field, True)
        hit = item.__class__ is str and (own == "itemLink" or own == "inlineItem") and item in targets and (force or not texts.get((model, _below("item", field, beside)), False))
        if own == "inlineItem" and hit:
            return []
        children = v.get("children")
        if children.__class__ is not list or own == "inlineItem":
            out = members(v, model, field, apart, beside)
            if own == "span" and "marks" in v and v.get("value") == "":
                out = {k: x for k, x in out.items() if k != "marks"}
            return [out]
        kids = nodes(children, model, _below("children", field, beside))
        if own == "itemLink" and hit:
            return kids
        if not kids:
            return []
        if (own == "link" or own == "itemLink") and len(kids) == 1 and _is_void(kids[0]):
            return [{"type": "span", "value": ""}]
        out = members(v, model, field, apart, beside, but="children")
        if len(kids) != len(children) or not all(map(is_, kids, children)):
            out = out | {"children": kids}
        return [out]

    def nodes(children: list, model, field) -> list:
        out: list = []
        for c in children:
            if c.__class__ is dict:
                out.extend(node(c, model, field))
            elif c.__class__ is list:
                out.append(nodes(c, model, field))
            elif c.__class__ is not str or not goes(c, model, field):
                out.append(c)
        return _tidy(out)

    def edit(model, root):
        return walk(root, model, X._HOLDS, False) if root.__class__ is dict else listed(root, model, None) if root.__class__ is list else root

    return edit


def _rows(fields: DataFrame) -> list[tuple]:
    return [tuple(r) for r in fields.select("item_type_id", "field", "required", "kind").collect()]  # a schema's fields are few


def strip_texts(docs: DataFrame, fields: DataFrame, targets: DataFrame, force: bool = False, leftover: bool = False) -> DataFrame:
    """Documents without their references to ``targets`` (``to_id``): canonical texts and hashes, as ``fold_documents(strip_references(...))`` gives them. With ``leftover`` an array of
    ``path, to_id`` beside: the required references to targets that stay.
    """
    known, schema = sent(targets.select("to_id").distinct()), _rows(fields)
    if known is None:
        return _strip_rows(docs, fields, targets, force, leftover)
    required = {(m, f, kind == "text"): bool(r) for m, f, r, kind in schema}
    find = X._links(frozenset(f for _, f, _, kind in schema if kind != "text"))

    def make(ids):
        gone = frozenset(ids)
        return gone, stripper(schema, gone, force)

    def edit(model, root):
        gone, strip = _cells(known, "strip", make)
        tree = strip(model, root)
        if not leftover:
            return tree
        stay = []
        for path, text, block_model, field, in_text, _ in find(root):
            if not force and text in gone and required.get((block_model or model, field if field.__class__ is str else None, in_text), False):
                stay.append({"path": path, "to_id": text})
        return tree, [stay]

    pair = T.StructType().add("path", "string").add("to_id", "string")
    more = T.StructType().add("leftover", T.ArrayType(pair)) if leftover else None
    return edit_documents(docs, edit, more=more)


def _strip_rows(docs: DataFrame, fields: DataFrame, targets: DataFrame, force: bool, leftover: bool) -> DataFrame:
    from planweave.operators import rebuild as R
    from planweave.operators.store import kept

    rows, keys = kept(X.explode_document(docs), "rows"), [c for c in docs.columns if c != "value"]
    versions, stay = R.project_versions(rows, fields, targets, *keys, force=force)
    if not leftover:
        return versions
    left = stay.groupBy(*keys).agg(F.collect_list(F.struct("path", "to_id")).alias("leftover"))
    return versions.join(left, keys, "left").withColumn("leftover", F.coalesce("leftover", F.array().cast("array<struct<path:string,to_id:string>>")))


def rewriter(links: frozenset, records: dict, blocks: dict, uploads: dict) -> Callable:
    """An edit that replaces ids by what they name, as ``rebuild.rewrite_ids`` does. ``links``: ``(model, field)`` of link fields."""

    def walk(v, model, field, around: bool, key=None):
        if v.__class__ is list:
            field = None if field == X._HOLDS else field
            linked = (model, field) in links
            return [(records.get(x, x) if linked else x) if x.__class__ is str else walk(x, model, field, True) if x.__class__ in (dict, list) else x for x in v]
        own = v.get("type")
        in_text = own == "itemLink" or own == "inlineItem"
        apart = block = False
        if own == "item" and (found := _block(v, around)):
            block, (model, apart) = True, found
            field = None if apart else X._HOLDS
        out = {}
        for k, x in v.items():
            c = x.__class__
            if c is str or c is dict or c is list:
                below = X._HOLDS if apart and k == "attributes" else _below(k, field, block and not apart)
                if c is not str:
                    x = walk(x, model, below, True)
                elif block and k == "id":
                    x = blocks.get(x, x)
                elif in_text and k == "item" or (model, below) in links:
                    x = records.get(x, x)
                elif k == "upload_id":
                    x = uploads.get(x, x)
            out[k] = x
        return out

    return lambda model, root: walk(root, model, X._HOLDS, False) if root.__class__ in (dict, list) else root


def rewrite_texts(docs: DataFrame, fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Documents with ids replaced by ``mapping`` (``kind, old_id, new_id``): canonical texts and hashes, as ``fold_documents(rewrite_ids(...))`` gives them."""
    known, schema = sent(mapping.select("kind", "old_id", "new_id")), _rows(fields)
    if known is None:
        from planweave.operators import rebuild as R
        from planweave.operators.store import kept

        keys = [c for c in docs.columns if c != "value"]
        return R.fold_documents(R.rewrite_ids(kept(X.explode_document(docs), "rows"), fields, mapping, *keys), *keys)
    links = frozenset((m, f) for m, f, _, kind in schema if kind != "text")

    def make(kinds, old, new):
        of = {k: {} for k in ("record", "block", "upload")}
        for kind, a, b in zip(kinds, old, new, strict=True):
            if kind in of and a is not None and b is not None:
                of[kind][a] = b
        return rewriter(links, of["record"], of["block"], of["upload"])

    return edit_documents(docs, lambda model, root: _cells(known, "ids", make)(model, root))


def filler(defaults: dict) -> Callable:
    """An edit that fills in missing defaults, as ``rebuild.fill_defaults`` does. ``defaults``: by model, ``(field, value, locales)``."""

    def filled(v: dict, model) -> dict:
        out = dict(v)
        for field, value, locales in defaults.get(model, ()):
            if field not in v:
                out[field] = value if locales is None else dict.fromkeys(locales, value)
            elif locales is not None and v[field].__class__ is dict:
                out[field] = out[field] | {x: value for x in locales if x not in v[field]}
        return out

    def walk(v, around: bool, holds):
        """``holds``: the model whose fields the object holds, in a list of one."""
        if v.__class__ is list:
            return [walk(x, True, None) if x.__class__ in (dict, list) else x for x in v]
        apart = False
        if v.get("type") == "item" and (block := _block(v, around)):
            model, apart = block
            holds = None if apart else [model]
        out = {k: walk(x, True, [model] if apart and k == "attributes" else None) if x.__class__ in (dict, list) else x for k, x in v.items()}
        return filled(out, holds[0]) if holds else out

    return lambda model, root: walk(root, False, [model]) if root.__class__ in (dict, list) else root


def fill_texts(docs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Documents with the defaults that they lack (as of ``rebuild.fill_defaults``): canonical texts and hashes."""
    by: dict = {}
    for r in defaults.select("item_type_id", "field", "value", "locales").collect():  # a schema's fields are few
        if r.value is not None and (r.item_type_id is not None):
            by.setdefault(r.item_type_id, []).append((r.field, json.loads(r.value, parse_int=_whole, parse_float=X._number), r.locales))
    return edit_documents(docs, filler(by))
