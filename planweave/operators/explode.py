"""Nested documents as rows: every value of a record with its place and owning block; references and ownership from these rows."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.functions.canonical import number_text

#: Members of a block that are no fields, where its fields stand beside them.
RESERVED = ("id", "type", "item_type", "__itemTypeId", "meta", "creator")
_FIELDS = (
    "path string, depth int, kind string, value string, block_path string, block_model string, fields_path string, parent_type string, "
    "place array<string>, shape string, name string, chain array<int>, types array<string>"
)
_TEXTS, _INTS = pa.list_(pa.string()), pa.list_(pa.int32())
_ARROW = [pa.string(), pa.int32(), *[pa.string()] * 6, _TEXTS, pa.string(), pa.string(), _INTS, _TEXTS]


_LINK_ROWS = "text string, block_model string, _field string, _text boolean, parent_type string"
_FIELD = re.compile(r"[^.\[]*").match
#: In place of a field: the object holds the fields. No text, so that it is no field's name, and one value in all processes.
_HOLDS = b""


class _Number(str):
    """A number as it stands in the text."""


def _number(text: str) -> _Number:
    if abs(float(text)) == float("inf"):
        raise ValueError(text)
    return _Number(text)


def _constant(text: str):
    raise ValueError(text)


_DECODE = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_constant).decode


def _upper_escapes(text: str) -> str:
    return re.sub(r"\\\\|\\u00[0-9a-f]{2}", lambda m: m[0][:2] + m[0][2:].upper(), text)


def _quoted(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    if "\\u" in out:
        out = _upper_escapes(out)
    return out.encode("utf-8", "replace").decode()


def _leaf(value) -> tuple[str, str | None]:
    if isinstance(value, dict):
        return "object", None if value else "{}"
    if isinstance(value, list):
        return "array", None if value else "[]"
    if isinstance(value, _Number):
        return "number", str(value)
    if isinstance(value, str):
        return "string", _quoted(value)
    return ("null", "null") if value is None else ("boolean", "true" if value else "false")


def _member(value, *names: str):
    for name in names:
        value = value.get(name) if isinstance(value, dict) else None
    return value if isinstance(value, str) and value else None


def _nodes(text: str | None) -> Iterator[tuple]:
    """All nodes of a JSON text, as rows of _FIELDS."""
    try:
        root = json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_constant) if text is not None else None
    except (ValueError, RecursionError):
        return
    if text is None:
        return
    open_ = [(root, (), "", "", None, (None, None, ""), None, (), (), False)]
    while open_:
        value, place, path, shape, name, block, parent_type, chain, types, is_text = open_.pop()
        kind, leaf = _leaf(value)
        if kind != "object":
            yield path, len(place), kind, leaf, *block, parent_type, place, shape, name, chain, None
            if kind == "array":
                for i, v in enumerate(value):
                    open_.append((v, (*place, f"{i:08d}"), f"{path}[{i}]", shape + "[", None, block, None, chain, types, is_text))
            continue
        own_type = value.get("type") if isinstance(value.get("type"), str) else None
        if is_text:
            chain, types = (*chain, len(place)), (*types, own_type)
        yield path, len(place), kind, leaf, *block, parent_type, place, shape, name, chain, types if is_text else None
        model = _member(value, "item_type", "id") or _member(value, "relationships", "item_type", "data", "id") or _member(value, "__itemTypeId")
        if place and own_type == "item" and value.get("id") is not None and model:
            block = (path, model, path + ".attributes" if isinstance(value.get("attributes"), dict) else path)
        starts = value.get("schema") == "dast"
        for k, v in value.items():
            begins = starts and k == "document" and isinstance(v, dict)
            inside = begins or is_text and k == "children" and isinstance(v, list) and own_type != "inlineItem"
            quoted = _quoted(k)
            open_.append((v, (*place, quoted[1:-1]), f"{path}.{k}", shape + "{", quoted, block, own_type, chain, () if begins else types, inside))


def explode_document(docs: DataFrame, value: str = "value") -> DataFrame:
    """Every node of the JSON text in column ``value`` as a row; the other columns repeat.

    ``path`` adds ``.key`` for objects and ``[i]`` for arrays; ``kind`` is object, array, string, number, boolean or null; ``value`` is the canonical JSON text of a leaf
    or an empty container, and null for other containers, so that rows grow with the text and not with its depth. ``block_path`` and ``block_model`` are of the innermost
    block around the node (null outside of blocks), ``fields_path`` is where its fields stand (empty for the document itself), ``parent_type`` is the member
    ``type`` of the object that the node is a member of. ``place`` (keys, and indexes of eight digits) orders the nodes of a document, ``shape`` has the opening bracket of
    each container around the node, ``name`` is the quoted key: ``fold_documents`` builds texts from these. ``chain`` has the depths of the nodes of structured text around
    and at the node, ``types`` is set for such nodes: their types from the root of their text on.

    A text is parsed once and unfolded in one pass without a shuffle; a task holds one text at a time. Of a key that repeats in an object the last value counts. Null, text
    that is no JSON, and text with a number beyond doubles give no rows (``unreadable_documents`` lists them).
    """
    keys = [c for c in docs.columns if c != value]
    schema = docs.select(*keys).schema
    for f in docs.sparkSession.createDataFrame([], _FIELDS).schema.fields:
        schema = schema.add(f)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            made: list[tuple] = []
            ids = [batch.column(i) for i in range(len(keys))]

            def flush() -> pa.RecordBatch:
                at = pa.array(owners, pa.int32())
                columns = [c.take(at) for c in ids] + [pa.array(c, t) for c, t in zip(zip(*made, strict=True), _ARROW, strict=True)]  # noqa: B023
                owners.clear()
                made.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for row in _nodes(text):
                    owners.append(i)
                    made.append(row)
                    if len(made) == 8192:
                        yield flush()
            if made:
                yield flush()

    rows = docs.select(*keys, value).mapInArrow(run, schema)
    return rows.withColumn("value", F.when(F.col("kind") == "number", number_text(F.col("value"))).otherwise(F.col("value")))


def _read(text: str | None):
    """The value of a JSON text, with numbers as they stand; None for null and for what is no JSON."""
    try:
        return _DECODE(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def _place(frame: tuple) -> str:
    """The path of a container: frames lead from it to the root, ``(value, frame around, key or index, block, field)``."""
    parts = []
    while frame[1] is not None:
        key = frame[2]
        parts.append(f"[{key}]" if key.__class__ is int else f".{key}")
        frame = frame[1]
    parts.reverse()
    return "".join(parts)


def _model_of(value: dict) -> str | None:
    """The model that an object names if it is a block."""
    if value.get("type") != "item" or value.get("id") is None:
        return None
    return _member(value, "item_type", "id") or _member(value, "relationships", "item_type", "data", "id") or _member(value, "__itemTypeId")


def _named(names: frozenset[str], lists: bool):
    """Finder of strings that are members of one of these names, with ``lists`` also in a list that is: ``path, text``."""

    def find(root) -> Iterator[tuple]:
        open_ = [(root, None, None)] if root.__class__ in (dict, list) else []
        for frame in open_:
            value = frame[0]
            if value.__class__ is list:
                at = None
                for i, x in enumerate(value):
                    c = x.__class__
                    if c is dict or c is list:
                        open_.append((x, frame, i))
                    elif c is str and lists and frame[2].__class__ is str and frame[2] in names:
                        at = at or _place(frame)
                        yield f"{at}[{i}]", x
                continue
            for k, x in value.items():
                c = x.__class__
                if c is str:
                    if k in names:
                        yield f"{_place(frame)}.{k}", x
                elif c is dict or c is list:
                    open_.append((x, frame, k))

    return find


def _texts(root) -> Iterator[tuple]:
    """Finder of all different strings of a document."""
    if root.__class__ is str:
        return iter([(root,)])
    seen: set[str] = set()
    open_ = [root]
    for value in open_:
        if value.__class__ is dict:
            value = value.values()
        elif value.__class__ is not list:
            continue
        for x in value:
            if x.__class__ is str:
                seen.add(x)
            else:
                open_.append(x)
    return ((x,) for x in seen)


def _blocks(root) -> Iterator[tuple]:
    """Finder of blocks whose id is a string: ``block_path, block_model, block_id, owner_path, owner_model``."""
    none = (None, None)
    open_ = [(root, None, None, none)] if root.__class__ in (dict, list) else []
    for frame in open_:
        value, owner = frame[0], frame[3]
        if value.__class__ is list:
            for i, x in enumerate(value):
                c = x.__class__
                if c is dict or c is list:
                    open_.append((x, frame, i, owner))
            continue
        if "type" in value and value["type"] == "item" and frame[1] is not None and value.get("id").__class__ is str:
            model = _model_of(value)
            if model:
                at = _place(frame)
                yield at, model, value["id"], *owner
                owner = (at, model)
        for k, x in value.items():
            c = x.__class__
            if c is dict or c is list:
                open_.append((x, frame, k, owner))


def _links(names: frozenset[str]):
    """Finder of strings below a field of one of these names (of the innermost block), and of links in structured text: ``path, text, block_model, _field, _text, parent_type``."""

    def find(root) -> Iterator[tuple]:
        # block: its model, whether its reserved members stand beside its fields; field: null outside of fields, and _HOLDS at the object that holds them
        open_ = [(root, None, None, (None, False), _HOLDS)] if root.__class__ in (dict, list) else []
        for frame in open_:
            value, around, _, block, field = frame
            if value.__class__ is list:
                if field == _HOLDS:
                    field = None
                for i, x in enumerate(value):
                    c = x.__class__
                    if c is dict or c is list:
                        open_.append((x, frame, i, block, field))
                    elif c is str and field in names:
                        yield f"{_place(frame)}[{i}]", x, block[0], field, False, None
                continue
            own = value.get("type")
            if own.__class__ is not str:
                own = None
            apart = False
            if own == "item" and around is not None:
                model = _model_of(value)
                if model:
                    apart = value.get("attributes").__class__ is dict
                    block, field = (model, not apart), None if apart else _HOLDS
            in_text = own == "itemLink" or own == "inlineItem"
            for k, x in value.items():
                c = x.__class__
                if c is not str and c is not dict and c is not list:
                    continue
                below = field
                if field == _HOLDS:
                    below = k if "." not in k and "[" not in k else _FIELD(k)[0]
                    if block[1] and below in RESERVED:
                        below = None
                elif apart and k == "attributes":
                    below = _HOLDS
                if c is not str:
                    open_.append((x, frame, k, block, below))
                elif in_text and k == "item":
                    yield f"{_place(frame)}.{k}", x, block[0], below, True, own
                elif below in names:
                    yield f"{_place(frame)}.{k}", x, block[0], below, False, own

    return find


def without_cycles(run):
    """A pass over batches during which the collector of cycles rests: trees have none to find."""

    def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return rested


def _found(docs: DataFrame, find, schema: str, value: str, once: bool = False) -> DataFrame:
    """What ``find`` gives for each document, as rows of ``schema`` behind the other columns of ``docs``; with ``once``, a row that a batch repeats is given once."""
    keys = [c for c in docs.columns if c != value]
    out = docs.select(*keys).schema
    for f in docs.sparkSession.createDataFrame([], schema).schema.fields:
        out = out.add(f)
    names = [f.name for f in out.fields]
    types = [pa.bool_() if f.dataType.typeName() == "boolean" else pa.string() for f in out.fields[len(keys) :]]

    def column(cells: tuple, type_: pa.DataType) -> pa.Array:
        try:
            return pa.array(cells, type_)
        except UnicodeEncodeError:  # half of a surrogate pair
            return pa.array([c if c is None else c.encode("utf-8", "replace").decode() for c in cells], type_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i) for i in range(len(keys))]
            owners: list[int] = []
            made: list[tuple] = []

            def flush() -> pa.RecordBatch:
                at = pa.array(owners, pa.int32())  # noqa: B023
                columns = [c.take(at) for c in ids] + [column(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]  # noqa: B023
                owners.clear()  # noqa: B023
                made.clear()  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names)

            texts = batch.column(len(keys)).to_pylist()
            if once:
                known = list(zip(*(c.to_pylist() for c in ids), strict=True)) or [()] * len(texts)
                first: dict[tuple, int] = {}
                for i, text in enumerate(texts):
                    for row in find(_read(text)):
                        first.setdefault((known[i], row), i)
                made.extend(row for _, row in first)
                owners.extend(first.values())
            else:
                for i, text in enumerate(texts):
                    before = len(made)
                    made.extend(find(_read(text)))
                    owners.extend([i] * (len(made) - before))
                    if len(made) >= 8192:
                        yield flush()
            if made:
                yield flush()

    return docs.select(*keys, value).mapInArrow(without_cycles(run), out)


def named_texts(docs: DataFrame, names: tuple[str, ...], value: str = "value", lists: bool = False) -> DataFrame:
    """``path, text``: the strings of documents that are members of one of ``names``, with ``lists`` also in a list that is; like ``explode_document``, without the nodes that a caller does not want."""
    return _found(docs, _named(frozenset(names), lists), "path string, text string", value)


def all_texts(docs: DataFrame, value: str = "value") -> DataFrame:
    """``text``: the different strings of each document, wherever they stand."""
    return _found(docs, _texts, "text string", value)


def explode_blocks(docs: DataFrame, value: str = "value") -> DataFrame:
    """``block_path, block_model, block_id, owner_path, owner_model``: every block of a document whose id is a string, and the innermost block around it (null if there is none)."""
    return _found(docs, _blocks, "block_path string, block_model string, block_id string, owner_path string, owner_model string", value)


def link_texts(docs: DataFrame, names: tuple[str, ...], value: str = "value", once: bool = False) -> DataFrame:
    """Strings of documents that may be references: below a field of ``names``, or links in structured text. ``references`` takes them as it takes exploded rows.

    With ``once`` paths are left out, and so are repetitions in a batch.
    """
    find = _links(frozenset(names))
    if once:
        return _found(docs, lambda root: (row[1:] for row in find(root)), _LINK_ROWS, value, once)
    return _found(docs, find, f"path string, {_LINK_ROWS}", value)


def unreadable_documents(docs: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose text is there but cannot be unfolded: no JSON, or a number beyond doubles."""
    from planweave.functions.canonical import canonical_json

    return docs.where(F.col(value).isNotNull() & canonical_json(F.col(value)).isNull())


def typed_rows(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the link field that they belong to: ``_name`` (null if it is none), ``required``, and ``_text`` for links in structured text. Rows of ``link_texts`` know their field."""
    inside = F.col("path").startswith(F.concat("fields_path", F.lit(".")))
    field = F.when(inside, F.regexp_extract(F.expr("substring(path, length(fields_path) + 1)"), r"^\.([^.\[]+)", 1))
    beside = F.col("block_path").isNotNull() & (F.col("fields_path") == F.col("block_path")) & field.isin(*RESERVED)
    text = F.coalesce(F.col("parent_type").isin("itemLink", "inlineItem") & F.col("path").endswith(".item"), F.lit(False))
    model = F.coalesce("block_model", "item_type_id") if "item_type_id" in rows.columns else F.col("block_model")
    found = (rows if "_field" in rows.columns else rows.withColumn("_field", F.when(~beside, field)).withColumn("_text", text)).withColumn("_model", model)
    is_text = F.coalesce(F.col("kind") == "text", F.lit(False)) if "kind" in links.columns else F.lit(False)
    by_model = "item_type_id" in links.columns
    known = links.select(F.col("field").alias("_name"), "required", is_text.alias("_in_text"), *([F.col("item_type_id").alias("_link_model")] if by_model else []))
    same = (F.col("_field") == F.col("_name")) & (F.col("_text") == F.col("_in_text"))
    if by_model:
        same &= F.col("_model").eqNullSafe(F.col("_link_model"))
    return found.join(F.broadcast(known), same, "left")  # a schema's fields are few


def references(rows: DataFrame, links: DataFrame, unique: bool = False) -> DataFrame:
    """Edges ``from_id, to_id, path, required`` from exploded rows, or rows of ``link_texts``, and link fields ``field, required`` (small), at any depth.

    A field belongs to the innermost block around it, or to the record. With a column ``item_type_id``, a link field is one of that model, else of every
    model; records have the ``item_type_id`` of their rows, or null without that column. Links in structured text (``item`` of itemLink and inlineItem)
    are edges in every field; ``required`` is that of the field's row of ``kind`` text, else false. Rows of another ``kind``, or all without
    that column, are fields of links: each string in them is an edge. Several texts of a record may hold the same edge; with ``unique`` a record has one text, and nothing is compared.
    """
    known = "text" in rows.columns
    hit = typed_rows(rows if known else rows.where("kind = 'string'"), links).where("_text OR _name IS NOT NULL")
    to = F.col("text") if known else F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    found = hit.select(F.col("record_id").alias("from_id"), to.alias("to_id"), "path", F.coalesce("required", F.lit(False)).alias("required"))
    return found if unique else found.distinct()


def parent_edges(records: DataFrame) -> DataFrame:
    """The required edge of a record to its parent."""
    return records.where("parent_id IS NOT NULL").select(F.col("record_id").alias("from_id"), F.col("parent_id").alias("to_id"), F.lit("parent").alias("path"), F.lit(True).alias("required"))


def slices(records: DataFrame) -> DataFrame:
    """Long form of the two slices: ``record_id, item_type_id, slice, fields``; an absent published slice has no row."""
    both = F.array(F.struct(F.lit("current").alias("slice"), F.col("current").alias("fields")), F.struct(F.lit("published").alias("slice"), F.col("published").alias("fields")))
    return records.select("record_id", "item_type_id", F.inline(both)).where("fields IS NOT NULL")


def strip_values(links: Column, targets: Column) -> Column:
    """An array of links without those in ``targets``."""
    return F.filter(links, lambda x: ~F.array_contains(targets, x))


def block_ownership(blocks: DataFrame) -> DataFrame:
    """Ownership conflicts of blocks ``block_id, record_id, slice, location``: blocks with several locations, or twice at one location of one slice."""
    per = blocks.groupBy("block_id").agg(
        F.countDistinct("record_id", "location").alias("n_locations"), F.count("*").alias("n_rows"), F.countDistinct("record_id", "location", "slice").alias("n_versions")
    )
    return per.where("n_locations > 1 OR n_rows > n_versions")


def text_runs(spans: DataFrame) -> DataFrame:
    """Adjacent spans of equal marks merged: ``doc_id, run, marks, text`` from ``doc_id, i, marks, text``; empty spans are dropped.

    Gaps and islands: a run begins where the marks differ from those before.
    """
    order = W.partitionBy("doc_id").orderBy("i")
    some = spans.where("text <> ''").withColumn("new", F.coalesce(~F.lag("marks").over(order).eqNullSafe(F.col("marks")), F.lit(True)).cast("int"))
    numbered = some.withColumn("run", F.sum("new").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "")
    return numbered.groupBy("doc_id", "run").agg(F.first("marks").alias("marks"), joined.alias("text"))

