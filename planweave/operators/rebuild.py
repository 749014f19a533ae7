"""Documents put together again from their rows (``explode_document``): fold, references taken out, ids rewritten, defaults filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.operators.blocks import plain
from planweave.operators.explode import typed_rows
from planweave.operators.store import kept

#: What stays of a structured text of which nothing is left, and of a link around an empty text. Fixed values.
EMPTY_ROOT = '{"children":[{"children":[{"type":"span","value":""}],"type":"paragraph"}],"type":"root"}'
EMPTY_SPAN = '{"type":"span","value":""}'
_LINKS = ("link", "itemLink")


def fold_documents(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys..., value, hash``: the canonical JSON text of each document from its rows, and its hash; the inverse of ``explode_document``.

    Rows come in any order and need ``place, depth, shape, name, kind, value``. One group-by a document: in the order of places, each row adds its comma, key and value or bracket,
    and closes the containers that end behind it. A document has to fit in a row, as it does in its text.
    """
    keys = keys or ("record_id",)
    parts = F.array_sort(F.collect_list(F.struct("place", "depth", "shape", "name", "kind", "value")))
    all_ = rows.groupBy(*keys).agg(parts.alias("_rows"))

    def piece(rows: Column, x: Column, i: Column) -> Column:
        before = F.try_element_at(rows, i.cast("int"))
        after = F.coalesce(F.try_element_at(rows, (i + 2).cast("int"))["depth"], F.lit(0))
        opens = F.when(x["value"].isNotNull(), "").when(x["kind"] == "object", "{").otherwise("[")
        comma = F.when((i > 0) & (F.when(i > 0, before["depth"]) >= x["depth"]), ",").otherwise("")
        key = F.when(x["name"].isNotNull() & x["shape"].endswith("{"), F.concat(x["name"], F.lit(":"))).otherwise("")
        closed = F.reverse(F.translate(F.substr(F.concat(x["shape"], opens), after + 1), "{[", "}]"))
        return F.concat(comma, key, F.coalesce(x["value"], opens), closed)

    # the outer array of one element binds the sorted rows to a name, else the optimizer would sort them anew for every row
    text = F.transform(F.array("_rows"), lambda rows: F.array_join(F.transform(rows, lambda x, i: piece(rows, x, i)), ""))[0]
    return all_.select(*keys, text.alias("value")).withColumn("hash", F.sha2("value", 256))


def _prefix(place: str, n) -> Column:
    return F.slice(F.col(place), F.lit(1), n)


def _text_nodes(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys..., node, chain, types, type, text, style, marks, parent``: a row per node of structured text; ``text`` is a span's, ``parent`` tells that it has children."""
    own = F.try_element_at("chain", F.lit(-1))
    inside = rows.where(F.size("chain") > 0).withColumn("_at", own)
    is_node = F.col("types").isNotNull()
    name = F.when(F.col("depth") == F.col("_at") + 1, F.try_element_at("place", F.lit(-1)))
    mark = (F.col("depth") == F.col("_at") + 2) & (F.try_element_at("place", F.col("_at") + 1) == "marks")
    of = lambda what, kind, c: F.max(F.when((name == what) & (F.col("kind") == kind), F.col(c)))
    near = inside.where(is_node | (F.col("depth") <= F.col("_at") + 2)).withColumn("node", _prefix("place", F.col("_at")))
    return near.groupBy(*keys, "node").agg(
        F.max(F.when(is_node, F.col("chain"))).alias("chain"),
        F.max(F.when(is_node, F.col("types"))).alias("types"),
        of("value", "string", "value").alias("text"),
        of("style", "string", "value").alias("style"),
        F.array_sort(F.collect_set(F.when(mark, F.col("value")))).alias("marks"),
        F.coalesce(F.max((name == "children") & (F.col("kind") == "array")), F.lit(False)).alias("parent"),
    ).withColumn("type", F.try_element_at("types", F.lit(-1)))


def _node_fates(nodes: DataFrame, actions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What becomes of each node of structured text: ``keys..., node, fate, text, cuts, moves``.

    ``actions`` (``keys..., node, action``): nodes to remove (``gone``) or to replace by their children (``unwrap``). A node without children left goes; a link around nothing but empty
    texts is an empty text; of empty texts only one stays where nothing else does; neighbouring texts of equal marks and neighbouring lists of one style become one. None of this needs a walk:
    whether something is left below a node follows from its leaves, and what merges from its neighbours. ``cuts`` are the depths of unwrapped nodes around a node, ``moves`` says under which list a merged
    one's items go.
    """
    met = kept(nodes, "text-nodes").join(actions, [*keys, "node"], "left")
    met = met.withColumn("_gone", F.coalesce(F.col("action") == "gone", F.lit(False))).withColumn("_unwrap", F.coalesce(F.col("action") == "unwrap", F.lit(False)))
    met = met.withColumn("_empty", F.coalesce((F.col("type") == "span") & (F.col("text") == '""') & ~F.col("parent"), F.lit(False)))
    n = F.size("types")
    leaves = met.where("NOT parent AND NOT _gone")
    above = leaves.select(*keys, "node", "chain", "types", "_empty", F.explode(F.sequence(F.lit(1), n)).alias("_k")).where(F.col("_k") < F.size("types"))
    between = F.expr("exists(slice(types, _k + 1, size(types) - _k - 1), t -> t IS NULL OR t NOT IN ('link', 'itemLink'))")
    depth = F.try_element_at("chain", F.size("chain") - F.size("types") + F.col("_k"))
    alive = above.select(*keys, _prefix("node", depth).alias("node"), (~F.col("_empty") | between).alias("_solid")).groupBy(*keys, "node").agg(F.max("_solid").alias("_solid"))
    seen = met.join(alive, [*keys, "node"], "left")
    dead = F.when(F.col("parent"), F.col("_solid").isNull()).otherwise(F.col("_gone"))
    hollow = ~F.col("_unwrap") & F.col("parent") & F.col("type").isin(*_LINKS) & ~F.coalesce("_solid", F.lit(True))
    judged = kept(seen.withColumn("_dead", dead).withColumn("_hollow", hollow), "text-nodes")

    special = judged.where("_unwrap OR _hollow").select(*keys, F.col("node").alias("_around"), "_unwrap")
    around = judged.select(*keys, "node", F.explode("chain").alias("_d")).withColumn("_around", _prefix("node", F.col("_d")))
    within = around.join(special, [*keys, "_around"]).groupBy(*keys, "node").agg(
        F.sort_array(F.collect_set(F.when(F.col("_unwrap"), F.col("_d"))), asc=False).alias("cuts"),
        F.max(~F.col("_unwrap") & (F.col("_d") < F.size("node"))).alias("_in_hollow"),
    )
    placed = judged.join(within, [*keys, "node"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>"))).withColumn("_in_hollow", F.coalesce("_in_hollow", F.lit(False)))
    placed = kept(placed, "placed-nodes")

    element = placed.where("NOT _dead AND NOT _unwrap AND NOT _in_hollow AND size(types) > 1")
    up = F.expr("try_element_at(filter(slice(chain, size(chain) - size(types) + 1, size(types) - 1), c -> NOT array_contains(cuts, c)), -1)")
    element = element.withColumn("_list", _prefix("node", up)).withColumn("_void", F.col("_empty") | F.col("_hollow"))
    siblings = W.partitionBy(*keys, "_list")
    some = element.withColumn("_full", F.sum((~F.col("_void")).cast("int")).over(siblings)).withColumn("_last", F.max("node").over(siblings))
    stays = some.where(~F.col("_void") | ((F.col("_full") == 0) & (F.col("node") == F.col("_last"))))
    order = siblings.orderBy("node")
    same = lambda c: F.lag(c).over(order).eqNullSafe(F.col(c))
    texts = (F.col("type") == "span") & F.col("text").isNotNull() & F.lag("text").over(order).isNotNull() & same("marks")
    lists = (F.col("type") == "list") & F.col("parent") & same("style")
    joins = F.coalesce(same("type") & (texts | lists), F.lit(False))
    islands = kept(stays.withColumn("_joins", joins).withColumn("_island", F.sum((~F.col("_joins")).cast("int")).over(order)), "islands")
    body = F.expr("substring(text, 2, length(text) - 2)")
    groups = islands.where("type IN ('span', 'list')").groupBy(*keys, "_list", "_island").agg(
        F.min("node").alias("_first"), F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", body.alias("t")))), lambda e: e["t"]), "").alias("_joined")
    )
    met = islands.select(*keys, "node", "_list", "_island", "_joins").join(groups.where("_n > 1"), [*keys, "_list", "_island"], "left").select(*keys, "node", "_joins", "_first", "_joined")
    all_ = placed.join(met, [*keys, "node"], "left")
    fate = (
        F.when(F.col("_dead") & (F.size("types") == 1), "blank")
        .when(F.col("_dead") | F.col("_in_hollow"), "drop")
        .when(F.col("_unwrap"), "unwrap")
        .when((F.size("types") > 1) & F.col("_joins").isNull(), "drop")
        .when(F.col("_joins") & (F.col("type") == "list"), "move")
        .when(F.col("_joins"), "drop")
        .when(F.col("_hollow"), "hollow")
        .otherwise("keep")
    )
    text = F.when((F.col("type") == "span") & F.col("_first").isNotNull(), F.concat(F.lit('"'), "_joined", F.lit('"'))).otherwise(F.col("text"))
    known = kept(all_.withColumn("fate", fate).select(*keys, "node", "chain", "fate", text.alias("text"), "cuts", "_first"), "fates")
    moved = known.where("fate = 'move'").select(*keys, F.col("node").alias("_around"), "_first")
    under = known.select(*keys, "node", F.explode("chain").alias("_d")).withColumn("_around", _prefix("node", F.col("_d"))).join(moved, [*keys, "_around"])
    moves = under.groupBy(*keys, "node").agg(F.sort_array(F.collect_list(F.struct(F.col("_d").alias("at"), F.col("_first").alias("to"))), asc=False).alias("moves"))
    return known.drop("chain", "_first").join(moves, [*keys, "node"], "left")


def _moved(place: Column, moves: Column) -> Column:
    """A place below merged lists: behind the items of the first of them."""

    def step(p: Column, m: Column) -> Column:
        at = m["at"]
        late = F.concat(F.lit("99999999|"), F.array_join(F.slice(p, F.lit(1), at), "|"), F.lit("|"), F.element_at(p, at + 2))
        rest = F.slice(p, at + 3, F.greatest(F.size(p) - at - 2, F.lit(0)))
        return F.concat(m["to"], F.array(F.lit("children"), late), rest)

    return F.aggregate(moves, place, step)


def _cut(shape: Column, cuts: Column) -> Column:
    """A shape without the brackets of unwrapped nodes and of their lists of children."""
    return F.aggregate(cuts, shape, lambda s, c: F.concat(F.substr(s, F.lit(1), c), F.substr(s, c + 3)))


def normalize_texts(rows: DataFrame, actions: DataFrame, *keys: str) -> DataFrame:
    """Rows of documents after ``actions`` on nodes of structured text (``keys..., node, action``), with all structured text in normal form.

    An action removes a node (``gone``) or puts its children in its place (``unwrap``); an empty table of actions only normalises. Rows outside of structured text pass through. A text of which nothing is
    left is a root with one empty paragraph.
    """
    keys = keys or ("record_id",)
    rows = kept(rows, "rows")
    fates = _node_fates(_text_nodes(rows, keys), actions, keys)
    columns = rows.columns
    own = F.try_element_at("chain", F.lit(-1))
    inside = rows.where(F.size("chain") > 0).withColumn("node", _prefix("place", own)).join(fates.withColumnRenamed("text", "_text"), [*keys, "node"])
    at = F.size("node")
    is_node = F.col("depth") == at
    name = F.when(F.col("depth") > at, F.try_element_at("place", at + 1))
    stays = (F.col("fate") == "keep") & ~F.coalesce((name == "marks") & (F.col("_text") == '""'), F.lit(False))
    whole = F.when(F.col("fate") == "hollow", EMPTY_SPAN).when(F.col("fate") == "blank", EMPTY_ROOT)
    out = inside.where(stays | (is_node & F.col("fate").isin("hollow", "blank")))
    text = F.coalesce((name == "value") & (F.col("depth") == at + 1) & F.col("_text").isNotNull(), F.lit(False))
    cut = F.filter("cuts", lambda c: c < F.col("depth"))
    done = out.withColumn("value", F.when(text, F.col("_text")).otherwise(F.coalesce(whole, F.col("value"))))
    done = done.withColumn("place", F.when(F.col("moves").isNotNull(), _moved(F.col("place"), F.col("moves"))).otherwise(F.col("place")))
    done = done.withColumn("shape", F.when(F.size(cut) > 0, _cut(F.col("shape"), cut)).otherwise(F.col("shape")))
    done = done.withColumn("depth", F.col("depth") - 2 * F.size(cut))
    return rows.where(F.size("chain") == 0).unionByName(done.select(columns))


def reference_rows(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows that are references, with ``to_id, required, in_text`` beside their columns; ``fields`` as of ``references``."""
    typed = typed_rows(rows, fields)
    return typed.where("kind = 'string' AND (_text OR _name IS NOT NULL)").select(
        *rows.columns, plain(F.col("value")).alias("to_id"), F.coalesce("required", F.lit(False)).alias("required"), F.col("_text").alias("in_text")
    )


def strip_references(rows: DataFrame, fields: DataFrame, targets: DataFrame, *keys: str, force: bool = False) -> DataFrame:
    """Rows of documents without their optional references to ``targets`` (``to_id``, and any of ``keys`` for targets of one document); with ``force``, without required ones too.

    ``fields``: ``item_type_id, field, required, kind`` (kind ``link`` for fields of one or many ids, ``text`` for structured text). A link becomes null, an id leaves its list, an inline item goes, and a link
    around text leaves the text behind; then all structured text is in normal form (``normalize_texts``).
    """
    keys = keys or ("record_id",)
    rows = kept(rows, "rows")
    found = reference_rows(rows, fields).where(F.lit(force) | ~F.col("required"))
    on = [k for k in keys if k in targets.columns] + ["to_id"]
    hits = found.join(targets.select(*on).distinct(), on, "left_semi")
    nodes = hits.where("in_text").select(*keys, _prefix("place", F.try_element_at("chain", F.lit(-1))).alias("node"), F.when(F.col("parent_type") == "inlineItem", "gone").otherwise("unwrap").alias("action")).distinct()
    nodes = kept(nodes, "actions")
    links = hits.where("NOT in_text").select(*keys, "place", F.lit(True).alias("_hit"))
    left = rows.join(links, [*keys, "place"], "left")
    listed = F.col("shape").endswith("[")
    gone = F.col("_hit") & ~listed
    left = left.where(F.col("_hit").isNull() | ~listed).withColumn("value", F.when(gone, "null").otherwise(F.col("value"))).withColumn("kind", F.when(gone, "null").otherwise(F.col("kind")))
    return normalize_texts(left.select(rows.columns), nodes, *keys)


def project_versions(rows: DataFrame, fields: DataFrame, targets: DataFrame, *keys: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Versions without their references to targets: ``keys..., value, hash``, and ``keys..., path, to_id``: references to targets that stay in the way, as they are required."""
    keys = keys or ("record_id",)
    on = [k for k in keys if k in targets.columns] + ["to_id"]
    stay = reference_rows(rows, fields).join(targets.select(*on).distinct(), on, "left_semi").where(~F.lit(force) & F.col("required")).select(*keys, "path", "to_id")
    return fold_documents(strip_references(rows, fields, targets, *keys, force=force), *keys), stay


def typed_ids(rows: DataFrame, fields: DataFrame, *keys: str) -> DataFrame:
    """``keys..., place, kind, id``: every id in documents by what it names: ``record`` (links, also in texts), ``block`` (a block's own id), ``upload`` (``upload_id`` of an asset). Other texts that look like ids are none."""
    keys = keys or ("record_id",)
    records = reference_rows(rows, fields).select(*keys, "place", F.lit("record").alias("kind"), F.col("to_id").alias("id"))
    texts = rows.where("kind = 'string'")
    blocks = texts.where(F.col("path") == F.concat("block_path", F.lit(".id"))).select(*keys, "place", F.lit("block").alias("kind"), plain(F.col("value")).alias("id"))
    uploads = texts.where(F.try_element_at("place", F.lit(-1)) == "upload_id").select(*keys, "place", F.lit("upload").alias("kind"), plain(F.col("value")).alias("id"))
    return records.unionByName(blocks).unionByName(uploads)


def record_ids(links: DataFrame, fields: DataFrame) -> DataFrame:
    """``kind, id``: the different ids of records in rows of ``link_texts``."""
    return typed_rows(links, fields).where("_text OR _name IS NOT NULL").select(F.lit("record").alias("kind"), F.col("text").alias("id")).distinct()


def rewrite_ids(rows: DataFrame, fields: DataFrame, mapping: DataFrame, *keys: str) -> DataFrame:
    """Rows of documents with ids replaced by ``mapping`` (``kind, old_id, new_id``; one row an old id) at the places of their kind; all else stays, as do ids without an entry."""
    keys = keys or ("record_id",)
    entry = mapping.select(F.col("kind").alias("kind"), F.col("old_id").alias("id"), "new_id")
    new = typed_ids(rows, fields, *keys).join(entry, ["kind", "id"]).select(*keys, "place", "new_id")
    quoted = F.expr("substring(to_json(named_struct('v', new_id)), 6, length(to_json(named_struct('v', new_id))) - 6)")
    met = rows.join(new, [*keys, "place"], "left")
    return met.withColumn("value", F.when(F.col("new_id").isNotNull(), quoted).otherwise(F.col("value"))).select(rows.columns)


def merged_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """``kind, id, n``: ids (``kind, id``) that several ids become under a mapping: entries with one new id, and ids without an entry that equal one."""
    entry = mapping.select("kind", F.col("old_id").alias("id"), "new_id")
    after = ids.select("kind", "id").distinct().join(entry, ["kind", "id"], "left").select("kind", F.coalesce("new_id", "id").alias("id"))
    return after.groupBy("kind", "id").agg(F.count("*").alias("n")).where("n > 1")


def fill_defaults(rows: DataFrame, defaults: DataFrame, *keys: str) -> DataFrame:
    """Rows of documents with the default of each field that the document or a block in it lacks.

    ``defaults``: ``item_type_id, field, value`` (JSON text of a plain value, or of an empty container) and ``locales`` (array; null for a field that is not localized): a localized field gets an object
    of its locales, and one that is there gets the locales that it lacks. The document's own model is its ``item_type_id``; blocks that a default would bring in are not unfolded.
    """
    keys = keys or ("record_id",)
    rows = kept(rows, "rows")
    top = rows.where("depth = 0 AND kind = 'object'").select(*keys, "item_type_id", F.col("place").alias("_at"), F.col("shape").alias("_shape"), "block_path", "block_model", "fields_path", "chain")
    starts = rows.where("depth > 0 AND block_path IS NOT NULL AND block_model IS NOT NULL").select(*keys, F.col("block_path").alias("_p"), "block_model", "fields_path").distinct()
    homes = rows.where("depth > 0 AND kind = 'object'").select(*keys, F.col("path").alias("fields_path"), F.col("place").alias("_at"), F.col("shape").alias("_shape"), "chain").join(starts, [*keys, "fields_path"])
    homes = homes.select(*keys, F.col("block_model").alias("item_type_id"), "_at", "_shape", F.col("_p").alias("block_path"), "block_model", "fields_path", "chain")
    owners = top.select(homes.columns).unionByName(homes)
    wanted = owners.join(F.broadcast(defaults), "item_type_id")  # a schema's fields are few
    members = rows.where("depth > 0").select(*keys, F.col("place").alias("_field"), F.col("kind").alias("_kind"))
    field = wanted.withColumn("_field", F.concat("_at", F.array("field")))
    met = field.join(members, [*keys, "_field"], "left")
    quoted = F.concat(F.lit('"'), "field", F.lit('"'))

    def made(df: DataFrame, place: Column, shape: Column, name: Column, value: Column, path: Column) -> DataFrame:
        kind = F.when(value.isNull() | value.startswith("{"), "object").when(value.startswith("["), "array").when(value == "null", "null").when(value.startswith('"'), "string")
        kind = kind.when(value.isin("true", "false"), "boolean").otherwise("number")
        cells = {"path": path, "depth": F.size(place), "kind": kind, "value": value, "parent_type": F.lit(None).cast("string"), "place": place, "shape": shape, "name": name, "types": F.lit(None).cast("array<string>")}
        return df.select(*(cells[c].alias(c) if c in cells else F.col(c) for c in rows.columns))

    lacking = met.where("_kind IS NULL")
    path = F.concat("fields_path", F.lit("."), "field")
    brace = F.concat("_shape", F.lit("{"))
    flat = made(lacking.where("locales IS NULL"), F.col("_field"), brace, quoted, F.col("value"), path)
    objects = made(lacking.where("locales IS NOT NULL"), F.col("_field"), brace, quoted, F.lit(None).cast("string"), path)
    each = met.where("locales IS NOT NULL AND (_kind IS NULL OR _kind = 'object')").withColumn("_locale", F.explode("locales")).withColumn("_cell", F.concat("_field", F.array("_locale")))
    there = members.select(*keys, F.col("_field").alias("_cell"))
    cells = each.join(there, [*keys, "_cell"], "left_anti")
    localized = made(cells, F.col("_cell"), F.concat(brace, F.lit("{")), F.concat(F.lit('"'), "_locale", F.lit('"')), F.col("value"), F.concat(path, F.lit("."), "_locale"))
    parents = each.select(*keys, F.col("_field").alias("place")).unionByName(lacking.select(*keys, F.col("_at").alias("place"))).distinct()
    opened = rows.join(parents.withColumn("_opened", F.lit(True)), [*keys, "place"], "left")  # an empty object that gets members is no leaf any more
    opened = opened.withColumn("value", F.when(F.col("_opened") & (F.col("value") == "{}"), None).otherwise(F.col("value"))).select(rows.columns)
    return opened.unionByName(flat).unionByName(objects).unionByName(localized)
