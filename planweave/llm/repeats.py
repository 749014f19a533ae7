"""Removing repeated byte strings across documents with suffix arrays.

Every window of WINDOW bytes picks an anchor, a gram of its own content (``anchors``), so equal windows meet under one anchor. Runs of windows under
an anchor are contexts. Equal contexts need no sorting: the earliest stays. Where an anchor has several contexts, a suffix array of them
(``suffix_groups``) brings equal windows together. An anchor with too many to be sorted by one task is split by more of the windows' content:
windows whose anchor lies in one stretch of offsets also share the bytes around it, so the stretch and these bytes make smaller groups, of shorter contexts,
which are sorted in turn; what is still too large is split until a group is one window, where nothing is left to sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.llm.anchors import GRAM, anchors
from planweave.llm.common import documents, in_slices, stored
from planweave.llm.suffix_groups import suffix_arrays

WINDOW = 100
#: Contexts that are sorted together; larger groups are split by content first.
SORTED_CONTEXTS = 64
#: Offsets of the anchor in a window that make one group when an anchor is split, in turn, until a group is one window.
STRETCHES = (20, 5, 1)
#: Bytes of contexts that a task sorts at a time.
SORTED_BYTES = 3 << 20
#: Anchors with so many contexts in a sample of so many documents are dealt by context from the start. This decides where rows go, not what is found.
SAMPLE_DOCUMENTS, HOT_CONTEXTS = 5_000, 25
#: Rows up to which a list of ids may be broadcast (16 MB); longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NULL_ID = -(1 << 63)

_LONGS = lambda *names: {n: pa.int64() for n in names}
_KEY = ["doc", "tag"]


def _batch(kinds: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _rows_batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return _batch(kinds, *(zip(*rows, strict=True) if rows else [()] * len(kinds)))


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, tag, text``: the id that orders documents (null first), and 64 bits of the text where rows share an id, else 0."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text")
    several = stored(rows.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", F.lit(True).alias("several")), "repeated-ids")
    n = several.count()
    if not n:
        return rows.select("doc", F.lit(0).cast("long").alias("tag"), "text")
    met = rows.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "doc", "left")
    return met.select("doc", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("tag"), "text")


def occurrences(keyed: DataFrame, window: int = WINDOW, hot: np.ndarray | None = None) -> DataFrame:
    """``gram, ctx, ctx2, doc, tag, at, lane``: one row per run of windows with one anchor.

    ``ctx`` and ``ctx2`` are 128 bits of a hash of the context's bytes; ``at`` packs first window (upper bits), number of windows (8), anchor (8). ``lane`` is 1
    where the same context stands earlier in the same batch, so just one row per batch has to meet the others of its gram; 2 for other rows of ``hot`` anchors.
    """
    kinds = _LONGS("gram", "ctx", "ctx2", "doc", "tag", "at", "lane")
    hot = np.zeros(0, np.int64) if hot is None else np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4096):
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [_utf8(t) for t in batch.column(2).to_pylist()]
            number, gram, first, count, behind = anchors(texts, window)
            digest = xxhash.xxh3_128_digest
            ends = (first + count + window - 1).tolist()
            both = b"".join([digest(texts[n][a:b], k) for n, a, b, k in zip(number.tolist(), first.tolist(), ends, behind.tolist(), strict=True)])
            ctx, ctx2 = np.frombuffer(both, "<i8").reshape(-1, 2).T
            at = (first << 16) | (count << 8) | behind
            gram, doc, tag = gram.view(np.int64), doc[number], tag[number]
            order = np.lexsort((tag, at, doc, ctx2, ctx, gram))
            gram, ctx, ctx2, doc, tag, at = (c[order] for c in (gram, ctx, ctx2, doc, tag, at))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1]) | (ctx2[1:] != ctx2[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = (doc != doc[head]) | (at != at[head]) | (tag != tag[head])
            is_hot = np.isin(gram, hot) if len(hot) else np.zeros(len(gram), bool)
            yield _batch(kinds, gram, ctx, ctx2, doc, tag, at, np.where(again, 1, np.where(is_hot, 2, 0)))

    return keyed.mapInArrow(run, ", ".join(f"{k} long" for k in kinds))


def hot_anchors(keyed: DataFrame, window: int = WINDOW, rows: int = SAMPLE_DOCUMENTS, least: int = HOT_CONTEXTS) -> np.ndarray:
    """Anchors with many contexts, from a sample of about ``rows`` documents, so that there are at most its runs by ``least``."""
    total = keyed.count()
    some = keyed if total <= rows else keyed.sample(fraction=rows / total, seed=1)
    per = occurrences(some, window).select("gram", "ctx").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    return np.array([r["gram"] for r in per.where(F.col("n") >= least).select("gram").collect()], np.int64)


def judged(occ: DataFrame, most: int) -> DataFrame:
    """``kind, gram, doc, tag, at`` of the runs that matter: 0 repeats an equal context; 1 and 2 are the first of one of several contexts of an anchor (2: more than ``most``)."""
    route = F.when(F.col("lane") == 1, F.col("doc")).when(F.col("lane") == 2, F.xxhash64("gram", "ctx")).otherwise(F.col("gram"))
    dealt = occ.withColumn("route", route).repartition("lane", "route")
    place = ["lane", "route"]
    per_gram, per_ctx = W.partitionBy(*place), W.partitionBy(*place, "ctx", "ctx2").orderBy("doc", "at", "tag")
    seen = (
        dealt.sortWithinPartitions(*place, "ctx", "ctx2", "doc", "at", "tag")
        .withColumn("several", F.min("ctx").over(per_gram) != F.max("ctx").over(per_gram))
        .withColumn("repeats", F.first(F.struct("doc", "at", "tag")).over(per_ctx) != F.struct("doc", "at", "tag"))
        .withColumn("contexts", F.sum((F.row_number().over(per_ctx) == 1).cast("int")).over(per_gram))
    )
    many = (F.col("lane") == 2) | (F.col("contexts") > most)
    kind = F.when((F.col("lane") == 1) | F.col("repeats"), 0).when(many, 2).when(F.col("several"), 1)
    return seen.select(kind.alias("kind"), "gram", *_KEY, "at").where("kind IS NOT NULL")


def _stretches(data: bytes, at: int, window: int, stretch: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A context by stretches of offsets of its anchor: ``key, same, same2, at, bytes`` of each shorter context.

    ``key`` is a hash of the bytes that all windows of the stretch share, ``same`` and ``same2`` are 128 bits of the hash of all its bytes.
    """
    first, count, behind = at >> 16, at >> 8 & 0xFF, at & 0xFF
    for low in range((behind - count + 1) // stretch * stretch, behind + 1, stretch):
        top, bottom = min(low + stretch - 1, behind), max(low, behind - count + 1)
        right = max(0, window - GRAM - (low + stretch - 1))
        key = xxhash.xxh3_128_digest(b"%d:" % low + data[behind - low : behind + GRAM + right])
        begin, n = behind - top, top - bottom + 1
        part = data[begin : begin + n + window - 1]
        same = xxhash.xxh3_128_digest(part, top)
        yield _signed(key), _signed(same), _signed(same[8:]), (first + begin) << 16 | n << 8 | top, part


def contexts(keyed: DataFrame, need: DataFrame, window: int) -> DataFrame:
    """``part, key, same, same2, doc, tag, at, bytes`` for the runs in ``need`` (kind 1 and 2).

    Kind 1 gives its context, with the gram as ``key``; kind 2 gives its stretches (``part`` true), with a hash of what their windows share as ``key`` and 128
    bits of the bytes' hash as ``same, same2``.
    """
    kinds = {"part": pa.bool_()} | _LONGS("key", "same", "same2", "doc", "tag", "at") | {"bytes": pa.binary()}
    lists = need.groupBy(*_KEY).agg(F.collect_list(F.struct("kind", "gram", "at")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for doc, tag, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = _utf8(text)
                for r in runs:
                    at = r["at"]
                    begin = at >> 16
                    piece = data[begin : begin + (at >> 8 & 0xFF) + window - 1]
                    if r["kind"] == 1:
                        rows.append((False, r["gram"], 0, 0, doc, tag, at, piece))
                        continue
                    for key, same, same2, at2, part in _stretches(piece, at, window, STRETCHES[0]):
                        rows.append((True, key, same, same2, doc, tag, at2, part))
                if len(rows) >= 20_000:
                    yield _rows_batch(kinds, rows)
                    rows = []
            if rows:
                yield _rows_batch(kinds, rows)

    met = keyed.join(lists, _KEY).select(*_KEY, "text", "runs")
    return met.mapInArrow(run, "part boolean, key long, same long, same2 long, doc long, tag long, at long, bytes binary")


def split_parts(parts: DataFrame, window: int, stretch: int) -> DataFrame:
    """``key, same, same2, doc, tag, at, bytes``: contexts by shorter stretches."""
    kinds = _LONGS("key", "same", "same2", *_KEY, "at") | {"bytes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2048):
            rows = []
            for doc, tag, at, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(key, same, same2, doc, tag, at2, part) for key, same, same2, at2, part in _stretches(data, at, window, stretch)]
            yield _rows_batch(kinds, rows)

    return parts.select(*_KEY, "at", "bytes").mapInArrow(run, "key long, same long, same2 long, doc long, tag long, at long, bytes binary")


def _promising(groups: list[list[tuple[int, int, int, bytes]]], window: int) -> list[list[tuple[int, int, int, bytes]]]:
    """Contexts that can share a window: a window holds at least half of what it has beside the gram on one side of it."""
    half, out = (window - GRAM) // 2, []
    for group in groups:
        seen: dict[bytes, int] = {}
        sides = []
        for _, _, at, data in group:
            a = at & 0xFF
            left = b"l" + data[a - half : a] if a >= half else None
            right = b"r" + data[a + GRAM : a + GRAM + half] if len(data) - a - GRAM >= half else None
            sides.append((left, right))
            for s in (left, right):
                if s:
                    seen[s] = seen.get(s, 0) + 1
        kept = [c for c, s in zip(group, sides, strict=True) if any(x and seen[x] > 1 for x in s)]
        if len(kept) > 1:
            out.append(kept)
    return out


def sorted_repeats(groups: list[list[tuple[int, int, int, bytes]]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that repeat an earlier one within their group: document, tag and place.

    A group is a list of contexts (doc, tag, at, bytes) in ascending (doc, at, tag) order. Each group is one string, contexts end with a symbol below all bytes.
    """
    groups = _promising(groups, window)
    flat = [c for g in groups for c in g]
    if not flat:
        return (np.zeros(0, np.int64),) * 3
    lengths = np.array([len(c[3]) for c in flat])
    raw = np.frombuffer(b"".join(c[3] for c in flat), np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(flat)), lengths)
    spread = np.arange(len(raw)) + owner
    symbols = np.ones(len(raw) + len(flat), np.int16)
    symbols[spread] = raw.astype(np.int16) + 2
    sizes = np.array([len(g) for g in groups])
    last = np.cumsum(sizes) - 1
    symbols[begin[last] + lengths[last]] = 0
    ends = np.concatenate([[0], begin[last] + lengths[last] + 1])
    sa = suffix_arrays(symbols, np.diff(ends))
    whole = np.zeros(len(symbols), bool)
    whole[spread] = np.arange(len(raw)) - (np.cumsum(lengths) - lengths)[owner] <= (lengths - window)[owner]
    w = sa[whole[sa]]
    text = np.zeros(len(symbols) + window, np.uint8)
    text[spread] = raw
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    string = np.searchsorted(ends, w, side="right")
    same = string[1:] == string[:-1]
    for i in range(0, len(same), 1 << 16):
        part = slice(i, min(i + (1 << 16), len(same)))
        some = np.flatnonzero(same[part]) + i
        same[some] = (view[w[some]] == view[w[some + 1]]).all(axis=1)
    head = np.flatnonzero(np.concatenate([[True], ~same])) if len(w) else np.zeros(0, int)
    earliest = np.repeat(np.minimum.reduceat(w, head), np.diff(np.append(head, len(w)))) if len(w) else w
    doc = np.array([c[0] for c in flat], np.int64)
    first = np.array([c[2] >> 16 for c in flat], np.int64)
    which = np.searchsorted(begin, w, side="right") - 1
    from_ = np.searchsorted(begin, earliest, side="right") - 1
    place = first[which] + w - begin[which]
    other = first[from_] + earliest - begin[from_]
    tag = np.array([c[1] for c in flat], np.int64)
    again = (doc[which] != doc[from_]) | (place != other) | (tag[which] != tag[from_])
    return doc[which][again], tag[which][again], place[again]


def sort_contexts(rows: DataFrame, window: int) -> DataFrame:
    """``doc, tag, first, count``: runs of windows that repeat an earlier one, from groups of contexts (``key, doc, tag, at, bytes``)."""
    kinds = _LONGS(*_KEY, "first", "count")

    def flush(groups) -> pa.RecordBatch:
        doc, tag, place = sorted_repeats(groups, window)
        order = np.lexsort((place, tag, doc))
        doc, tag, place = doc[order], tag[order], place[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
        return _batch(kinds, doc[head], tag[head], place[head], place[tail] - place[head] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, current, size = [], None, 0
        for batch in batches:
            for key, doc, tag, at, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != current:
                    if size >= SORTED_BYTES:
                        yield flush(groups)
                        groups, size = [], 0
                    groups.append([])
                    current = key
                groups[-1].append((doc, tag, at, data))
                size += len(data)
        if groups:
            yield flush(groups)

    dealt = rows.select("key", *_KEY, "at", "bytes").repartition("key").sortWithinPartitions("key", "doc", "at", "tag")
    return dealt.mapInArrow(run, "doc long, tag long, first long, count long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, most: int = SORTED_CONTEXTS, hot: int = HOT_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, removed (array of start, end), kept (binary)``, one row per input row (``doc_id, text`` and any other columns).

    Removed is each UTF-8 byte that lies in a string of ``window`` bytes that also starts earlier: in a document of smaller doc_id, or earlier in the
    same one; all strings are judged on the input. Null texts are empty; null doc_ids come first. Rows that
    repeat a doc_id and its text are one document, whose strings are not earlier than themselves; of rows that repeat a doc_id with other text, the order is
    by start, then by a hash of the text. Very long texts are read in stretches. An empty table gives an empty result.

    Windows in suffix arrays are compared byte by byte; equal contexts by 128 bits of a hash.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    found = stored(judged(occurrences(keyed, window, hot_anchors(keyed, window, least=hot)), most), "runs")
    fields = [*_KEY, F.shiftright("at", 16).alias("first"), F.shiftright("at", 8).bitwiseAND(F.lit(0xFF)).alias("count")]
    group = ["key", *_KEY, "at", "bytes"]
    rows = stored(contexts(keyed, found.where("kind > 0"), window), "contexts")
    runs, sortable, parts = [found.where("kind = 0").select(*fields)], [rows.where("NOT part").select(*group)], rows.where("part")
    for shorter in (*STRETCHES[1:], 0):
        earliest = parts.groupBy("key", "same", "same2").agg(F.min(F.struct("doc", "at", "tag")).alias("e"), F.first("bytes").alias("bytes"))
        firsts = stored(earliest.select("key", "e.*", "bytes"), "first-parts")
        runs.append(parts.join(firsts.select("key", *_KEY, "at"), ["key", *_KEY, "at"], "left_anti").select(*fields))
        sizes = firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        several = stored(firsts.join(sizes, "key"), "several-parts")
        sortable.append(several.where(F.col("n") <= most).select(*group))
        large = several.where(F.col("n") > most)
        if not shorter or large.isEmpty():  # a stretch of one is one window: equal keys are equal windows
            break
        parts = stored(split_parts(large, window, shorter), "parts")
    runs.append(sort_contexts(reduce(DataFrame.unionByName, sortable), window))
    repeated = stored(reduce(DataFrame.unionByName, runs), "repeated-runs")
    lists = repeated.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out = []
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data, spans = _utf8(text), []
                for a, b in sorted((r["first"], r["first"] + r["count"] - 1 + window) for r in runs or ()):
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], b)
                    else:
                        spans.append({"start": a, "end": b})
                cuts = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((None if doc == NULL_ID else doc, len(data), spans, kept))
            yield _rows_batch(kinds, out)

    both = keyed.join(lists, _KEY, "left").select("doc", "text", "runs")
    return both.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    done = remove_repeats(documents(spark, sf_dir))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_remove_repeats": op8_remove_repeats}
SQL: dict[str, str] = {}
