"""Near duplicates: bottom-k sketches, inverted lists of their values, union-sketch estimates, exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import documents, in_slices, stored

SHINGLE_WORDS = 4
#: Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Values of a sketch. Two sets at the threshold share about 77 of them; fewer than SHARED is an event of less than 1e-8.
K, SHARED = 96, 52
#: Lists of up to so many sets give all their pairs; longer ones are compared with pivots, in rounds.
SHORT_LIST = 16
#: Rows up to which a list of ids may be broadcast (16 MB); longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words, with A-Z in lower case.

    A text of fewer words is one shingle; without words, or null, the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # for bytes, both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(size, len(words))
    mixed = np.full(len(words) - take + 1, take, np.uint64)
    for j in range(take):
        mixed = mixed * _MULTIPLIER + h[j : len(h) - take + 1 + j]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the mixing steps of SplitMix64
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def sketches(docs: DataFrame, size: int = SHINGLE_WORDS, k: int = K) -> DataFrame:
    """``doc_id, n_shingles, set_id, sketch``: set size, digest of the set (null if empty), and its k smallest hashes in ascending order."""
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_id": pa.binary(), "sketch": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n, ids, low = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                ids.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                low.append(s[:k].view(np.int64))
            made = (batch.column(0), n, ids, low)
            yield pa.RecordBatch.from_arrays([v if i == 0 else pa.array(v, t) for i, (v, t) in enumerate(zip(made, kinds.values(), strict=True))], list(kinds))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, hashes``: the whole shingle sets of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingle_set(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, hashes array<long>")


def restricted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids`` (one column of that name, distinct). A counted, short list is broadcast."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among ``ids``; a null key never is."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_anti")


def rare_values(sets: DataFrame, percent: int, k: int, shared: int) -> DataFrame:
    """Inverted lists: ``value, node, n, m`` (set size, and how many values the set has from this one on, among those that others have too), for the rarest sketch values of every set only, and only values of at least two such sets.

    Sets that are linked share at least s values of their sketches. In any order that is the same for all sets, they then share one among
    each one's first (size - s + 1) values. With rare values first, common lines and passages stay out of the lists.
    """
    each = sets.select("node", "n", F.explode("sketch").alias("value"))
    seen = each.join(_shared_values(each, "df"), "value")
    whole = F.least(F.ceil(F.col("n") * percent / 100), F.floor(k - F.col("n") * ((100 - percent) / percent)))
    least = F.greatest(F.lit(1), F.when(F.col("n") > k, F.lit(shared)).otherwise(whole))
    mine = seen.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    first = (F.least("n", F.lit(k)) - least + 1 - (F.least("n", F.lit(k)) - F.size("values"))).cast("int")
    prefix = mine.where(first > 0).select("node", "n", F.size("values").alias("s"), F.posexplode(F.slice("values", F.lit(1), first)).alias("i", "v"))
    prefix = stored(prefix.select("v.value", "node", "n", (F.col("s") - F.col("i")).cast("long").alias("m")), "rare-values")
    return prefix.join(_shared_values(prefix, "listed"), "value").drop("listed")


def _shared_values(rows: DataFrame, name: str) -> DataFrame:
    """``value`` and how many rows have it, if several do. Counted before the shuffle; the join with it is one that Spark splits where a value is frequent."""
    return rows.groupBy("value").agg(F.count("*").alias(name)).where(F.col(name) > 1)


def verified(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int, k: int, shared: int) -> DataFrame:
    """The pairs (``a, b``) that are linked. The union of both sketches estimates their similarity first; full sets decide."""
    side = lambda df, n: df.select(F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in df.columns if c != "node"))
    pairs = stored(pairs.distinct(), "pairs")
    files = _files(20 * pairs.count())
    both = pairs.join(side(sketch, "a"), "a").join(side(sketch, "b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    small = (F.col("n_a") <= k) & (F.col("n_b") <= k) & (F.size(F.array_union("sketch_a", "sketch_b")) <= k)
    likely = F.when(small, common * 100 >= F.size(union) * percent).otherwise(common * k >= F.size(union) * shared)
    close = stored(both.where(likely).select("a", "b").coalesce(files), "likely-pairs")
    met = close.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    inter = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return met.where(100 * inter >= percent * (F.size("hashes_a") + F.size("hashes_b") - inter)).select("a", "b").distinct()


def _files(rows: int) -> int:
    """Tasks and files for a table of known size in an iteration, so that rounds on little data are short."""
    return max(6, -(-rows // 100_000))


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for the nodes of ``links`` (``a, b``).

    Large-star and small-star steps in turn until nothing changes. Each moves every edge towards the smallest neighbour seen, so
    the number of rounds is logarithmic; minima are aggregated before they are shuffled, and hubs are met by joins that Spark can split.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    files, mark = _files(edges.count()), None
    while True:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "minima")
        large = stored(ends.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(files), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "minima")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def links_of(lists: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int, k: int, shared: int) -> DataFrame:
    """Enough links (``a, b``) to connect all sets that are linked: pairs that are connected already need no check.

    Short lists give all their pairs. The sets of long lists get lists anew, from their full sets: what is linked shares one of the rarest
    fifth of its values, so sets that have just a common passage part here. There, if a value is the rarest that two sets share, they share
    no more than what comes after it in either; where that is too little for a link, the pair is left out, and a set leaves the lists in which it is too little for any. Lists that are still long have pivots (the smallest nodes of some hash
    buckets) that meet all members; then pairs within one component are settled, pivots leave the list, and what is open goes on with
    more pivots. So a list of copies of one text costs as many pairs as it has members, and no pair is given up.
    """
    sized = stored(lists.join(lists.groupBy("value").agg(F.count("*").alias("listed")), "value"), "sized-lists")
    short, long = sized.where(F.col("listed") <= SHORT_LIST), sized.where(F.col("listed") > SHORT_LIST)
    whole = lambda df: df.withColumn("m", F.col("n")).withColumn("c", F.col("node"))  # sketches do not bound what full sets share
    links = stored(verified(_all_pairs(whole(short), percent), sketch, sets, percent, k, shared), "links")
    dense = stored(long.select("node").distinct(), "dense")
    if dense.isEmpty():
        return links
    full = restricted(sets, dense, "node").select("node", F.size("hashes").cast("long").alias("n"), F.col("hashes").alias("sketch"))
    lists = stored(rare_values(full, percent, 1 << 40, 0), "dense-lists")
    lists = lists.withColumn("c", F.col("node"))
    files, pivots = _files(lists.count()), 1
    while True:
        smallest = lists.join(lists.groupBy("value").agg(F.min("n").alias("least")), "value")
        able = F.col("m") * (100 + percent) >= percent * (F.col("n") + F.greatest("least", F.col("n") * percent / 100))
        lists = stored(smallest.where(able).drop("least").coalesce(files), "able")
        sized = stored(lists.join(lists.groupBy("value").agg(F.count("*").alias("listed")), "value").coalesce(files), "sized-lists")
        short, long = sized.where(F.col("listed") <= SHORT_LIST), sized.where(F.col("listed") > SHORT_LIST)
        bucket = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
        heads = stored(long.groupBy("value", bucket.alias("bucket")).agg(F.min(F.struct("node", "n", "m", "c")).alias("p")).select("value", "p.*").coalesce(files), "pivots")
        pairs = _all_pairs(short, percent).unionByName(_pairs(heads, long, F.lit(True), percent))
        links = links.unionByName(stored(verified(pairs, sketch, sets, percent, k, shared), "links"))
        open_ = stored(long.drop("listed", "c").join(heads.select("value", "node"), ["value", "node"], "left_anti").coalesce(files), "open-lists")
        if open_.isEmpty():
            return links
        comp = components(links)
        labelled = stored(open_.join(comp, "node", "left").select("value", "node", "n", "m", F.coalesce("component", "node").alias("c")).coalesce(files), "labelled")
        mixed = stored(labelled.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("value").coalesce(files), "mixed")
        lists = stored(labelled.join(mixed, "value", "left_semi").coalesce(files), "lists")
        if lists.isEmpty():
            return links
        pivots *= 16


def _pairs(one: DataFrame, two: DataFrame, which, percent: int) -> DataFrame:
    """Pairs ``a, b`` (ascending) of rows of two tables of lists, of different components, whose sizes and remaining values allow a link."""
    side = lambda df, x: df.select("value", *(F.col(c).alias(c + x) for c in ("node", "n", "m", "c")))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    values = F.least("ma", "mb") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    met = side(one, "a").join(side(two, "b"), "value").where(which & (F.col("ca") != F.col("cb")) & sizes & values)
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"))


def _all_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of lists that are known to be short."""
    return _pairs(lists, lists, F.col("nodea") < F.col("nodeb"), percent)


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, k: int = K, shared: int = SHARED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row (``doc_id, text`` and any other columns).

    Documents with equal shingle sets are one class, represented by its smallest doc_id; classes are linked by exact similarity of
    their sets. ``component_id`` is the smallest doc_id reachable, and ``kept`` tells whether it is the document's own. Null and empty texts
    and texts without words have empty sets and are linked with nothing. A null doc_id is linked with nothing and kept.
    Rows that repeat a doc_id count as one document that has all their texts. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    drawn = stored(sketches(docs, size, k), "sketches")
    linkable = drawn.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(linkable.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = stored(rare_values(classes, percent, k, shared), "lists")
    nodes = stored(lists.select("node").distinct(), "nodes")
    sets = stored(full_sets(restricted(docs, nodes.select(F.col("node").alias("doc_id")), "doc_id"), size), "sets")
    sketch = stored(restricted(classes.select("node", "n", "sketch"), nodes, "node"), "listed-sketches")
    comp = components(links_of(lists, sketch, sets, percent, k, shared))
    named = classes.select("set_id", "node").join(comp, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    out = drawn.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on 4-word shingles."""
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
SQL: dict[str, str] = {}
