"""Mixing sources to target weights by systematic sampling. DataFrame functions only; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.llm.common import documents, n_words, stored

#: Weights of the sources in code point order, repeating, null last (fixed by the data contract).
WEIGHTS = (5, 2, 1)
#: No source's target is above this many times its own size.
MAX_EPOCHS = 3
#: Rows of one source that are ranked together in one task.
SHARD_ROWS = 4000
SEED = "planweave-mix-1"


def _hash32(text: Column) -> Column:
    """The first 32 bits of the text's MD5 as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources. In: ``source, source_size``, one row per source. Adds ``target``.

    Water filling: sources by ascending cap per weight; those whose share is above their cap stop at it, and what they
    leave is shared by weight among the rest. With sources in this order that is one running sum. A source of size 0 has target 0.
    """
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(1))
    before = W.partitionBy(F.lit(1)).orderBy("_ratio", "_place").rowsBetween(W.unboundedPreceding, -1)
    df = (
        sizes.withColumn("_place", F.row_number().over(by_code_point))
        .withColumn("_w", weight.cast("long"))
        .withColumn("_cap", F.col("source_size") * F.lit(max_epochs).cast("long"))
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
        .withColumn("_t", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_r", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_full", F.col("_cap") * F.col("_r") < F.col("_w") * F.col("_t"))
    )
    first_open = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_place", "_t", "_r"))).over(every)
    level = df.withColumn("_level", first_open)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
        (F.col("_w") * F.col("_level._t")).cast("double") / F.col("_level._r").cast("double")
    )
    return level.withColumn("target", target).select(*sizes.columns, "target")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    shard_rows: int = SHARD_ROWS,
    by: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """How often the mix takes each document: adds ``source_size, target, copies``, one row per input row.

    In: ``doc_id, source, size`` and any other columns, which stay (but those named like a result or like this operator's own, with a
    leading underscore, are replaced). A document's expected copies are target / source size of its source. Within a source the
    documents stand in a fixed order, the expected copies are summed up along it from one random offset per source, and a document
    is emitted once for every integer that its part of the sum crosses. So each document gets the floor or the ceiling of its
    expectation, and as the order goes by size within shards, the words that a source gives stay close to its target.

    The order is (shard, size, hash of the columns ``by``). A large source has many shards of about ``shard_rows`` rows; the sum before a shard
    comes from a small table of shard counts, so no task ever holds a whole source. Where ids repeat or are missing, ``by`` should name a digest
    of the text too, or all such rows meet in one shard. The table of sources is small: one task may order it.

    Null sources are one source; a null size counts as 0 and a null doc_id as an empty one. Rows that repeat are separate documents.
    A source without words has target 0 and no copies. An empty table gives an empty result. Reruns agree.
    """
    own = ("source_size", "target", "copies", "_source", "_n", "_shards", "_offset", "_rate", "_hash", "_shard", "_rank", "_s", "_k", "_before")
    docs = docs.drop(*own).withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
    names = docs.columns
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    named = F.concat(F.lit(seed + "|"), F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
    targets = (
        source_targets(per_source, weights, max_epochs)
        .withColumn("_shards", F.ceil(F.col("_n") / shard_rows).cast("long"))
        .withColumn("_offset", _hash32(named) / F.lit(4294967296.0))
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumnRenamed("source", "_source")
    )
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    placed = (
        docs.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
        .drop("_source", "_n")
        .withColumn("_hash", F.md5(key))
        .withColumn("_shard", _hash32(key) % F.col("_shards"))
    )
    shards = placed.groupBy("source", "_shard").agg(F.count("*").alias("_rows"))
    ahead = W.partitionBy("source").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select(
        F.col("source").alias("_s"), F.col("_shard").alias("_k"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before")
    )
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("source", "_shard").orderBy("size", "_hash", "doc_id")))
    summed = ranked.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")))
    upto = F.floor((F.col("_before") + F.col("_rank")) * F.col("_rate") + F.col("_offset"))
    prior = F.floor((F.col("_before") + F.col("_rank") - 1) * F.col("_rate") + F.col("_offset"))
    return summed.select(*names, "source_size", "target", (upto - prior).cast("long").alias("copies"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; ``taken`` counts a document's words once per copy."""
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    mixed = mix_sources(stored(docs, "mix-sizes"), by=("doc_id", "digest"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((place - 1) % 3 + 1 AS INT)] AS BIGINT) AS w, 3 * source_size AS cap FROM s),
c AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
         sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS t, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS r
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * r < w * t AS stops FROM c),
l AS (SELECT t AS lt, r AS lr FROM f WHERE NOT stops ORDER BY ratio, place LIMIT 1),
g AS (
  SELECT source, source_size, CAST(ceil(n / 4000.0) AS BIGINT) AS shards,
         CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(w * lt AS DOUBLE) / CAST(lr AS DOUBLE) END AS target,
         CAST(CAST('0x' || substr(md5('{SEED}|' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8) AS BIGINT) AS DOUBLE)
           / 4294967296.0 AS u
  FROM f LEFT JOIN l ON true),
p AS (
  SELECT doc_id, d.source, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(hash, 1, 8) AS BIGINT) % shards, size, hash, doc_id) AS k
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CAST(floor(CAST(k AS DOUBLE) * rate + u) - floor(CAST(k - 1 AS DOUBLE) * rate + u) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n
"""

QUERIES = {"op5_mix_sources": op5_mix_sources}
SQL = {"op5_mix_sources": OP5_SQL}
