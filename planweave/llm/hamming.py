"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.llm.common import stored

K = 10
BITS = 64
#: Values per segment up to which radii are searched in one first step.
FIRST_VALUES = 16
#: Codes of one segment value that stand in one list; a value with more has several lists.
LIST_CODES = 512
#: What comparing one code costs against looking up one value; it serves the choice of the number of segments only.
COMPARE_COST = 1 / 16


def sign_codes(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """``id, code``: bit i of the code is 1 where component i is above 0. A null vector has no code; missing or null components give 0."""
    one = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = one(0)
    for i in range(1, bits):
        code = code.bitwiseOR(one(i))
    return vectors.select(F.col("vec_id").alias("id"), F.when(F.col("embedding").isNotNull(), code).alias("code")).where("code IS NOT NULL")


def _segments(code, bits: int, m: int):
    """Array of (segment, value) of a code. The first segments take the bits that don't divide evenly."""
    out, at = [], 0
    for s in range(m):
        wide = bits // m + (s < bits % m)
        value = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))
        out.append(F.struct(F.lit(s).alias("seg"), value.alias("val")))
        at += wide
    return F.array(*out)


def segment_count(n_codes: int, k: int = K, bits: int = BITS) -> int:
    """Into how many segments codes are cut: the number with the least predicted work per query, looked-up values and compared codes.

    The kth distance is predicted as that of evenly spread codes; where codes lie closer together, searches end earlier.
    """
    below, kth = 0.0, bits
    for d in range(bits + 1):
        below += math.comb(bits, d) / 2**bits
        if n_codes * below >= k:
            kth = d
            break
    best = None
    for m in range(2, bits // 2 + 1):
        r, last = divmod(kth, m)
        work = 0.0
        for s in range(m):
            wide = bits // m + (s < bits % m)
            values = sum(math.comb(wide, i) for i in range(min(wide, r if s <= last else r - 1) + 1))
            work += values + COMPARE_COST * n_codes * values / 2**wide
        if best is None or work < best[0]:
            best = work, m
    return best[1]


def inverted_lists(codes: DataFrame, bits: int, m: int, list_codes: int = LIST_CODES) -> DataFrame:
    """``seg, val, entries`` (array of code, ids): the codes by the value of each segment, a common value's in several lists by a hash."""
    cut = codes.select("code", "ids", F.explode(_segments(F.col("code"), bits, m)).alias("s")).select("code", "ids", "s.seg", "s.val")
    lists = cut.groupBy("seg", "val").agg(F.ceil(F.count("*") / list_codes).alias("lists"))
    part = F.pmod(F.xxhash64("code"), F.col("lists")).alias("part")
    dealt = cut.join(lists, ["seg", "val"]).select("seg", "val", part, F.struct("code", "ids").alias("entry"))
    return dealt.groupBy("seg", "val", "part").agg(F.collect_list("entry").alias("entries")).drop("part")


def _masks(spark: SparkSession, looked_up: list[tuple[int, int]], widths: list[int]) -> DataFrame:
    """``_seg, mask``: what to flip in a segment's value to get all values at the given distances."""
    rows = [(s, sum(1 << b for b in c)) for s, r in looked_up if r <= widths[s] for c in combinations(range(widths[s]), r)]
    return spark.createDataFrame(rows, "_seg int, mask long")


def hamming_top_k(base: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """The k nearest base rows of every query: ``query_id, id, distance, rank``, by Hamming distance, then id. Exact.

    Both tables: ``id, code`` (long) and any others. Base rows with one code are one entry with their k smallest ids, which is all that a top-k
    list can take. Codes are cut into segments (``segment_count``), and inverted lists hold the codes of each segment value. A step looks up, for
    every open query, the values of one segment at distance r; then comes the next segment, and after the last one r grows. Once segments 0 to s
    are searched up to r and the others up to r-1, every code within m*r+s bits has been seen, since any other is further away than
    that in all segments together; a query is done once its kth verified distance is within that bound. The first radii, of few values,
    are taken in one step. A list gives its k nearest codes within the query's kth distance so far, so what leaves it stays small however long it is.

    Ties go to the smaller id. Null ids or codes are left out. Base rows that repeat are rows of their own. Queries that repeat are one; a query id with several codes gets
    the rows of each of them. With fewer than k base rows a query gets them all; an empty table gives none.
    """
    spark = base.sparkSession
    base = base.where("id IS NOT NULL AND code IS NOT NULL")
    smallest = base.groupBy("code", "id").agg(F.count("*").alias("_n")).select("code", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(k)))).alias("_c"), "id")
    firsts = smallest.withColumn("_r", F.row_number().over(W.partitionBy("code").orderBy("id", "_c"))).where(F.col("_r") <= k)
    codes = stored(firsts.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    queries = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).distinct()
    open_ = stored(queries.withColumn("kth", F.lit(bits)), "open-queries")
    count = codes.count()
    best = spark.createDataFrame([], "query_id long, query_code long, distance int, id long, copy int, code long")
    if not count or open_.isEmpty():
        return best.select("query_id", "id", "distance", F.lit(0).alias("rank"))
    m = segment_count(count, k, bits)
    widths = [bits // m + (s < bits % m) for s in range(m)]
    index = stored(inverted_lists(codes, bits, m), "lists")
    query, by_rank = ["query_id", "query_code"], W.partitionBy("query_id", "query_code").orderBy("distance", "id", "copy", "code")
    together = max(r for r in range(widths[0] + 1) if r == 0 or sum(math.comb(widths[0], i) for i in range(r + 1)) <= FIRST_VALUES)
    steps = [(together, m - 1, [(s, r) for r in range(together + 1) for s in range(m)])]
    steps += [(r, s, [(s, r)]) for r in range(together + 1, widths[0] + 1) for s in range(m)]
    done = []
    for number, (r, last, looked_up) in enumerate(steps):
        cut = open_.select("*", F.explode(_segments(F.col("query_code"), bits, m)).alias("s"))
        probes = cut.join(F.broadcast(_masks(spark, looked_up, widths)), F.col("s.seg") == F.col("_seg"))  # masks of one step: few, whatever the data
        probes = probes.select(*query, "kth", F.col("s.seg").alias("seg"), F.col("s.val").bitwiseXOR(F.col("mask")).alias("val"))
        compared = F.transform("entries", lambda e: F.struct(F.bit_count(F.col("query_code").bitwiseXOR(e["code"])).alias("distance"), e["ids"].alias("ids"), e["code"].alias("code")))
        near = F.slice(F.array_sort(F.filter(compared, lambda e: e["distance"] <= F.col("kth"))), 1, k)
        met = probes.join(index, ["seg", "val"]).select(*query, F.explode(near).alias("e")).select(*query, "e.*")
        new = met.select(*query, "distance", F.posexplode("ids").alias("copy", "id"), "code").select(best.columns)
        merged = best.unionByName(new).distinct()
        best = stored(merged.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k), f"top-{number}")
        kth = best.where(F.col("rank") == k).select(*query, F.col("distance").alias("_kth"))
        seen = stored(open_.join(kth, query, "left").select(*query, F.coalesce("_kth", "kth").alias("kth"), (F.col("_kth") <= m * r + last).alias("covered")), f"seen-{number}")
        open_ = seen.where("covered IS NOT TRUE").select(*query, "kth")
        if number == len(steps) - 1 or open_.isEmpty():
            done.append(best)
            break
        covered = seen.where("covered").select(*query)
        done.append(best.join(covered, query, "left_semi"))
        best = best.join(covered, query, "left_anti").drop("rank")
    out = reduce(DataFrame.unionByName, done)
    return out.select("query_id", "id", "distance", "rank")


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes, itself included, for every vector whose id is divisible by 50, against all vectors."""
    codes = stored(sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "sign-codes")
    return hamming_top_k(codes, codes.where(F.col("id") % 50 == 0))


OP7_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(generate_series(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END) AS bits FROM embeddings),
s AS (SELECT vec_id, CAST(array_to_string(bits, '') AS BIT) AS code FROM c),
d AS (
  SELECT q.vec_id AS query_id, b.vec_id AS id, CAST(bit_count(xor(q.code, b.code)) AS INT) AS distance
  FROM s q JOIN s b ON q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM d)
SELECT query_id, id, distance, rank FROM r WHERE rank <= 10
"""

QUERIES = {"op7_hamming_top_k": op7_hamming_top_k}
SQL = {"op7_hamming_top_k": OP7_SQL}
