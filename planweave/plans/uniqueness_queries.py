"""Registered queries of unique values over phases and of rows that lose their peers, with DuckDB SQL that looks at pairs of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.operators import uniqueness as U
from planweave.operators.store import kept
from planweave.plans.queries import query
from planweave.sources.records import read_table


def _phase_sql(name: str, incoming: str, holders: str) -> str:
    """Pairs of ``incoming`` (k, v, phase, may) and ``holders`` (o, v, f), and who waits on a ring."""
    return f"""{name}p AS MATERIALIZED (SELECT i.k, i.v, i.phase, h.o, i.may AND h.f AND h.o <> i.k AS free, NOT (i.may AND h.f) AS stays FROM ({incoming}) i JOIN ({holders}) h ON h.v = i.v),
{name}r AS (SELECT k AS a, o AS b FROM {name}p WHERE free UNION SELECT r.a, p.o FROM {name}r r JOIN {name}p p ON p.k = r.b WHERE p.free),
{name}g AS (SELECT k, v, phase, min(o) FILTER (WHERE free) AS first_free, count(*) FILTER (WHERE free) AS n, min(o) FILTER (WHERE stays) AS a, max(o) FILTER (WHERE stays) AS b, coalesce(bool_or((o, k) IN (SELECT (a, b) FROM {name}r)) FILTER (WHERE free), false) AS ring FROM {name}p GROUP BY 1, 2, 3),
{name} AS (SELECT k, v, phase, first_free AS holder, n, CASE WHEN ring THEN 'ring' ELSE 'wait' END AS reason FROM {name}g WHERE n > 0
  UNION ALL SELECT k, v, phase, CASE WHEN a <> k THEN a ELSE b END, NULL, 'holder keeps the value' FROM {name}g WHERE a <> k OR b <> k)"""


_PHASES = f"""x AS (SELECT p_partkey AS i, p_partkey // 60 * 60 AS z FROM part),
y AS (SELECT i, i AS b, CASE WHEN i % 5 = 0 THEN i ELSE z + (i % 60 * 7 + 3) % 60 END AS c, z + (i % 60 + 1) % 60 AS q FROM x),
r AS MATERIALIZED (SELECT 'p' || lpad(CAST(i AS VARCHAR), 9, '0') AS k, i % 10 <> 0 AS ins, i % 10 <> 1 AS int, i % 3 <> 1 AS hp, i % 4 <> 0 AS sc, b, c, CASE WHEN i % 2 = 0 THEN q ELSE c END AS p FROM y),
s AS MATERIALIZED (SELECT *, ins AND NOT int AS cr, ins AND int AND hp AND sc AS st FROM r),
fu AS (SELECT k, c AS v FROM s WHERE ins UNION SELECT k, p FROM s WHERE st OR cr AND hp),
rel AS MATERIALIZED (SELECT k FROM s WHERE ins AND int AND c <> b AND EXISTS (SELECT 1 FROM fu WHERE fu.v = s.b AND fu.k <> s.k)),
h0 AS MATERIALIZED (SELECT k AS o, CASE WHEN cr THEN CASE WHEN hp THEN p ELSE c END WHEN k IN (FROM rel) THEN c ELSE b END AS v, st, p, c, ins FROM s WHERE int OR cr),
{_phase_sql("u", "SELECT k, CASE WHEN hp THEN p ELSE c END AS v, 'create-seed' AS phase, false AS may FROM s WHERE cr UNION ALL SELECT k, p, 'published-stage', true FROM s WHERE st", "SELECT o, v, st AND p <> v AS f FROM h0")},
{_phase_sql("w", "SELECT k, c AS v, 'current-restore' AS phase, true AS may FROM s WHERE (st OR cr AND hp) AND c <> p OR ins AND int AND NOT st AND c <> b AND k NOT IN (FROM rel)", "SELECT o, v, ins AND c <> v AS f FROM (SELECT o, CASE WHEN st THEN p ELSE v END AS v, c, ins FROM h0)")}"""


def _phases(spark, sf):
    """Parts as rows of two sides: a row holds its own key, wants another one of its block of 60, and publishes a third."""
    i = F.col("p_partkey")
    z = F.floor(i / 60) * 60
    current = F.when(i % 5 == 0, i).otherwise(z + (i % 60 * 7 + 3) % 60)
    published = F.when(i % 2 == 0, z + (i % 60 + 1) % 60).otherwise(current)
    id_ = F.concat(F.lit("p"), F.lpad(i.cast("string"), 9, "0"))
    values = read_table(spark, sf, "part").select(id_.alias("record_id"), i.alias("i"), i.cast("long").alias("before"), current.cast("long").alias("current"), published.cast("long").alias("published"))
    rows = values.select(
        "record_id", (F.col("i") % 10 != 0).alias("in_source"), (F.col("i") % 10 != 1).alias("in_target"), (F.col("i") % 3 != 1).alias("has_published"), (F.col("i") % 4 != 0).alias("stage_changes"),
        (F.col("current") == F.col("published")).alias("equal_slices"), (F.col("current") == F.col("before")).alias("current_kept"),
    )
    claim = lambda v: values.select(F.lit("part").alias("item_type_id"), F.lit("slug").alias("field"), F.lit("value").alias("locale"), F.col(v).cast("string").alias("value"), "record_id", F.lit(v).alias("version"))
    return U.unique_phases(rows, claim("before").unionByName(claim("current")).unionByName(claim("published")))


@query("f15_unique_phases", f"WITH RECURSIVE {_PHASES} SELECT k AS record_id, CAST(v AS VARCHAR) AS value, phase, holder, reason, n FROM u UNION ALL SELECT k, CAST(v AS VARCHAR), phase, holder, reason, n FROM w", records=False)
def f15_unique_phases(spark, sf):
    """Who waits for whom in which phase, and what no order can solve."""
    waits, conflicts = _phases(spark, sf)
    columns = ["record_id", "value", "phase", "holder", "reason"]
    return waits.withColumn("reason", F.lit("wait")).select(*columns, "n").unionByName(conflicts.select(*columns, F.lit(None).cast("long").alias("n")))


@query("g6_unsupported_uniqueness", """WITH r AS MATERIALIZED (SELECT p_partkey AS k, p_brand || p_size AS v, p_partkey % 3 <> 0 AS checked, p_partkey % 4 <> 0 AS supports, p_partkey % 10 = 1 AS pres FROM part),
s AS (SELECT *, count(*) FILTER (WHERE supports) OVER (PARTITION BY v) - supports::INT AS peers, count(*) FILTER (WHERE pres) OVER (PARTITION BY v) AS kept FROM r),
z AS MATERIALIZED (SELECT * FROM s WHERE checked AND peers = 0 AND kept = 0)
SELECT CAST(k AS VARCHAR) AS record_id, 'current' AS slice, 0 AS round FROM z
UNION ALL SELECT CAST(k AS VARCHAR), 'current', 1 FROM s WHERE checked AND kept = 0 AND peers > 0 AND peers = (SELECT count(*) FROM z WHERE z.v = s.v AND z.supports AND z.k <> s.k)""", records=False)
def g6_unsupported_uniqueness(spark, sf):
    """Parts of one brand and size are peers; of every four, one is no support for others, and every tenth is preserved in the destination."""
    p, k = read_table(spark, sf, "part"), F.col("p_partkey")
    id_, slice_ = k.cast("string").alias("record_id"), F.lit("current").alias("slice")
    claim = lambda df: df.select(F.lit("part").alias("item_type_id"), F.lit("kind").alias("field"), F.lit("value").alias("locale"), F.concat("p_brand", F.col("p_size").cast("string")).alias("value"), id_, slice_)
    rows = kept(p.select(id_, slice_, (k % 3 != 0).alias("checked"), (k % 4 != 0).alias("supports")), "rows")
    preserved = claim(p.where("p_partkey % 10 = 1")).withColumn("record_id", F.concat(F.lit("kept-"), "record_id"))
    return U.unsupported_uniqueness(rows, claim(p), preserved)
