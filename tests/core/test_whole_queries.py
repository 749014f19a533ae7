"""Queries over whole tables lose no row and no text."""

from pyspark.sql import functions as F

import planweave.plans.registered  # noqa: F401  (registers all queries)
from planweave.operators.stages import STAGES
from planweave.plans.queries import QUERIES
from planweave.sources.records import both

SF = "/root/testdata/sf0.001"


def test_text_runs_hold_every_turn(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {r.conv_id: "".join(t.text or "" for t in sorted(r.turns)) for r in turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns")).collect()}
    runs = QUERIES["c10_text_runs"](spark, SF).collect()
    got = {}
    for r in sorted(runs, key=lambda r: (r.doc_id, r.run)):
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == want and len(runs) < turns.count()


def test_seeds_are_whole(spark):
    s, d = both(spark, SF)
    closed = {r.id for r in QUERIES["a11_collection_closure"](spark, SF).where("distance = 0").collect()}
    assert closed == {r.record_id for r in s.where("item_type_id = 'customer'").collect()}
    same = s.select("record_id", "current").intersect(d.select("record_id", "current"))
    assert QUERIES["g3_match_diagnostics"](spark, SF).count() == same.count()
    p = spark.read.parquet(f"{SF}/part.parquet")
    n = {r.b: r.n for r in p.where("p_partkey % 10 <> 0").groupBy(F.col("p_brand").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert all(r.s_n == n.get(r.item_type_id, 0) for r in QUERIES["d16_singleton_mismatches"](spark, SF).collect())


def test_all_stages_occur(spark):
    assert {r.stage for r in QUERIES["g15_write_stages"](spark, SF).select("stage").distinct().collect()} == set(STAGES)
