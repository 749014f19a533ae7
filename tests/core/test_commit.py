"""Greedy chunks against a sequential packer, chains against a walk, and plans that died half-way."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from planweave.operators import dependencies as E
from planweave.operators import ledger as L
from planweave.operators import snapshot as N


@pytest.mark.parametrize("seed", [1])
def test_greedy_chunks_are_those_of_one_pass(spark, seed):
    rng = random.Random(seed)
    entries = [(ns, f"{rng.randint(0, 10**9)}", "t" * rng.randint(1, 120)) for ns, n in (("a", 400), ("b", 37), ("c", 1)) for _ in range(n)]
    entries += [("d", "1", "x" * 180), ("d", "2", "y" * 180), ("d", "2", "y" * 180)]
    df = spark.createDataFrame(entries, "namespace string, source_id string, target_id string").repartition(5)
    want, used, chunk, last = [], 0, -1, None
    for ns, s, t in sorted(entries):
        size = len(f"{ns}:{s}:{t}") + 3
        if ns != last or used + size > 200:
            chunk, used = (0 if ns != last else chunk + 1), 0
        used, last = used + size, ns
        want.append((ns, s, t, chunk))
    chunks = L.greedy_chunks(df, limit=300, envelope=100)
    assert sorted(tuple(r) for r in chunks.collect()) == sorted(want)
    batches = L.ledger_batches(chunks).collect()
    again = L.ledger_batches(L.greedy_chunks(df.repartition(2), limit=300, envelope=100)).collect()
    assert sorted(batches) == sorted(again) and len({b.chunk_id for b in batches}) == len(batches) and len({b.batch_id for b in batches}) == 4
    with pytest.raises(ValueError):
        L.greedy_chunks(df, limit=250, envelope=100)


def test_chains_are_those_of_a_walk(spark):
    rng = random.Random(1)
    rows = [("r0", "r0", 0), ("r1", "r1", 0)]
    up = {"r0": None, "r1": None}
    for i in range(2, 70):
        above = rng.choice([f"r{i - 1}", f"r{rng.randint(0, i - 1)}"])
        up[f"r{i}"] = above
        rows.append((f"r{i}", above, next(d for x, _, d in rows if x == above) + 1))
    got = {r.id: r.chain for r in E.skip_chains(spark.createDataFrame(rows, "id string, blocker string, distance int")).collect()}

    def walk(x):
        return [x, *walk(up[x])] if up[x] else [x]

    assert got == {x: walk(x) for x in up} and max(map(len, got.values())) > 10


def test_a_plan_counts_as_a_whole(spark, tmp_path):
    plan = spark.range(500).select(F.concat(F.lit("r"), "id").alias("record_id"), F.lit("update").alias("action"))
    good = f"{tmp_path}/good"
    N.commit_plan(plan, good, ["record_id"])
    assert N.open_plan(spark, good).exceptAll(plan).isEmpty() and N.open_plan(spark, good).count() == 500
    dead = f"{tmp_path}/dead"
    shutil.copytree(f"{good}/plan", f"{dead}/plan")  # what a write leaves that dies before its manifest
    with pytest.raises(ValueError, match="not committed"):
        N.open_plan(spark, dead)
    part = sorted(Path(good, "plan").glob("part-*"))[0]
    extra = f"{tmp_path}/extra"
    shutil.copytree(good, extra)
    shutil.copy(part, Path(extra, "plan", "part-99999-x.snappy.parquet"))
    lost = f"{tmp_path}/lost"
    shutil.copytree(good, lost)
    Path(lost, "plan", part.name).unlink()
    for broken in (extra, lost):
        with pytest.raises(ValueError, match="not what was committed"):
            N.open_plan(spark, broken)
    with pytest.raises(ValueError, match="several rows"):
        N.commit_plan(plan.union(plan.limit(1)), f"{tmp_path}/twice", ["record_id"])
    with pytest.raises(ValueError, match="contradicts"):
        N.commit_plan(plan, f"{tmp_path}/wrong", ["record_id"], plan.limit(1))
    assert not Path(tmp_path, "twice").exists() and not Path(tmp_path, "wrong").exists()
