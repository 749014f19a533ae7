"""Conversation repair against an enumeration of all edits, whole and in segments, and the registered query against the contract in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from planweave.llm import repair as R

SF = "/root/testdata/sf0.001"
LEGAL = re.compile("(s?(ua)+)?")


def all_edits(rows):
    """The cheapest (cost, audit) over every edit sequence with up to two inserted turns at each place."""
    inserts = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    best = None

    def walk(i, word, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for added in inserts:
            w, c, a = word + "".join(added), cost + 3 * len(added), audit + "I" * len(added)
            if i == len(rows):
                if LEGAL.fullmatch(w):
                    best = min(best, (c, a)) if best else (c, a)
                continue
            initial, fault = rows[i]
            walk(i + 1, w, c + 4, a + "D")
            if fault not in (R.BLANK, R.DUPLICATE):
                more = 3 * (fault == R.TRUNCATED)
                walk(i + 1, w + initial, c + more, a + "K")
                for symbol in "ua":
                    walk(i + 1, w + symbol, c + more + 3, a + "R")

    walk(0, "", 0, "")
    return best


def whole(rows):
    found = R.parse(rows)
    cost, rank, inserts = R.finish([(s, c) for s, c, _ in found])
    return cost, found[rank][2] + inserts


def test_every_short_conversation():
    kinds = [(i, f) for i in "suat" for f in (0, 3)] + [("u", 1), ("a", 2)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert whole(list(rows)) == all_edits(list(rows))
    rng = random.Random(5)
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(4)]
        assert whole(rows) == all_edits(rows)


def test_segments_compose():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice("suuaaat"), rng.choice([0, 0, 0, 3, 1, 2])) for _ in range(rng.randint(1, 40))]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=3))
        parts = [p for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) if (p := rows[a:b])]
        tables = [[R.parse(p, e) for e in range(len(R.STACKS))] for p in parts]
        cost, inserts, way = R.composed([[[(s, c) for s, c, _ in t] for t in table] for table in tables])
        audit = "".join(tables[k][e][place][2] for k, (e, place) in enumerate(way)) + inserts
        assert (cost, audit) == whole(rows)
        role = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
        repaired, at = [], 0
        for k, (e, place) in enumerate(way):
            piece = tables[k][e][place][2] + (inserts if k == len(way) - 1 else "")
            repaired += R.applied(piece, [(role[i], "x") for i, _ in parts[k]], R.NEXT[e])[0]
            at += len(parts[k])
        assert at == len(rows) and LEGAL.fullmatch("".join(r[0] for r, _ in repaired))


def text_or_space(x):
    return " " if x is None else str(x)


def plain(table):
    """The contract's rows: conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = text_or_space(role), text_or_space(text)
        kind = zlib.crc32(f"{text_or_space(conv)}:{text_or_space(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, parsed = set(), []
        for _, role, text in rows:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not marks else 2 if (role, text) in seen else 3 if marks[-1] not in ".!?" else 0
            seen.add((role, text))
            parsed.append((role[:1] or "?", fault))  # an empty role cannot stay
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(parsed))
        cost, audit = whole(parsed) if len(parsed) > 4 else all_edits(parsed)
        repaired, word, source = [], "", iter(rows)
        for letter in audit:
            if letter == "D":
                next(source)
                continue
            role, text = (None, "") if letter == "I" else next(source)[1:]
            if letter != "K":
                role = "assistant" if word.endswith("u") else "user"
            repaired.append(f"{role}:{text}")
            word += role[0]
        assert LEGAL.fullmatch(word)
        faults = [f for _, f in parsed]
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


EDGES = [
    (None, 0, "user", "hi."), (None, None, "assistant", "yes."), (None, None, None, None), (900, 1, "user", "a."), (900, 1, "user", "a."), (900, 1, "assistant", "a."),
    (901, None, "user", None), (902, 5, "tool", "x!"), (902, 9, "system", "s."), (902, 7, "", "no role."), (903, 0, "assistant", "end"), (904, 2, "user", "long. " * 50_000),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("conv"))
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    edges = spark.createDataFrame(EDGES, "conv_id long, turn long, role string, text string")
    long = spark.range(3000).select(F.lit(77_000).alias("conv_id"), "id", F.expr("CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'user' END").alias("role"), F.expr("concat('turn ', id % 1000, '.')").alias("text"))
    rows.union(edges).union(long).withColumn("audit", F.lit(1)).withColumn("part", F.lit("x")).repartition(5).write.parquet(f"{d}/conversations.parquet")
    return d


def test_query(spark, table):
    raw = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{table}/conversations.parquet").collect()]
    got = R.op13_repair_conversations(spark, table).collect()
    want = plain(raw)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_a_conversation_over_many_partitions(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}." if i % 5 else f"t{i}") for i in range(400)], "conv_id int, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary, repaired = R.repair_conversations(turns)
        assert repaired.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (one,) = summary.collect()
    text = R.digests(repaired).collect()[0]
    rows = [("u" if i % 2 == 0 else "a", 0 if i % 5 else 3) for i in range(400)]
    assert (one.cost, text.audit) == whole(rows) and one.gaps == 0 and one.illegal == 0 and one.truncated == 80


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, repaired = R.repair_conversations(empty)
    assert summary.count() == 0 and R.digests(repaired).count() == 0
