"""Unique values over phases against pairs of rows, and peers against a loop to a fixpoint."""

import random

import pytest

from planweave.operators import uniqueness as U

VALUES = ["a", "b", "c", "d"]


def brute(rows, claims):
    """rows: id -> flags; claims: (id, version) -> set of keys; all keys are of one field."""
    get = lambda r, v: claims.get((r, v), set())
    create = {r for r, f in rows.items() if f["in_source"] and not f["in_target"]}
    staged = {r for r, f in rows.items() if f["in_source"] and f["in_target"] and f["has_published"] and f["stage_changes"]}
    source, target = {r for r in rows if rows[r]["in_source"]}, {r for r in rows if rows[r]["in_target"]}
    future = {r: get(r, "current") | (get(r, "published") if r in staged | create else set()) for r in source}
    released = set()
    for r in target & source:
        for k in get(r, "before"):
            if {x for x in target if k in get(x, "before")} == {r} and k not in get(r, "current") and any(k in f for x, f in future.items() if x != r):
                released.add(r)
    seed = {r: get(r, "published" if rows[r]["has_published"] else "current") for r in create}
    start = {r: get(r, "current" if r in released else "before") for r in target} | seed
    waits, conflicts = {}, {}

    def meet(incoming, holders, frees, phase, may_wait):
        edges, found = set(), {}
        for r, keys in incoming.items():
            for k in keys:
                owners = {o for o, ks in holders.items() if k in ks}
                free = {o for o in owners - {r} if may_wait and frees(o, k)}
                stay = {o for o in owners if not (may_wait and frees(o, k))}
                if stay - {r}:
                    conflicts[r, k, phase, "holder keeps the value"] = min(stay) if min(stay) != r else max(stay)
                if free:
                    found[r, k] = (min(free), len(free))
                    edges |= {(r, o, k) for o in free}
        reach = {}
        for r in incoming:
            seen, todo = set(), [r]
            while todo:
                x = todo.pop()
                new = {o for a, o, _ in edges if a == x} - seen
                seen |= new
                todo += new
            reach[r] = seen
        for (r, k), (o, n) in found.items():
            if any(r in reach.get(x, ()) or x == r for a, x, kk in edges if (a, kk) == (r, k)):
                conflicts[r, k, phase, "ring"] = o
            else:
                waits[r, k, phase] = (o, n)

    stage = {r: get(r, "published") for r in staged}
    meet(seed, start, None, "create-seed", False)
    meet(stage, start, lambda o, k: o in staged and k not in stage[o], "published-stage", True)
    end = start | stage
    last = {}
    for r in source:
        f = rows[r]
        if (r in staged or r in create and f["has_published"]) and not f["equal_slices"]:
            last[r] = get(r, "current")
        elif r in target and r not in staged and not f["current_kept"] and r not in released:
            last[r] = get(r, "current")
    meet(last, end, lambda o, k: o in source and k not in get(o, "current"), "current-restore", True)
    return waits, conflicts


@pytest.mark.parametrize("seed", range(2))
def test_phases(spark, seed):
    """Many small worlds at once, told apart by the model."""
    rng = random.Random(seed)
    rows, claims, want_waits, want_conflicts = [], [], {}, {}
    for w in range(40):
        flags, held = {}, {}
        for i in range(rng.randint(2, 5)):
            r = f"w{w:02d}-{i}"
            f = {"in_source": rng.random() < 0.85, "in_target": rng.random() < 0.8, "has_published": rng.random() < 0.6, "stage_changes": rng.random() < 0.7}
            if not f["in_source"] and not f["in_target"]:
                f["in_target"] = True
            b, c, p = (rng.choice([*VALUES, None]) for _ in range(3))
            f["equal_slices"], f["current_kept"] = c == p, b == c
            flags[r] = f
            for version, v, there in (("before", b, f["in_target"]), ("current", c, f["in_source"]), ("published", p, f["in_source"] and f["has_published"])):
                if there and v:
                    held.setdefault((r, version), set()).add(v)
                    claims.append((f"m{w}", "slug", "value", v, r, version))
            rows.append((r, *f.values()))
        a, b = brute(flags, held)
        want_waits |= a
        want_conflicts |= b
    waits, conflicts = U.unique_phases(
        spark.createDataFrame(rows, "record_id string, in_source boolean, in_target boolean, has_published boolean, stage_changes boolean, equal_slices boolean, current_kept boolean"),
        spark.createDataFrame(claims, "item_type_id string, field string, locale string, value string, record_id string, version string"),
    )
    assert {(r.record_id, r.value, r.phase): (r.holder, r.n) for r in waits.collect()} == want_waits
    assert {(r.record_id, r.value, r.phase, r.reason): r.holder for r in conflicts.collect()} == want_conflicts
    assert any(k[3] == "ring" for k in want_conflicts) and len(want_waits) > 3


def test_peers_to_a_fixpoint(spark):
    rng = random.Random(8)
    ids = [f"r{i:03d}" for i in range(120)]
    rows = {r: (rng.random() < 0.8, rng.random() < 0.7) for r in ids}
    claims = {r: {rng.choice(range(60)) for _ in range(rng.randint(0, 2))} for r in ids}
    claims |= {f"c{i}": {100 + i, 101 + i} for i in range(12)}  # a chain that falls one by one
    rows |= {f"c{i}": (True, True) for i in range(12)} | {"c11": (True, False)}
    preserved = {("p0", 3), ("p1", 7)}
    open_, support, want, step = {r for r in rows if rows[r][0]}, {r for r in rows if rows[r][1]}, {}, 0
    while True:
        backed = {r for r in open_ if any(k in claims[x] for k in claims[r] for x in support - {r}) or any(k in claims[r] for _, k in preserved)}
        out = open_ - backed
        if not out:
            break
        want |= {r: step for r in out}
        open_, support, step = backed, support - out, step + 1
    schema = "item_type_id string, field string, locale string, value string, record_id string, slice string"
    table = lambda pairs: spark.createDataFrame([("m", "f", "value", str(v), r, "current") for r, v in pairs], schema)
    got = U.unsupported_uniqueness(
        spark.createDataFrame([(r, "current", a, b) for r, (a, b) in rows.items()], "record_id string, slice string, checked boolean, supports boolean"),
        table([(r, v) for r, vs in claims.items() for v in vs]), table(preserved),
    )
    assert {r.record_id: r["round"] for r in got.collect()} == want
