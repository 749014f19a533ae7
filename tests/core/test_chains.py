"""Levels of graphs with long chains."""

import random

import pytest

from planweave.operators import graph as G


def rows(df):
    return sorted(map(tuple, df.collect()))


def both(spark, ids, edges):
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    return nodes, spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_are_those_of_peeling(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i - 1) for i in range(1, 14)]  # a chain
    edges += [(20 + i, 20 + (i + 1) % 3) for i in range(3)] + [(30, 20), (31, 30), (32, 31), (32, 5), (33, 33)]  # a cycle, what leads to it, a self edge
    edges += [(a, b) for a, b in ((rng.randrange(40, 60), rng.randrange(0, 60)) for _ in range(18)) if a > b]  # forks
    nodes, e = both(spark, range(62), edges)
    a, b = G.topological_levels(nodes, e), G.chain_levels(nodes, e)
    assert rows(a[0]) == rows(b[0]) and rows(a[1]) == rows(b[1]) and len(rows(b[1])) >= 6


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(G, "kept", lambda df, name, real=G.kept: tables.append(name) or real(df, name))
    n = 300
    levels, left = G.chain_levels(*both(spark, range(n), [(i, i + 1) for i in range(n - 1)]))
    assert rows(levels) == [(i, n - 1 - i) for i in range(n)] and left.isEmpty() and len(tables) < 20
    only = G.chain_levels(*both(spark, [0, 1], [(0, 1), (1, 0)]))
    assert only[0].isEmpty() and only[1].count() == 2
