"""Closures of long chains, rings, combs and random graphs against a plain walk."""

import random

import pytest
from evidencelake.operators import lifecycle


def reached(edges, root):
    ways, seen, todo = {}, set(), [root]
    for s, t in edges:
        ways.setdefault(s, []).append(t)
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += ways.get(n, [])
    return seen


CHAIN = [(i, i + 1) for i in range(10_000)]
RING = [(i, (i + 1) % 700) for i in range(700)]
COMB = [(i, i + 1) for i in range(2000)] + [(i, 10_000 + i) for i in range(2000)]
TAIL = RING + [(900 + i, 901 + i) for i in range(300)] + [(1200, 5), (300, 2000), (2000, 2001), (2001, 300)]


@pytest.mark.parametrize("edges, roots, most", [(CHAIN, [0, 9_990, 77_777], 20), (RING, [3], 14), (COMB, [0, 1990], 16), (TAIL, [900, 2001], 40)])
def test_rounds_of_long_paths(spark, monkeypatch, edges, roots, most):
    rounds = []
    real = lifecycle.shared
    monkeypatch.setattr(lifecycle, "shared", lambda frame: rounds.append(1) or real(frame))
    got = lifecycle.closure(spark.createDataFrame([(r, r) for r in roots], "root long, node long"), spark.createDataFrame(edges, "source long, target long")).collect()
    for root in roots:
        mine = [r["node"] for r in got if r["root"] == root]
        assert len(mine) == len(set(mine)) and set(mine) == reached(edges, root)
    # of a round, what it reached and the jumps of twice the length are written
    assert len(rounds) <= 2 * most + 8


def test_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 25), (40, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        roots = [(r, r) for r in (0, 5, 9)]
        got = lifecycle.closure(spark.createDataFrame(roots, "root long, node long"), spark.createDataFrame(edges, "source long, target long")).collect()
        assert {(r["root"], r["node"]) for r in got} == {(r, x) for r, _ in roots for x in reached(edges, r)} and len(got) == len({tuple(r) for r in got})
        back = [(t, s) for s, t in edges]
        changed = spark.createDataFrame([(3,), (7,)], "node long")
        assert {r["node"] for r in lifecycle.affected(changed, spark.createDataFrame(edges, "source long, target long")).collect()} == reached(back, 3) | reached(back, 7)
    none = spark.createDataFrame([], "source long, target long")
    assert [tuple(r) for r in lifecycle.closure(spark.createDataFrame([(1, 1)], "root long, node long"), none).collect()] == [(1, 1)]
