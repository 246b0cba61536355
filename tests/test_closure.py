"""Closure: known pairs are not moved in each round, and no round sends a table to the driver."""

from clausemill.functions import scratch
from clausemill.operators import graph


def test_rounds_move_only_their_own_pairs(spark, monkeypatch):
    plans = []
    add = scratch.Dealt.add
    monkeypatch.setattr(scratch.Dealt, "add", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), add(self, df)))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (1, 4), (1, 4), (9, 9)], "src long, dst long")
    got = {(r.src, r.dst): r.depth for r in graph.closure(edges).collect()}
    want, step = {}, {(r.src, r.dst) for r in edges.collect()}
    new, d = step, 1
    while new:
        want |= dict.fromkeys(new, d)
        new, d = {(a, c) for a, b in new for x, c in step if b == x} - set(want), d + 1
    assert got == want
    rounds = plans[2:]
    assert len(rounds) == 6 and not any("BroadcastExchange" in p for p in rounds)
    # Pairs go to the edges that extend them, and to their bucket; known pairs and edges stay.
    assert {p.count("Exchange hashpartitioning") for p in rounds} == {2}
    assert {(r.src, r.dst) for r in graph.closure(edges, depth=2).collect()} == {k for k, v in want.items() if v <= 2}


def test_reduction_reads_a_closure_that_is_there(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2), (2, 1), (4, 3), (4, 1), (5, 4)], "src long, dst long")
    both = [sorted(tuple(r) for r in graph.transitive_reduction(edges, reach).collect()) for reach in (None, graph.closure(edges))]
    assert both[0] == both[1] == [(2, 1), (3, 2), (4, 3), (5, 4)]
