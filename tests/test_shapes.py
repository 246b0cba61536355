"""Operators over skewed and random inputs, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clausemill.operators import evaluation, graph, knowledge, rules, stored_index


def components(edges):
    """Strongly connected components of more than one node, by reachability from each node."""
    out = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out[a].add(b)
    nodes = set(out) | {b for bs in out.values() for b in bs}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in nodes}
    found = {}
    for a in nodes:
        own = {b for b in far[a] if a in far[b]} | {a}
        if len(own) > 1:
            found[a] = min(own)
    return found


@pytest.mark.parametrize("seed", range(2))
def test_cycles_equal_reachability(spark, seed):
    draw = random.Random(seed)
    edges = []
    for base in range(0, 400, 40):  # several graphs of different density, some with long chains
        n = draw.randint(1, 40)
        edges += [(base + draw.randrange(n), base + draw.randrange(n)) for _ in range(draw.choice([n // 2, n, 3 * n // 2]))]
        if draw.random() < 0.5:
            edges += [(base + i, base + (i + 1) % n) for i in range(draw.randint(0, n))]
    edges += [(None, 1), (2, None)]
    got = {r.node: r.component for r in graph.find_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components(edges)


def test_one_cycle_of_many_nodes(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(n, n + 500).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    got = graph.find_cycles(ring.union(tail))
    assert got.agg(F.count("*"), F.max("component"), F.max("node")).first() == (n, 0, n - 1)


def inconsistent(rows):
    out = {}
    for i, (doc, req, parameter, lo, hi) in enumerate(rows):
        if doc is None or parameter is None or req is None:
            continue
        low = lambda x: float("-inf") if x is None else x
        high = lambda x: float("inf") if x is None else x
        later = [r for d, r, p, a, b in rows if d == doc and p == parameter and r is not None and r > req and (low(a) > high(hi) or low(lo) > high(b))]
        if later:
            out[doc, parameter, req] = min(min(later), out.get((doc, parameter, req), min(later)))
    return out


@pytest.mark.parametrize("bits", [2, 7])
def test_first_later_disagreement(spark, monkeypatch, bits):
    monkeypatch.setattr(rules, "BLOCK_BITS", bits)
    draw = random.Random(bits)
    rows = []
    for _ in range(700):
        a = draw.choice([None, draw.randrange(40)])
        rows.append((draw.choice([1, 1, 1, 2, 3, None]), draw.choice([draw.randrange(300), None]) if draw.random() < 0.1 else draw.randrange(300), draw.choice(["x", "x", "y", None]), a, draw.choice([None, (a or 0) + draw.randrange(30)])))
    rows = [(d, r, p, None if a is None else float(a), None if b is None else float(b)) for d, r, p, a, b in rows]
    df = spark.createDataFrame(rows, "doc long, req long, parameter string, lo double, hi double")
    got = {(r.doc, r.parameter, r.req): r.other for r in rules.internal_inconsistency(df).collect()}
    assert got == inconsistent(rows)
    assert rules.internal_inconsistency(df.limit(0)).collect() == []


def test_one_document_of_many_requirements(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("req"), F.lit("frequency").alias("parameter"), F.when(F.col("id") == n - 1, 60.0).otherwise(50.0).alias("lo"), F.when(F.col("id") == n - 1, 60.0).otherwise(50.0).alias("hi"))
    got = rules.internal_inconsistency(df).agg(F.count("*"), F.min("other"), F.max("req")).first()
    assert got == (n - 1, n - 1, n - 2)


def test_greedy_match_equals_one_after_the_other(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(12), draw.randrange(9), draw.randrange(9)) for _ in range(420)] + [(50, a, b) for a in range(7) for b in range(5)] + [(None, 1, 2), (1, None, 2)]
    want = set()
    for doc in {p[0] for p in pairs if p[0] is not None}:
        used = set()
        for gold in sorted({g for d, g, _ in pairs if d == doc and g is not None}):
            free = sorted({p for d, g, p in pairs if (d, g) == (doc, gold)} - used)
            if free:
                used.add(free[0])
                want.add((doc, gold, free[0]))
    got = evaluation.greedy_match(spark.createDataFrame(pairs, "doc long, gold long, predicted long"))
    assert {tuple(r) for r in got.collect()} == want
    assert evaluation.greedy_match(spark.createDataFrame([], "doc long, gold long, predicted long")).collect() == []


def test_similar_texts_equal_all_pairs(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(14)]
    make = lambda: [(draw.randrange(3), i, ["the"] * draw.randint(0, 1) + [draw.choice(words) for _ in range(draw.randint(0, 9))]) for i in range(90)]
    gold, predicted = make(), make()
    want = {}
    for d, i, a in gold:
        for e, j, b in predicted:
            x, y = set(a), set(b)
            k = len(x & y)
            if d == e and k and (k / len(x | y) >= 0.6 or k == min(len(x), len(y))):
                want[d, i, j] = round(k / len(x | y), 6)
    g, p = spark.createDataFrame(gold, "doc long, gid long, tokens array<string>"), spark.createDataFrame(predicted, "doc long, pid long, tokens array<string>")
    got = {(r.doc, r.gid, r.pid): r.jaccard for r in evaluation.text_match_candidates(g, p).collect()}
    assert got == want


def test_a_token_of_all_texts_brings_none_together(spark):
    n = 4000
    side = lambda one: spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias(one), F.array(F.lit("the"), F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")).alias("tokens"))
    got = evaluation.text_match_candidates(side("gid"), side("pid"))
    assert got.agg(F.count("*"), F.count_if(F.col("gid") == F.col("pid"))).first() == (n, n)


def test_paths_take_the_best_of_each_end(spark):
    starts = spark.createDataFrame([(1, "requirement", "r1"), (2, "requirement", "r2")], "doc long, kind string, node string")
    edge = "src string, dst string, confidence double, current boolean"
    mapped = spark.createDataFrame([("r1", "s1", 0.9, True), ("r1", "s2", 0.8, False), ("r1", "s3", 0.5, True)], edge)
    tests = spark.createDataFrame([("s1", "t1", 1.0, True), ("s3", "t1", 1.0, True)], edge)
    got = graph.evidence_paths(starts, [("standard", "requirement", mapped, True), ("test", "standard", tests, False)], most=1).orderBy("path_no").collect()
    assert [([x.node for x in r.nodes], r.current, r.confidence) for r in got] == [(["r1", "s1", "t1"], True, 0.9), (["r1", "s2"], False, 0.8)]


def test_stored_index_equals_all_scores(spark):
    draw = random.Random(11)
    words = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, "common " + " ".join(draw.choices(words, weights, k=draw.randint(0, 30))), draw.choice(["alpha", "beta", None])) for i in range(900)] + [(900, None, None), (901, "", "x")]
    df = spark.createDataFrame(docs, "did long, text string, source string")
    asked = spark.createDataFrame([(i, "common " + " ".join(draw.choices(words, k=draw.randint(0, 8)))) for i in range(40)] + [(99, None), (98, "unknown")], "qid long, text string")
    fields = {"text": 1.0, "source": 2.0}
    query = knowledge.build_query(asked, {"text": 1.0})
    want = knowledge.top_n(knowledge.bm25(query, knowledge.build_index(df, fields)), 10)
    index = stored_index.write_index(df, fields)
    got = stored_index.top_n(index, query, 10)
    as_rows = lambda t: sorted((r.qid, r.rank, r.did, round(r.score, 6)) for r in t.collect())
    assert as_rows(got) == as_rows(want)
    # Blocks stay where they are: the scan is bucketed, and the query comes to it.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored_index._needed(index, query, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(token") == 1  # the query's
