"""Evidence paths: edges come to a document's paths in arrays, so that branched paths are not shuffled."""

from pyspark.sql import functions as F

from clausemill.operators import graph


def _edges(df, src, dst, confidence=1.0):
    return df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(confidence).alias("confidence"), F.lit(True).alias("current"))


def test_branched_paths_stay_with_their_document(spark):
    starts = spark.range(40).select((F.col("id") % 4).alias("doc"), F.lit("r").alias("kind"), F.col("id").alias("node"))
    hops = [
        ("s", "r", _edges(spark.range(40), "id", "id % 5", 0.5), True),
        ("c", "s", _edges(spark.range(1500), "id % 5", "id"), True),  # 300 a node: more than an array holds
        ("t", "s", _edges(spark.range(3), "id", "100 + id"), False),
        ("z", "s", _edges(spark.range(600), "4", "id"), False),  # a later hop with more than an array holds
    ]
    got = graph.evidence_paths(starts, hops, most=400)
    rows = {}
    for r in got.collect():
        nodes = tuple((n.kind, n.node) for n in r.nodes)
        assert nodes not in rows and r.current and r.confidence == 0.5
        rows[nodes] = (r.doc, r.path_no)
    # A test method keeps 400 of its paths of each document; of standard 4 each document has two requirements.
    by_end = {}
    for nodes, (doc, _) in rows.items():
        s = int(nodes[1][1])
        assert [k for k, _ in nodes] == ["r", "s", "c"] + (["t"] if s < 3 else []) + (["z"] if s == 4 else [])
        assert int(nodes[2][1]) % 5 == s and int(nodes[0][1]) % 5 == s and int(nodes[0][1]) % 4 == doc
        by_end[doc, s] = by_end.get((doc, s), 0) + 1
    assert by_end == {(d, s): 400 if s < 3 else 600 if s == 3 else 600 * 400 for d in range(4) for s in range(5)}


def test_only_one_shuffle_by_document_after_the_last_lookup(spark):
    starts = spark.range(8).select((F.col("id") % 4).alias("doc"), F.lit("r").alias("kind"), F.col("id").alias("node"))
    hops = [("s", "r", _edges(spark.range(8), "id", "id"), True), ("c", "s", _edges(spark.range(64), "id % 8", "id"), True), ("t", "s", _edges(spark.range(4), "id", "id"), False)]
    got = graph.evidence_paths(starts, hops)
    assert got.count() == 4 * 8 + 4 * 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") == 1
