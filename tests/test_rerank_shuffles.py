"""Features of hits: sets of clauses, standards and queries come to the hits, which are shuffled once for each of the three."""

from clausemill.operators import retrieval


def _tables(spark):
    frame = spark.createDataFrame
    hits = [(1, 10, 1, 4.0), (1, 11, 1, 2.0), (1, 20, 2, 3.0), (2, 10, 1, 1.0), (2, 30, None, 0.5), (3, 40, 4, 0.0), (None, 10, 1, 2.0)]
    return dict(
        hits=frame(hits, "qid long, did long, standard long, score double"),
        parameters=frame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "z"), (None, "a")], "qid long, parameter string"),
        clause_parameters=frame([(10, 1, "b"), (10, 1, "a"), (10, 1, "a"), (11, 1, "c"), (20, 2, None), (None, 4, "z")], "did long, standard long, parameter string"),
        terms=frame([(1, "pump"), (1, "motor"), (2, "cable")], "qid long, term string"),
        context=frame([(1, "cable"), (3, "pump")], "qid long, term string"),
        products=frame([(1, "pump"), (1, "motor"), (2, "cable"), (4, None)], "standard long, term string"),
        explicit=frame([(1, 2), (1, 2), (3, None)], "qid long, standard long"),
        cited=frame([(1, 1), (1, 2), (2, 2)], "qid long, standard long"),
    )


def test_features_of_each_hit(spark):
    got = {(r.qid, r.did): tuple(r)[3:] for r in retrieval.rerank_features(**_tables(spark)).collect()}
    assert got == {
        (1, 10): (4.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, False, ["a", "b"], "motor"),
        (1, 11): (2.0, 0.5, 0.0, 0.5 / 0.75, 1.0, 0.0, 1.0, False, [], "motor"),
        (1, 20): (3.0, 0.75, 0.0, 0.0, 0.0, 1.0, 0.0, True, [], None),
        (2, 10): (1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, [], None),
        (2, 30): (0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, False, [], None),
        (3, 40): (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, [], None),
        (None, 10): (2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, [], None),
    }


def test_hits_are_shuffled_once_for_clauses_standards_and_queries(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.rerank_features(**_tables(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Three for the hits, and one for each of the eight sets that they meet.
    assert plan.count("Exchange hashpartitioning") == 11
