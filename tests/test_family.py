"""Families of standards: each pair of a chain comes from one join, without a shuffle of the pairs."""

from clausemill.operators import graph


def test_pairs_of_a_chain_are_not_shuffled(spark):
    replaced = spark.createDataFrame([(2, 1), (3, 2), (6, 5), (8, 7), (7, 8), (9, 9)], "src long, dst long")
    related = spark.createDataFrame([(1, 3), (3, 5), (5, 10), (10, 5), (11, 11), (None, 1)], "src long, dst long")
    got = graph.standard_family(replaced, related)
    chains = {(a, b) for c in ((1, 2, 3), (5, 6)) for a in c for b in c if a != b}
    assert sorted(tuple(r) for r in got.collect()) == sorted(chains | {(1, 5), (1, 10), (3, 5), (3, 10), (5, 10), (10, 5)})
    assert not got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
