"""Scope of standards: one term of very many documents and standards costs no product of the two."""

from pyspark.sql import functions as F

from clausemill.operators import rules


def test_a_term_of_all_standards_is_not_multiplied_out(spark):
    n = 100_000  # the product of documents and standards would have 10**10 rows
    ids = spark.range(n)
    pairs = ids.select(F.col("id").alias("doc"), F.col("id").alias("standard"))
    doc_terms = ids.where("id % 2 = 0").select(F.col("id").alias("doc"), F.when(F.col("id") % 4 == 0, "bolt").otherwise("gear").alias("term"))
    standard_terms = ids.select(F.col("id").alias("standard"), F.lit("bolt").alias("term"))
    got = rules.in_scope(pairs, doc_terms, standard_terms)
    assert {(r.m, r.scope): r.n for r in got.groupBy((F.col("doc") % 4).alias("m"), "scope").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, True): n // 4, (2, False): n // 4, (1, True): n // 4, (3, True): n // 4}
