"""Scores at the middle between two roundings are ordered as in SQL, and sums don't depend on the order of rows."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from clausemill.functions.numeric import steady_sum
from clausemill.operators import retrieval

SQL = """WITH bm AS (SELECT qid, did, sum(weight * ln(1 + (2 - 1 + 0.5) / (1 + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score FROM query JOIN postings USING (token) GROUP BY 1, 2)
SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM bm"""


def test_ranks_at_the_middle_of_two_roundings(spark):
    draw, unit = random.Random(3), math.log(2) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 7 / 5.5))
    query = []
    for qid in range(600):
        k = draw.randint(10**9, 2 * 10**10)
        query += [(qid, "a", (k + 0.5) * 1e-9 / unit), (qid, "b", (k + 0.2) * 1e-9 / unit)]
    postings = [("a", 2, 3.0, 7.0, 2, 5.5), ("b", 1, 3.0, 7.0, 2, 5.5)]
    got = retrieval.rank_clauses(spark.createDataFrame(query, "qid int, token string, weight double"), spark.createDataFrame(postings, "token string, did long, tf double, length double, n long, mean_length double"))
    con = duckdb.connect()
    con.execute("create table query (qid int, token varchar, weight double)")
    con.execute("create table postings (token varchar, did bigint, tf double, length double, n bigint, mean_length double)")
    con.executemany("insert into query values (?, ?, ?)", query)
    con.executemany("insert into postings values (?, ?, ?, ?, ?, ?)", postings)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(SQL).fetchall())


def test_sums_are_the_same_in_any_order(spark):
    draw = random.Random(4)
    values = [draw.uniform(0, 10 ** draw.randint(-6, 2)) for _ in range(40)]
    rows = [(i, x) for i in range(50) for x in draw.sample(values, len(values))]
    got = spark.createDataFrame(rows, "did int, gain double").groupBy("did").agg(steady_sum(F.col("gain")).alias("score")).collect()
    assert {r.score for r in got} == {math.fsum(values)}
