"""Edges of the evidence paths are packed in few bytes, and unpacked to what they were."""

import pytest
from pyspark.sql import functions as F

from clausemill.operators import graph


@pytest.mark.parametrize("dst", ["id + 1000000", "id * 5000", "id * 3000000000", "concat('n', id)", "if(id = 7, null, id)", "(id - 50) * 180000000000000000"])
@pytest.mark.parametrize("grades", [3, 500])
def test_edges_come_back(spark, dst, grades):
    edges = spark.range(0, 100).select((F.col("id") % 3).alias("src"), F.expr(dst).alias("dst"), (F.col("id") % grades / 7).alias("confidence"), F.expr("if(id % 5 = 0, null, id % 2 = 0)").alias("current"))
    bundles = graph._bundles(edges)
    packed, array, edge = graph._packed(bundles)
    e = F.col("_edges")
    got = packed.select("_at", e, F.explode(array(e)).alias("one")).select("_at", edge(F.col("_edges"), F.col("one")).alias("e")).select("_at", "e.*")
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert rows(got) == rows(edges.select(F.col("src").cast("string"), "dst", "confidence", "current"))
    assert got.schema["dst"].dataType == edges.schema["dst"].dataType


def test_few_grades_and_near_numbers_take_three_bytes(spark):
    edges = spark.range(0, 1000).select((F.col("id") % 7).alias("src"), (F.col("id") + 10**12).alias("dst"), (F.col("id") % 9 / 7).alias("confidence"), F.lit(True).alias("current"))
    types = {f.name: f.dataType.simpleString() for f in graph._packed(graph._bundles(edges))[0].schema["_edges"].dataType}
    assert types == {"least": "bigint", "dst": "array<smallint>", "grade": "array<tinyint>"}
