"""Titles of uploads of which nothing tells one."""

from pyspark.sql import functions as F

from clausemill.functions import text as t


def test_text_without_a_line_of_four_characters_has_no_title(spark):
    rows = spark.createDataFrame([(1, " ", None, "ab\n\n  c "), (2, None, None, ""), (3, None, None, None), (4, None, None, "ab\n Scope of work "), (5, None, "a_b.pdf", "")], "id int, name string, file string, text string")
    got = [r.title for r in rows.orderBy("id").select(t.title_of(F.col("name"), F.col("file"), F.col("text")).alias("title")).collect()]
    assert got == [None, None, None, "Scope of work", "a b"]
