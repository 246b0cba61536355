import hashlib
import string
from collections import defaultdict

from pyspark.sql import functions as F

from clausemill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [(1, "Ab cd"), (2, "aB CD"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, "x" * 50), (8, "X" * 50), (9, "x" * 49 + "y"), (9, "x" * 49 + "y"), (9, "x" * 49 + "y"), (10, "abcd" * 9), (11, "abcd" * 8 + "abce"), (None, "lone"), (12, "ab cd"), (12, "ab cd"), (None, None)]


def expected(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[(t or "").translate(FOLD)].append(k)
    out = []
    for k, t in rows:
        body = (t or "").translate(FOLD)
        keep = max((x for x in groups[body] if x is not None), default=None)
        out.append((k, keep, len(groups[body]), k == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def test_blocks_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("pos", F.lit(1))
    for block in (4, 7, 4096):
        got = exact_duplicates(df, block=block)
        assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_colliding_digests_are_told_apart(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_duplicates(df, block=5, digest=lambda b: F.pmod(F.xxhash64(b), F.lit(2)))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_dropping_keeps_rows_as_they_were(spark):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(ROWS)], "doc_id long, text string, _k long")
    rows = drop_exact_duplicates(df).select("doc_id", "text").collect()
    assert len(rows) == len({(t or "").translate(FOLD) for _, t in ROWS})
    assert {(r[0], r[1]) for r in rows} <= set(ROWS)
