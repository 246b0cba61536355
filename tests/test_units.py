"""Literal cases, one row each."""

import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as t
from clausemill.operators import facts, refine, rules


def stated(spark, text):
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    q = facts.comparator(facts.canonicalise_units(facts.extract_quantities(rows, ["id"], "text")), "text")
    return [(round(r.canonical, 6), r.unit, r.comparator) for r in q.orderBy("start").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("11 kV", [(11000.0, "V", None)]),
        ("45 m head", [(45000.0, "mm", None)]),
        ("10 lps", [(36.0, "m3/h", None)]),
        ("15 HP", [(11185.5, "W", None)]),
        ("104 °F", [(40.0, "degC", None)]),
        ("not less than 20 mm", [(20.0, "mm", "min")]),
        ("1 NTU (max)", [(1.0, "NTU", "max")]),
        ("65 % or more", [(65.0, "%", "min")]),
        ("not more than 5 mA and at least 2 km", [(0.005, "A", "max"), (2e6, "mm", "min")]),
        ("IP55, M25, IS 732:2019, Fe 500D", []),
        ("", []),
    ],
)
def test_quantities(spark, text, want):
    assert stated(spark, text) == want


def test_interval_compare(spark):
    rows = [("none", 10.0, 20.0, 5.0, 30.0), ("disjoint", 50.0, 50.0, None, 40.0), ("partial", 30.0, 50.0, None, 40.0), ("none", None, 30.0, None, 40.0), ("disjoint", 45.0, None, None, 40.0)]
    df = spark.createDataFrame([(w, a, b, c, d) for w, a, b, c, d in rows], "want string, a double, b double, c double, d double")
    for r in df.select("want", rules.interval_compare(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got")).collect():
        assert r.got.overlap == r.want


def test_readiness(spark):
    one = spark.range(1).select(rules.readiness_score(F.lit(2), F.lit(1), F.lit(1), F.lit(1), F.lit(0)).alias("s")).first()
    assert one.s == 39


def test_running_header_goes(spark):
    rows = [(1, p, i, line) for p in range(3) for i, line in enumerate(["Tender 12/3 page", f"text {'abc'[p]}"])]
    kept = refine.strip_repeated_lines(spark.createDataFrame(rows, "doc int, page int, line_no int, line string")).collect()
    assert sorted(r.line for r in kept) == ["text a", "text b", "text c"]


def test_reflow_joins_and_dehyphenates(spark):
    lines = ["The insu-", "lation shall be", "tested.", "1. Item", "", "Rated current: 1600 A", "Next"]
    got = refine.reflow_lines(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, line_no int, line string")).orderBy("line_no")
    assert [r.line for r in got.collect()] == ["The insulation shall be tested.", "1. Item", "", "Rated current: 1600 A", "Next"]


def test_citations(spark):
    text = "IS:732-2019, IS 1554 (Part 1):1988, IS/IEC 61439-1:2020, IEC 60529"
    rows = facts.extract_citations(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text").orderBy("c_no").collect()
    assert [(r.designation, r.year) for r in rows] == [("IS 732", 2019), ("IS 1554 (Part 1)", 1988), ("IS/IEC 61439-1", 2020), ("IEC 60529", None)]


def test_decode(spark):
    rows = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfab"),), (bytearray("é€".encode()),), (bytearray(b"\x93q\x94 \xe9"),)], "content binary")
    assert [r.text for r in refine.decode_text(rows).collect()] == ["ab", "é€", "“q” é"]


def test_fnv(spark):
    assert spark.createDataFrame([("",), ("a",), ("foobar",)], "x string").select(t.fnv1a(F.col("x")).alias("h")).collect() == [(2166136261,), (0xE40C292C,), (0xBF9CF968,)]


def test_segment(spark):
    rows = refine.segment(spark.createDataFrame([(1, 0, "a) Refer to Cl. No. 5 here. The pump shall run. Next!")], "doc int, line_no int, line string")).orderBy("seg_no").collect()
    assert [r.segment for r in rows] == ["Refer to Cl. No. 5 here.", "The pump shall run.", "Next!"]


def test_queries_read_whole_texts(spark, tmp_path):
    from clausemill import plans
    from clausemill.plans import more

    long = "same words " * 300
    rows = [(1, long + "a"), (2, long + "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(r.text for r in more._labelled(spark, str(tmp_path)).collect()) == [t for _, t in rows]

    def fnv(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    got = {r.doc: r.fnv for r in plans.queries()["s15_content_fingerprint"](spark, str(tmp_path)).collect()}
    assert got == {k: fnv(t) for k, t in rows}
