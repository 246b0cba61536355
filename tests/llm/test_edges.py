"""Clashing columns, nulls, repeats, empty tables and very long texts, for the forms that keep rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm import bpe, exact_dedup, jaccard_join, language_id, licences, mixing, paragraphs, toxicity, warc

#: Names that the operators use inside.
NAMES = ["row", "k", "h", "name", "rows", "copies", "cuts", "t", "d", "id", "n", "part", "src", "units", "_k", "_n"]


def table(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, mark long")
    for c in NAMES:
        df = df.withColumn(c, F.concat(F.lit(f"{c}-"), "mark"))
    return df


def whole(df, kept):
    """The marks of kept rows, each of which must be as it was."""
    rows = kept.collect()
    assert kept.columns == df.columns
    was = {r["mark"]: r for r in df.collect()}
    assert all(r == was[r["mark"]] for r in rows)
    return sorted(r["mark"] for r in rows)


def test_exact_duplicates_with_clashing_columns(spark):
    df = table(spark, [(1, "A b", "s"), (2, "a B", None), (None, "a b", "s"), (3, None, "s"), (4, "", "s"), (5, "x", "s"), (5, "y", "s")])
    assert whole(df, exact_dedup.drop_exact_duplicates(df)) == [1, 4, 5, 6]
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_with_clashing_columns(spark):
    near = "a b c d e f g h"
    df = table(spark, [(2, near, "s"), (1, near + " i", None), (None, near + " j", "s"), (3, None, "s"), (4, "", "s"), (1, "quite another text stands here", "s"), (5, "one two", "s"), (6, "ONE two", "s")])
    assert whole(df, jaccard_join.drop_near_duplicates(df)) == [1, 3, 4, 5, 6]
    assert jaccard_join.drop_near_duplicates(df.limit(0)).collect() == []


def test_mix_with_clashing_columns(spark):
    df = table(spark, [(i % 30, "w " * (i % 7) if i % 5 else None, [None, "a", "b"][i % 3]) for i in range(60)] + [(None, "w w", "a"), (99, "w", "b"), (99, "w", "b")])
    plan = mixing.mix_plan(df)
    assert plan.count() == df.count()
    marks = whole(df, mixing.mix(df))
    assert len(marks) == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(df.limit(0)).collect() == []


def test_toxic_rows_with_clashing_columns(spark):
    df = table(spark, [(1, "fine words here", "s"), (None, None, None), (2, "", "s"), (1, "fine words here", "s")]).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert whole(df, toxicity.drop_toxic(df, labels)) == [0, 1, 2, 3]
    assert toxicity.drop_toxic(df.limit(0), labels).collect() == []


@pytest.fixture(scope="module")
def long_text():
    draw = random.Random(4)
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(150_000))


def test_texts_of_a_million_characters(spark, long_text):
    rows = [(1, long_text, "a"), (2, long_text.upper(), "a"), (3, long_text + " end", "b"), (4, "short", "b"), (5, "x" * 1_000_000, "b"), (6, "( " * 300_000, None)]
    df = table(spark, rows)
    assert len(long_text) > 1_000_000
    groups = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(df).collect()}
    assert groups == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    near = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_components(df).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    sizes = {r.id: r.size for r in mixing.mix_plan(df).collect()}
    assert sizes == {1: 150_000, 2: 150_000, 3: 150_001, 4: 1, 5: 1, 6: 300_000}
    hit = {r.doc_id for r in paragraphs.repeated_paragraphs(df).where("removed").collect()}
    assert hit >= {2, 3} and not hit & {1, 4, 5}
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(df, labels).count() == 6
    assert licences.scan_licences(df).where("licence = 'none'").count() == 6
    few = df.where("doc_id in (4, 5)")
    assert bpe.encode_documents(few, columns=("n_tokens", "ids_sha256")).count() == 2


def test_long_and_broken_pages(spark, long_text, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat with this and that", "en"), (2, "der hund und die katze mit dem haus auf", "de")], "doc_id long, text string, lang string")
    pages = [(1, "http://a/", f"<html lang=de><p>{long_text}"), (2, "http://a/", "<script" * 100_000), (3, "http://a/", "<!--" * 100_000), (4, "http://a/", "<" * 500_000), (5, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language_id.identify_languages(df, docs).collect()} == {1: "de", 2: None, 3: None, 4: None, 5: None}
    got = {r.page_id: r.payload_bytes for r in warc.archive_round_trip(df, str(tmp_path / "w")).collect()}
    assert got == {k: len((h or "").encode()) for k, _, h in pages}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from clausemill.llm import common

    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Jsc:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isEmpty():
                                return True

                        return Option

                return Jsc

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
