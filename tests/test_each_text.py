"""Patterns run once over each distinct text, in as many tasks as a shuffle has."""

from pyspark.sql import functions as F

from clausemill.functions import scratch
from clausemill.operators import attributes, models


def _rows(spark):
    text = F.when(F.col("id") % 4 == 0, "Cables of copper conductor shall be tested to IS 7098").when(F.col("id") % 4 == 1, "Motors of 415 V, IE3").when(F.col("id") % 4 == 2, "Plain words")
    return spark.range(400).select(F.col("id").alias("key"), text.alias("text")).coalesce(1)


def test_work_sees_each_text_once(spark):
    seen = []
    got = scratch.each_text(_rows(spark), "text", lambda texts, key: seen.append(texts) or texts.where("coalesce(text, '') <> 'Plain words'").select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.length("text").alias("size")))
    assert seen[0].count() == 4
    assert got.columns == ["key", "text", "n", "size"]
    rows = got.collect()
    assert len(rows) == 600 and len({(r.key, r.n) for r in rows}) == 600
    assert all(r.size == (None if r.text is None else len(r.text)) and r.text != "Plain words" for r in rows)


def test_fragments_and_features_read_each_text_once(spark, monkeypatch):
    counts = []
    for module in (attributes, models):
        monkeypatch.setattr(module, "each_text", lambda rows, text, work: scratch.each_text(rows, text, lambda texts, key: counts.append(texts.count()) or work(texts, key)))
    rows = _rows(spark)
    fragments = {r.key: r for r in attributes.structure_fragments(rows, ["key"], "text").collect()}
    assert len(fragments) == 400 and counts == [4]
    assert all(r.references == (["IS 7098"] if k % 4 == 0 else []) for k, r in fragments.items())
    assert {len({tuple(r.features) for r in models.symbolic_features(rows.where(f"key % 4 = {i}"), ["key"], "text").collect()}) for i in range(4)} == {1}
    assert counts == [4, 1, 1, 1, 1]
