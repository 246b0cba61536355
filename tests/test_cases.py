"""Literal cases of quantities, tables, attributes, stores, streams and models, one row each."""

import json
import threading
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clausemill.operators import analysis, attributes, evaluation, facts, knowledge, models, quantities, refine, tables
from clausemill.sources import results, uploads
from clausemill.streaming import runs


def intervals(spark, text):
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r.unit, r.comparator, r.value, r.lo, r.hi, r.tolerance and round(r.tolerance, 6)) for r in quantities.all_quantities(rows, ["id"], "text").orderBy("q_no").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("415 V ± 10 %", [("V", "tolerance", 415.0, 373.5, 456.5, 0.1)]),
        ("415 V AC ±10 pct", [("V", "tolerance", 415.0, 373.5, 456.5, 0.1)]),
        ("1000 mm ± 5 mm", [("mm", "tolerance", 1000.0, 995.0, 1005.0, 0.005)]),
        ("±10 %", [("%", "tolerance", 10.0, 10.0, 10.0, 0.1)]),
        ("-5 to 50 °C", [("degC", "range", None, -5.0, 50.0, None)]),
        ("between 10 and 20 lps", [("m3/h", "range", None, 36.0, 72.0, None)]),
        ("from 40 °C max", [("degC", "eq", 40.0, 40.0, 40.0, None)]),
        ("10 V to 5 A", []),
        ("3 KILOVOLT, 5 ma", [("V", "eq", 3000.0, 3000.0, 3000.0, None)]),
        ("1.5 k.W. or more", [("W", "min", 1500.0, 1500.0, None, None)]),
        ("60 cu.m/hr, 2,500 kg per cubic metre", [("m3/h", "eq", 60.0, 60.0, 60.0, None), ("kg/m3", "eq", 2500.0, 2500.0, 2500.0, None)]),
        ("pH 6.5 to 8.5", [("pH", "range", None, 6.5, 8.5, None)]),
        ("pH of 7 and w/c ratio 0.45", [("pH", "eq", 7.0, 7.0, 7.0, None), ("ratio", "max", 0.45, None, 0.45, None)]),
        ("pH as IS 10500:2012", []),
        ("IP55, M25, Fe500", []),
        ("", []),
    ],
)
def test_intervals(spark, text, want):
    assert intervals(spark, text) == want


def test_null_text_has_no_quantities(spark):
    assert intervals(spark, None) == []


def test_tolerance_keeps_small_values(spark):
    row = facts.tolerance_bounds(spark.createDataFrame([(1.5e-9, 1e-10, False)], "value double, tolerance double, relative boolean")).first()
    assert (row.lo, row.hi) == (1.4e-9, 1.6e-9)


def test_tables_become_sentences(spark):
    lines = ["Intro", "Sl. No. | Particulars | Unit | Offered", "1 | Rated power | kVA | 630", "2 | 3.5 core cable | m | 50 for 1 s", "", "Parameter | Unit | Result | Acceptable limit", "Turbidity | NTU | 3.2 | 1", "x", "Test | Requirement | Observed | Result", "| HV | 3 kV | 3 kV | Fail |", "y", "Item | Qty | Unit | Rate", "Pump | 4 | Nos. | 100", "end"]
    got = tables.linearize_tables(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc long, line_no int, line string")).orderBy("line_no")
    want = ["Intro", "", "Rated power: 630 kVA.", "Item 2: 3.5 core cable: 50 m for 1 s.", "", "", "Turbidity: acceptable limit 1 NTU; result 3.2 NTU.", "x", "", "HV: requirement 3 kV; observed 3 kV; Fail.", "y", ""]
    assert [r.line for r in got.collect()][: len(want)] == want


def test_entities(spark):
    text = "Concrete of grade M 25, Fe500D, IP-55, aluminum and PVC, ISI marked; routine tests shall be done"
    rows = facts.extract_entities(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text").collect()
    assert {(r.kind, r.value) for r in rows} == {("ip_rating", "IP55"), ("concrete_grade", "M25"), ("steel_grade", "Fe 500D"), ("material", "aluminium"), ("material", "PVC"), ("certification", "isi mark"), ("test", "routine tests")}


def test_product_terms_of_several_words(spark):
    df = spark.createDataFrame([("A submersible pump with MCCB",), ("3-phase motors",), ("pumping",), (None,)], "t string")
    assert [r.x for r in df.select(facts.product_terms_of(F.col("t")).alias("x")).collect()] == [["submersible pump", "pump", "circuit breaker"], ["induction motor"], [], []]


def test_wording_after_its_cue(spark):
    rows = [(1, "mild steel; exposure shall be taken as severe"), (2, "no coliforms in any sample"), (3, "OPC 53 grade"), (4, None)]
    got = attributes.extract_text_parameters(spark.createDataFrame(rows, "k int, text string"), ["k"], "text").collect()
    assert {(r.k, r.parameter, r.value) for r in got} == {(1, "exposure_condition", "severe"), (2, "bacteriological_quality", "coliforms not detectable"), (3, "cement_type", "OPC 53 grade")}


def test_relations_are_inherited_by_coordination(spark):
    text = "Cement shall conform to IS 269, IS 383 and IS 1786. See IS 456. Tested in accordance with IS 516"
    rows = spark.createDataFrame([(1, text)], "key int, text string")
    got = knowledge.extract_relations(rows, facts.extract_citations(rows, ["key"], "text")).collect()
    assert {r.designation: (r.type, r.confidence) for r in got} == {"IS 269": ("REQUIRES", 0.8), "IS 383": ("REQUIRES", 0.7), "IS 1786": ("REQUIRES", 0.7), "IS 456": ("REFERENCES", 0.6), "IS 516": ("TESTED_BY", 0.8)}


def test_only_part_and_part_one(spark):
    cited = spark.createDataFrame([("a", "IS 1", None), ("b", "IS 2", None), ("c", "IS 3", None)], "cid string, designation string, year int")
    known = spark.createDataFrame([(1, "IS 1 (Part 4)", 2000, "current"), (2, "IS 2 (Part 1)", 2000, "current"), (3, "IS 2 (Part 2)", 2000, "current"), (4, "IS 3 (Part 2)", 2000, "current"), (5, "IS 3 (Part 5)", 2000, "current")], "sid int, designation string, year int, status string")
    got = {r.cid: (r.sid, r.confidence) for r in knowledge.resolve_citations(cited, known).collect()}
    assert got == {"a": (1, 0.8), "b": (2, 0.6), "c": (None, 0.0)}
    old = knowledge.prior_replacements(spark.createDataFrame([("a", 1, 0.9, "older")], "cid string, sid int, confidence double, edition string"), spark.createDataFrame([("a", "IS 1", 1990)], "cid string, designation string, year int"), spark.createDataFrame([(1, 1990, 7)], "sid int, year int, replaced_by int"))
    assert old.first().replaced_by == 7


def test_results_are_replaced_run_by_run(spark, tmp_path):
    rows = lambda *r: {"findings": spark.createDataFrame(list(r), "run_id long, x string")}
    results.write_results(rows((1, "a"), (1, "b"), (2, "c")), str(tmp_path))
    results.write_results(rows((1, "d")), str(tmp_path))
    assert {(r.run_id, r.x) for r in spark.read.parquet(f"{tmp_path}/findings").collect()} == {(1, "d"), (2, "c")}


def test_newest_version_is_active(spark, tmp_path):
    for version, x in (("b", 1), ("a", 2)):
        results.publish_corpus({"t": spark.createDataFrame([(x,)], "x int")}, str(tmp_path), version)
    assert results.active_corpus(spark, str(tmp_path), "t").first().x == 2


def test_publishers_at_once_get_numbers_of_their_own(spark, tmp_path):
    numbers, rows = [], spark.range(3)
    publish = lambda v: numbers.append((results.publish_corpus({"t": rows}, str(tmp_path), v), v))
    threads = [threading.Thread(target=publish, args=(f"v{i}",)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in numbers) == list(range(1, 7))
    found = {(r.number, r.version): r.active for r in results.corpus_versions(spark, str(tmp_path)).collect()}
    assert found == {x: x[0] == 6 for x in numbers}
    with pytest.raises(ValueError):
        results.active_corpus(spark, str(tmp_path / "nothing"), "t")


def test_records_of_any_tasks(spark, tmp_path):
    one = {"run": "a", "tasks": {"id": {"metrics": {"f1": 0.5, "n": 2, "note": "x"}, "items": [{"key": "k", "ok": True}, {"x": 1}, {"key": "k", "ok": False}]}}}
    (tmp_path / "r.json").write_text("\n".join([json.dumps(one), json.dumps({"run": "b", "tasks": {"other": {"metrics": {"acc": 0.25}}}}), "no json", json.dumps({"run": "c"})]))
    records = results.run_records(spark, str(tmp_path))
    assert sorted(r.run or "-" for r in records.collect()) == ["-", "a", "b", "c"]
    assert {(r.run, r.task, r.metric): r.value for r in results.run_metrics(records).collect()} == {("a", "id", "f1"): 0.5, ("a", "id", "n"): 2.0, ("a", "id", "note"): None, ("b", "other", "acc"): 0.25}
    assert {(r.run, r.task, r.key): len(r["items"]) for r in results.run_items(records).collect()} == {("a", "id", "k"): 2, ("a", "id", ""): 1}


def test_a_row_that_fails_stops_no_other(spark, tmp_path):
    for part in ([(i, "a") for i in range(40)], [(3, "a"), (50, "b")]):
        spark.createDataFrame(part, "k int, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    analyse = lambda df: df.withColumn("t", F.when(F.col("k") == 17, F.raise_error(F.lit("bad"))).otherwise(F.col("t")))
    out = str(tmp_path / "out")
    runs.ingest_stream(spark, str(tmp_path / "in"), "k int, t string", analyse, out, str(tmp_path / "c"), checks={"five": F.col("k") == 5}).awaitTermination()
    assert sorted(r.k for r in spark.read.schema("k int, t string").parquet(out).collect()) == [*[i for i in range(40) if i not in (5, 17)], 50]
    assert {(r.key, r.code) for r in spark.read.parquet(f"{out}-errors").collect()} == {("5", "five"), ("17", "USER_RAISED_EXCEPTION")}


def test_a_run_is_written_once(spark, tmp_path):
    items = spark.createDataFrame([(1, 0.5)], "item int, value double")
    results.write_eval_run(items, str(tmp_path), "r1")
    with pytest.raises(Exception, match="already exists"):
        results.write_eval_run(items, str(tmp_path), "r1")
    assert results.read_eval_runs(spark, f"{tmp_path}/*", "item int, value double").first().run == "r1"


def test_gold_with_its_text(spark, tmp_path):
    for stem, text in (("a", "first\nline"), ("b", None)):
        (tmp_path / f"{stem}.gold.json").write_text(json.dumps({"id": stem, "split": "dev"}))
        if text:
            (tmp_path / f"{stem}.txt").write_text(text)
    got = {r.stem: (r.id, r.split, r.text) for r in uploads.read_gold(spark, str(tmp_path), "id string, split string").collect()}
    assert got == {"a": ("a", "dev", "first\nline"), "b": ("b", "dev", None)}


def test_uploads_of_a_folder(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("b.txt", b"x"), ("c.pdf", b"PKno"), ("d.bin", b"x")):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.error_code) for r in uploads.scan_uploads(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == ("pdf", None) and got["b.txt"] == ("txt", None) and got["d.bin"] == (None, "unsupported_format") and got["c.pdf"][0] is None


def test_ingestion_goes_on_after_a_bad_batch(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, t string").write.parquet(str(tmp_path / "in"))
    broken = lambda df: df.select("no_such_column")
    runs.ingest_stream(spark, str(tmp_path / "in"), "k int, t string", broken, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert "no_such_column" in spark.read.parquet(str(tmp_path / "out-errors")).first().error
    runs.ingest_stream(spark, str(tmp_path / "in"), "k int, t string", lambda df: df, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.schema("k int, t string").parquet(str(tmp_path / "out")).count() == 1


def test_silent_runs_are_put_back_then_fail(spark, tmp_path):
    start = datetime(2024, 1, 1)
    beats = [[(1, 0), (2, 0)], [(2, 300)], [(2, 600)], [(2, 900)], [(2, 1200)], [(2, 1500)]]
    for i, rows in enumerate(beats):
        spark.createDataFrame([(k, start + timedelta(seconds=t)) for k, t in rows], "run_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema("run_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = []
    query = runs.stalled_runs(source).writeStream.foreachBatch(lambda df, n: found.extend((r.run_id, r.action) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [a for k, a in found if k == 1] == ["requeue", "requeue", "fail"]


def test_nfkc_only_where_needed(spark):
    rows = ["plain", "ｆｕｌｌ ½", None]
    got = [r.text for r in refine.normalize_text(spark.createDataFrame([(x,) for x in rows], "text string")).collect()]
    assert got == ["plain", unicodedata.normalize("NFKC", rows[1]), None]


def test_greedy_match_takes_first_free(spark):
    pairs = [(1, 1, 10), (1, 1, 11), (1, 2, 10), (1, 2, 11), (2, 5, 10), (2, 6, 10)]
    got = evaluation.greedy_match(spark.createDataFrame(pairs, "doc long, gold long, predicted long")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 10), (1, 2, 11), (2, 5, 10)}


def test_specific_gold_first(spark):
    gold = spark.createDataFrame([(1, 1, "gap", None, None), (1, 2, "gap", 7, "ph")], "doc long, gid long, grp string, standard long, parameter string")
    found = spark.createDataFrame([(1, 10, "gap", 7, "ph"), (1, 11, "gap", 8, None)], "doc long, pid long, grp string, standard long, parameter string")
    assert {(r.gid, r.pid) for r in evaluation.match_findings(gold, found).collect()} == {(2, 10), (1, 11)}


def test_classifier_learns(spark):
    rows = [(i, "good fine words" if i % 2 else "bad poor text", i % 2) for i in range(40)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = models.predict(models.text_classifier(df), models.word_grams(df), ["doc_id", "label"]).collect()
    assert len(got) == 41 and all(r.prediction == r.label for r in got if r.doc_id != 99)
    vectors = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)], "vec_id long, embedding array<double>, label int")
    assert all(r.prediction == r.vec_id % 2 for r in models.predict(models.embedding_classifier(vectors), vectors, ["vec_id"], True).collect())


def test_symbolic_features_have_one_length(spark):
    df = spark.createDataFrame([(1, "415 V to IS 325, IP55"), (2, None), (3, "")], "k int, text string")
    got = {r.k: list(r.features) for r in models.symbolic_features(df, ["k"], "text").collect()}
    assert len({len(f) for f in got.values()}) == 1 and sum(got[2]) == sum(got[3]) == 0 and got[1][-1] == 1.0 and sum(got[1]) >= 4


def test_presets_and_unknown_names():
    assert len(analysis.CHANGES) == 20
    assert analysis.preset("legacy-2.1").relations_version == 1 and analysis.preset("v3.1-dag").dependency_mode == "dag"
    one = json.loads(analysis.preset("v3.1-gated", units_v3=False).record())
    assert one["classifier"] == "gated" and not one["units_v3"] and one["text_attrs_v2"] and one["retrieval"]["top_k"] == 5
    with pytest.raises(ValueError, match="v3-tfidf"):
        analysis.preset("v9")


def test_stages_of_an_analysis(spark):
    rows = [(1, 1, "Motors of 415 V ± 10 % shall be used", 7), (1, 2, None, 7), (2, 1, "Supply at least 50 kV", 7), (2, 2, "Paint it blue", 8)]
    df = spark.createDataFrame(rows, "doc long, req long, text string, standard long")
    limits = spark.createDataFrame([(7, "rated_voltage", 100.0, 1000.0)], "standard long, parameter string, cmin double, cmax double")
    heard = []
    done = analysis.analyse(df, ["doc", "req"], "text", limits, "standard", on_stage=lambda *x: heard.append(x[:3]))
    assert [x[0] for x in heard] == ["requirements", "values", "categories", "conflicts"] and heard[0][1:] == (4, 1)
    assert [tuple(r) for r in done.stages.select("stage", "rows", "errors").collect()] == heard
    for name, table in done.tables.items():
        assert table.count() == dict((x[0], x[1]) for x in heard)[name]
    assert {(r.doc, r.severity) for r in done.tables["conflicts"].collect()} == {(2, "high")}
    assert {json.loads(r.settings)["name"] for r in done.record().collect()} == {"v3.1"}
    own = {"mine": lambda rows, keys, text: rows.select(*keys, F.lit("x").alias("category"), F.lit(1.0).alias("confidence"))}
    mine = analysis.analyse(df, ["doc", "req"], "text", limits, "standard", analysis.preset(classifier="mine"), own)
    assert {r.category for r in mine.tables["categories"].collect()} == {"x"}
    with pytest.raises(ValueError, match="lexicon"):
        analysis.analyse(df, ["doc", "req"], "text", limits, "standard", analysis.preset(classifier="none"))


def test_combinators(spark):
    items = spark.createDataFrame([("a", 1, 1, 0, 0.5), ("a", 1, 0, 1, None), ("b", 0, 0, 0, 1.0)], "run string, x_tp int, x_fp int, x_fn int, v double")
    got = {r.run: r for r in analysis.headline(items, analysis.sums("x_tp") | analysis.means("v") | analysis.rates("x") | analysis.ratios(hit=("x_tp", "x_fp")), ["run"]).collect()}
    assert (got["a"].x_tp, got["a"].v, round(got["a"].x_f1, 6), got["a"].hit) == (2, 0.25, round(2 / 3, 6), 2.0)
    assert (got["b"].x_precision, got["b"].x_recall, got["b"].hit) == (1.0, 1.0, None)
