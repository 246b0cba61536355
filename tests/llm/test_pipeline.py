"""The pipeline against plain Python, stage by stage."""

import random
import string

import corpus_pipeline
from clausemill.llm import bpe, jaccard_join, mixing, toxicity

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages_follow_each_other(spark, tmp_path):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(120):
        w = [f"w{draw.randrange(80)}" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            w[3] = w[20] = "worthless"
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    rows += [(200 + i, rows[i + 1][1].upper(), "en", "s0", 1) for i in range(3)] + [(300, rows[7][1] + " extra", "en", None, None), (301, None, None, None, None), (302, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    label_rows = spark.read.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    model = toxicity.train(*toxicity.training_sample(docs, label_rows)).scorer()
    kept = [r for r in rows if model.score(r[1] or "") < 0.5]
    assert {r[0] for r in kept} & set(range(0, 120, 5)) == set()
    last = {}
    for r in kept:
        body = (r[1] or "").translate(FOLD)
        last[body] = max(last.get(body, -1), r[0])
    kept = [r for r in kept if last[(r[1] or "").translate(FOLD)] == r[0]]
    third = spark.createDataFrame(kept, docs.schema)
    parts = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_components(third).collect()}
    kept = [r for r in kept if parts[r[0]] == r[0]]
    assert 300 not in {r[0] for r in kept} and {301, 302} & {r[0] for r in kept}
    copies = {r.id: r.copies for r in mixing.mix_plan(spark.createDataFrame(kept, docs.schema)).collect()}
    encoder = bpe.WordBPE(open(__import__("public_tokenizers").path("word_bpe_49k.json"), encoding="utf-8").read())
    want = sorted((r[0], encoder.encode(r[1] or "")[0]) for r in kept for _ in range(copies[r[0]]))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, bytes(r.ids)) for r in got.collect()) == want
