"""Requirement classifiers on Spark ML."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import vocabulary as v
from clausemill.functions.scratch import each_text, keep, shared_folder
from clausemill.operators import facts, quantities


def word_grams(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds grams: the lower-case words of a text and its pairs of neighbouring words; null texts have none."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    with_words = rows.withColumn("words", F.filter(words, lambda w: w != ""))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return with_words.withColumn("grams", F.concat("words", pairs)).drop("words")


def _stored(model, kind):
    """The model, saved to the shared folder and loaded: its coefficients alone, without the tables and summaries of its training, which tasks can't be sent."""
    path = f"{shared_folder(SparkSession.active())}/model-{uuid.uuid4().hex}"
    model.save(path)
    return kind.load(path)


def text_classifier(rows: DataFrame, slots: int = 1 << 14, rounds: int = 15):
    """(text, label) -> a fitted pipeline over grams: TF-IDF of words and word pairs, multinomial logistic regression with balanced weights.

    The training rows are written once and reread by each round.
    """
    counts = [(r["label"], r["k"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("k")).orderBy("label").limit(1000).collect()]  # a row a label
    total = sum(k for _, k in counts)
    weight = F.lit(1.0)
    for label, k in counts:
        weight = F.when(F.col("label") == label, float(total / (len(counts) * k))).otherwise(weight)
    weighted = keep(word_grams(rows).select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "grams"))
    stages = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=slots), IDF(inputCol="tf", outputCol="features"), LogisticRegression(weightCol="weight", maxIter=rounds, regParam=0.01)]
    return _stored(Pipeline(stages=stages).fit(weighted), PipelineModel)


def embedding_classifier(rows: DataFrame, rounds: int = 20):
    """(embedding array, label) -> a fitted logistic regression."""
    model = LogisticRegression(maxIter=rounds, regParam=0.01).fit(rows.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return _stored(model, LogisticRegressionModel)


def predict(model, rows: DataFrame, columns: list[str], features: bool = False) -> DataFrame:
    """columns, prediction and the probability of it."""
    if features:
        rows = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return model.transform(rows).select(*columns, F.col("prediction").cast("int").alias("prediction"), F.array_max(vector_to_array("probability")).alias("probability"))


def symbolic_features(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, features): shares of the category scores, then one-hots of dimensions, entity kinds and parameters, then whether a standard is cited.

    Names come from the vocabularies, in their order, so vectors of all tables fit together.
    Each text is read once.
    """
    return each_text(rows.select(*keys, text), text, lambda texts, key: _features(texts, [key], text)).drop(text)


def _features(one: DataFrame, keys: list[str], text: str) -> DataFrame:
    values = facts.infer_parameter(quantities.all_quantities(one, keys, text), keys, text)
    sets = [
        ("dimension", values.select(*keys, F.col("dimension").alias("x")), sorted({d for _, d in v.UNITS} | {"ph", "ratio"})),
        ("kind", facts.extract_entities(one, keys, text).select(*keys, F.col("kind").alias("x")), list(facts.ENTITIES)),
        ("parameter", values.where("parameter is not null").select(*keys, F.col("parameter").alias("x")), list(v.PARAMETERS)),
    ]
    out = facts.category_scores(one, keys, text)
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s["score"])
    parts = [F.transform("scores", lambda s: F.when(total > 0, s["score"] / total).otherwise(0.0))]
    for name, found, names in sets:
        out = out.join(found.groupBy(*keys).agg(F.collect_set("x").alias(name)), keys, "left")
        parts.append(F.array(*[F.coalesce(F.array_contains(name, n), F.lit(False)).cast("double") for n in names]))
    cited = facts.extract_citations(one, keys, text).select(*keys).distinct().withColumn("cited", F.lit(1.0))
    out = out.join(cited, keys, "left")
    return out.select(*keys, F.concat(*parts, F.array(F.coalesce("cited", F.lit(0.0)))).alias("features"))
