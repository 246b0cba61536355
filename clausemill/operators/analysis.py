"""An analysis of requirements under recorded settings: stages that are written one after the other and counted as they are written."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.scratch import keep
from clausemill.operators import evaluation, facts, quantities, rules


@dataclass(frozen=True)
class Retrieval:
    """Options of a retrieval: synonyms, product terms of the document, re-ranking, the least confidence of a mapping, how many."""

    expansion: bool = False
    document_context: bool = True
    rerank: bool = True
    min_confidence: float = 0.35
    top_k: int = 5


@dataclass(frozen=True)
class Settings:
    """What an analysis does. A run records all of it, so that two runs can be told apart by more than their name."""

    name: str = "v3"
    retrieval: Retrieval = field(default_factory=Retrieval)
    zoning: bool = True
    heading_v2: bool = True
    segmentation_v2: bool = True
    attributes_v2: bool = True
    lexicon_version: int = 2
    units_v2: bool = True
    classifier: str = "lexicon"
    units_v3: bool = False
    text_attrs_v2: bool = False
    identify_v2: bool = False
    document_role: str = "specification"
    tables_v2: bool = False
    reports_v1: bool = False
    reasoning_v31: bool = False
    rerank_version: int = 2
    product_terms_v2: bool = True
    scope_guard: bool = True
    dependency_mode: str = "citation"
    detector_gate: bool = True
    scoped_checklists: bool = True
    vague_version: int = 2
    amendment_dedupe: bool = True
    certification_scope: bool = True
    relations_version: int = 2

    def record(self) -> str:
        """All settings as one JSON text, keys in order."""
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


#: Settings of the first generation, and what each named preset changes of its base.
FIRST = {
    "zoning": False, "heading_v2": False, "segmentation_v2": False, "attributes_v2": False, "lexicon_version": 1, "units_v2": False, "rerank_version": 1, "product_terms_v2": False, "scope_guard": False,
    "dependency_mode": "legacy", "detector_gate": False, "scoped_checklists": False, "vague_version": 1, "amendment_dedupe": False, "certification_scope": False, "relations_version": 1,
}
THIRD_ONE = {"units_v3": True, "text_attrs_v2": True, "identify_v2": True, "reasoning_v31": True}
CHANGES = {
    "legacy-2.1": ("legacy", {}),
    "v3": ("v3", {}),
    "v3.1": ("v3.1", {}),
    "v3.1-dag": ("v3.1", {"dependency_mode": "dag"}),
    "v3.1-gated": ("v3.1", {"classifier": "gated"}),
    "v3.1-hybrid": ("v3.1", {"classifier": "hybrid-nn"}),
    "v3+units3": ("v3", {"units_v3": True}),
    "v3+textattrs2": ("v3", {"text_attrs_v2": True}),
    "v3+identify2": ("v3", {"identify_v2": True}),
    "v3+reasoning31": ("v3", {"reasoning_v31": True}),
    "v3-dep-legacy": ("v3", {"dependency_mode": "legacy"}),
    "v3-dag": ("v3", {"dependency_mode": "dag"}),
    "v3-hybrid": ("v3", {"classifier": "hybrid-nn"}),
    "v3-gated": ("v3", {"classifier": "gated"}),
    "v3-tfidf": ("v3", {"classifier": "tfidf-lr"}),
    "legacy+extraction": ("legacy", {"zoning": True, "heading_v2": True, "segmentation_v2": True, "attributes_v2": True}),
    "legacy+lexicon2": ("legacy", {"lexicon_version": 2, "units_v2": True}),
    "legacy+rerank2": ("legacy", {"rerank_version": 2, "product_terms_v2": True}),
    "legacy+gating": ("legacy", {"detector_gate": True, "scope_guard": True, "scoped_checklists": True, "certification_scope": True}),
    "legacy+dep-citation": ("legacy", {"dependency_mode": "citation"}),
}
BASES = {"v3": {}, "v3.1": THIRD_ONE, "legacy": FIRST}
DEFAULT = "v3.1"


def preset(name: str = DEFAULT, **changes) -> Settings:
    """The settings of a preset, with further changes; an unknown name is an error that lists those there are."""
    if name not in CHANGES:
        raise ValueError(f"no preset {name!r}: " + ", ".join(CHANGES))
    base, own = CHANGES[name]
    return replace(Settings(name=name), **(BASES[base] | own | changes))


def preset_table(spark: SparkSession) -> DataFrame:
    """(preset, flag, value): every flag of every preset, retrieval options under retrieval.*, values as JSON."""
    rows = []
    for name in CHANGES:
        for flag, value in dataclasses.asdict(preset(name)).items():
            if isinstance(value, dict):
                rows += [(name, f"{flag}.{k}", json.dumps(v)) for k, v in value.items()]
            elif flag != "name":
                rows.append((name, flag, json.dumps(value)))
    return spark.createDataFrame(rows, "preset string, flag string, value string")


class Stages:
    """Writes stages and counts their rows and errors while they are written, without a job of its own."""

    def __init__(self, spark: SparkSession, on_stage: Callable[[str, int, int, float], None] | None = None):
        self.spark, self.on_stage, self.done = spark, on_stage, []

    def write(self, name: str, df: DataFrame, error: Column | None = None) -> DataFrame:
        """df, written and reread. error: true for rows that count as errors. on_stage gets (name, rows, errors, seconds)."""
        seen, began = Observation(), time.monotonic()
        errors = F.count_if(F.coalesce(error, F.lit(False))) if error is not None else F.lit(0).cast("long")
        out = keep(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.lit(0)).alias("_") if error is None else errors.alias("errors")))
        got = seen.get
        row = (len(self.done), name, got["rows"], got.get("errors", 0), time.monotonic() - began)
        self.done.append(row)
        if self.on_stage is not None:
            self.on_stage(*row[1:])
        return out

    def table(self) -> DataFrame:
        """(number, stage, rows, errors, seconds)."""
        return self.spark.createDataFrame(self.done, "number int, stage string, rows long, errors long, seconds double")


#: Classifiers by name: (rows, keys, text) -> (keys, category, confidence). Callers add their own under a name that settings then give.
CLASSIFIERS: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {
    "lexicon": lambda rows, keys, text: facts.classify(rows, keys, text).select(*keys, "category", "confidence"),
}


@dataclass
class Analysis:
    """The tables of an analysis by stage, the stages' counts, and the settings that it ran under."""

    tables: dict[str, DataFrame]
    stages: DataFrame
    settings: Settings

    def record(self) -> DataFrame:
        """(settings, stage, rows, errors): what a run records of itself."""
        return self.stages.select(F.lit(self.settings.record()).alias("settings"), "stage", "rows", "errors")


def analyse(
    requirements: DataFrame, keys: list[str], text: str, limits: DataFrame, standard: str, settings: Settings | None = None,
    classifiers: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] | None = None, on_stage: Callable[[str, int, int, float], None] | None = None,
) -> Analysis:
    """requirements (keys, text, standard) and limits (standard, parameter, cmin, cmax) -> values, categories and conflicts, stage by stage.

    keys: the document first. units_v3 reads ranges, tolerances and spelled units, else plain values
    only. The classifier is the one that settings name, of classifiers or CLASSIFIERS; "gated" takes the
    lexicon where it is sure and "model" of classifiers elsewhere. detector_gate leaves conflicts below
    a confidence of 0.5 out. Errors of a stage: requirements without text, values without parameter,
    requirements without category.
    """
    settings = settings or preset()
    known = CLASSIFIERS | (classifiers or {})
    wanted = ["lexicon", "model"] if settings.classifier == "gated" else [settings.classifier]
    for name in wanted:
        if name not in known:
            raise ValueError(f"no classifier {name!r}: " + ", ".join(sorted(known)))
    stages = Stages(requirements.sparkSession, on_stage)
    tables = {"requirements": stages.write("requirements", requirements.select(*keys, text, standard), F.col(text).isNull())}
    rows = tables["requirements"]
    if settings.units_v3:
        stated = quantities.all_quantities(rows, keys, text)
    else:
        stated = facts.comparator(facts.canonicalise_units(facts.extract_quantities(rows, keys, text)), text)
    named = facts.infer_parameter(stated, keys, text).select(*keys, "parameter", "dimension", "lo", "hi")
    tables["values"] = stages.write("values", named, F.col("parameter").isNull())
    sorted_ = known[wanted[0]](rows, keys, text).select(*keys, "category", "confidence")
    if len(wanted) > 1:
        model = known["model"](rows, keys, text).select(*keys, F.col("category").alias("model"))
        sorted_ = facts.gated_category(sorted_.withColumnRenamed("category", "lexicon").join(model, keys, "left"), 0.8).select(*keys, "category", "confidence")
    tables["categories"] = stages.write("categories", sorted_, F.col("category").isNull())
    req = F.concat_ws("/", *keys[1:]) if len(keys) > 1 else F.col(keys[0]).cast("string")
    values = tables["values"].where("parameter is not null").join(rows.select(*keys, standard), keys).select(F.col(keys[0]).alias("doc"), req.alias("req"), F.col(standard).alias("standard"), "parameter", "lo", "hi")
    found = rules.constraint_conflicts(rules.check_constraints(values, limits))
    tables["conflicts"] = stages.write("conflicts", found.where("confidence >= 0.5") if settings.detector_gate else found)
    return Analysis(tables, stages.table(), settings)


def headline(items: DataFrame, aggregates: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Aggregate combinators over items, each named: sums(), means(), rates() and ratios() below, in one pass."""
    return items.groupBy(*(by or [])).agg(*[c.alias(name) for name, c in aggregates.items()])


def sums(*columns: str) -> dict[str, Column]:
    return {c: F.coalesce(F.sum(c), F.lit(0)) for c in columns}


def means(*columns: str) -> dict[str, Column]:
    """Means in which a missing value is 0."""
    return {c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)) for c in columns}


def rates(prefix: str) -> dict[str, Column]:
    """Precision, recall and F1 of the sums of prefix_tp, prefix_fp, prefix_fn."""
    tp, fp, fn = (F.coalesce(F.sum(f"{prefix}_{k}"), F.lit(0)) for k in ("tp", "fp", "fn"))
    one = evaluation.prf(tp, fp, fn)
    return {f"{prefix}_{k}": one[k] for k in ("precision", "recall", "f1")}


def ratios(**pairs: tuple[str, str]) -> dict[str, Column]:
    """name=(hits, of): the quotient of two sums; null where there is nothing."""
    return {name: F.sum(hits) / F.nullif(F.sum(of), F.lit(0)) for name, (hits, of) in pairs.items()}
