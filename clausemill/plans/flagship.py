"""The end-to-end slice: which stated values of a document break a limit of the standard that they cite?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.scratch import each_text
from clausemill.operators import analysis
from clausemill.operators import facts as x
from clausemill.operators import rules as r
from clausemill.plans.refine import rendered
from clausemill.plans.tables import read

KEYS = ["doc", "at", "part"]


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of each part taken as a standard, in canonical units."""
    p = read(spark, sf_dir, "part")
    each = F.array(
        F.struct(F.lit("rated_voltage").alias("parameter"), F.lit(None).cast("double").alias("cmin"), (F.col("p_size") * 1000.0).alias("cmax")),
        F.struct(F.lit("rated_current").alias("parameter"), F.lit(0.005).alias("cmin"), F.lit(0.04).alias("cmax")),
        F.struct(F.lit("ambient_temperature").alias("parameter"), F.lit(None).cast("double").alias("cmin"), F.lit(40.0).alias("cmax")),
    )
    return p.select(F.col("p_partkey").alias("standard"), F.inline(each))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment -> quantity -> unit -> comparator -> parameter -> limit -> conflict."""
    sentences = rendered(spark, sf_dir).groupBy(*KEYS).agg(F.min("segment").alias("segment"))

    def read_values(texts, key):
        stated = x.comparator(x.canonicalise_units(x.extract_quantities(texts, [key], "segment")), "segment")
        return x.infer_parameter(stated, [key], "segment").select(key, "parameter", "lo", "hi")

    named = each_text(sentences, "segment", read_values)
    values = named.select("doc", (F.col("at") * 1000000 + F.col("part")).alias("req"), F.col("part").alias("standard"), "parameter", "lo", "hi")
    return r.constraint_conflicts(r.check_constraints(values, limits(spark, sf_dir)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts and readiness of each document; all of its requirements count as mapped."""
    total = rendered(spark, sf_dir).select(*KEYS).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    found = conflicts(spark, sf_dir).groupBy("doc").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    rows = total.join(found, "doc", "left").select("doc", "total", F.coalesce("high", F.lit(0)).alias("high"), F.coalesce("medium", F.lit(0)).alias("medium"))
    return rows.withColumn("readiness", r.readiness_score(F.col("total"), F.col("total"), F.col("high"), F.col("medium"), F.lit(0)))


def _analysis(spark: SparkSession, sf_dir: str, **settings) -> analysis.Analysis:
    """Requirements of the documents under settings; the part that a requirement comes from is its standard."""
    sentences = rendered(spark, sf_dir).groupBy(*KEYS).agg(F.min("segment").alias("segment"))
    return analysis.analyse(sentences.withColumn("standard", F.col("part")), KEYS, "segment", limits(spark, sf_dir), "standard", **settings)


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analysis records of its stages while it runs."""
    return _analysis(spark, sf_dir, settings=analysis.preset("v3")).stages.select("number", "stage", "rows", "errors")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the lexicon where it is sure, of a classifier that the caller gives elsewhere."""
    by_part = lambda rows, keys, text: rows.select(*keys, F.concat(F.lit("m"), F.col("part") % 3).alias("category"))
    return _analysis(spark, sf_dir, settings=analysis.preset("v3-gated"), classifiers={"model": by_part}).tables["categories"].select(*KEYS, "category")


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with the preset that it ran under, each of whose flags differs from the default or not."""
    presets = list(analysis.CHANGES)
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.element_at(F.array(*[F.lit(p) for p in presets]), (F.col("o_orderkey") % len(presets) + 1).cast("int")).alias("preset"))
    flags = analysis.preset_table(spark)
    usual = flags.where(F.col("preset") == analysis.DEFAULT).select("flag", F.col("value").alias("usual"))
    own = flags.join(usual, "flag").where("value <> usual").groupBy("preset").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "flag", "value"))), ";").alias("changes"))
    return runs.join(own, "preset", "left").select("run", "preset", F.coalesce("changes", F.lit("")).alias("changes"))


QUERIES = {"e1_recorded_settings": recorded, "e3_gated_classifier": gated, "e5_stages": stages, "flagship_conflicts": conflicts, "flagship_documents": documents}

_PART = "CASE dimension WHEN 'voltage' THEN 'rated_voltage' WHEN 'current' THEN CASE WHEN segment LIKE 'Fault current%' THEN 'short_circuit_current' ELSE 'rated_current' END WHEN 'temperature' THEN 'ambient_temperature' ELSE 'other' END"


def _sql() -> dict[str, str]:
    from clausemill.plans.facts import _D
    from clausemill.plans.facts import SQL as SQL_FACTS

    base = _D + f""", c AS (SELECT *, CASE WHEN segment LIKE '%not more than%' THEN 'max' WHEN segment LIKE '%not less than%' OR segment LIKE '%at least%' OR segment LIKE '%or more%' THEN 'min' END AS comparator, {_PART} AS parameter FROM u),
      v AS (SELECT doc, "at" * 1000000 + part AS req, part AS standard, parameter, CASE WHEN comparator IS DISTINCT FROM 'max' THEN canonical END AS lo, CASE WHEN comparator IS DISTINCT FROM 'min' THEN canonical END AS hi, CASE parameter WHEN 'rated_current' THEN 0.005::DOUBLE END AS cmin, CASE parameter WHEN 'rated_voltage' THEN p_size * 1000.0 WHEN 'rated_current' THEN 0.04 ELSE 40.0 END::DOUBLE AS cmax FROM c JOIN part ON part = p_partkey WHERE parameter IN ('rated_voltage', 'rated_current', 'ambient_temperature')),
      w AS (SELECT *, coalesce(lo < cmin, false) OR (lo IS NULL AND coalesce(hi < cmin, false)) AS below, coalesce(hi > cmax, false) OR (hi IS NULL AND coalesce(lo > cmax, false)) AS above, coalesce(hi < cmin, false) OR coalesce(lo > cmax, false) AS apart FROM v),
      f AS (SELECT doc, req, standard, parameter, CASE WHEN above THEN 'above' ELSE 'below' END AS side, CASE WHEN apart THEN 'high' ELSE 'medium' END AS severity, CASE WHEN apart THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM w WHERE below OR above) """
    # What a preset changes of the default, flag by flag.
    usual = analysis.preset()
    changed = {}
    for name in analysis.CHANGES:
        own = analysis.preset(name)
        flags = {f: getattr(own, f) for f in vars(own) if f not in ("name", "retrieval") and getattr(own, f) != getattr(usual, f)}
        changed[name] = ";".join(sorted(f"{f}={str(v).lower() if not isinstance(v, str) else chr(34) + v + chr(34)}" for f, v in flags.items()))
    presets = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(changed.items()))
    return {
        "e1_recorded_settings": f"SELECT o_orderkey AS run, preset, changes FROM orders JOIN (VALUES {presets}) p(i, preset, changes) ON o_orderkey % {len(changed)} = i",
        "e3_gated_classifier": SQL_FACTS["x20_gated_category"],
        "e5_stages": base + "SELECT 0 AS number, 'requirements' AS stage, count(*) AS rows, 0 AS errors FROM base UNION ALL SELECT 1, 'values', count(*), count(*) FILTER (dimension IN ('length', 'time')) FROM c UNION ALL SELECT 2, 'categories', count(*), 0 FROM base UNION ALL SELECT 3, 'conflicts', count(*), 0 FROM f",
        "flagship_conflicts": base + "SELECT * FROM f",
        "flagship_documents": base + 'SELECT b.doc, total, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, CAST(floor(least(greatest(100 - (coalesce(high, 0) * 8 + coalesce(medium, 0) * 3), 0), 100) + 0.5) AS INTEGER) AS readiness FROM (SELECT doc, count(*) AS total FROM base GROUP BY 1) b LEFT JOIN (SELECT doc, count(*) FILTER (severity = \'high\') AS high, count(*) FILTER (severity = \'medium\') AS medium FROM f GROUP BY 1) g USING (doc)',
    }


SQL = _sql()
