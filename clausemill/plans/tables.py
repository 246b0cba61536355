"""How the operators' tables are read from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("succeeded")).otherwise("running")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("doc_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("conflicting", "missing", "outdated", "certification", "verified")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("finding_no"), kind.alias("kind"), severity.alias("severity"),
        F.when(F.col("l_linestatus") == "O", "pending").otherwise(F.when(F.col("l_suppkey") % 2 == 0, "dismissed").otherwise("accepted")).alias("review"),
        F.col("l_partkey").alias("standard"), (F.col("l_linenumber") % 4).alias("requirement"), (F.col("l_discount") * 10).alias("confidence"),
    )


CTES = {
    "runs": """runs AS (SELECT o_orderkey AS run_id, o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'succeeded' END ELSE 'running' END AS status, o_orderdate AS created_at FROM orders)""",
    "findings": """findings AS (SELECT l_orderkey AS run_id, l_linenumber AS finding_no, ['conflicting','missing','outdated','certification','verified'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS kind, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_suppkey % 2 = 0 THEN 'dismissed' ELSE 'accepted' END AS review, l_partkey AS standard, l_linenumber % 4 AS requirement, l_discount * 10 AS confidence FROM lineitem)""",
    "latest": """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1)""",
    "open": """open AS (SELECT * FROM findings WHERE kind <> 'verified' AND review <> 'dismissed')""",
    "scores": """scores AS (SELECT run_id, total, mapped, penalty, CAST(floor(least(greatest(100.0::DOUBLE * mapped / total - penalty, 0), 100) + 0.5) AS INTEGER) AS score FROM (SELECT run_id, count(*) AS total, count(*) FILTER (confidence >= 0.35) AS mapped, sum(CASE WHEN kind = 'verified' OR review = 'dismissed' THEN 0 WHEN severity = 'high' THEN 8 WHEN severity = 'medium' THEN 3 ELSE 1 END) AS penalty FROM findings GROUP BY run_id))""",
    "status": """status AS (SELECT l.doc_id, l.run_id, CASE WHEN status = 'failed' THEN 'Failed' WHEN status IN ('queued', 'running') THEN 'Processing' WHEN EXISTS (SELECT 1 FROM open o WHERE o.run_id = l.run_id AND severity <> 'low') THEN 'Review required' ELSE 'Analyzed' END AS document_status FROM latest l)""",
    "view": """view_ AS (SELECT s.doc_id, s.run_id, s.document_status, coalesce(requirements, 0) AS requirements, coalesce(standards, 0) AS standards, coalesce(open_issues, 0) AS open_issues, coalesce(schemes, 0) AS schemes FROM status s LEFT JOIN (SELECT run_id, count(DISTINCT requirement) AS requirements, count(DISTINCT standard) AS standards, count(*) FILTER (kind <> 'verified' AND review <> 'dismissed') AS open_issues, count(DISTINCT CASE WHEN kind = 'certification' THEN standard END) AS schemes FROM findings GROUP BY run_id) f USING (run_id))""",
    "changes": """changes AS (SELECT p_partkey AS change_id, p_partkey AS standard, CASE WHEN p_size % 3 = 0 THEN 'high' WHEN p_size % 3 = 1 THEN 'medium' ELSE 'low' END AS severity FROM part WHERE p_size % 5 = 0)""",
    "usage": """usage_ AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS standard FROM lineitem WHERE l_quantity > 40)""",
    "ancestors": """RECURSIVE_ancestors AS (SELECT 1)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(CTES[n] for n in names) + " "
