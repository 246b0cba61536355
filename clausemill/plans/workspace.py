"""Workspace queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import graph
from clausemill.operators import workspace as w
from clausemill.plans.tables import CTES, ctes, findings, read, runs


def _owners(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("organisation"))
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey").join(customer, "o_custkey").join(F.broadcast(nation), "c_nationkey").select("run_id", "organisation")


def _hits(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("requirement"), (F.col("l_suppkey") % 2).alias("rank"), F.col("l_partkey").alias("standard"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") > 0.06).alias("explicit"))


def _standards(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("standard"), F.col("p_type").alias("category"))


def _changes(spark, d):
    severity = F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "medium").otherwise("low")
    return read(spark, d, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("change_id"), F.col("p_partkey").alias("standard"), severity.alias("severity"))


def _usage(spark, d):
    return read(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("standard")).distinct()


def _impact(spark, d):
    # Part p builds on part p div 2: what changes in p div 2 reaches p.
    parts = read(spark, d, "part")
    edges = parts.where("p_partkey > 1 and p_size % 2 = 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    reach = graph.closure(edges).select(F.col("dst").alias("standard"), F.col("src").alias("ancestor"))
    return w.change_impact(_changes(spark, d), _usage(spark, d), reach)


def _decisions(spark, d):
    n = F.col("turn") % 4
    decision = F.when(n == 0, "pending").when(n == 1, "accepted").when(n == 2, "edited").otherwise("rejected")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("entity"), F.col("turn").alias("event_id"), F.col("turn").alias("at"), decision.alias("decision"), F.col("text").alias("edited"), F.col("role").alias("recommended"))


def _heartbeats(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("heartbeat"), F.count(F.lit(1)).alias("attempt")).withColumn("status", F.when(F.col("run_id") % 3 == 0, "running").otherwise("done"))


def _metrics(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.round(F.avg("l_discount"), 6).alias("f1"), F.round(F.avg("l_tax"), 6).alias("recall"))


NOW = "2024-01-30 20:00:00"

QUERIES = {
    "w1_latest_run": lambda s, d: w.latest_run(runs(s, d)),
    "w2_document_view": lambda s, d: w.document_view(runs(s, d), findings(s, d)),
    "w3_top_mapped": lambda s, d: w.top_mapped(_hits(s, d)),
    "w4_document_status": lambda s, d: w.document_status(runs(s, d), findings(s, d)),
    "w5_summary_of": lambda s, d: w.summary_of(read(s, d, "documents"), ("text",)),
    "w6_findings_feed": lambda s, d: w.findings_feed(findings(s, d), kind="missing", severity="high"),
    "w7_change_impact": _impact,
    "w8_change_kpis": lambda s, d: w.change_kpis(_changes(s, d), _impact(s, d)),
    "w9_standard_usage": lambda s, d: w.standard_usage(findings(s, d)),
    "w10_domain_rollup": lambda s, d: w.domain_rollup(w.standard_usage(findings(s, d)), _standards(s, d)),
    "w11_readiness_bands": lambda s, d: w.readiness_bands(w.readiness(findings(s, d))),
    "w13_organisation_rollup": lambda s, d: w.organisation_rollup(w.readiness(findings(s, d)), _owners(s, d)),
    "w14_usage_network_report": lambda s, d: w.usage_network(findings(s, d), 6, 8),
    "w14_usage_network": lambda s, d: w.usage_network(findings(s, d), 300, 200),
    "w15_status_counts": lambda s, d: w.status_counts(findings(s, d)),
    "w16_count_by": lambda s, d: w.count_by(_standards(s, d), "category"),
    "w17_priority_findings": lambda s, d: w.priority_findings(findings(s, d)),
    "w18_alerts": lambda s, d: w.alerts(_changes(s, d), _impact(s, d)),
    "w19_workspace_stats": lambda s, d: w.workspace_stats(w.document_status(runs(s, d), findings(s, d)), w.readiness(findings(s, d))),
    "w20_most_issues": lambda s, d: w.most_issues(w.document_view(runs(s, d), findings(s, d))),
    "w21_text_filter": lambda s, d: w.text_filter(read(s, d, "part"), ["p_name", "p_type"], "WIDGET", p_size=10).select("p_partkey", "p_name"),
    "w22_distinct_values": lambda s, d: read(s, d, "part").select("p_brand").distinct(),
    "w23_corpus_status": lambda s, d: w.count_by(read(s, d, "documents"), "source"),
    "w25_current_decision": lambda s, d: w.current_decision(_decisions(s, d)),
    "w26_stalled_runs": lambda s, d: w.stalled_runs(_heartbeats(s, d), NOW),
    "w27_needs_rerun": lambda s, d: w.needs_rerun(
        read(s, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 4).alias("old_type"), (F.col("p_partkey") % 4).cast("int").alias("new_type")),
        s.createDataFrame([(0, True, False), (1, True, False), (2, False, None), (3, False, None)], "type int, zoning boolean, tables boolean"),
    ),
    "w28_eval_headline": lambda s, d: w.eval_headline(_metrics(s, d).selectExpr("run", "stack(2, 'f1', f1, 'recall', recall) as (metric, value)"), ("f1", "recall")),
    "w29_latest_per_config": lambda s, d: w.latest_per_config(read(s, d, "orders").select(F.col("o_orderpriority").alias("config"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("value"))),
    "a29_readiness": lambda s, d: w.readiness(findings(s, d)),
}

_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END"
_VIEW = ctes("runs", "findings", "latest", "open", "status", "view")
_IMPACT = (
    "WITH RECURSIVE edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 AND p_size % 2 = 0), reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src), "
    + CTES["changes"] + ", " + CTES["usage"]
    + ", direct AS (SELECT DISTINCT change_id, doc_id FROM changes JOIN usage_ USING (standard)), via AS (SELECT change_id, doc_id, min(src) AS via FROM changes c JOIN reach r ON c.standard = r.dst JOIN usage_ u ON u.standard = r.src GROUP BY 1, 2), "
    "impact AS (SELECT change_id, doc_id, CAST(NULL AS BIGINT) AS via FROM direct UNION ALL SELECT v.change_id, v.doc_id, v.via FROM via v ANTI JOIN direct d ON v.change_id = d.change_id AND v.doc_id = d.doc_id) "
)
SQL = {
    "w1_latest_run": ctes("runs", "latest") + "SELECT doc_id, run_id, status, created_at FROM latest",
    "w2_document_view": _VIEW + "SELECT * FROM view_",
    "w3_top_mapped": "SELECT l_orderkey AS run_id, l_linenumber AS requirement, l_partkey AS standard, l_discount * 10 AS confidence FROM lineitem WHERE l_suppkey % 2 = 0 AND (l_discount * 10 >= 0.35 OR l_tax > 0.06)",
    "w4_document_status": ctes("runs", "findings", "latest", "open", "status") + "SELECT * FROM status",
    "w5_summary_of": "SELECT doc_id, lang, source, n_chars FROM documents",
    "w6_findings_feed": ctes("findings") + "SELECT * FROM findings WHERE kind = 'missing' AND severity = 'high'",
    "w7_change_impact": _IMPACT + "SELECT * FROM impact",
    "w8_change_kpis": _IMPACT + "SELECT count(*) FILTER (n > 0) AS affecting, CAST(sum(n) AS BIGINT) AS affected, count(*) FILTER (severity = 'high' AND n > 0) AS high, CAST(sum(d) AS BIGINT) AS direct, CAST(sum(n - d) AS BIGINT) AS indirect FROM (SELECT c.change_id, severity, count(i.doc_id) AS n, count(i.doc_id) FILTER (via IS NULL) AS d FROM changes c LEFT JOIN impact i USING (change_id) GROUP BY 1, 2)",
    "w9_standard_usage": ctes("findings") + "SELECT standard, count(*) AS requirements, count(DISTINCT run_id) AS documents, count(*) FILTER (kind <> 'verified' AND review <> 'dismissed') AS open_findings FROM findings GROUP BY standard",
    "w10_domain_rollup": "SELECT p_type AS category, CAST(sum(coalesce(n, 0)) AS BIGINT) AS requirements, count(n) AS standards_used, count(*) AS standards FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1",
    "w11_readiness_bands": ctes("findings", "scores") + "SELECT band, count(run_id) AS documents FROM (VALUES ('strong', 80, 100), ('fair', 50, 79), ('weak', 0, 49)) b(band, low, high) LEFT JOIN scores ON score BETWEEN low AND high GROUP BY band",
    "w13_organisation_rollup": ctes("findings", "scores") + "SELECT n_name AS organisation, count(*) AS documents, CAST(floor(sum(score) / count(*) + 0.5) AS INTEGER) AS readiness FROM scores JOIN orders ON run_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "w14_usage_network_report": ctes("findings") + ", d AS (SELECT run_id FROM findings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6), t AS (SELECT standard FROM findings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) SELECT run_id, standard, count(*) AS weight, ['ok','gap','conflict'][max(CASE kind WHEN 'conflicting' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END) + 1] AS tone FROM findings SEMI JOIN d USING (run_id) SEMI JOIN t USING (standard) GROUP BY 1, 2",
    "w14_usage_network": ctes("findings") + ", d AS (SELECT run_id FROM findings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 300), t AS (SELECT standard FROM findings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 200) SELECT run_id, standard, count(*) AS weight, ['ok','gap','conflict'][max(CASE kind WHEN 'conflicting' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END) + 1] AS tone FROM findings SEMI JOIN d USING (run_id) SEMI JOIN t USING (standard) GROUP BY 1, 2",
    "w15_status_counts": ctes("findings") + "SELECT k.kind, count(f.kind) AS findings FROM (VALUES ('conflicting'), ('missing'), ('outdated'), ('certification'), ('verified')) k(kind) LEFT JOIN findings f USING (kind) GROUP BY 1",
    "w16_count_by": "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1",
    "w17_priority_findings": ctes("findings", "open") + f"SELECT run_id, finding_no, kind, severity FROM open ORDER BY {_RANK}, run_id, finding_no LIMIT 6",
    "w18_alerts": _IMPACT + f"SELECT change_id, severity, affected FROM (SELECT c.change_id, severity, count(i.doc_id) AS affected FROM changes c LEFT JOIN impact i USING (change_id) GROUP BY 1, 2) ORDER BY affected > 0 DESC, {_RANK}, change_id LIMIT 5",
    "w19_workspace_stats": ctes("runs", "findings", "latest", "open", "status", "scores") + "SELECT count(*) AS documents, count(*) FILTER (document_status IN ('Analyzed', 'Review required')) AS done, count(*) FILTER (document_status = 'Processing') AS processing, count(*) FILTER (document_status = 'Failed') AS failed, count(*) FILTER (document_status = 'Review required') AS need_attention, CAST(floor(avg(score) FILTER (document_status IN ('Analyzed', 'Review required')) + 0.5) AS INTEGER) AS average_readiness FROM status LEFT JOIN scores USING (run_id)",
    "w20_most_issues": _VIEW + "SELECT doc_id, open_issues FROM view_ WHERE open_issues > 0 ORDER BY open_issues DESC, doc_id LIMIT 4",
    "w21_text_filter": "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'widget') AND p_size = 10",
    "w22_distinct_values": "SELECT DISTINCT p_brand FROM part",
    "w23_corpus_status": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "w25_current_decision": "SELECT conv_id AS entity, d AS decision, CASE d WHEN 'edited' THEN e WHEN 'accepted' THEN r END AS applied FROM (SELECT conv_id, ['pending','accepted','edited','rejected'][CAST(turn % 4 + 1 AS INTEGER)] AS d, text AS e, role AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    "w26_stalled_runs": f"SELECT run_id, CASE WHEN attempt >= 3 THEN 'fail' ELSE 'requeue' END AS action FROM (SELECT user_id AS run_id, max(ts) AS heartbeat, count(*) AS attempt FROM events GROUP BY 1) WHERE run_id % 3 = 0 AND (heartbeat IS NULL OR heartbeat < TIMESTAMP '{NOW}' - INTERVAL 90 SECOND)",
    "w27_needs_rerun": "SELECT p_partkey AS doc_id, p_size % 4 AS old_type, CAST(p_partkey % 4 AS INTEGER) AS new_type FROM part WHERE (p_size % 4 < 2) <> (p_partkey % 4 < 2)",
    "w28_eval_headline": "SELECT l_suppkey AS run, round(avg(l_discount), 6) AS f1, round(avg(l_tax), 6) AS recall FROM lineitem GROUP BY 1",
    "w29_latest_per_config": "SELECT o_orderpriority AS config, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest, max(o_totalprice) AS best FROM orders GROUP BY 1",
    "a29_readiness": ctes("findings", "scores") + "SELECT run_id, total, mapped, CAST(penalty AS BIGINT) AS penalty, score FROM scores",
}
