"""Further rule, retrieval, workspace and model queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.operators import evaluation as e
from clausemill.operators import graph as g
from clausemill.operators import knowledge as k
from clausemill.operators import models as m
from clausemill.operators import rules as r
from clausemill.operators import workspace as w
from clausemill.plans.graph import _S, _H, _L, _supersedes
from clausemill.plans.tables import read


def _li(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("req"), F.col("l_partkey").alias("standard"), "l_suppkey", "l_quantity", "l_tax", (F.col("l_discount") * 10).alias("confidence"))


def _terms(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("standard"), F.element_at(F.split("p_name", " "), 2).alias("term"), F.when(F.col("p_size") % 3 == 0, "code_of_practice").otherwise("product").alias("kind"))


def _cited(s, d):
    return _li(s, d).where("l_tax >= 0.06").select("doc", "standard").distinct()


def _edges(s, d):
    return read(s, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"), F.when(F.col("p_size") % 2 == 0, "REQUIRES").otherwise("TESTED_BY").alias("type"))


def _labelled(s, d):
    return read(s, d, "documents").join(read(s, d, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))


def _numbered(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("standard"), F.concat(F.lit("S "), "p_partkey").alias("number"), F.col("p_type").alias("category"))


def _edge_rows(s, d):
    return _edges(s, d).withColumn("edge_no", F.col("src")).withColumn("confidence", F.lit(0.8))


def _details(s, d):
    """Clauses from the suppliers of a part, events from its orders' dates, relationships from the tree of parts."""
    li = read(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("day"))
    clauses = li.select(F.col("l_partkey").alias("standard"), F.col("l_suppkey").alias("clause_no"), F.concat(F.lit("c"), "l_suppkey").alias("section"), F.lit("text").alias("text")).distinct()
    events = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("standard"), F.col("day").cast("string").alias("date"), F.lit("amended").alias("kind"), F.lit("").alias("summary")).distinct()
    rows = k.standard_details(_numbered(s, d), clauses, _edge_rows(s, d), events)
    joined = lambda name, of: F.array_join(F.transform(name, of), ";").alias(name)
    return rows.select("standard", "number", joined("clauses", lambda x: x["section"]), joined("relationships", lambda x: F.concat_ws(" ", x["type"], x["direction"], x["other_number"])), joined("events", lambda x: x["date"]))


QUERIES = {
    "r23_related_standards": lambda s, d: k.related_standards(_numbered(s, d), _edge_rows(s, d)).select("standard", "number", "category", F.array_join("related", ";").alias("related")),
    "r23_standard_details": _details,
    "a3_in_scope": lambda s, d: r.in_scope(_cited(s, d), _li(s, d).where("l_quantity > 40").join(_terms(s, d), "standard").select("doc", "term").distinct(), _terms(s, d).select("standard", "term")),
    "a4_qualifiers": lambda s, d: r.qualifiers(_li(s, d).select("doc", F.concat(F.lit("p"), F.col("req") % 3).alias("parameter"), (F.col("l_suppkey") % 5).cast("string").alias("text")), ["p0", "p2"]),
    "a5_candidate_standards": lambda s, d: r.candidate_standards(_li(s, d).where("l_tax >= 0.06"), _li(s, d).withColumn("scope", F.col("l_suppkey") % 2 == 0)),
    "a13_companion_parts": lambda s, d: r.companion_parts(_cited(s, d).withColumnRenamed("standard", "replacement"), _edges(s, d)),
    "a14_governed_requirements": lambda s, d: r.governed_requirements(_li(s, d).where("confidence >= 0.5").select("doc", "standard", "req"), _li(s, d).where("l_tax < 0.02").select("doc", "standard", "req"), _terms(s, d).select("standard", "kind")),
    "a18_addressed_standards": lambda s, d: r.addressed_standards(_cited(s, d), _supersedes(s, d), g.latest_replacement(_supersedes(s, d))),
    "a20_nearest_missing": lambda s, d: r.nearest_missing(_cited(s, d), _edges(s, d), _li(s, d).where("l_tax < 0.02").select("doc", F.floor(F.col("standard") / 2).cast("long").alias("standard"))),
    "a22_quantity_role": lambda s, d: r.quantity_role(_li(s, d).select("doc", "req", "standard", F.concat(F.when(F.col("req") % 2 == 0, "observed value ").otherwise("as noted "), F.when(F.col("l_suppkey") % 3 == 0, "limit ").when(F.col("l_suppkey") % 3 == 1, "then measured ").otherwise("")).alias("before"))),
    "a33_evidence_rows": lambda s, d: r.evidence_rows(read(s, d, "part").select(F.col("p_partkey").alias("doc"), F.lit("f-1").alias("local_id"), F.split("p_name", " ").alias("evidence"))),
    "r9_add_cited_clauses": lambda s, d: k.add_cited_clauses(_li(s, d).where("l_tax < 0.02").groupBy(F.col("doc").alias("qid"), F.col("standard").alias("did")).agg(F.max("confidence").alias("score")), _cited(s, d).select(F.col("doc").alias("qid"), "standard"), read(s, d, "part").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("standard"), F.col("p_partkey").alias("did"))),
    "r10_product_match": lambda s, d: k.product_match(read(s, d, "part").select(F.col("p_partkey").alias("standard"), "p_name"), s.createDataFrame([("bolt", "fastener"), ("ring", "fastener"), ("gear", "drive")], "form string, term string"), "p_name"),
    "r13_cited_competitors": lambda s, d: k.cited_competitors(_li(s, d).where("confidence >= 0.5").select("doc", "standard").distinct(), _cited(s, d), _terms(s, d)),
    "r17_mapping_basis": lambda s, d: k.mapping_basis(_li(s, d).select("doc", "req").distinct(), _li(s, d).where("confidence >= 0.5").select("doc", "req", (F.col("l_tax") >= 0.06).alias("explicit"))),
    "r23_catalogue": lambda s, d: k.catalogue(_terms(s, d), _edges(s, d)),
    "v4_finding_group": lambda s, d: _li(s, d).select("doc", "req", "standard", e.finding_group(F.element_at(F.array(F.lit("conflicting"), F.lit("missing"), F.lit("outdated")), (F.col("req") % 3 + 1).cast("int")), F.when(F.col("l_suppkey") % 5 == 0, "dependency_gap").otherwise("other")).alias("grp")),
    "w12_daily_activity": lambda s, d: w.daily_activity(read(s, d, "events"), "2024-02-02"),
    "w24_audit_trail": lambda s, d: w.audit_trail(read(s, d, "events"), read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))),
    "x18_text_classifier": lambda s, d: m.predict(m.text_classifier(_labelled(s, d)), m.word_grams(_labelled(s, d)), ["doc_id"]),
    "x19_embedding_classifier": lambda s, d: m.predict(m.embedding_classifier(read(s, d, "embeddings")), read(s, d, "embeddings"), ["vec_id"], True),
}

_LI = "li AS (SELECT l_orderkey AS doc, l_linenumber AS req, l_partkey AS standard, l_suppkey, l_quantity, l_tax, l_discount * 10 AS confidence FROM lineitem)"
_T = "t AS (SELECT p_partkey AS standard, string_split(p_name, ' ')[2] AS term, CASE WHEN p_size % 3 = 0 THEN 'code_of_practice' ELSE 'product' END AS kind FROM part)"
_C = "c AS (SELECT DISTINCT doc, standard FROM li WHERE l_tax >= 0.06)"
_W = f"WITH {_LI}, {_T}, {_C}"
_REL = "rel AS (SELECT p_partkey AS standard, p_partkey // 2 AS other, p_partkey AS edge_no, CASE WHEN p_size % 2 = 0 THEN 'REQUIRES' ELSE 'TESTED_BY' END AS type, 'out' AS direction FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey // 2, p_partkey, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'REQUIRES' ELSE 'TESTED_BY' END, 'in' FROM part WHERE p_partkey > 1)"
SQL = {
    "r23_related_standards": f"WITH {_REL} SELECT p_partkey AS standard, 'S ' || p_partkey AS number, p_type AS category, coalesce((SELECT string_agg('S ' || other, ';' ORDER BY edge_no, 'S ' || other) FROM (SELECT standard, other, min(edge_no) AS edge_no FROM rel GROUP BY 1, 2) x WHERE x.standard = p_partkey), '') AS related FROM part",
    "r23_standard_details": f"WITH {_REL}, c AS (SELECT standard, string_agg('c' || n, ';' ORDER BY n) AS t FROM (SELECT DISTINCT l_partkey AS standard, l_suppkey AS n FROM lineitem) GROUP BY 1), r AS (SELECT standard, string_agg(concat_ws(' ', type, direction, 'S ' || other), ';' ORDER BY edge_no, type, direction) AS t FROM rel GROUP BY 1), v AS (SELECT standard, string_agg(day, ';' ORDER BY day) AS t FROM (SELECT DISTINCT l_partkey AS standard, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1) SELECT p_partkey AS standard, 'S ' || p_partkey AS number, coalesce(c.t, '') AS clauses, coalesce(r.t, '') AS relationships, coalesce(v.t, '') AS events FROM part LEFT JOIN c ON c.standard = p_partkey LEFT JOIN r ON r.standard = p_partkey LEFT JOIN v ON v.standard = p_partkey",
    "a3_in_scope": _W + ", dt AS (SELECT DISTINCT doc, term FROM li JOIN t USING (standard) WHERE l_quantity > 40) SELECT doc, standard, EXISTS (SELECT 1 FROM dt JOIN t USING (term) WHERE dt.doc = c.doc AND t.standard = c.standard) OR NOT EXISTS (SELECT 1 FROM dt WHERE dt.doc = c.doc) AS scope FROM c",
    "a4_qualifiers": f"WITH {_LI} SELECT doc, concat('p', req % 3) AS parameter, string_agg(DISTINCT CAST(l_suppkey % 5 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 5 AS VARCHAR)) AS stated FROM li WHERE req % 3 IN (0, 2) GROUP BY 1, 2",
    "a5_candidate_standards": f"WITH {_LI} SELECT doc, req, standard, min(ord) AS ord FROM (SELECT doc, req, standard, 0 AS ord FROM li WHERE l_tax >= 0.06 UNION ALL SELECT doc, req, standard, 1 FROM li WHERE confidence >= 0.5 AND l_suppkey % 2 = 0) GROUP BY 1, 2, 3",
    "a13_companion_parts": _W + " SELECT doc, standard AS replacement, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS companions FROM c JOIN part ON p_partkey // 2 = standard AND p_partkey > 1 AND p_size % 2 = 0 GROUP BY 1, 2",
    "a14_governed_requirements": _W + ", u AS (SELECT doc, standard, req FROM li WHERE confidence >= 0.5 UNION SELECT doc, standard, req FROM li WHERE l_tax < 0.02) SELECT doc, standard, req FROM (SELECT u.*, kind, count(*) OVER (PARTITION BY doc, u.standard) AS n FROM u JOIN t USING (standard)) WHERE kind <> 'code_of_practice' OR n >= 2",
    "a18_addressed_standards": f"WITH RECURSIVE {_LI}, {_C}, {_S}, {_H}, {_L} SELECT doc, standard FROM c UNION SELECT doc, dst FROM c JOIN s ON standard = src UNION SELECT doc, latest FROM c JOIN l ON standard = node",
    "a20_nearest_missing": _W.replace("WITH", "WITH RECURSIVE", 1) + ", re AS (SELECT doc, standard FROM c UNION SELECT doc, standard // 2 FROM li WHERE l_tax < 0.02), f AS (SELECT doc, standard FROM c UNION SELECT f.doc, p_partkey // 2 FROM f JOIN part ON f.standard = p_partkey JOIN re x ON x.doc = f.doc AND x.standard = p_partkey // 2 WHERE p_partkey > 1) SELECT DISTINCT f.doc, p_partkey // 2 AS target FROM f JOIN part ON f.standard = p_partkey WHERE p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM re x WHERE x.doc = f.doc AND x.standard = p_partkey // 2)",
    "a22_quantity_role": f"WITH {_LI} SELECT doc, req, standard, concat(CASE WHEN req % 2 = 0 THEN 'observed value ' ELSE 'as noted ' END, CASE l_suppkey % 3 WHEN 0 THEN 'limit ' WHEN 1 THEN 'then measured ' ELSE '' END) AS before, CASE l_suppkey % 3 WHEN 0 THEN 'limit' WHEN 1 THEN 'observed' ELSE CASE WHEN req % 2 = 0 THEN 'observed' END END AS role FROM li",
    "a33_evidence_rows": "SELECT p_partkey AS doc, 'f-1' AS local_id, generate_subscripts(x, 1) - 1 AS ordinal, unnest(x) AS item FROM (SELECT p_partkey, string_split(p_name, ' ') AS x FROM part)",
    "r9_add_cited_clauses": _W + ", h AS (SELECT doc AS qid, standard AS did, max(confidence) AS score FROM li WHERE l_tax < 0.02 GROUP BY 1, 2) SELECT * FROM h UNION ALL SELECT DISTINCT doc, p_partkey, 0.0::DOUBLE FROM c JOIN part ON p_partkey // 2 = standard WHERE NOT EXISTS (SELECT 1 FROM h WHERE qid = doc AND did = p_partkey)",
    "r10_product_match": "SELECT DISTINCT p_partkey AS standard, term FROM part JOIN (VALUES ('bolt', 'fastener'), ('ring', 'fastener'), ('gear', 'drive')) f(form, term) ON contains(lower(p_name), form)",
    "r13_cited_competitors": _W + " SELECT DISTINCT a.doc, a.standard FROM li a JOIN t x USING (standard) JOIN c ON c.doc = a.doc AND c.standard <> a.standard JOIN t y ON y.standard = c.standard AND y.kind = x.kind AND y.term = x.term WHERE confidence >= 0.5",
    "r17_mapping_basis": f"WITH {_LI} SELECT doc, req, CASE WHEN bool_or(l_tax >= 0.06) FILTER (confidence >= 0.5) THEN 'explicit_reference' WHEN count(*) FILTER (confidence >= 0.5) > 0 THEN 'retrieval' ELSE 'none' END AS basis FROM li GROUP BY 1, 2",
    "r23_catalogue": "WITH b AS (SELECT p_partkey AS a, p_partkey // 2 AS o FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey > 1) SELECT p_partkey AS standard, count(o) AS related FROM part LEFT JOIN b ON p_partkey = a GROUP BY 1",
    "v4_finding_group": f"WITH {_LI} SELECT doc, req, standard, CASE WHEN l_suppkey % 5 = 0 THEN 'dependency' ELSE ['conflict', 'gap', 'outdated'][CAST(req % 3 + 1 AS INTEGER)] END AS grp FROM li",
    "w12_daily_activity": "WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-20', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day), e AS (SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS events FROM days d LEFT JOIN e ON d.day = e.day",
    "w24_audit_trail": "SELECT event_id, user_id, coalesce(c_name, 'system') AS actor, event_type, coalesce('k=' || (props::JSON ->> 'k'), '') AS detail FROM events LEFT JOIN customer ON user_id = c_custkey",
}
