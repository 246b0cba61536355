"""Graph queries over the parts table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausemill.operators import graph as g
from clausemill.plans.tables import read


def _normative(s, d):
    # A binary tree, and a second edge that skips a level for some.
    parts = read(s, d, "part").where("p_partkey > 1")
    near = parts.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"), F.when(F.col("p_size") % 2 == 0, "REQUIRES").otherwise("TESTED_BY").alias("type"), (F.col("p_size") / 50).alias("confidence"))
    far = parts.where("p_partkey > 3 and p_size % 3 = 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 4).cast("long").alias("dst"), F.lit("REFERENCES").alias("type"), (F.col("p_size") / 50).alias("confidence"))
    return near.unionByName(far)


def _supersedes(s, d):
    order = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    return read(s, d, "part").select(F.lead("p_partkey").over(order).alias("src"), F.col("p_partkey").alias("dst")).where("src is not null")


def _cyclic(s, d):
    block = F.floor(F.col("p_partkey") / 50).cast("long") * 50
    return read(s, d, "part").select(F.col("p_partkey").alias("src"), (block + (F.col("p_partkey") * 7 + 3) % 50).alias("dst"))


def _few(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("node"))


def _paths(s, d):
    """Requirements (line items) -> standards (parts) -> clauses (suppliers of a part), the part's test method, its certification (size)."""
    li = read(s, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("req"), "l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    part = read(s, d, "part")
    mapped = li.groupBy("req", "l_partkey").agg(F.max("l_discount").alias("c"))
    mapped = mapped.join(part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 7 != 0).alias("current")), "l_partkey")
    mapped = mapped.select(F.col("req").alias("src"), F.col("l_partkey").alias("dst"), (1 - F.col("c")).alias("confidence"), "current")
    clauses = li.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg((1 - F.max("l_tax")).alias("confidence")).withColumn("current", F.lit(True))
    tests = part.where("p_partkey > 1 and p_size % 2 = 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"), F.lit(1.0).alias("confidence"), F.lit(True).alias("current"))
    schemes = part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("src"), F.col("p_size").alias("dst"), F.lit(1.0).alias("confidence"), F.lit(True).alias("current"))
    starts = li.select(F.col("l_orderkey").alias("doc"), F.lit("requirement").alias("kind"), F.col("req").alias("node")).distinct()
    hops = [("standard", "requirement", mapped, True), ("clause", "standard", clauses, True), ("test", "standard", tests, False), ("certification", "standard", schemes, False)]
    return g.evidence_paths(starts, hops, most=3).select("doc", F.array_join(F.transform("nodes", lambda x: F.concat_ws("=", x["kind"], x["node"])), ">").alias("path"), "current", F.round("confidence", 6).alias("confidence"), "path_no")


QUERIES = {
    "g1_neighbors": lambda s, d: g.neighbors(_normative(s, d), _few(s, d), "in", ["REQUIRES", "TESTED_BY"]),
    "g2_latest_replacement": lambda s, d: g.latest_replacement(_supersedes(s, d)),
    "g3_dependencies": lambda s, d: g.closure(_normative(s, d).where("type <> 'REFERENCES'"), depth=2),
    "g5_contract_supersession": lambda s, d: g.contract_supersession(_normative(s, d), _supersedes(s, d)),
    "g6_find_cycles": lambda s, d: g.find_cycles(_cyclic(s, d)),
    "g7_layers": lambda s, d: g.layers(_normative(s, d)),
    "g8_closure": lambda s, d: g.closure(_normative(s, d)),
    "g9_ancestors": lambda s, d: g.ancestors(_normative(s, d).where("type <> 'REFERENCES'")),
    "g10_transitive_reduction": lambda s, d: g.transitive_reduction(_normative(s, d)),
    "g11_graph_stats": lambda s, d: g.graph_stats(_normative(s, d)),
    "g12_dag_export": lambda s, d: g.dag_export(_normative(s, d)),
    "g13_neighborhood": lambda s, d: g.neighborhood(_normative(s, d), _few(s, d), 2),
    "g16_evidence_paths": _paths,
}

_E = "edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, CASE WHEN p_size % 2 = 0 THEN 'REQUIRES' ELSE 'TESTED_BY' END AS type, p_size / 50.0::DOUBLE AS confidence FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 4, 'REFERENCES', p_size / 50.0::DOUBLE FROM part WHERE p_partkey > 3 AND p_size % 3 = 0), e AS (SELECT DISTINCT src, dst FROM edges)"
_R = "r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src)"
_C = "c AS (SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2)"
_S = "s AS (SELECT * FROM (SELECT lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS src, p_partkey AS dst FROM part) WHERE src IS NOT NULL)"
_L = "l AS (SELECT node, max(hops) AS hops, arg_max(latest, hops) AS latest FROM h GROUP BY 1)"
_H = "h AS (SELECT dst AS node, src AS latest, 1 AS hops FROM s UNION ALL SELECT h.node, s.src, h.hops + 1 FROM h JOIN s ON h.latest = s.dst)"
_N = "lay AS (SELECT n.node, CAST(coalesce(max(r.depth), 0) AS INTEGER) AS layer FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n LEFT JOIN r ON n.node = r.src GROUP BY 1)"
_T = "red AS (SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN c ON x.dst = c.src WHERE x.src = e.src AND c.dst = e.dst AND x.dst <> e.dst))"
#: The hops one after the other; after each the three best paths of a document and end stay.
_BEST = "current DESC, len(nodes) DESC, round(confidence, 9) DESC, nodes"
_PRUNED = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc, nodes[-1] ORDER BY {_BEST}) AS n FROM (%s)) WHERE n <= 3"
_PATHS_SQL = (
    """WITH RECURSIVE li AS (SELECT concat_ws('/', l_orderkey, l_linenumber) AS req, l_orderkey, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem),
    hops AS (
      SELECT 1 AS hop, 'standard' AS kind, 1 AS after, req AS src, CAST(l_partkey AS VARCHAR) AS dst, 1 - max(l_discount) AS confidence, l_partkey % 7 <> 0 AS current FROM li JOIN part ON p_partkey = l_partkey GROUP BY req, l_partkey
      UNION ALL SELECT 2, 'clause', 2, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), 1 - max(l_tax), true FROM li GROUP BY l_partkey, l_suppkey
      UNION ALL SELECT 3, 'test', 2, CAST(p_partkey AS VARCHAR), CAST(p_partkey // 2 AS VARCHAR), 1.0, true FROM part WHERE p_partkey > 1 AND p_size % 2 = 0
      UNION ALL SELECT 4, 'certification', 2, CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), 1.0, true FROM part WHERE p_size % 3 = 0),
    f(hop, doc, nodes, current, confidence) AS (
      SELECT 0, l_orderkey, [{'kind': 'requirement', 'node': req}], true, 1.0::DOUBLE FROM (SELECT DISTINCT l_orderkey, req FROM li)
      UNION ALL """
    + _PRUNED
    % """SELECT f.hop + 1 AS hop, doc, CASE WHEN dst IS NULL THEN nodes ELSE list_append(nodes, {'kind': h.kind, 'node': dst}) END AS nodes, f.current AND coalesce(h.current, true) AS current, f.confidence * coalesce(h.confidence, 1.0)::DOUBLE AS confidence
         FROM f LEFT JOIN hops h ON h.hop = f.hop + 1 AND h.src = f.nodes[h.after].node WHERE f.hop < 4 AND (f.hop >= 2 OR dst IS NOT NULL)"""
    + f""")
    SELECT doc, array_to_string(list_transform(nodes, lambda x: concat(x.kind, '=', x.node)), '>') AS path, current, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY doc ORDER BY {_BEST}) AS path_no FROM f WHERE hop = 4"""
)
SQL = {
    "g1_neighbors": f"WITH {_E} SELECT dst AS node, src AS neighbor, type FROM edges WHERE dst IN (SELECT p_partkey FROM part) AND type IN ('REQUIRES', 'TESTED_BY')",
    "g2_latest_replacement": f"WITH RECURSIVE {_S}, {_H}, {_L} SELECT node, latest, CAST(hops AS BIGINT) AS hops FROM l",
    "g3_dependencies": "WITH e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1) SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src",
    "g5_contract_supersession": f"WITH RECURSIVE {_E}, {_S}, {_H}, {_L} SELECT DISTINCT * FROM (SELECT coalesce(a.latest, src) AS src, coalesce(b.latest, dst) AS dst FROM edges LEFT JOIN l a ON src = a.node LEFT JOIN l b ON dst = b.node WHERE confidence >= 0.7) WHERE src <> dst",
    "g6_find_cycles": "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 50 * 50 + (p_partkey * 7 + 3) % 50 AS dst FROM part), r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src WHERE e.src <> e.dst) SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1 HAVING min(a.dst) <> a.src OR max(a.dst) <> a.src",
    "g7_layers": f"WITH RECURSIVE {_E}, {_R}, {_N} SELECT node, layer FROM lay",
    "g8_closure": f"WITH RECURSIVE {_E}, {_R}, {_C} SELECT * FROM c",
    "g9_ancestors": "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), r AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src) SELECT dst AS node, src AS ancestor, depth FROM r",
    "g10_transitive_reduction": f"WITH RECURSIVE {_E}, {_R}, {_C}, {_T} SELECT * FROM red",
    "g11_graph_stats": f"WITH RECURSIVE {_E}, {_R}, {_C}, {_N}, {_T} SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM c) AS closure_pairs, (SELECT count(*) FROM c WHERE depth > 1) AS transitive_only, (SELECT count(*) FROM lay) AS nodes, (SELECT max(layer) FROM lay) AS deepest, (SELECT count(*) FROM red) AS reduced_edges",
    "g12_dag_export": f"WITH RECURSIVE {_E}, {_R}, {_C}, {_N}, {_T} SELECT src, dst, a.layer AS src_layer, b.layer AS dst_layer FROM red JOIN lay a ON src = a.node JOIN lay b ON dst = b.node",
    "g13_neighborhood": f"WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), n AS (SELECT p_partkey AS center, p_partkey AS node, 0 AS distance FROM part UNION SELECT center, b, distance + 1 FROM n JOIN u ON node = a WHERE distance < 2) SELECT center, node, min(distance) AS distance FROM n GROUP BY 1, 2",
    "g16_evidence_paths": _PATHS_SQL,
}
