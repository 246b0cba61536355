"""Rule and evaluation queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import text as t
from clausemill.operators import evaluation as e
from clausemill.operators import rules as r
from clausemill.plans.tables import read


def _li(s, d):
    return read(s, d, "lineitem")


def _values(s, d):
    """Requirements from lineitem: an interval around the quantity, open on one side by line number."""
    q, w = F.col("l_quantity"), F.col("l_discount") * 50
    return _li(s, d).select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("req"), F.col("l_partkey").alias("standard"), F.element_at(F.array(F.lit("voltage"), F.lit("current"), F.lit("length")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("parameter"), F.when(F.col("l_linenumber") % 4 != 1, q - w).alias("lo"), F.when(F.col("l_linenumber") % 4 != 2, q + w).alias("hi"))


def _limits(s, d):
    p = read(s, d, "part")
    one = lambda name, low, high: p.select(F.col("p_partkey").alias("standard"), F.lit(name).alias("parameter"), low.cast("double").alias("cmin"), high.cast("double").alias("cmax"))
    return one("voltage", F.col("p_size") / 2, F.col("p_size")).unionByName(one("current", F.when(F.col("p_size") % 2 == 0, F.lit(5)), F.lit(40)))


VALUES = "vals AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS req, l_partkey AS standard, ['voltage','current','length'][CAST(l_suppkey % 3 + 1 AS INTEGER)] AS parameter, CASE WHEN l_linenumber % 4 <> 1 THEN l_quantity - l_discount * 50 END AS lo, CASE WHEN l_linenumber % 4 <> 2 THEN l_quantity + l_discount * 50 END AS hi FROM lineitem)"
LIMITS = "lims AS (SELECT p_partkey AS standard, 'voltage' AS parameter, p_size / 2::DOUBLE AS cmin, p_size::DOUBLE AS cmax FROM part UNION ALL SELECT p_partkey, 'current', CASE WHEN p_size % 2 = 0 THEN 5.0::DOUBLE END, 40.0::DOUBLE FROM part)"
CHECKS = "checks AS (SELECT v.*, cmin, cmax, CASE WHEN NOT below AND NOT above THEN 'none' WHEN coalesce(hi < cmin, false) OR coalesce(lo > cmax, false) THEN 'disjoint' ELSE 'partial' END AS overlap, CASE WHEN above THEN 'above' WHEN below THEN 'below' END AS side FROM (SELECT v.*, cmin, cmax, coalesce(lo < cmin, false) OR (lo IS NULL AND coalesce(hi < cmin, false)) AS below, coalesce(hi > cmax, false) OR (hi IS NULL AND coalesce(lo > cmax, false)) AS above FROM vals v JOIN lims USING (standard, parameter)) v)"


def _checks(s, d):
    return r.check_constraints(_values(s, d), _limits(s, d))


def _hits(s, d):
    return _li(s, d).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("req"), F.col("l_partkey").alias("standard"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") >= 0.07).alias("explicit"))


HITS = "hits AS (SELECT l_orderkey AS doc, l_linenumber AS req, l_partkey AS standard, l_discount * 10 AS confidence, l_tax >= 0.07 AS explicit FROM lineitem), app AS (SELECT doc, standard, max(confidence) AS confidence, bool_or(explicit) AS explicit, list_sort(list_distinct(list(req))) AS requirements FROM hits WHERE confidence >= 0.35 OR explicit GROUP BY 1, 2)"


def _cited(s, d):
    return _li(s, d).select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("req"), F.col("l_partkey").alias("standard"), (1980 + F.col("l_suppkey") % 40).cast("int").alias("year"), F.when(F.col("l_linenumber") % 2 == 0, 0.98).otherwise(0.9).alias("resolution"))


CITED = "cited AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS req, l_partkey AS standard, CAST(1980 + l_suppkey % 40 AS INTEGER) AS year, CASE WHEN l_linenumber % 2 = 0 THEN 0.98 ELSE 0.9 END AS resolution FROM lineitem)"


def _records(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("standard"), (1980 + F.col("p_size") % 40).alias("own_year"), F.when(F.col("p_partkey") % 7 == 0, "superseded").otherwise("current").alias("status"), (F.col("p_partkey") % 3 == 0).alias("amended"))


VERSIONS = CITED + ", recs AS (SELECT p_partkey AS standard, 1980 + p_size % 40 AS own_year, p_partkey % 7 = 0 AS gone, p_partkey % 3 = 0 AS amended FROM part), ver AS (SELECT doc, req, standard, CASE WHEN gone THEN 'superseded_reference' WHEN year < own_year THEN 'superseded_edition' WHEN year > own_year THEN 'newer_edition' WHEN amended THEN 'amendment_check' END AS rule, CASE WHEN gone THEN 'high' WHEN year < own_year THEN 'medium' ELSE 'low' END AS severity, round(CASE WHEN gone OR year < own_year THEN resolution * 0.85 ELSE 0.6 END, 6)::DOUBLE AS confidence FROM cited JOIN recs USING (standard))"


def _versions(s, d):
    return r.version_findings(_cited(s, d), _records(s, d))


def _checklist(s, d):
    return read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("standard"), F.concat(F.lit("p"), F.col("n_regionkey")).alias("parameter"), F.when(F.col("n_nationkey") % 2 == 0, "medium").otherwise("high").alias("severity"))


def _edges(s, d):
    return read(s, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"), F.element_at(F.array(F.lit("TESTED_BY"), F.lit("REQUIRES"), F.lit("REFERENCES")), (F.col("p_size") % 3 + 1).cast("int")).alias("type"), (F.col("p_size") / 50).alias("confidence"))


def _small(s, d):
    return _li(s, d).select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 25).alias("standard")).distinct()


def _labels(s, d):
    docs = read(s, d, "documents").select("doc_id", "text", "lang", F.length("text").alias("n"))
    return read(s, d, "labels").join(docs, "doc_id")


def _items(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("slot"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("other"))


def _ranked(s, d):
    hits = _li(s, d).select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("did"), F.col("l_linenumber").alias("rank")).groupBy("qid", "did").agg(F.min("rank").alias("rank"))
    gold = _li(s, d).groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("did")).agg((F.max("l_suppkey") % 3 + F.max("l_linenumber") % 3).cast("int").alias("grade"))
    return hits, gold


def _runs(s, d, m):
    return read(s, d, "orders").where(f"o_orderkey % {m} <> 0").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % m < 2).alias("ok"))


def _tokens(s, d, name):
    return read(s, d, "part").select(F.floor(F.col("p_partkey") / 100).cast("long").alias("doc"), F.col("p_partkey").alias(name), F.array_distinct(t.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("tokens"))


def _matches(s, d):
    return e.text_match_candidates(_tokens(s, d, "gid"), _tokens(s, d, "pid"))


#: Parameters with a polarity, of safety, accepted within a tolerance, and without any.
JUDGED = ["turbidity", "flow_rate", "efficiency", "noise_level", "voltage"]


def _judged(s, d, role):
    """Line items as values of reports: an order is a report, a line a requirement; every third value is a limit."""
    n = F.col("l_linenumber") + F.col("l_suppkey")
    name = F.element_at(F.array(*[F.lit(x) for x in JUDGED]), (F.col("l_partkey") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("eq"), F.lit("min"), F.lit("max")), (n % 3 + 1).cast("int"))
    rows = _li(s, d).where((F.col("l_suppkey") % 3 == 0) == (role == "limit")).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("req"), F.concat_ws("/", "l_partkey", "l_suppkey", "l_quantity").alias("ord"), name.alias("parameter"), F.lit("x").alias("dimension"), kind.alias("comparator"), F.col("l_quantity").alias("value"))
    low, high = F.when(F.col("comparator") != "max", F.col("value")), F.when(F.col("comparator") != "min", F.col("value"))
    return rows.withColumn("lo", low).withColumn("hi", high).distinct()


def _qualified(s, d):
    checks = _checks(s, d).withColumn("qualifier", F.when(F.col("standard") % 3 == 0, F.concat(F.lit("exposure="), F.element_at(F.array(F.lit("Severe"), F.lit("mild")), (F.col("standard") % 2 + 1).cast("int")))))
    stated = read(s, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("doc"), F.lit("exposure").alias("key"), F.element_at(F.array(F.lit("severe"), F.lit("MILD")), (F.col("o_custkey") % 2 + 1).cast("int")).alias("value"))
    return r.qualified_checks(checks, stated).select("doc", "req", "standard", "parameter", "lo", "hi", "cmin", "cmax", "overlap", "side", "qualifier")


def _replaced(s, d):
    p = read(s, d, "part")
    standards = p.select(F.col("p_partkey").alias("standard"), F.when(F.col("p_partkey") % 7 == 0, "superseded").otherwise("current").alias("status"), F.when(F.col("p_size") % 2 == 0, "product").otherwise("test_method").alias("kind"), F.when(F.col("p_size") % 3 == 0, "mark").alias("scheme"))
    latest = p.where("p_partkey % 14 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") - 1).alias("latest"))
    evidence = _li(s, d).where("l_tax > 0.05").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("standard")).distinct()
    return r.replaced_certification_gaps(_li(s, d).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("standard")).distinct(), standards, latest, evidence)


def _verified_references(s, d):
    li = _li(s, d)
    edition = F.element_at(F.array(F.lit("current"), F.lit("older"), F.lit("unspecified")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    resolved = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("req"), F.col("l_suppkey").alias("c_no"), F.col("l_partkey").alias("standard"), edition.alias("edition"), F.when(F.col("l_tax") > 0.03, 0.98).otherwise(0.7).alias("confidence"))
    standards = read(s, d, "part").select(F.col("p_partkey").alias("standard"), F.when(F.col("p_partkey") % 7 == 0, "superseded").otherwise("current").alias("status"))
    taken = li.where("l_discount > 0.07").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("req"))
    return r.verified_references(resolved, standards, taken)


def _scored(s, d, run):
    """Two runs over orders as items: tasks by priority, of which the first has other items in the second run."""
    o = read(s, d, "orders").where("o_orderpriority is not null")
    o = o if run == "a" else o.where("not startswith(o_orderpriority, '1') or o_orderkey % 5 <> 0")
    ok = F.col("o_custkey") % (3 if run == "a" else 4) == 0
    return o.select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("item"), F.lit("ok").alias("metric"), ok.cast("double").alias("value"))


def _deltas(s, d):
    got = e.compare_metrics(_scored(s, d, "a"), _scored(s, d, "b"), samples=100)
    return got.select("task", "metric", *[F.round(c, 5).alias(c) for c in ("a", "b", "delta", "low", "high")], "mark")


def _flips(s, d):
    details = lambda run: _scored(s, d, run).where("value = 1").select("task", "item", F.concat(F.lit("found "), "item").alias("detail"))
    return e.item_flips(details("a"), details("b"))


_JUDGED_SQL = "jd AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS req, concat_ws('/', l_partkey, l_suppkey, l_quantity) AS ord, ['" + "','".join(JUDGED) + """'][CAST(l_partkey % 5 + 1 AS INTEGER)] AS parameter, ['eq','min','max'][CAST((l_linenumber + l_suppkey) % 3 + 1 AS INTEGER)] AS comparator, l_quantity AS value, l_suppkey % 3 = 0 AS is_limit FROM lineitem),
  lim AS (SELECT doc, req, ord, parameter, CASE WHEN comparator = 'min' OR comparator = 'eq' AND parameter IN ('flow_rate', 'efficiency') THEN value ELSE '-inf'::DOUBLE END AS low, CASE WHEN comparator = 'max' OR comparator = 'eq' AND parameter IN ('turbidity', 'noise_level') THEN value ELSE 'inf'::DOUBLE END AS high FROM jd WHERE is_limit AND NOT (comparator = 'eq' AND parameter = 'voltage')),
  ob AS (SELECT doc, req, ord, parameter, value FROM jd WHERE NOT is_limit),
  br AS (SELECT ob.*, low, high, row_number() OVER (PARTITION BY ob.doc, ob.req, ob.ord, ob.parameter ORDER BY lim.req, lim.ord) AS n FROM ob JOIN lim ON ob.doc = lim.doc AND ob.parameter = lim.parameter AND (lim.req = ob.req OR NOT EXISTS (SELECT 1 FROM lim x WHERE x.doc = ob.doc AND x.parameter = ob.parameter AND x.req = ob.req)) WHERE value > high + 1e-9 OR value < low - 1e-9),
  on_ AS (SELECT *, row_number() OVER (PARTITION BY doc, parameter, value ORDER BY req, ord) AS k, CASE WHEN value > high + 1e-9 THEN high ELSE low END AS bound FROM br WHERE n = 1),
  dv AS (SELECT *, CASE WHEN bound <> 0 THEN abs(value - bound) / abs(bound) ELSE 1.0 END AS dev FROM on_ WHERE k = 1)"""
_SCORED = "sa AS (SELECT o_orderpriority AS task, o_orderkey AS item, (o_custkey % 3 = 0)::INTEGER::DOUBLE AS value FROM orders), sb AS (SELECT o_orderpriority AS task, o_orderkey AS item, (o_custkey % 4 = 0)::INTEGER::DOUBLE AS value FROM orders WHERE NOT starts_with(o_orderpriority, '1') OR o_orderkey % 5 <> 0)"
_POISSON = " + ".join(f"CASE WHEN x >= {limit} THEN 1 ELSE 0 END" for limit in e.TIMES)
FURTHER_SQL = {
    "v7_per_class": "WITH p AS (SELECT CAST(quality AS VARCHAR) AS g, CASE WHEN length(text) > 600 THEN '1' WHEN length(text) > 200 THEN '0' ELSE '2' END AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT g AS label FROM p UNION SELECT p FROM p), c AS (SELECT label, count(*) FILTER (g = label AND p = label) AS tp, count(*) FILTER (g <> label AND p = label) AS fp, count(*) FILTER (g = label AND p <> label) AS fn FROM l, p GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END::DOUBLE AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END::DOUBLE AS re FROM c) SELECT label, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r",
    "a24_report_nonconformity": f"WITH {_JUDGED_SQL} SELECT doc, req, parameter, value, CASE WHEN value > high + 1e-9 THEN 'above' ELSE 'below' END AS side, bound, CASE WHEN parameter = 'turbidity' OR dev > 0.1 THEN 'high' WHEN parameter = 'flow_rate' AND dev <= 0.02 THEN 'low' ELSE 'medium' END AS severity FROM dv",
    "a7_qualified_checks": "WITH {V}, {L}, {C}, c AS (SELECT *, CASE WHEN standard % 3 = 0 THEN 'exposure=' || ['Severe', 'mild'][CAST(standard % 2 + 1 AS INTEGER)] END AS qualifier FROM checks), q AS (SELECT o_orderkey AS doc, ['severe', 'MILD'][CAST(o_custkey % 2 + 1 AS INTEGER)] AS value FROM orders WHERE o_orderkey % 4 <> 0) SELECT doc, req, standard, parameter, lo, hi, cmin, cmax, overlap, side, qualifier FROM c WHERE qualifier IS NULL OR EXISTS (SELECT 1 FROM q WHERE q.doc = c.doc AND lower(q.value) = lower(split_part(qualifier, '=', 2)))".replace("{V}", VALUES).replace("{L}", LIMITS).replace("{C}", CHECKS),
    "a21_replaced_certification": "WITH a AS (SELECT DISTINCT l_orderkey AS doc, CASE WHEN l_partkey % 14 = 0 THEN l_partkey - 1 ELSE l_partkey END AS standard FROM lineitem WHERE l_partkey % 7 <> 0 OR l_partkey % 14 = 0), ev AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS standard FROM lineitem WHERE l_tax > 0.05) SELECT doc, string_agg(CAST(standard AS VARCHAR), ',' ORDER BY CAST(standard AS VARCHAR)) AS standards, count(*) AS n FROM a JOIN part ON p_partkey = standard AND p_size % 6 = 0 ANTI JOIN ev USING (doc, standard) GROUP BY 1",
    "a27_verified_references": "SELECT doc, req, standard, edition, round(confidence * 0.9, 6) AS confidence FROM (SELECT l_orderkey AS doc, l_linenumber AS req, l_partkey AS standard, ['current', 'older', 'unspecified'][CAST(l_suppkey % 3 + 1 AS INTEGER)] AS edition, 0.98::DOUBLE AS confidence, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) AS n FROM lineitem l WHERE l_tax > 0.03 AND l_suppkey % 3 <> 1 AND l_partkey % 7 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber AND x.l_discount > 0.07)) WHERE n = 1",
    "v18_run_deltas": f"WITH {_SCORED}, m AS (SELECT task, (SELECT avg(value) FROM sa x WHERE x.task = t.task) AS a, (SELECT avg(value) FROM sb x WHERE x.task = t.task) AS b FROM (SELECT DISTINCT task FROM sa) t), p AS (SELECT task, item, sb.value - sa.value AS v FROM sa JOIN sb USING (task, item) WHERE task NOT IN (SELECT task FROM sa WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.task = sa.task AND sb.item = sa.item))), h AS (SELECT task, v, r, CAST('0x' || substr(md5(concat(r, ':', item)), 1, 8) AS BIGINT) % 1000000 AS x FROM p, (SELECT unnest(range(100)) AS r)), w AS (SELECT task, r, v, {_POISSON} AS times FROM h), g AS (SELECT task, r, sum(v * times) / sum(times) AS m FROM w GROUP BY 1, 2), c AS (SELECT task, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM g GROUP BY 1) SELECT task, 'ok' AS metric, round(a, 5) AS a, round(b, 5) AS b, round(b - a, 5) AS delta, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN low > 0 OR high < 0 THEN CASE WHEN b > a THEN 'up' ELSE 'down' END END AS mark FROM m LEFT JOIN c USING (task)",
    "v18_item_flips": f"WITH {_SCORED}, x AS (SELECT task, item, 'found ' || item AS detail FROM sa WHERE value = 1), y AS (SELECT task, item, 'found ' || item AS detail FROM sb WHERE value = 1) SELECT *, 'gained' AS flip FROM (SELECT * FROM y EXCEPT SELECT * FROM x) UNION ALL SELECT *, 'lost' FROM (SELECT * FROM x EXCEPT SELECT * FROM y)",
}

QUERIES = {
    "a24_report_nonconformity": lambda s, d: r.report_nonconformity(_judged(s, d, "observed"), _judged(s, d, "limit")),
    "a7_qualified_checks": _qualified,
    "a21_replaced_certification": _replaced,
    "a27_verified_references": _verified_references,
    "v18_run_deltas": _deltas,
    "v18_item_flips": _flips,
    "a1_applicability": lambda s, d: r.applicability(_hits(s, d)),
    "a2_strong_applicable": lambda s, d: r.strong_applicable(r.applicability(_hits(s, d)), _hits(s, d).where("standard % 2 = 0").select("doc", "standard").distinct(), _hits(s, d).where("req = 3").select("doc", "standard").distinct()).select("doc", "standard", "confidence", "explicit"),
    "a7_check_constraints": lambda s, d: _checks(s, d),
    "a8_constraint_conflicts": lambda s, d: r.constraint_conflicts(_checks(s, d)),
    "a9_internal_inconsistency": lambda s, d: r.internal_inconsistency(_values(s, d)),
    "a10_edition_conflicts": lambda s, d: r.edition_conflicts(_cited(s, d)),
    "a11_version_findings": _versions,
    "a12_amendment_dedupe": lambda s, d: r.amendment_dedupe(_versions(s, d)),
    "a15_checklist_gaps": lambda s, d: r.checklist_gaps(_small(s, d), _checklist(s, d), _li(s, d).select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("parameter")).distinct(), _li(s, d).select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("p"), F.col("l_linenumber") % 3).alias("parameter"))),
    "a19_dependency_gaps": lambda s, d: r.dependency_gaps(_li(s, d).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("standard")).distinct(), _edges(s, d), _li(s, d).where("l_quantity > 25").select(F.col("l_orderkey").alias("doc"), F.floor(F.col("l_partkey") / 2).cast("long").alias("standard")).distinct()),
    "a21_certification_gaps": lambda s, d: r.certification_gaps(_small(s, d), _small(s, d).where("standard % 4 = 1").select("standard").distinct(), _li(s, d).where("l_tax > 0.05").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 25).alias("standard")).distinct()),
    "a24_result_nonconformity": lambda s, d: r.result_nonconformity(_li(s, d).select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 2).alias("parameter"), F.col("l_quantity").alias("value")), read(s, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 2).alias("parameter"), (F.col("o_custkey") % 10).cast("double").alias("low"), (F.col("o_custkey") % 30 + 15).cast("double").alias("high"))),
    "a27_verified_constraints": lambda s, d: r.verified_constraints(_checks(s, d)),
    "a28_assemble_findings": lambda s, d: r.assemble_findings(r.constraint_conflicts(_checks(s, d)).select("doc", F.lit("conflicting").alias("kind"), "severity", F.concat_ws("/", F.lit("c"), "req", "parameter", "standard").alias("ord")).unionByName(_versions(s, d).select("doc", F.lit("outdated").alias("kind"), "severity", F.concat_ws("/", F.lit("v"), "req", "standard").alias("ord")).distinct())),
    "a30_report_cap": lambda s, d: r.report_cap(read(s, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 101).cast("int").alias("score")), r.constraint_conflicts(_checks(s, d))),
    "a31_repairs": lambda s, d: r.repairs(_checks(s, d).where("overlap = 'disjoint' and lo is not null and lo > 0").withColumn("value", F.floor("lo")).withColumn("text", F.concat(F.lit("rated "), F.floor("lo"), F.lit(" units")))).select("doc", "req", "parameter", "repaired"),
    "a32_rewrite_guard": lambda s, d: r.rewrite_guard(read(s, d, "part").select("p_partkey", F.concat(F.lit("not more than "), "p_size", F.lit(" V [value]")).alias("original"), F.concat(F.lit("at most "), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), F.lit(" V"), F.when(F.col("p_partkey") % 2 == 0, " [value]").otherwise("")).alias("rewrite"))).select("p_partkey", "ok", "reason"),
    "v1_text_match_candidates": _matches,
    "v2_greedy_match": lambda s, d: e.greedy_match(_matches(s, d).select("doc", F.col("gid").alias("gold"), F.col("pid").alias("predicted"))),
    "v3_score_attributes": lambda s, d: e.score_attributes(_li(s, d).where("l_linenumber % 2 = 0").groupBy(F.col("l_orderkey").alias("req"), (F.col("l_suppkey") % 5).alias("parameter")).agg(F.max("l_quantity").alias("value")), _li(s, d).where("l_linenumber % 3 <> 0").select(F.col("l_orderkey").alias("req"), (F.col("l_suppkey") % 5).alias("parameter"), F.col("l_quantity").alias("value"))),
    "v6_micro_prf": lambda s, d: e.micro_prf(_li(s, d).select("l_returnflag", (F.col("l_linenumber") % 3).alias("tp"), (F.col("l_partkey") % 2).alias("fp"), (F.col("l_suppkey") % 2).alias("fn")), ["l_returnflag"]),
    "v7_per_class": lambda s, d: e.confusion(_labels(s, d).select(F.col("quality").cast("string").alias("gold"), F.when(F.col("n") > 600, "1").when(F.col("n") > 200, "0").otherwise("2").alias("predicted"))).select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]),
    "v7_classification_metrics": lambda s, d: e.classification_metrics(_labels(s, d).select(F.col("quality").cast("string").alias("gold"), F.when(F.col("n") > 600, "1").when(F.col("n") > 200, "0").otherwise("2").alias("predicted"))).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1")),
    "v8_mean_fields": lambda s, d: e.mean_fields(_values(s, d), ["lo", "hi"]).select(F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi")),
    "v9_bootstrap_ci": lambda s, d: e.bootstrap_ci(_items(s, d), "value").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high")),
    "v10_paired_bootstrap": lambda s, d: e.paired_bootstrap(_items(s, d), "value", "other").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high")),
    "v11_retrieval_metrics": lambda s, d: e.retrieval_metrics(*_ranked(s, d)).select(*[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr", "ndcg_5")]),
    "v14_multiset_prf": lambda s, d: e.multiset_prf(_li(s, d).select((F.col("l_partkey") % 500).alias("k"), "l_returnflag"), _li(s, d).where("l_linenumber < 4").select((F.col("l_suppkey") * 3 % 500).alias("k"), "l_returnflag"), ["k", "l_returnflag"]),
    "v16_mapping_accuracy": lambda s, d: e.mapping_accuracy(_li(s, d).select(F.when(F.col("l_tax") > 0.02, F.col("l_partkey") % 7).alias("gold"), (F.col("l_suppkey") % 7).alias("predicted"))),
    "v18_compare_runs": lambda s, d: e.compare_runs(_runs(s, d, 5), _runs(s, d, 7)),
    "v20_training_set": lambda s, d: e.training_set(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")),
    "v21_tune_gate": lambda s, d: e.tune_gate(_li(s, d).select(F.col("l_partkey") .bitwiseAND(3).alias("gold"), F.col("l_suppkey").bitwiseAND(3).alias("lexicon"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linenumber") % 4).alias("model"))).select(F.round("threshold", 4).alias("threshold"), F.round("accuracy", 6).alias("accuracy")),
    "v22_quality_gate": lambda s, d: e.quality_gate(_li(s, d).groupBy(F.col("l_suppkey").alias("dataset")).agg(F.avg("l_discount").alias("value")).select("dataset", F.lit("f1").alias("metric"), F.round("value", 6).alias("value")), s.createDataFrame([("f1", 0.05)], "metric string, floor double")),
}

_M = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS f1"
_BOOT = "WITH it AS (SELECT p_partkey AS slot, {0} AS v FROM part), x AS (SELECT b, v, CAST('0x' || substr(md5(concat(b, ':', slot)), 1, 8) AS BIGINT) % 1000000 AS x FROM it, range(1000) t(b)), dr AS (SELECT b, v, len(list_filter([" + ", ".join(map(str, e.TIMES)) + "], lambda l: x >= l)) AS times FROM x), m AS (SELECT b, sum(v * times) / sum(times) AS m FROM dr WHERE times > 0 GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m"
_CC = f"WITH {VALUES}, {LIMITS}, {CHECKS}"
_CONF = "conf AS (SELECT doc, req, standard, parameter, side, CASE overlap WHEN 'disjoint' THEN 'high' ELSE 'medium' END AS severity, CASE overlap WHEN 'disjoint' THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc, req, parameter, standard ORDER BY cmin NULLS FIRST, cmax NULLS FIRST, lo NULLS FIRST, hi NULLS FIRST) AS n FROM checks WHERE overlap <> 'none') WHERE n = 1)"
SQL = {
    "a1_applicability": f"WITH {HITS} SELECT * FROM app",
    "a2_strong_applicable": f"WITH {HITS} SELECT doc, standard, confidence, explicit FROM app a WHERE explicit OR (confidence >= 0.5 AND standard % 2 = 0 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc = a.doc AND h.standard = a.standard AND req = 3))",
    "a7_check_constraints": _CC + " SELECT doc, req, standard, parameter, lo, hi, cmin, cmax, overlap, side FROM checks",
    "a8_constraint_conflicts": _CC + f", {_CONF} SELECT * FROM conf",
    "a9_internal_inconsistency": f"WITH {VALUES}, v AS (SELECT doc, req, parameter, coalesce(lo, '-inf'::DOUBLE) AS lo, coalesce(hi, 'inf'::DOUBLE) AS hi FROM vals) SELECT a.doc, a.parameter, a.req, min(b.req) AS other FROM v a JOIN v b ON a.doc = b.doc AND a.parameter = b.parameter AND a.req < b.req AND (a.lo > b.hi OR b.lo > a.hi) GROUP BY 1, 2, 3",
    "a10_edition_conflicts": f"WITH {CITED} SELECT doc, standard, count(DISTINCT year) AS years, min(year) AS first, max(year) AS last FROM cited GROUP BY 1, 2 HAVING count(DISTINCT year) >= 2",
    "a11_version_findings": f"WITH {VERSIONS} SELECT * FROM ver WHERE rule IS NOT NULL",
    "a12_amendment_dedupe": f"WITH {VERSIONS} SELECT doc, standard, min(req) AS req, count(*) AS citations, rule FROM ver WHERE rule = 'amendment_check' GROUP BY doc, standard, rule UNION ALL SELECT doc, standard, req, 1, rule FROM ver WHERE rule <> 'amendment_check'",
    "a15_checklist_gaps": "WITH a AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 25 AS standard FROM lineitem), w AS (SELECT doc, n_nationkey AS standard, concat('p', n_regionkey) AS parameter, CASE WHEN n_nationkey % 2 = 0 THEN 'medium' ELSE 'high' END AS sev FROM a JOIN nation ON standard = n_nationkey), st AS (SELECT DISTINCT l_orderkey AS doc, concat('p', l_suppkey % 7) AS parameter FROM lineitem), me AS (SELECT DISTINCT l_orderkey AS doc, concat('p', l_linenumber % 3) AS parameter FROM lineitem), m AS (SELECT w.*, me.doc IS NOT NULL AS said FROM w ANTI JOIN st ON w.doc = st.doc AND w.parameter = st.parameter LEFT JOIN me ON w.doc = me.doc AND w.parameter = me.parameter) SELECT doc, parameter, CAST(min(standard) AS BIGINT) AS standard, CASE WHEN bool_or(said) THEN 'insufficient_specification' ELSE 'checklist_gap' END AS rule, CASE WHEN bool_or(said) THEN 'low' ELSE arg_min(sev, standard) END AS severity, CASE WHEN bool_or(said) THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM m GROUP BY 1, 2",
    "a19_dependency_gaps": "WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS standard FROM lineitem), e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, p_size / 50.0::DOUBLE AS conf FROM part WHERE p_partkey > 1 AND p_size % 3 < 2 AND p_size / 50.0::DOUBLE >= 0.7), ad AS (SELECT DISTINCT l_orderkey AS doc, l_partkey // 2 AS standard FROM lineitem WHERE l_quantity > 25) SELECT c.doc, dst AS target, min(c.standard) AS standard, round(least(0.85, max(conf)), 6) AS confidence FROM c JOIN e ON c.standard = src WHERE NOT EXISTS (SELECT 1 FROM ad WHERE ad.doc = c.doc AND ad.standard = dst) GROUP BY 1, 2",
    "a21_certification_gaps": "WITH a AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 25 AS standard FROM lineitem WHERE l_partkey % 25 % 4 = 1), ev AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 25 AS standard FROM lineitem WHERE l_tax > 0.05) SELECT doc, string_agg(CAST(standard AS VARCHAR), ',' ORDER BY CAST(standard AS VARCHAR)) AS standards, count(*) AS n FROM a ANTI JOIN ev USING (doc, standard) GROUP BY 1",
    "a24_result_nonconformity": "WITH b AS (SELECT l_orderkey AS doc, l_suppkey % 2 AS parameter, l_quantity AS value, (o_custkey % 10)::DOUBLE AS low, (o_custkey % 30 + 15)::DOUBLE AS high FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey % 2 = o_custkey % 2), o AS (SELECT *, greatest(value - high, low - value) AS over FROM b) SELECT doc, parameter, value, any_value(CASE WHEN over / greatest(abs(CASE WHEN value > high THEN high ELSE low END), 1e-9) > 0.1 THEN 'high' WHEN over / greatest(abs(CASE WHEN value > high THEN high ELSE low END), 1e-9) <= 0.02 THEN 'low' ELSE 'medium' END) AS severity FROM o WHERE over > 1e-9 GROUP BY 1, 2, 3",
    "a27_verified_constraints": _CC + " SELECT doc, req, min(standard) AS standard FROM checks c WHERE overlap = 'none' AND NOT EXISTS (SELECT 1 FROM checks b WHERE b.doc = c.doc AND b.req = c.req AND b.overlap <> 'none') GROUP BY 1, 2",
    "a28_assemble_findings": _CC + f", {_CONF}, {VERSIONS}, u AS (SELECT doc, 'conflicting' AS kind, severity, concat_ws('/', 'c', req, parameter, standard) AS ord FROM conf UNION ALL SELECT DISTINCT doc, 'outdated', severity, concat_ws('/', 'v', req, standard) FROM ver WHERE rule IS NOT NULL) SELECT *, concat('f-', row_number() OVER (PARTITION BY doc ORDER BY kind = 'outdated', CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ord)) AS local_id FROM u",
    "a30_report_cap": _CC + f", {_CONF}, cap AS (SELECT doc, min(CASE severity WHEN 'high' THEN 40 WHEN 'medium' THEN 70 ELSE 90 END) AS cap FROM conf GROUP BY 1) SELECT o_orderkey AS doc, CAST(least(o_custkey % 101, coalesce(cap, 100)) AS INTEGER) AS score FROM orders LEFT JOIN cap ON o_orderkey = doc",
    "a31_repairs": _CC + " SELECT doc, req, parameter, concat('rated ', CAST(CASE WHEN side = 'above' THEN cmax ELSE cmin END AS BIGINT), ' units') AS repaired FROM (SELECT doc, req, parameter, side, trunc(cmax) AS cmax, trunc(cmin) AS cmin FROM checks WHERE overlap = 'disjoint' AND lo > 0)",
    "a32_rewrite_guard": "SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS ok, CASE WHEN p_partkey % 3 = 0 THEN 'numbers' WHEN p_partkey % 2 <> 0 THEN 'placeholders' END AS reason FROM part",
    "v1_text_match_candidates": "WITH tk AS (SELECT p_partkey, p_partkey // 100 AS doc, list_distinct(list_transform(string_split(lower(concat_ws(' ', p_name, p_type)), ' '), lambda w: CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) > 4 AND w NOT LIKE '%eed' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' AND w NOT LIKE '%is' THEN w[:-2] ELSE w END)) AS t FROM part), j AS (SELECT a.doc, a.p_partkey AS gid, b.p_partkey AS pid, len(a.t) AS n, len(b.t) AS m, len(list_intersect(a.t, b.t)) AS k FROM tk a JOIN tk b ON a.doc = b.doc) SELECT doc, gid, pid, round(k / (n + m - k), 6) AS jaccard FROM j WHERE k > 0 AND (k / (n + m - k) >= 0.6 OR k = least(n, m))",
    "v3_score_attributes": "WITH g AS (SELECT l_orderkey AS req, l_suppkey % 5 AS p, max(l_quantity) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), b AS (SELECT g.req, g.p, coalesce(bool_or(abs(v - l_quantity) <= abs(v) * 0.01), false) AS found, count(l_quantity) AS c FROM g LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber % 3 <> 0) l ON l_orderkey = req AND l_suppkey % 5 = p GROUP BY 1, 2) SELECT req, count(*) FILTER (found) AS tp, CAST(greatest(sum(c) - count(*) FILTER (found), 0) AS BIGINT) AS fp, count(*) FILTER (NOT found) AS fn FROM b GROUP BY 1",
    "v6_micro_prf": f"SELECT *, {_M} FROM (SELECT l_returnflag, CAST(sum(l_linenumber % 3) AS BIGINT) AS tp, CAST(sum(l_partkey % 2) AS BIGINT) AS fp, CAST(sum(l_suppkey % 2) AS BIGINT) AS fn FROM lineitem GROUP BY 1)",
    "v7_classification_metrics": "WITH p AS (SELECT CAST(quality AS VARCHAR) AS g, CASE WHEN length(text) > 600 THEN '1' WHEN length(text) > 200 THEN '0' ELSE '2' END AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT g AS label FROM p UNION SELECT p FROM p), c AS (SELECT label, count(*) FILTER (g = label AND p = label) AS tp, count(*) FILTER (g <> label AND p = label) AS fp, count(*) FILTER (g = label AND p <> label) AS fn FROM l, p GROUP BY 1) SELECT round((SELECT count(*) FILTER (g = p) / count(*) FROM p), 6) AS accuracy, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6)::DOUBLE AS macro_f1 FROM c",
    "v8_mean_fields": f"WITH {VALUES} SELECT round(sum(coalesce(lo, 0)) / count(*), 5) AS lo, round(sum(coalesce(hi, 0)) / count(*), 5) AS hi FROM vals",
    "v9_bootstrap_ci": _BOOT.replace("{0}", "p_retailprice"),
    "v10_paired_bootstrap": _BOOT.replace("{0}", "p_size - p_retailprice"),
    "v11_retrieval_metrics": "WITH h AS (SELECT l_orderkey AS qid, l_partkey AS did, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey AS qid, l_partkey AS did, max(l_suppkey) % 3 + max(l_linenumber) % 3 AS grade FROM lineitem GROUP BY 1, 2), j AS (SELECT g.*, rank, pow(2, grade) - 1 AS gain, row_number() OVER (PARTITION BY g.qid ORDER BY grade DESC) AS i FROM g LEFT JOIN h ON g.qid = h.qid AND g.did = h.did), b AS (SELECT qid, min(CASE WHEN grade >= 2 THEN rank END) AS first, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN gain / log2(i + 1) ELSE 0 END) AS ideal FROM j GROUP BY 1) SELECT round(avg(coalesce((first <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((first <= 3)::INT, 0)), 6) AS recall_3, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg_5 FROM b",
    "v14_multiset_prf": f"WITH g AS (SELECT l_partkey % 500 AS k, l_returnflag, count(*) AS g FROM lineitem GROUP BY 1, 2), p AS (SELECT l_suppkey * 3 % 500 AS k, l_returnflag, count(*) AS p FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2), b AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (k, l_returnflag)), x AS (SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM b) SELECT tp, fp, fn, {_M} FROM x",
    "v16_mapping_accuracy": "SELECT count(*) FILTER (l_partkey % 7 = l_suppkey % 7) / nullif(count(*), 0) AS accuracy, count(*) AS n FROM lineitem WHERE l_tax > 0.02",
    "v18_compare_runs": "SELECT CASE WHEN a.i IS NULL THEN 'new' WHEN b.i IS NULL THEN 'removed' WHEN a.ok = b.ok THEN 'same' WHEN b.ok THEN 'gained' ELSE 'lost' END AS flip, count(*) AS items FROM (SELECT o_orderkey AS i, o_custkey % 5 < 2 AS ok FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS i, o_custkey % 7 < 2 AS ok FROM orders WHERE o_orderkey % 7 <> 0) b ON a.i = b.i GROUP BY 1",
    "v20_training_set": "WITH n AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS norm, min(doc_id) AS id FROM documents GROUP BY 1) SELECT id, CAST('0x' || substr(md5(norm), 1, 8) AS BIGINT) % 100 < 20 AS held_out FROM n",
    "v21_tune_gate": "SELECT round(t / 20.0::DOUBLE, 4) AS threshold, round(avg((CASE WHEN l_discount * 10 >= t / 20.0::DOUBLE THEN l_suppkey & 3 ELSE l_linenumber % 4 END = l_partkey & 3)::INT), 6) AS accuracy FROM lineitem, range(21) r(t) GROUP BY t",
    "v22_quality_gate": "SELECT dataset, 'f1' AS metric, value, 0.05::DOUBLE AS floor FROM (SELECT l_suppkey AS dataset, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1) WHERE value < 0.05",
}

SQL |= FURTHER_SQL

#: Golds one after the other, each with the list of predictions taken before.
SQL["v2_greedy_match"] = f"""WITH RECURSIVE c AS ({SQL["v1_text_match_candidates"]}),
  g AS (SELECT doc, gid, list_sort(list(pid)) AS ps, row_number() OVER (PARTITION BY doc ORDER BY gid) AS n FROM c GROUP BY doc, gid),
  m(doc, n, used, gid, pid) AS (
    SELECT DISTINCT doc, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM g
    UNION ALL
    SELECT doc, n, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, gid, p
    FROM (SELECT m.doc, g.n, m.used, g.gid, list_filter(g.ps, lambda x: NOT list_contains(m.used, x))[1] AS p FROM m JOIN g ON g.doc = m.doc AND g.n = m.n + 1))
  SELECT doc, gid AS gold, pid AS predicted FROM m WHERE pid IS NOT NULL"""
