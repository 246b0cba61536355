"""Tables, attributes, report rules, retrieval features, evidence graphs and evaluation over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausemill.functions.scratch import Dealt, each_text, keep
from clausemill.operators import attributes as at
from clausemill.operators import evaluation as e
from clausemill.operators import facts as x
from clausemill.operators import graph as g
from clausemill.operators import knowledge as k
from clausemill.operators import models as m
from clausemill.operators import quantities as q
from clausemill.operators import refine as r
from clausemill.operators import reports as rp
from clausemill.operators import retrieval as rt
from clausemill.operators import rules as r_
from clausemill.operators import tables as tb
from clausemill.plans import facts as pf
from clausemill.plans import graph as pg
from clausemill.plans.tables import read

KEYS = ["doc", "line"]


def pick(values: list[str | None], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str | None], by: str) -> str:
    return f"{_sql_list(values)}[CAST({by} % {len(values)} + 1 AS INTEGER)]"


def _rows(s, d):
    """One row an order and line number: doc, line, part, supp, qty."""
    return _grouped(read(s, d, "lineitem"))


def _grouped(items):
    return items.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_quantity").cast("int").alias("qty"), F.min("l_tax").alias("tax"), F.min("l_discount").alias("discount"))


def _rows_by_doc(s, d):
    """_rows(), shuffled once and kept in buckets by document: what goes on by document stays where it is."""
    items = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    return Dealt(_grouped(items.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")), ["doc"], placed=True).table()


ROWS = "rows_ AS (SELECT l_orderkey AS doc, l_linenumber AS line, min(l_partkey) AS part, min(l_suppkey) AS supp, CAST(min(l_quantity) AS INTEGER) AS qty, min(l_tax) AS tax, min(l_discount) AS discount FROM lineitem GROUP BY 1, 2)"

HEADERS = ["Sl. No. | Particulars | Unit | Offered", "Parameter | Unit | Result | Acceptable limit", "Test | Requirement | Observed | Result"]


def _table_lines(s, d):
    rows = _rows(s, d)
    form = F.col("doc") % 3
    cells = F.when(form == 0, F.concat_ws(" | ", "line", F.concat(F.lit("Item p"), "part"), F.lit("kVA"), "qty")).when(form == 1, F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.lit("Turbidity "), "part"), F.lit("NTU"), "qty", "line"), F.lit(" |"))).otherwise(F.concat_ws(" | ", F.concat(F.lit("Test "), "part"), F.concat(F.lit("Min "), "line", F.lit(" V")), F.concat("qty", F.lit(" V")), F.when(F.col("supp") % 2 == 0, "Pass").otherwise("Fail")))
    body = rows.select("doc", F.col("line").alias("line_no"), cells.alias("line"))
    docs = rows.select("doc").distinct()
    heads = docs.select("doc", F.lit(0).alias("line_no"), pick(HEADERS, form).alias("line"))
    notes = docs.select("doc", F.lit(100).alias("line_no"), F.concat(F.lit("Notes on "), "doc").alias("line"))
    return heads.unionByName(body.withColumn("line_no", F.col("line_no").cast("int"))).unionByName(notes)


HEADINGS = ["General Conditions of Contract", "Technical requirements", "Approved Makes"]
ZONED = ["Earnest money is due", "Rating to be furnished by the bidder", "a | b | c | d", "The pump shall run"]
TYPES = ["specification", "Tender", " boq ", "datasheet", "test_report", "inspection_report", "other", "unheard of", None]
BEFORE = ["Insulation tested. It shall withstand ", "rated voltage of ", "the insulation resistance is ", "a temperature rise of ", "losses of ", "carries "]
DIMENSIONS = ["voltage", "resistance", "temperature", "power", "current"]
CUED = ["The measured value is ", "limit not more than ", "observed against the limit of ", "the specified and the recorded ", "plain "]
REPORTS = ["The sample failed in turbidity", "All tests passed", "Rated voltage does not comply", "Found unsatisfactory", "It exceeds the permissible"]

#: Choices that sentences are built from, by columns of the parts.
INSULATION, EXPOSURE, EARTHING = ["B", "F", "H"], ["mild", "moderate", "severe", "very severe", "extreme"], ["TN-S", "TN-C", "TT", "IT"]
CEMENT, GRADE, CONDUCTOR, SHEATH, GERM = ["OPC", "PPC", "PSC"], ["33", "43", "53"], ["copper", "aluminium"], ["XLPE", "PVC"], ["total", "thermotolerant"]
#: The eight forms of a sentence: terms, category (germs without a star rating are a matter of quality).
FORMS = [("induction motor", "electrical"), ("concrete,cement", "material"), ("earthing", "safety"), ("cable", "material"), ("", "performance"), ("", "environmental"), ("submersible pump,pump,induction motor", "performance"), ("", "electrical")]


def _sentences(s, d):
    """A sentence a part: its form by key, its values, classes, grades and references by key and size; some pieces are only there for some sizes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    when = lambda condition, *parts: F.when(condition, F.concat(*parts)).otherwise("")
    lit = F.lit
    forms = [
        F.concat(lit("Motors of "), 100 + size, lit(" V with class "), pick(INSULATION, key), lit(" insulation, IE"), size % 5 + 1, when(key % 3 != 0, lit(", duty S"), key % 9 + 1), when(size % 2 == 0, lit(", IP"), 54 + size % 3), when(size % 3 == 0, lit(", to IS "), 100 + key % 400), lit(".")),
        F.concat(lit("Exposure shall be taken as "), pick(EXPOSURE, size), lit("; concrete M "), 20 + 5 * (key % 5), lit(" with "), pick(CEMENT, size), when(key % 3 != 0, lit(" "), pick(GRADE, key), lit(" grade")), lit(" cement")),
        F.concat(lit("The earthing arrangement of the supply is "), pick(EARTHING, size)),
        F.concat(lit("Cables of "), pick(CONDUCTOR, size), lit(" conductor "), pick(SHEATH, key + size), lit(" insulated shall be tested to IS "), 7000 + size, when(size % 3 == 0, lit(" (Part "), key % 4 + 1, lit(")"))),
        F.concat(pick(GERM, size), lit(" coliforms shall be absent"), when(key % 3 != 0, lit("; "), key % 5 + 1, lit(" star rated"))),
        F.concat(lit("Suitable enclosure with dust protection of item "), key),
        F.concat(lit("Submersible pump with flow "), 5 + size, lit(" l/s and 3 phase motor"), when(key % 3 != 0, lit(" at total head "), 10 + size, lit(" m"))),
        F.concat(lit("Fault current "), 10 + size, lit(" kA for 1 s"), when(key % 3 != 0, lit(" at "), 1 + size, lit(" kV power frequency withstand"))),
    ]
    text = F.when(key % 8 == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        text = text.when(key % 8 == i, form)
    # Behind an explode, so that the text is made once and not again wherever it is read.
    return read(s, d, "part").select(key.alias("key"), F.explode(F.array(text)).alias("text"))


def _sql_pick(items: list[str], by: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + f"][CAST(({by}) % {len(items)} + 1 AS INTEGER)]"


#: What the pieces of a sentence state: its form, when the piece is there, parameter ('?' for a bare mention), the wording's value.
STATED = [
    (0, "true", "?insulation_material", None),
    (0, "true", "rated_voltage", None),
    (0, "true", "insulation_class", "'Class ' || " + _sql_pick(INSULATION, "k")),
    (0, "true", "efficiency_class", "'IE' || (z % 5 + 1)"),
    (0, "k % 3 <> 0", "duty_type", "'S' || (k % 9 + 1)"),
    (0, "z % 2 = 0", "ip_rating", None),
    (1, "true", "exposure_condition", _sql_pick(EXPOSURE, "z")),
    (1, "true", "concrete_grade", None),
    (1, "true", "cement_type", _sql_pick(CEMENT, "z") + " || CASE WHEN k % 3 <> 0 THEN ' ' || " + _sql_pick(GRADE, "k") + " || ' grade' ELSE '' END"),
    (2, "true", "earthing_system", _sql_pick(EARTHING, "z")),
    (3, "true", "conductor_material", None),
    (3, "true", "insulation_material", None),
    (3, "true", "test_method", None),
    (4, "true", "bacteriological_quality", _sql_pick(GERM, "z") + " || ' coliforms not detectable'"),
    (4, "k % 3 <> 0", "efficiency_class", "(k % 5 + 1) || ' star'"),
    (5, "true", "?ip_rating", None),
    (6, "true", "flow_rate", None),
    (6, "k % 3 <> 0", "pump_head", None),
    (7, "true", "short_circuit_rating", None),
    (7, "k % 3 <> 0", "rated_voltage", None),
]
_PARTS = "p AS (SELECT p_partkey AS k, p_size AS z FROM part)"
_STATED = "st AS (" + " UNION ALL ".join(f"SELECT k, '{name}' AS parameter, {value or 'NULL'} AS value FROM p WHERE k % 8 = {form} AND {there}" for form, there, name, value in STATED) + ")"
_CITED = "CASE WHEN k % 8 = 0 AND z % 3 = 0 THEN 'IS ' || (100 + k % 400) WHEN k % 8 = 3 THEN 'IS ' || (7000 + z) || CASE WHEN z % 3 = 0 THEN ' (Part ' || (k % 4 + 1) || ')' ELSE '' END ELSE '' END"


def _listed(condition: str, name: str) -> str:
    return f"WITH {_PARTS}, {_STATED} SELECT k AS key, coalesce(string_agg(parameter, ',' ORDER BY parameter) FILTER ({condition}), '') AS {name} FROM p LEFT JOIN st USING (k) GROUP BY 1"


def _fragments(s, d):
    return at.structure_fragments(_sentences(s, d), ["key"], "text")


def _interval_text(s, d):
    n = F.col("qty")
    form = F.col("part") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("Supply of "), n, F.lit(" to "), n + 10, F.lit(" kV here")))
        .when(form == 1, F.concat(F.lit("Supply "), n, F.lit(" V ± 10 % only")))
        .when(form == 2, F.concat(F.lit("Length "), n, F.lit(" mm ± 2 mm only")))
        .when(form == 3, F.concat(F.lit("Output at least "), n, F.lit(" Kilowatts")))
        .when(form == 4, F.concat(F.lit("pH 6."), F.col("line"), F.lit(" to 8.5 and w/c ratio not exceeding 0."), n + 40, F.lit(", ambient from "), n, F.lit(" °C or more")))
        .otherwise(F.concat(F.lit("Odd 1 V to "), n, F.lit(" A; then "), n, F.lit("-0 mm and IP55")))
    )
    # Kept, as each_text() reads the rows twice: grouped and shuffled once.
    return keep(_rows(s, d).select(*KEYS, "part", "qty")).select(*KEYS, "part", text.alias("text"))


def _intervals(s, d):
    return each_text(_interval_text(s, d), "text", lambda texts, key: q.all_quantities(texts, [key], "text"))


def _variations(s, d):
    return each_text(_interval_text(s, d), "text", lambda texts, key: q.derive_variation(x.infer_parameter(q.all_quantities(texts, [key], "text"), [key], "text")))


INTERVALS = f"""{ROWS}, qs AS (
    SELECT doc, line, part, 0 AS q_no, 'V' AS unit, 'range' AS comparator, NULL::DOUBLE AS value, qty * 1000.0 AS lo, (qty + 10) * 1000.0 AS hi, NULL::DOUBLE AS tolerance FROM rows_ WHERE part % 6 = 0
    UNION ALL SELECT doc, line, part, 0, 'V', 'tolerance', qty, qty * 0.9, qty * 1.1, 0.1 FROM rows_ WHERE part % 6 = 1
    UNION ALL SELECT doc, line, part, 0, 'mm', 'tolerance', qty, qty - 2, qty + 2, 2.0 / qty FROM rows_ WHERE part % 6 = 2
    UNION ALL SELECT doc, line, part, 0, 'W', 'min', qty * 1000.0, qty * 1000.0, NULL, NULL FROM rows_ WHERE part % 6 = 3
    UNION ALL SELECT doc, line, part, 0, 'pH', 'range', NULL, 6 + line / 10.0, 8.5, NULL FROM rows_ WHERE part % 6 = 4
    UNION ALL SELECT doc, line, part, 1, 'ratio', 'max', (qty + 40) / 100.0, NULL, (qty + 40) / 100.0, NULL FROM rows_ WHERE part % 6 = 4 AND qty < 60
    UNION ALL SELECT doc, line, part, 2, 'degC', 'eq', qty, qty, qty, NULL FROM rows_ WHERE part % 6 = 4 AND qty < 60
    UNION ALL SELECT doc, line, part, 0, 'mm', 'eq', 0, 0, 0, NULL FROM rows_ WHERE FALSE)"""


def _hits(rows):
    hits = rows.groupBy(F.col("doc").alias("qid"), F.col("part").alias("did")).agg(F.max("qty").cast("double").alias("score"), F.max("tax").alias("tax"), F.max("discount").alias("discount"))
    return hits.withColumn("standard", F.floor(F.col("did") / 4).cast("long"))


def _word(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("part"), F.element_at(F.split("p_name", " "), 2).alias("term"))


def _features(s, d, rows=None):
    rows = _rows_by_doc(s, d) if rows is None else rows
    hits, words = _hits(rows), _word(s, d)
    clauses = read(s, d, "part").select(F.col("p_partkey").alias("did"), F.floor(F.col("p_partkey") / 4).cast("long").alias("standard"), F.concat(F.lit("p_"), F.col("p_size") % 5).alias("parameter"))
    terms = lambda n: rows.where(F.col("line") == n).join(words, "part").select(F.col("doc").alias("qid"), "term").distinct()
    products = words.select(F.floor(F.col("part") / 4).cast("long").alias("standard"), "term").distinct()
    parameters = rows.select(F.col("doc").alias("qid"), F.concat(F.lit("p_"), F.col("supp") % 5).alias("parameter")).distinct()
    return rt.rerank_features(hits.select("qid", "did", "standard", "score"), parameters, clauses, terms(1), terms(2), products, hits.where("tax >= 0.07"), hits.where("tax < 0.02"))


FEATURES = f"""{ROWS}, h AS (SELECT doc AS qid, part AS did, part // 4 AS standard, CAST(max(qty) AS DOUBLE) AS score, max(tax) AS tax, max(discount) AS discount FROM rows_ GROUP BY 1, 2),
    w AS (SELECT p_partkey AS part, string_split(p_name, ' ')[2] AS term FROM part), pr AS (SELECT DISTINCT part // 4 AS standard, term FROM w),
    pa AS (SELECT DISTINCT doc AS qid, concat('p_', supp % 5) AS parameter FROM rows_), cl AS (SELECT p_partkey AS did, p_partkey // 4 AS standard, concat('p_', p_size % 5) AS parameter FROM part),
    tm AS (SELECT DISTINCT doc AS qid, line, term FROM rows_ JOIN w USING (part) WHERE line IN (1, 2)),
    f AS (SELECT h.*, score / greatest(max(score) OVER (PARTITION BY h.qid), 1e-12) AS bm25, cp.governed, sp.qid IS NOT NULL AS wide, p1.term AS product_term, p2.qid IS NOT NULL AS ctx, ex.qid IS NOT NULL AS explicit, ci.qid IS NOT NULL AS cited
      FROM h LEFT JOIN (SELECT qid, did, string_agg(DISTINCT parameter, ',' ORDER BY parameter) AS governed FROM pa JOIN cl USING (parameter) GROUP BY 1, 2) cp USING (qid, did)
      LEFT JOIN (SELECT DISTINCT qid, standard FROM pa JOIN cl USING (parameter)) sp USING (qid, standard)
      LEFT JOIN (SELECT qid, standard, min(term) AS term FROM tm JOIN pr USING (term) WHERE line = 1 GROUP BY 1, 2) p1 USING (qid, standard)
      LEFT JOIN (SELECT DISTINCT qid, standard FROM tm JOIN pr USING (term) WHERE line = 2) p2 USING (qid, standard)
      LEFT JOIN (SELECT DISTINCT qid, standard FROM h WHERE tax >= 0.07) ex USING (qid, standard) LEFT JOIN (SELECT DISTINCT qid, standard FROM h WHERE tax < 0.02) ci USING (qid, standard)),
    ft AS (SELECT qid, did, standard, bm25, least(1, bm25 / 0.75) * (governed IS NOT NULL)::INT AS clause_parameter, least(1, bm25 / 0.75) * wide::INT AS standard_parameter, (product_term IS NOT NULL)::INT::DOUBLE AS product, ctx::INT::DOUBLE AS context_product, (NOT explicit AND cited)::INT::DOUBLE AS document_cited, explicit, coalesce(governed, '') AS governed, product_term FROM f)"""


def _scored(s, d):
    standards = read(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 4).cast("long").alias("standard")).agg(F.when(F.min("p_size") % 3 == 0, "superseded").otherwise("current").alias("status"), F.when(F.max("p_size") % 2 == 0, "test_method").otherwise("product").alias("kind"))
    queries = read(s, d, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % 3 == 0).alias("testing"), (F.col("o_custkey") % 2 == 0).alias("known_products"))
    rows = _rows_by_doc(s, d)
    return rt.rerank_full(_features(s, d, rows), standards, queries, _hits(rows).where("discount >= 0.09"))


SCORED = f"""{FEATURES}, st AS (SELECT p_partkey // 4 AS standard, min(p_size) % 3 = 0 AS old, max(p_size) % 2 = 0 AS test FROM part GROUP BY 1), ri AS (SELECT DISTINCT qid, standard FROM h WHERE discount >= 0.09),
    j AS (SELECT ft.*, old, test, coalesce(o_orderkey % 3 = 0, false) AS testing, coalesce(o_custkey % 2 = 0, false) AS known, ri.qid IS NOT NULL AS rival,
      (0.45 * bm25 + 0.2 * clause_parameter + 0.1 * standard_parameter + 0.2 * product + 0.08 * context_product + 0.12 * document_cited) / 1.15::DOUBLE + 0.6 * explicit::INT AS r0
      FROM ft LEFT JOIN st USING (standard) LEFT JOIN orders ON qid = o_orderkey LEFT JOIN ri USING (qid, standard)),
    k1 AS (SELECT *, CASE WHEN NOT explicit AND old THEN r0 * 0.5 ELSE r0 END AS r1 FROM j), k2 AS (SELECT *, CASE WHEN NOT explicit AND test AND NOT testing THEN r1 * 0.6 WHEN NOT explicit AND test AND testing THEN r1 + 0.08 ELSE r1 END AS r2 FROM k1),
    k3 AS (SELECT *, CASE WHEN NOT explicit AND document_cited = 0 AND rival THEN r2 * 0.75 ELSE r2 END AS r3 FROM k2), k4 AS (SELECT *, CASE WHEN NOT explicit AND product = 0 AND context_product = 0 AND document_cited = 0 AND known THEN r3 * 0.6 ELSE r3 END AS raw FROM k3)"""


def _explained(s, d):
    hits = _features(s, d).withColumn("number", F.concat(F.lit("IS "), "standard")).withColumn("heading", F.concat(F.lit("Clause "), "did")).withColumn("matched", F.when(F.col("did") % 2 == 0, F.array(F.lit("cable"), F.lit("rated"), F.lit("volt"), F.lit("core"))).otherwise(F.array().cast("array<string>")))
    return rt.explain_hits(hits)


def _search_documents(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("did"), F.col("source").alias("standard"), F.col("lang").alias("domain"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"))


def _mined(s, d):
    relations = k.extract_relations(pf._cite_text(s, d), pf._citations(s, d)).select(F.col("key").alias("clause"), "c_no", F.col("key").alias("source"), "type", "confidence")
    resolved = pf._resolved(s, d).select(F.split("cid", "/")[0].cast("long").alias("clause"), F.split("cid", "/")[1].cast("int").alias("c_no"), "sid", "confidence")
    return rt.mine_edges(relations, resolved, pf._standards(s, d))


MINED = f"""rel AS ({pf.SQL["r21_extract_relations"]}), res AS ({pf.SQL["r2_resolve_citations"]}), old AS (SELECT p_partkey AS sid FROM part WHERE p_size % 4 = 0),
    mi AS (SELECT type, CASE WHEN type = 'SUPERSEDES' AND key IN (SELECT sid FROM old) THEN sid ELSE key END AS src, CASE WHEN type = 'SUPERSEDES' AND key IN (SELECT sid FROM old) THEN key ELSE sid END AS dst, key AS clause, c_no, rel.confidence * res.confidence AS confidence FROM rel JOIN res ON res.cid = concat_ws('/', key, c_no) WHERE sid IS NOT NULL AND sid <> key),
    mined AS (SELECT type, src, dst, min(clause) AS clause, arg_min(confidence, clause * 1000 + c_no) AS confidence FROM mi GROUP BY 1, 2, 3)"""


def _curated(s, d):
    return read(s, d, "part").select(pick(["REQUIRES", "TESTED_BY", "SUPERSEDES", "REFERENCES"], F.col("p_partkey")).alias("type"), F.col("p_partkey").alias("src"), F.expr("p_partkey * 7 % 400 + 1").alias("dst"), (F.col("p_size") % 2 == 0).alias("supported"))


def _evidence(s, d):
    rows = _rows(s, d)
    mappings = rows.select("doc", F.col("line").alias("req"), F.col("part").alias("clause"), F.col("discount").alias("confidence"))
    clauses = read(s, d, "part").select(F.col("p_partkey").alias("clause"), F.floor(F.col("p_partkey") / 4).cast("long").alias("standard"))
    applicable = rows.where("qty > 30").select("doc", F.floor(F.col("part") / 4).cast("long").alias("standard")).distinct()
    edges = read(s, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"), pick(["REQUIRES", "SUPERSEDES", "REFERENCES"], F.col("p_size")).alias("type"), (F.col("p_size") / 50).alias("confidence"))
    schemes = read(s, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("standard"), F.lit("ISI").alias("scheme"))
    return rt.evidence_graph(mappings, clauses, applicable, edges, schemes)


EVIDENCE = f"""{ROWS}, mp AS (SELECT doc, line AS req, part AS clause, discount AS confidence FROM rows_ JOIN part ON part = p_partkey), ap AS (SELECT DISTINCT doc, part // 4 AS standard FROM rows_ WHERE qty > 30),
    ed AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, ['REQUIRES', 'SUPERSEDES', 'REFERENCES'][CAST(p_size % 3 + 1 AS INTEGER)] AS type, p_size / 50.0::DOUBLE AS confidence FROM part WHERE p_partkey > 1),
    f1 AS (SELECT doc, src, dst, type, confidence FROM ap JOIN ed ON standard = src WHERE type = 'REQUIRES'), f2 AS (SELECT DISTINCT f1.doc, ed.src, ed.dst, ed.type, ed.confidence FROM f1 JOIN ed ON f1.dst = ed.src WHERE ed.type = 'REQUIRES'),
    ev AS (SELECT doc, type, src, dst, max(confidence)::DOUBLE AS confidence FROM (SELECT doc, 'MAPS_TO' AS type, concat('req:', req) AS src, concat('clause:', clause) AS dst, confidence FROM mp UNION ALL SELECT doc, 'HAS_CLAUSE', concat('std:', clause // 4), concat('clause:', clause), 1.0 FROM mp
      UNION ALL SELECT doc, type, concat('std:', src), concat('std:', dst), confidence FROM f1 UNION ALL SELECT doc, type, concat('std:', src), concat('std:', dst), confidence FROM f2
      UNION ALL SELECT doc, type, concat('std:', src), concat('std:', dst), confidence FROM ap JOIN ed ON standard = src WHERE type <> 'REQUIRES' UNION ALL SELECT doc, type, concat('std:', src), concat('std:', dst), confidence FROM ap JOIN ed ON standard = dst WHERE type = 'SUPERSEDES'
      UNION ALL SELECT doc, 'CERTIFIED_BY', concat('std:', standard), concat('cert:', standard), 0.8 FROM ap JOIN part ON p_partkey = standard WHERE standard % 5 = 0) GROUP BY 1, 2, 3, 4)"""


def _routing(s, d):
    rows = _rows(s, d).withColumn("req", F.col("line")).withColumn("parameter", F.concat(F.lit("p"), F.col("supp") % 3))
    roles = rp.role_of_documents(_rows(s, d).select("doc").distinct().select("doc", pick(TYPES, F.col("doc")).alias("type")))
    of = lambda condition, rule: rows.where(condition).select("doc", "req", "parameter", F.lit(rule).alias("rule"))
    return rp.report_routing(roles, of("qty % 2 = 0", "constraint_conflict"), of("qty % 3 = 0", "result_nonconformity"), of("qty % 5 = 0", "internal_inconsistency"), of("qty % 7 = 0", "checklist_gap"))


def _attributes(s, d):
    return _rows(s, d).select("doc", F.col("line").alias("req"), pick(["rated_voltage", "turbidity", "frequency", "pump_head"], F.col("supp")).alias("parameter"))


def _scoped(s, d):
    rows = _rows(s, d)
    governed = rows.where("qty % 2 = 0").select("doc", F.col("part").alias("standard"), F.col("line").alias("req"))
    family = read(s, d, "part").select(F.col("p_partkey").alias("standard"), (F.col("p_partkey") + 1).alias("relative"))
    uncited = rows.where("qty % 11 = 0").select("doc", (F.col("part") + 2).alias("standard"), F.col("line").alias("req"))
    return rp.scoped_attributes(_attributes(s, d), governed, family, uncited)


def _vague(s, d):
    rows = _rows(s, d).withColumn("req", F.col("line"))
    return rp.vague_findings(rows.select("doc", "req", (F.col("qty") % 3 == 0).alias("vague")), rows.where("qty % 2 = 0").select("doc", "req"), rows.select("doc", "req", F.col("part").alias("standard"), (F.col("discount") * 10).alias("confidence")))


def _reported(s, d):
    rows = _rows(s, d).select("doc", F.col("line").alias("req"), pick(REPORTS, F.col("part")).alias("text"), "supp", "qty")
    attributes = rows.select("doc", "req", pick(["turbidity", "rated_voltage", "ph"], F.col("supp")).alias("parameter"))
    flagged = rows.where("qty > 40").select("doc", pick(["turbidity", "rated_voltage", "ph"], F.col("qty")).alias("parameter")).distinct()
    return rp.reported_nonconformity(rows.select("doc", "req", "text"), attributes, flagged, s.createDataFrame([("turbidity", "Turbidity"), ("rated_voltage", "rated voltage")], "parameter string, cue string"))


def _golds(s, d):
    rows = _rows(s, d).withColumn("grp", pick(["conflict", "gap"], F.col("supp")))
    specific = F.col("line") % 2 == 0
    gold = rows.select("doc", F.col("line").alias("gid"), "grp", F.when(specific, F.col("part") % 3).alias("standard"), F.when(specific, F.concat(F.lit("p"), F.col("supp") % 2)).alias("parameter"), F.concat(F.lit("gold "), "part").alias("text"))
    predicted = rows.where("qty > 10").select("doc", (F.col("line") + 100).alias("pid"), "grp", (F.col("qty") % 3).cast("long").alias("standard"), F.concat(F.lit("p"), F.col("supp") % 2).alias("parameter"), F.concat(F.lit("found "), "part").alias("text"))
    return gold, predicted


MATCHED = f"""{ROWS}, gr AS (SELECT doc, line AS gid, CASE supp % 2 WHEN 0 THEN 'conflict' ELSE 'gap' END AS grp, CASE WHEN line % 2 = 0 THEN part % 3 END AS standard, CASE WHEN line % 2 = 0 THEN concat('p', supp % 2) END AS parameter, concat('gold ', part) AS text FROM rows_),
    pr AS (SELECT doc, line + 100 AS pid, CASE supp % 2 WHEN 0 THEN 'conflict' ELSE 'gap' END AS grp, qty % 3 AS standard, concat('p', supp % 2) AS parameter, concat('found ', part) AS text FROM rows_ WHERE qty > 10),
    a AS (SELECT g.doc, gid, pid FROM (SELECT *, row_number() OVER (PARTITION BY doc, grp, standard, parameter ORDER BY gid) AS n FROM gr WHERE standard IS NOT NULL) g JOIN (SELECT *, row_number() OVER (PARTITION BY doc, grp, standard, parameter ORDER BY pid) AS n FROM pr) p USING (doc, grp, standard, parameter, n)),
    b AS (SELECT g.doc, gid, pid FROM (SELECT *, row_number() OVER (PARTITION BY doc, grp ORDER BY gid) AS n FROM gr WHERE standard IS NULL) g JOIN (SELECT *, row_number() OVER (PARTITION BY doc, grp ORDER BY pid) AS n FROM pr ANTI JOIN a USING (doc, pid)) p USING (doc, grp, n)),
    mt AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def _list_text(c: str) -> Column:
    return F.array_join(c, ";").alias(c)


RULES = ["constraint_conflict", "checklist_gap", "dependency_gap", "superseded_edition", "conformity_evidence_missing", "vague_requirement", "newer_edition"]


def _repairable(s, d):
    rows = _rows(s, d)
    rule = pick(RULES, F.col("part"))
    text = F.when(rule == "superseded_edition", F.concat(F.lit("Cables to IS "), "line", F.lit(":1990 and IS "), "line", F.lit(":1990."))).otherwise(F.concat(F.lit("Rated "), "qty", F.lit(" V,  or "), "qty", F.lit(" V.")))
    raw = F.when(rule == "superseded_edition", F.concat(F.lit("IS "), "line", F.lit(":1990"))).otherwise(F.concat("qty", F.lit(" V")))
    number = F.when((rule != "vague_requirement") | (F.col("supp") % 2 == 0), F.concat(F.lit("IS "), "part"))
    return rows.select(*KEYS, rule.alias("rule"), text.alias("text"), raw.alias("raw"), F.concat(F.col("supp"), F.lit(" kV")).alias("target"), number.alias("number"), F.lit("State it per {standard}.").alias("template"), (F.col("qty") % 2 == 0).alias("is_test"), F.when(F.col("supp") % 3 == 0, "IS 9").alias("companions"), F.lit("Limits").alias("heading"))


def _doubted(s, d):
    rows = _rows(s, d)
    hits = rows.select("doc", F.col("line").alias("req"), F.col("part").alias("standard"), F.col("discount").alias("confidence")).union(rows.select("doc", "line", F.col("part") + 1, F.col("discount") - F.when(F.col("supp") % 2 == 0, 0.1).otherwise(0.3)))
    checks = hits.select("doc", "req", "standard", F.lit("p").alias("parameter"), F.when(F.col("standard") % 3 == 0, "none").when(F.col("standard") % 3 == 1, "partial").otherwise("disjoint").alias("overlap"))
    return r_.drop_ambiguous(checks, hits, rows.where("qty % 4 = 0").select("doc", F.col("line").alias("req"), F.col("part").alias("standard")))


QUERIES = {
    "a7_drop_ambiguous": _doubted,
    "a31_repair_texts": lambda s, d: r_.repair_texts(_repairable(s, d)).where("recommended is not null").select(*KEYS, "rule", "recommended"),
    "a32_guard_citations": lambda s, d: r_.rewrite_guard(read(s, d, "part").select("p_partkey", F.concat(F.lit("As per IS "), "p_size", F.lit(".")).alias("original"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "To IS ").otherwise("To clause "), "p_size").alias("rewrite"))).select("p_partkey", "ok", "reason"),
    "t5_linearize_tables": lambda s, d: tb.linearize_tables(_table_lines(s, d)),
    "t12_drop_headings": lambda s, d: rp.drop_headings(r.lines(read(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc").withColumnRenamed("line", "segment"), r.detect_sections(r.lines(read(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc"))).select("doc", "start", "segment"),
    "t13_zone_filter": lambda s, d: rp.zone_filter(_rows(s, d).select(*KEYS, pick(ZONED, F.col("part")).alias("segment"), pick(HEADINGS, F.col("supp")).alias("heading"))),
    "t18_role_of_documents": lambda s, d: rp.role_of_documents(read(s, d, "orders").select(F.col("o_orderkey").alias("doc"), pick(TYPES, F.col("o_orderkey")).alias("type"))),
    "x1_intervals": lambda s, d: _intervals(s, d).where("part % 6 <> 5").select(*KEYS, "q_no", "unit", "comparator", *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi", "tolerance")]),
    "x5_special_quantities": lambda s, d: q.special_quantities(_interval_text(s, d), KEYS, "text").select(*KEYS, "unit", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")),
    "x7_report_guards": lambda s, d: rp.report_guards(_rows(s, d).select(*KEYS, pick(DIMENSIONS, F.col("supp")).alias("dimension"), F.lit("given").alias("parameter"), pick(BEFORE, F.col("part")).alias("before"), F.when(F.col("qty") % 2 == 0, " rms for 3 s").otherwise(" in all").alias("after"))).select(*KEYS, "dimension", "parameter"),
    "x8_derive_variation": lambda s, d: _variations(s, d).select(*KEYS, "parameter", "value"),
    "x11_text_parameters": lambda s, d: at.extract_text_parameters(_sentences(s, d), ["key"], "text"),
    "x13_build_attributes": lambda s, d: _fragments(s, d).select("key", F.array_join(F.filter("parameters", lambda p: ~p.startswith("?")), ",").alias("parameters")),
    "x14_unvalued_mentions": lambda s, d: _fragments(s, d).select("key", F.array_join(F.filter("parameters", lambda p: p.startswith("?")), ",").alias("mentions")),
    "x17_symbolic_features": lambda s, d: m.symbolic_features(_sentences(s, d), ["key"], "text"),
    "x22_structure_fragments": lambda s, d: _fragments(s, d).select("key", F.array_join("terms", ",").alias("terms"), "category", F.array_join("references", ",").alias("references")),
    "r11_rerank_features": lambda s, d: _features(s, d).select("qid", "did", "standard", *[F.round(c, 6).alias(c) for c in ("bm25", "clause_parameter", "standard_parameter", "product", "context_product", "document_cited")], "explicit", F.array_join("governed", ",").alias("governed"), "product_term"),
    "r12_rerank_full": lambda s, d: _scored(s, d).select("qid", "did", F.round("raw", 6).alias("raw"), F.round("confidence", 6).alias("confidence")),
    "r18_explain_hits": _explained,
    "r19_search": lambda s, d: rt.search(pf._query(s, d), pf._searched(s, d), _search_documents(s, d), ["en", "de"], (2005, 2020)).select("qid", "standard", "did", "rank"),
    "r20_rank_clauses": lambda s, d: rt.rank_clauses(pf._query(s, d), pf._searched(s, d)),
    "r22_mine_edges": lambda s, d: _mined(s, d).withColumn("confidence", F.round("confidence", 6)),
    "g4_evidence_edges": lambda s, d: _evidence(s, d)[1].withColumn("confidence", F.round("confidence", 6)),
    "g4_evidence_nodes": lambda s, d: _evidence(s, d)[0],
    "g14_dependency_cards": lambda s, d: rt.dependency_cards(g.closure(pg._normative(s, d)), g.layers(pg._normative(s, d)), g.latest_replacement(pg._supersedes(s, d)).select("node", "latest")),
    "g15_standard_family": lambda s, d: g.standard_family(pg._supersedes(s, d), pg._normative(s, d).where("type = 'REFERENCES'")),
    "a16_scoped_attributes": _scoped,
    "a17_vague_findings": _vague,
    "a23_observed_only": lambda s, d: rp.observed_only(rp.quantity_roles(_rows(s, d).select(*KEYS, pick(CUED, F.col("part")).alias("before"), pick(["max", "eq", None], F.col("supp")).alias("comparator")))).select(*KEYS, "role"),
    "a25_reported_nonconformity": _reported,
    "a26_report_routing": _routing,
    "v5_match_findings": lambda s, d: e.match_findings(*[df.drop("text") for df in _golds(s, d)]),
    "v12_ablation_grid": lambda s, d: e.ablation_grid(_features(s, d), s.createDataFrame([("lexical", 1.0, 0.0, 0.0), ("product", 0.5, 0.0, 0.5), ("all", 0.4, 0.3, 0.3)], "option string, bm25 double, clause_parameter double, product double"), ["bm25", "clause_parameter", "product"]).select("option", "kept", F.round("mean_score", 6).alias("mean_score")),
    "v13_resolution_accuracy": lambda s, d: e.resolution_accuracy(pf._resolved(s, d).select("cid", F.split("cid", "/")[0].cast("long").alias("expected"), F.lit("unspecified").alias("edition")), pf._resolved(s, d)).select(F.round("record_accuracy", 6).alias("record_accuracy"), F.round("edition_accuracy", 6).alias("edition_accuracy"), "n"),
    "v15_graph_prf": lambda s, d: e.graph_prf(_mined(s, d), _curated(s, d)),
    "v17_run_index": lambda s, d: e.run_index(_rows(s, d).select(F.col("doc").alias("run"), F.concat(F.lit("m"), F.col("line") % 4).alias("metric"), F.col("qty").alias("value")), ["m0", "m1", "m3"]),
    "v19_split_filter": lambda s, d: e.split_filter(read(s, d, "documents").select("doc_id", F.col("source").alias("split")), read(s, d, "documents").select(F.col("source").alias("split"), F.when(F.substring("source", -1, 1) == "7", "blind").otherwise("dev").alias("role")).distinct()),
    "v23_detail_lists": lambda s, d: e.detail_lists(_golds(s, d)[0], _golds(s, d)[1], e.match_findings(*[df.drop("text") for df in _golds(s, d)])).select("doc", _list_text("missed"), _list_text("spurious")),
}
_R = f"WITH {ROWS} "
_T = r_.TESTS_CLAUSE, r_.CONFORM_CLAUSE, r_.EVIDENCE_CLAUSE, r_.VAGUE_CLAUSE
SQL = {
    "a7_drop_ambiguous": _R + """, h AS (SELECT doc, line AS req, part AS standard, discount AS c, supp, qty, part AS own FROM rows_ UNION ALL SELECT doc, line, part + 1, discount - CASE WHEN supp % 2 = 0 THEN 0.1 ELSE 0.3 END, supp, qty, part FROM rows_)
      SELECT doc, req, standard, 'p' AS parameter, CASE standard % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'disjoint' END AS overlap FROM h
      WHERE standard % 3 = 0 OR (standard = own AND qty % 4 = 0) OR NOT ((standard = own AND (own + 1) % 3 = 0 AND supp % 2 = 0) OR (standard = own + 1 AND own % 3 = 0))""",
    "a31_repair_texts": _R + f""", f AS (SELECT *, {sql_pick(RULES, 'part')} AS rule FROM rows_) SELECT doc, line, rule, CASE rule WHEN 'constraint_conflict' THEN concat('Rated ', supp, ' kV, or ', qty, ' V, in accordance with IS ', part, '.') WHEN 'checklist_gap' THEN concat('State it per IS ', part, '.') WHEN 'dependency_gap' THEN CASE WHEN qty % 2 = 0 THEN concat('{_T[0][0]}IS ', part, '{_T[0][1]}') ELSE concat('{_T[1][0]}IS ', part, '{_T[1][1]}') END
      WHEN 'superseded_edition' THEN concat('Cables to IS ', part, CASE WHEN supp % 3 = 0 THEN ' and IS 9' ELSE '' END, ' and IS ', line, ':1990.') WHEN 'conformity_evidence_missing' THEN concat('{_T[2][0]}IS ', part, '{_T[2][1]}') ELSE concat('Rated ', qty, ' V, or ', qty, ' V{_T[3][0]}', CASE WHEN supp % 2 = 0 THEN concat(' per IS ', part, ' (Limits)') ELSE '' END, '{_T[3][1]}') END AS recommended FROM f WHERE rule <> 'newer_edition'""",
    "a32_guard_citations": "SELECT p_partkey, p_partkey % 2 = 0 OR p_size < 10 AS ok, CASE WHEN p_partkey % 2 <> 0 AND p_size >= 10 THEN 'citations' END AS reason FROM part",
    "t5_linearize_tables": _R + "SELECT doc, CAST(line AS INTEGER) AS line_no, CASE doc % 3 WHEN 0 THEN concat('Item p', part, ': ', qty, ' kVA.') WHEN 1 THEN concat('Turbidity ', part, ': acceptable limit ', line, ' NTU; result ', qty, ' NTU.') ELSE concat('Test ', part, ': requirement Min ', line, ' V; observed ', qty, ' V; ', CASE WHEN supp % 2 = 0 THEN 'Pass' ELSE 'Fail' END, '.') END AS line FROM rows_ UNION ALL SELECT DISTINCT doc, 0, '' FROM rows_ UNION ALL SELECT DISTINCT doc, 100, concat('Notes on ', doc) FROM rows_",
    "t12_drop_headings": r"""WITH li AS (SELECT doc_id AS doc, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)), lo AS (SELECT doc, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, trim(line) AS t FROM li),
      h AS (SELECT *, regexp_extract(t, '^([0-9]{1,2}(\.[0-9]{1,3}){0,4})[.)]?\s+[A-Z]', 1) <> '' AND length(t) <= 100 AND NOT regexp_matches(t, '[.;]$') OR regexp_matches(lower(t), '^(section|chapter|part|annex|appendix|schedule)\s+[0-9a-z]{1,4}\b') AND length(t) <= 100 OR (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^A-Za-z]', '', 'g')) * 0.8::DOUBLE AND length(t) <= 80) AS head FROM lo)
      SELECT doc, start, line AS segment FROM h WHERE NOT head OR length(line) > length(t) + 2""",
    "t13_zone_filter": _R + f"SELECT doc, line, {sql_pick(ZONED, 'part')} AS segment, {sql_pick(HEADINGS, 'supp')} AS heading FROM rows_ WHERE part % 4 = 3 AND supp % 3 = 1",
    "t18_role_of_documents": f"WITH t AS (SELECT o_orderkey AS doc, coalesce(lower(trim({sql_pick(TYPES, 'o_orderkey')})), '') AS raw FROM orders), n AS (SELECT doc, CASE WHEN raw IN ({', '.join(repr(t) for t in rp.DOCUMENT_TYPES)}) THEN raw ELSE 'specification' END AS type FROM t) SELECT doc, type, CASE WHEN type = 'boq' THEN 'schedule' WHEN type = 'datasheet' THEN 'declaration' WHEN type LIKE '%report' THEN 'report' ELSE 'specification' END AS role, type IN ('specification', 'tender') AS zoning, type NOT IN ('specification', 'tender') AS tables, type LIKE '%report' AS report, NOT (type LIKE '%report' OR type = 'boq') AS completeness FROM n",
    "x1_intervals": f"WITH {INTERVALS} SELECT doc, line, CAST(q_no AS INTEGER) AS q_no, unit, comparator, round(value, 6) AS value, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi, round(tolerance, 6)::DOUBLE AS tolerance FROM qs",
    "x5_special_quantities": f"WITH {INTERVALS} SELECT doc, line, unit, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi FROM qs WHERE unit IN ('pH', 'ratio')",
    "x7_report_guards": _R + f", b AS (SELECT doc, line, {sql_pick(DIMENSIONS, 'supp')} AS dimension, part % 6 AS i, qty FROM rows_) SELECT doc, line, dimension, CASE WHEN (dimension = 'voltage' AND i = 0) OR (dimension = 'resistance' AND i = 2) OR (dimension = 'temperature' AND i = 3) OR (dimension = 'power' AND i = 4) THEN NULL WHEN dimension = 'current' AND qty % 2 = 0 THEN 'short_circuit_rating' ELSE 'given' END AS parameter FROM b",
    "x8_derive_variation": _R + "SELECT doc, line, 'voltage_variation' AS parameter, 10.0::DOUBLE AS value FROM rows_ WHERE part % 6 = 1",
    "x11_text_parameters": f"WITH {_PARTS}, {_STATED} SELECT k AS key, parameter, value FROM st WHERE value IS NOT NULL",
    "x13_build_attributes": _listed("NOT starts_with(parameter, '?')", "parameters"),
    "x14_unvalued_mentions": _listed("starts_with(parameter, '?')", "mentions"),
    "x22_structure_fragments": f"WITH {_PARTS} SELECT k AS key, {_sql_pick([t for t, _ in FORMS], 'k')} AS terms, CASE WHEN k % 8 = 4 AND k % 3 = 0 THEN 'quality' ELSE {_sql_pick([c for _, c in FORMS], 'k')} END AS category, {_CITED} AS \"references\" FROM p",
    "r11_rerank_features": f"WITH {FEATURES} SELECT qid, did, standard, round(bm25, 6) AS bm25, round(clause_parameter, 6)::DOUBLE AS clause_parameter, round(standard_parameter, 6)::DOUBLE AS standard_parameter, product, context_product, document_cited, explicit, governed, product_term FROM ft",
    "r12_rerank_full": f"WITH {SCORED} SELECT qid, did, round(round(raw, 9), 6) AS raw, round(least(greatest(round(raw, 9), 0), 1), 6)::DOUBLE AS confidence FROM k4",
    "r18_explain_hits": f"WITH {FEATURES} SELECT qid, did, CASE WHEN NOT explicit AND product_term IS NULL AND governed = '' AND did % 2 = 1 THEN concat('Lexical similarity with IS ', standard, '.') ELSE concat_ws(' ', CASE WHEN explicit THEN concat('The requirement cites IS ', standard, ' directly.') END, CASE WHEN product_term IS NOT NULL THEN concat('The ', product_term, ' described in the requirement falls within the scope of IS ', standard, '.') END, CASE WHEN governed <> '' THEN concat('The clause \"Clause ', did, '\" governs ', replace(replace(governed, ',', ' and '), '_', ' '), ', which the requirement specifies.') END, CASE WHEN did % 2 = 0 THEN 'Shared technical terms: cable, rated, volt.' END) END AS explanation FROM ft",
    "r19_search": pf._BM + ", sc AS (SELECT qid, did, round(score, 9) AS sr, source AS standard, lang, 2000 + doc_id % 25 AS yr FROM (SELECT *, score / max(score) OVER (PARTITION BY qid) AS conf FROM bm) b JOIN documents ON did = doc_id WHERE conf >= 0.2), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, standard ORDER BY sr DESC, did) AS n FROM sc) WHERE n = 1), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sr DESC, did) AS k FROM one) WHERE k <= 20 AND lang IN ('en', 'de') AND yr BETWEEN 2005 AND 2020) SELECT * FROM (SELECT qid, standard, did, row_number() OVER (PARTITION BY qid ORDER BY k) AS rank FROM kept) WHERE rank <= 8",
    "r20_rank_clauses": pf._BM + "SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, did) AS rank FROM bm",
    "r22_mine_edges": f"WITH {MINED} SELECT type, src, dst, clause, round(confidence, 6) AS confidence FROM mined",
    "g4_evidence_edges": f"WITH {EVIDENCE} SELECT doc, type, src, dst, round(confidence, 6) AS confidence FROM ev",
    "g4_evidence_nodes": f"WITH {EVIDENCE} SELECT doc, id, CASE split_part(id, ':', 1) WHEN 'req' THEN 'requirement' WHEN 'std' THEN 'standard' WHEN 'cert' THEN 'certification' ELSE 'clause' END AS type FROM (SELECT doc, src AS id FROM ev UNION SELECT doc, dst FROM ev UNION SELECT doc, concat('std:', standard) FROM ap)",
    "g14_dependency_cards": f"WITH RECURSIVE {pg._E}, {pg._R}, {pg._C}, {pg._N}, {pg._S}, {pg._H}, {pg._L}, dn AS (SELECT src AS node, string_agg(concat(dst, '@', depth), ',' ORDER BY depth, dst) AS t FROM c GROUP BY 1), up AS (SELECT dst AS node, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS t FROM c GROUP BY 1) SELECT lay.node, layer, coalesce(l.latest, lay.node) AS canonical, coalesce(dn.t, '') AS depends_on, coalesce(up.t, '') AS required_by FROM lay LEFT JOIN dn ON lay.node = dn.node LEFT JOIN up ON lay.node = up.node LEFT JOIN l ON lay.node = l.node",
    "g15_standard_family": f"WITH RECURSIVE {pg._E}, {pg._S}, {pg._H}, {pg._L}, rf AS (SELECT src, dst FROM edges WHERE type = 'REFERENCES'), rr AS (SELECT src, dst FROM rf UNION SELECT rr.src, rf.dst FROM rr JOIN rf ON rr.dst = rf.src), u AS (SELECT a.node, b.node AS relative FROM l a JOIN l b USING (latest) UNION SELECT node, latest FROM l UNION SELECT latest, node FROM l UNION SELECT src, dst FROM rr) SELECT node, relative FROM u WHERE node <> relative",
    "a16_scoped_attributes": _R + ", atr AS (SELECT doc, line AS req, ['rated_voltage', 'turbidity', 'frequency', 'pump_head'][CAST(supp % 4 + 1 AS INTEGER)] AS parameter FROM rows_), go AS (SELECT doc, part AS standard, line AS req FROM rows_ WHERE qty % 2 = 0), st AS (SELECT DISTINCT doc, standard FROM go), ow AS (SELECT * FROM go UNION SELECT go.doc, go.standard - 1, go.req FROM go JOIN st ON st.doc = go.doc AND st.standard = go.standard - 1 JOIN part ON p_partkey = go.standard - 1 UNION SELECT doc, part + 2, line FROM rows_ WHERE qty % 11 = 0) SELECT doc, standard, req, parameter FROM atr JOIN ow USING (doc, req) UNION SELECT doc, standard, req, parameter FROM atr JOIN st USING (doc) WHERE parameter IN ('rated_voltage', 'frequency', 'ambient_temperature', 'altitude')",
    "a17_vague_findings": _R + "SELECT doc, line AS req, CASE WHEN discount * 10 >= 0.35 THEN part END AS standard, 'low' AS severity, 0.65::DOUBLE AS confidence FROM rows_ WHERE qty % 3 = 0 AND qty % 2 <> 0",
    "a23_observed_only": _R + "SELECT doc, line, 'observed' AS role FROM rows_ WHERE CASE part % 5 WHEN 0 THEN TRUE WHEN 3 THEN TRUE WHEN 4 THEN supp % 3 <> 0 ELSE FALSE END",
    "a25_reported_nonconformity": _R + f", t AS (SELECT doc, line AS req, {sql_pick(REPORTS, 'part')} AS text, ['failed', NULL, 'does not comply', 'unsatisfactory', 'exceeds the permissible'][CAST(part % 5 + 1 AS INTEGER)] AS cue, ['turbidity', 'rated_voltage', 'ph'][CAST(supp % 3 + 1 AS INTEGER)] AS parameter FROM rows_), fl AS (SELECT DISTINCT doc, ['turbidity', 'rated_voltage', 'ph'][CAST(qty % 3 + 1 AS INTEGER)] AS parameter FROM rows_ WHERE qty > 40) SELECT doc, req, cue, 'high' AS severity, 0.85::DOUBLE AS confidence FROM t WHERE cue IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.doc = t.doc AND (fl.parameter = t.parameter OR (fl.parameter <> 'ph' AND contains(lower(text), replace(fl.parameter, '_', ' ')))))",
    "a26_report_routing": _R + f", ty AS (SELECT doc, line AS req, concat('p', supp % 3) AS parameter, qty, coalesce(lower(trim({sql_pick(TYPES, 'doc')})), '') AS type FROM rows_), x AS (SELECT *, type LIKE '%report' AS report, NOT (type LIKE '%report' OR type = 'boq') AS comp FROM ty) SELECT doc, req, parameter, CASE WHEN report THEN 'outside_limit' ELSE 'constraint_conflict' END AS rule FROM x WHERE qty % 2 = 0 UNION ALL SELECT doc, req, parameter, 'result_nonconformity' FROM x WHERE report AND qty % 3 = 0 AND qty % 2 <> 0 UNION ALL SELECT doc, req, parameter, 'internal_inconsistency' FROM x WHERE NOT report AND qty % 5 = 0 UNION ALL SELECT doc, req, parameter, 'checklist_gap' FROM x WHERE comp AND qty % 7 = 0",
    "v5_match_findings": f"WITH {MATCHED} SELECT * FROM mt",
    "v12_ablation_grid": f"WITH {FEATURES}, o(option, b, c, p) AS (VALUES ('lexical', 1.0, 0.0, 0.0), ('product', 0.5, 0.0, 0.5), ('all', 0.4, 0.3, 0.3)), y AS (SELECT option, (bm25 * b + clause_parameter * c + product * p) / (b + c + p) AS raw FROM ft, o) SELECT option, count(*) FILTER (raw >= 0.35) AS kept, round(avg(raw), 6) AS mean_score FROM y GROUP BY 1",
    "v13_resolution_accuracy": f"WITH res AS ({pf.SQL['r2_resolve_citations']}) SELECT round(avg((CAST(split_part(cid, '/', 1) AS BIGINT) IS NOT DISTINCT FROM sid)::INT), 6) AS record_accuracy, round(avg((edition = 'unspecified')::INT), 6) AS edition_accuracy, count(*) AS n FROM res",
    "v15_graph_prf": f"WITH {MINED}, cu AS (SELECT ['REQUIRES', 'TESTED_BY', 'SUPERSEDES', 'REFERENCES'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS type, p_partkey AS src, p_partkey * 7 % 400 + 1 AS dst, p_size % 2 = 0 AS ok FROM part), hit AS (SELECT m.src, EXISTS (SELECT 1 FROM cu WHERE cu.type = m.type AND cu.src = m.src AND cu.dst = m.dst) AS e, EXISTS (SELECT 1 FROM cu WHERE cu.src = m.src AND cu.dst = m.dst) AS p FROM mined m), hs AS (SELECT src, count(*) FILTER (e) AS edge_tp, count(*) FILTER (NOT e) AS edge_fp, count(*) FILTER (p) AS pair_tp, count(*) FILTER (NOT p) AS pair_fp FROM hit GROUP BY 1), ms AS (SELECT src, count(*) AS edge_fn FROM (SELECT DISTINCT type, src, dst FROM cu WHERE ok) c WHERE NOT EXISTS (SELECT 1 FROM mined m WHERE m.type = c.type AND m.src = c.src AND m.dst = c.dst) GROUP BY 1) SELECT coalesce(hs.src, ms.src) AS src, coalesce(edge_tp, 0) AS edge_tp, coalesce(edge_fp, 0) AS edge_fp, coalesce(edge_fn, 0) AS edge_fn, coalesce(pair_tp, 0) AS pair_tp, coalesce(pair_fp, 0) AS pair_fp FROM hs FULL JOIN ms ON hs.src = ms.src",
    "v17_run_index": _R + "SELECT doc AS run, max(CASE WHEN line % 4 = 0 THEN qty END) AS m0, max(CASE WHEN line % 4 = 1 THEN qty END) AS m1, max(CASE WHEN line % 4 = 3 THEN qty END) AS m3 FROM rows_ GROUP BY 1",
    "v19_split_filter": "SELECT source AS split, doc_id FROM documents WHERE source[-1:] <> '7'",
    "v23_detail_lists": f"WITH {MATCHED}, mi AS (SELECT doc, string_agg(text, ';' ORDER BY gid) AS t FROM gr ANTI JOIN mt USING (doc, gid) GROUP BY 1), sp AS (SELECT doc, string_agg(text, ';' ORDER BY pid) AS t FROM pr ANTI JOIN mt USING (doc, pid) GROUP BY 1) SELECT coalesce(mi.doc, sp.doc) AS doc, coalesce(mi.t, '') AS missed, coalesce(sp.t, '') AS spurious FROM mi FULL JOIN sp ON mi.doc = sp.doc",
}
