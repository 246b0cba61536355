"""Text refinement queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.functions import text as t
from clausemill.operators import refine as r
from clausemill.plans.tables import read


def _docs(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _lines(s, d):
    return _docs(s, d).select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _pages(s, d):
    # A document of up to eight pages: groups stay as they are when the table grows.
    return read(s, d, "documents").select(F.floor(F.col("doc_id") / 8).cast("long").alias("doc"), F.col("doc_id").alias("page"), "text")


def _page_lines(s, d):
    return _pages(s, d).select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def rendered(s, d):
    """Sentences rendered from lineitem: a parameter, a comparison, a value and a unit."""
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    li = read(s, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("part"),
        F.concat(pick(["Rated voltage", "Ambient temperature", "Cable length", "Fault current"], F.col("l_partkey")), pick([" shall be ", " should be ", ": ", " may be ", " will be "], F.col("l_suppkey")), pick(["not more than ", "not less than ", "", "at least "], F.col("l_linenumber")), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), pick(["kV", "mA", "km", "degC", "l/s", "hours"], F.col("l_partkey")), pick([".", " or more.", " as required.", " of suitable make."], F.col("l_orderkey"))).alias("segment"),
    )


RENDERED = """rendered AS (SELECT l_orderkey AS doc, l_linenumber AS "at", l_partkey AS part, concat(['Rated voltage','Ambient temperature','Cable length','Fault current'][CAST(l_partkey % 4 + 1 AS INTEGER)], [' shall be ',' should be ',': ',' may be ',' will be '][CAST(l_suppkey % 5 + 1 AS INTEGER)], ['not more than ','not less than ','','at least '][CAST(l_linenumber % 4 + 1 AS INTEGER)], CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ' ', ['kV','mA','km','degC','l/s','hours'][CAST(l_partkey % 6 + 1 AS INTEGER)], ['.',' or more.',' as required.',' of suitable make.'][CAST(l_orderkey % 4 + 1 AS INTEGER)]) AS segment FROM lineitem)"""


def _flagged(s, d):
    return rendered(s, d).withColumn("has_value", F.col("doc") % 3 != 0).withColumn("has_reference", F.col("part") % 5 == 0)


def _headed(s, d):
    """Lines of contracts by line item: titles, statements, values and plain words."""
    li = read(s, d, "lineitem")
    n = F.col("l_partkey") % 5
    line = F.when(n == 0, F.concat(F.lit("Cables and Wires of Type "), F.col("l_linestatus"))).when(n == 1, F.lit("The panel shall be Tested")).when(n == 2, F.concat(F.lit("Rated Voltage "), F.col("l_suppkey"), F.lit(" V"))).when(n == 3, F.lit("Scope Of supply")).otherwise(F.concat(F.lit("Earthing System "), F.col("l_returnflag")))
    return li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("line_no"), line.alias("line")).withColumn("start", F.col("line_no")).distinct()


def _sentence_lines(s, d):
    text = F.concat(F.lit("a) Test at "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " deg C. The pump shall run. ").otherwise(" bar. Mr. A. Smith shall run it. "), F.lit("Cl. No. 5 holds."))
    return read(s, d, "orders").join(read(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("doc"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("line_no"), text.alias("line"))


_HEADED = """hd AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS line_no, CASE l_partkey % 5 WHEN 0 THEN 'Cables and Wires of Type ' || l_linestatus WHEN 4 THEN 'Earthing System ' || l_returnflag END AS heading FROM lineitem WHERE l_partkey % 5 IN (0, 4))"""

QUERIES = {
    "t9_title_headings": lambda s, d: r.detect_sections(_headed(s, d), titles=True).select("doc", "line_no", "heading", "section_no"),
    "t11_segment": lambda s, d: r.segment(_sentence_lines(s, d)),
    "t1_normalize_text": lambda s, d: r.normalize_text(_docs(s, d), nfkc=False),
    "t1_normalize_nfkc": lambda s, d: r.normalize_text(_docs(s, d)),
    "t2_drop_page_counters": lambda s, d: r.drop_page_counters(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Page "), "l_linenumber", F.lit(" of 9"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("- page "), "l_linenumber", F.lit(" -"))).otherwise(F.concat(F.lit("Item "), "l_linenumber")).alias("line"))),
    "t3_strip_repeated_lines": lambda s, d: r.strip_repeated_lines(_page_lines(s, d), share=0.3),
    "t4_reflow_lines": lambda s, d: r.reflow_lines(_lines(s, d)),
    "t6_sparse_page_report": lambda s, d: r.sparse_page_report(_pages(s, d)).withColumn("mean_chars", F.round("mean_chars", 4)),
    "t7_assemble_documents": lambda s, d: r.assemble_documents(_pages(s, d)).select("doc", "code", F.sha2("text", 256).alias("digest")),
    "t8_page_of": lambda s, d: r.page_of(_pages(s, d), _pages(s, d).select("doc", (F.col("page") * 37 % 20000).alias("at"))),
    "t9_detect_sections": lambda s, d: r.detect_sections(_lines(s, d).withColumn("start", F.col("line_no"))),
    "t10_locate": lambda s, d: r.locate(r.detect_sections(_lines(s, d).withColumn("start", F.col("line_no"))), _lines(s, d).select("doc", F.col("line_no").alias("at"))),
    "t14_identify": lambda s, d: r.identify(_flagged(s, d)),
    "t15_dedupe_requirements": lambda s, d: r.dedupe_requirements(rendered(s, d).select("doc", (F.col("at") * 1000000 + F.col("part")).alias("at"), "segment")),
    "t17_flag_vague": lambda s, d: r.flag_vague(_flagged(s, d)),
    "t19_validate_types": lambda s, d: r.validate_types(read(s, d, "part").select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("type")), s.createDataFrame([("red_bolt",), ("blue_bolt",), ("hot_gear",), ("red_widget",)], "type string")),
    "s2_decode_text": lambda s, d: r.decode_text(_docs(s, d).select("doc", F.encode("text", "UTF-8").alias("content"))).select("doc", "text"),
    "s3_html_to_lines": lambda s, d: r.html_to_lines(read(s, d, "pages"), "page_id", "html"),
    "s15_content_fingerprint": lambda s, d: _docs(s, d).select("doc", F.sha2("text", 256).alias("sha"), t.fnv1a(F.col("text")).alias("fnv")),
    "s17_upload_title": lambda s, d: read(s, d, "documents").select("doc_id", t.title_of(F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Doc "), "doc_id")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("spec_file-"), "doc_id", F.lit(".pdf"))), F.col("text")).alias("title")),
}

_LINES = r"lines AS (SELECT doc, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS parts FROM documents))"
_keep = {k: v for k, v in t.CHARACTERS.items() if v}
_FROM, _TO = "".join(_keep) + "­", "".join(_keep.values())
_Q = lambda x: x.replace("'", "''")
_PLINES = "plines AS (SELECT doc, page, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line FROM (SELECT doc_id // 8 AS doc, doc_id AS page, string_split(text, chr(10)) AS parts FROM documents))"
_SEC = r"""h AS (SELECT doc, line_no, line_no AS start, trim(line) AS heading, regexp_extract(trim(line), '^([0-9]{1,2}(\.[0-9]{1,3}){0,4})[.)]?\s+[A-Z]', 1) AS num, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS caps FROM lines),
 sec AS (SELECT doc, line_no, start, nullif(num, '') AS number, heading, CAST(CASE WHEN num <> '' AND length(heading) <= 100 AND NOT regexp_matches(heading, '[.;]$') THEN length(regexp_replace(num, '[^.]', '', 'g')) + 1 ELSE 1 END AS INTEGER) AS level FROM h WHERE (num <> '' AND length(heading) <= 100 AND NOT regexp_matches(heading, '[.;]$')) OR (regexp_matches(lower(heading), '^(section|chapter|part|annex|appendix|schedule)\s+[0-9a-z]{1,4}\b') AND length(heading) <= 100) OR (letters >= 4 AND caps > letters * 0.8::DOUBLE AND length(heading) <= 80))"""
_W = lambda a: rf"regexp_matches(lower(segment), '(^|[^a-z0-9_])({a})([^a-z0-9_]|$)')"
_FLAGGED = f"WITH {RENDERED}, f AS (SELECT *, doc % 3 <> 0 AS has_value, part % 5 = 0 AS has_reference FROM rendered) "
_ENUM = r.ENUMERATOR
SQL = {
    "t9_title_headings": f"WITH {_HEADED} SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS section_no FROM hd",
    "t11_segment": "WITH l AS (SELECT l_orderkey AS doc, concat_ws('/', l_linenumber, l_partkey, l_suppkey) AS line_no, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_linenumber % 2 = 0 AS even FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey) SELECT doc, line_no, 0 AS seg_no, CASE WHEN even THEN 'Test at ' || q || ' deg C.' ELSE 'Test at ' || q || ' bar.' END AS segment FROM l UNION ALL SELECT doc, line_no, 1, CASE WHEN even THEN 'The pump shall run.' ELSE 'Mr.' END FROM l UNION ALL SELECT doc, line_no, 2, CASE WHEN even THEN 'Cl. No. 5 holds.' ELSE 'A. Smith shall run it.' END FROM l UNION ALL SELECT doc, line_no, 3, 'Cl. No. 5 holds.' FROM l WHERE NOT even",
    "t1_normalize_text": f"SELECT doc_id AS doc, translate(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '{_Q(_FROM)}', '{_Q(_TO)}') AS text FROM documents",
    "t2_drop_page_counters": "SELECT l_orderkey, l_linenumber, concat('Item ', l_linenumber) AS line FROM lineitem WHERE l_linenumber % 3 = 2",
    "t3_strip_repeated_lines": f"WITH {_PLINES}, sh AS (SELECT *, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS shape FROM plines), rep AS (SELECT doc, shape FROM (SELECT doc, shape, count(DISTINCT page) AS n FROM sh WHERE shape <> '' GROUP BY 1, 2) JOIN (SELECT doc, count(DISTINCT page) AS pages FROM sh GROUP BY 1) USING (doc) WHERE pages >= 3 AND n >= ceil(pages * 0.3::DOUBLE) AND length(shape) < 120) SELECT doc, page, line_no, line FROM sh ANTI JOIN rep USING (doc, shape)",
    "t4_reflow_lines": rf"""WITH {_LINES}, a AS (SELECT doc, line_no, trim(regexp_replace(line, ' {{2,}}', ' ', 'g'), ' ') AS line FROM lines), b AS (SELECT *, lag(line) OVER w AS prev FROM a WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
 c AS (SELECT *, line <> '' AND prev <> '' AND regexp_matches(prev, '[a-z]-$') AND regexp_matches(line, '^[a-z]') AS hy, line <> '' AND prev <> '' AND ((regexp_matches(prev, '[a-z]-$') AND regexp_matches(line, '^[a-z]')) OR (NOT regexp_matches(lower(line), '{_ENUM}') AND (regexp_matches(line, '^[a-z(]') OR (regexp_matches(lower(prev), '([,(–-]|(^|[^a-z0-9_])({"|".join(r.OPEN_WORDS)}))$') AND NOT regexp_matches(prev, '[0-9]\s*[Aa]$'))))) AS cont FROM b),
 e AS (SELECT *, coalesce(hy, false) AS hyphen, CASE WHEN coalesce(cont, false) THEN 0 ELSE 1 END AS new FROM c), i AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line_no) AS island, coalesce(lead(hyphen) OVER (PARTITION BY doc ORDER BY line_no), false) AS nh FROM e)
 SELECT doc, min(line_no) AS line_no, string_agg(CASE WHEN hyphen OR new = 1 THEN '' ELSE ' ' END || CASE WHEN nh THEN regexp_replace(line, '-$', '') ELSE line END, '' ORDER BY line_no) AS line FROM i GROUP BY doc, island""",
    "t6_sparse_page_report": "SELECT doc, pages, round(mean_chars, 4) AS mean_chars, sparse, CASE WHEN mean_chars < 40 THEN 'no_text_layer' WHEN sparse > 0 THEN 'sparse_pages' END AS code FROM (SELECT doc_id // 8 AS doc, count(*) AS pages, avg(length(trim(text, ' '))) AS mean_chars, count(*) FILTER (length(trim(text, ' ')) < 40) AS sparse FROM documents GROUP BY 1)",
    "t7_assemble_documents": "SELECT doc, CASE WHEN trim(x, ' ') = '' THEN 'empty' WHEN length(x) > 1000000 THEN 'too_long' END AS code, CASE WHEN trim(x, ' ') <> '' AND length(x) <= 1000000 THEN sha256(x) END AS digest FROM (SELECT doc_id // 8 AS doc, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS x FROM documents GROUP BY 1)",
    "t8_page_of": "WITH p AS (SELECT doc_id // 8 AS doc, doc_id AS page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM documents) SELECT q.doc_id // 8 AS doc, q.doc_id * 37 % 20000 AS \"at\", (SELECT max(page) FROM p WHERE p.doc = q.doc_id // 8 AND p.st <= q.doc_id * 37 % 20000) AS page FROM documents q",
    "t9_detect_sections": f"WITH {_LINES}, {_SEC} SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS section_no FROM sec",
    "t10_locate": f"WITH {_LINES}, {_SEC} SELECT l.doc, l.line_no AS \"at\", (SELECT arg_max(heading, line_no) FROM sec s WHERE s.doc = l.doc AND s.line_no <= l.line_no) AS heading FROM lines l",
    "t14_identify": _FLAGGED + rf"""SELECT * FROM (SELECT *, CASE WHEN {_W('shall|must|is required to|are required to|required|mandatory')} THEN 'mandatory' WHEN {_W('is to be|are to be|will be')} THEN 'mandatory' WHEN {_W('should|recommended|preferably|desirable')} THEN 'recommended' WHEN has_value OR has_reference THEN CASE WHEN regexp_matches(segment, '^[A-Za-z][A-Za-z0-9 ()/&.,''-]{{1,60}}\s*(:|=|–)\s+\S') THEN 'declarative' WHEN has_reference AND {_W('as per|according to')} THEN 'declarative' WHEN {_W('may|optional')} AND has_value THEN 'permitted' WHEN has_value AND len(string_split_regex(trim(segment), '\s+')) <= 16 THEN 'declarative' END END AS modality,
 CASE WHEN {_W('shall|must|is required to|are required to|required|mandatory')} THEN CASE WHEN has_value OR has_reference THEN 0.95 ELSE 0.85 END WHEN {_W('is to be|are to be|will be')} THEN CASE WHEN has_value OR has_reference THEN 0.9 ELSE 0.8 END WHEN {_W('should|recommended|preferably|desirable')} THEN 0.75 WHEN (has_value OR has_reference) AND regexp_matches(segment, '^[A-Za-z][A-Za-z0-9 ()/&.,''-]{{1,60}}\s*(:|=|–)\s+\S') THEN 0.8 WHEN has_reference AND {_W('as per|according to')} THEN 0.75 WHEN {_W('may|optional')} AND has_value THEN 0.55 ELSE 0.6 END::DOUBLE AS confidence FROM f) WHERE modality IS NOT NULL""",
    "t15_dedupe_requirements": f"WITH {RENDERED}, n AS (SELECT doc, \"at\" * 1000000 + part AS \"at\", segment FROM rendered), o AS (SELECT *, row_number() OVER (PARTITION BY doc, lower(trim(segment)) ORDER BY \"at\", segment) AS k FROM n) SELECT doc, \"at\", segment, row_number() OVER (PARTITION BY doc ORDER BY \"at\", segment) AS req_no FROM o WHERE k = 1",
    "t17_flag_vague": _FLAGGED + f"SELECT *, ({_W('|'.join(r.VAGUE_WORDS + r.VAGUE_PHRASES))} AND NOT contains(lower(segment), 'suitable for ') AND NOT contains(lower(segment), 'approved make') AND NOT has_value AND NOT has_reference) AS vague FROM f",
    "t19_validate_types": "SELECT p_partkey AS doc, replace(lower(trim(p_name)), ' ', '_') AS key, CASE WHEN replace(lower(trim(p_name)), ' ', '_') NOT IN ('red_bolt','blue_bolt','hot_gear','red_widget') THEN 'unknown' END AS code FROM part",
    "s2_decode_text": "SELECT doc_id AS doc, text FROM documents",
    "s3_html_to_lines": r"""WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis') AS h FROM pages), b AS (SELECT page_id, regexp_replace(h, '<!--.*?-->', ' ', 'gs') AS h FROM a), c AS (SELECT page_id, regexp_replace(h, '<li[^>]*>', chr(10) || '• ', 'gi') AS h FROM b), d AS (SELECT page_id, regexp_replace(h, '</t[dh]>\s*<t[dh][^>]*>', ' | ', 'gi') AS h FROM c), e AS (SELECT page_id, regexp_replace(h, '<br[^>]*>|</(p|div|tr|li|h[1-6]|table|ul|ol|article|title|nav)>', chr(10), 'gi') AS h FROM d), f AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM e), g AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS line_no, trim(regexp_replace(unnest(x), '[ \t]+', ' ', 'g'), ' ') AS line FROM (SELECT page_id, string_split(h, chr(10)) AS x FROM f))
 SELECT page_id, line_no, CASE WHEN regexp_matches(line, '^[^|]+ \| [^|]+$') THEN replace(line, ' | ', ': ') ELSE line END AS line FROM g WHERE line <> ''""",
    "s17_upload_title": r"""SELECT doc_id, substr(coalesce(CASE WHEN doc_id % 3 = 1 THEN concat('Doc ', doc_id) END, CASE WHEN doc_id % 2 = 0 THEN concat('spec file ', doc_id) END, trim(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 3)[1], ' ')), 1, 90) AS title FROM documents""",
}
