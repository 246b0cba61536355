"""Source, sink and session queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausemill.functions.scratch import shared_folder
from clausemill.operators import workspace as w
from clausemill.plans.tables import ctes, findings, read, runs
from clausemill.sources import results, uploads
from clausemill.streaming import runs as streams
from clausemill.streaming.runs import session_gaps


def _unique_findings(s, d):
    # One row per run and number: the driver's line numbers repeat.
    return findings(s, d).groupBy("run_id", "finding_no").agg(F.min("kind").alias("kind"), F.min("severity").alias("severity"), F.min("standard").alias("standard"))


def _references(s, d):
    return {"lineitem": read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") + 3).alias("standard")), "orders": read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("standard"))}


def _files(s, d):
    return read(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def _manifest(s, d):
    sha = F.when(F.col("doc_id") % 10 == 0, F.lit("0")).otherwise(F.sha2(F.encode("text", "UTF-8"), 256))
    return read(s, d, "documents").where("doc_id % 7 <> 0").select(F.concat(F.lit("d/"), F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1000000).otherwise(0)).alias("path"), sha.alias("sha"))


def _folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _corpus(s, d):
    """Parts as the standards of knowledge base files of a hundred each, written as JSON and read back."""
    p = read(s, d, "part")
    clause = F.struct(F.concat(F.lit("c-"), "p_partkey").alias("id"), F.concat(F.lit("s-"), "p_partkey").alias("standardId"), F.lit("1").alias("ref"), F.col("p_type").alias("heading"), F.col("p_name").alias("text"))
    second = F.struct(F.concat(F.lit("d-"), "p_partkey").alias("id"), F.concat(F.lit("s-"), "p_partkey").alias("standardId"), F.lit("2").alias("ref"), F.col("p_brand").alias("heading"), F.lit(None).cast("string").alias("text"))
    standard = F.struct(F.concat(F.lit("s-"), "p_partkey").alias("id"), F.col("p_name").alias("title"), (1980 + F.col("p_size")).alias("year"), F.array(clause, second).alias("clauses"))
    files = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("block")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", standard.alias("s")))).alias("x"))
    path = _folder(s, "corpus")
    files.select("block", F.transform("x", lambda y: y["s"]).alias("standards")).repartition("block").write.partitionBy("block").json(path)
    return uploads.read_corpus(s, f"{path}/*")


def _published(s, d):
    """Two versions published one after the other: the second is the active one."""
    path, p = _folder(s, "published"), read(s, d, "part").select("p_partkey", "p_name")
    results.publish_corpus({"standards": p.where("p_partkey % 2 = 0")}, path, "1")
    results.publish_corpus({"standards": p.withColumn("p_name", F.upper("p_name"))}, path, "2")
    return results.active_corpus(s, path, "standards")


def _rewritten(s, d):
    """Runs written, then some written again with fewer rows: only these change."""
    path = _folder(s, "results")
    rows = read(s, d, "lineitem").select((F.col("l_suppkey") % 25).alias("run_id"), "l_orderkey", "l_linenumber", "l_partkey")
    results.write_results({"findings": rows}, path)
    results.write_results({"findings": rows.where("run_id % 3 = 0 and l_linenumber = 1")}, path)
    return s.read.schema("l_orderkey long, l_linenumber long, l_partkey long, run_id long").parquet(f"{path}/findings")


def _eval_runs(s, d):
    path = _folder(s, "eval")
    items = read(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    for run, keep in (("base", "true"), ("strict", "quality = 1")):
        results.write_eval_run(items.where(keep), path, run)
    return results.read_eval_runs(s, f"{path}/*", "doc_id long, quality int")


def _records(s, d):
    """A run a customer, its tasks nested as they come: open and finished orders, with other metrics each; written and read back."""
    orders = read(s, d, "orders").select(F.concat(F.lit("r"), "o_custkey").alias("run"), "o_orderkey", "o_orderstatus", "o_totalprice")
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("key"))
    task = F.when(F.col("o_orderstatus") == "O", "open").otherwise("done")
    each = orders.groupBy("run", task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("partial"), F.array_sort(F.collect_list(item)).alias("items"))
    metrics = F.when(F.col("task") == "open", F.create_map(F.lit("n"), F.col("n").cast("double"))).otherwise(F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("partial"), F.col("partial").cast("double")))
    records = each.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct(metrics.alias("metrics"), "items")))).alias("tasks"))
    path = _folder(s, "records")
    results.write_run_records(records, path)
    return results.run_records(s, path)


def _ingested(s, d):
    """Documents as they arrive in a stream, each analysed once."""
    out, table = _folder(s, "ingested"), read(s, d, "documents")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    analyse = lambda batch: batch.select("doc_id", F.size(F.split("text", "\n")).alias("lines"))
    streams.ingest_stream(s, f"{d}/documents.parque[t]", schema, analyse, out, _folder(s, "checkpoint")).awaitTermination()
    return s.read.schema("doc_id long, lines int, batch long, part int").parquet(out).select("doc_id", "lines")


def _stalled(s, d):
    """Users as runs and their events as heartbeats, hours apart: what a watch over the stream does about silent ones."""
    out = _folder(s, "stalled")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read(s, d, "events").schema)
    beats = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("run_id"), "ts")
    streams.watch(streams.stalled_runs(beats, stale_ms=6 * 3_600_000), out, _folder(s, "checkpoint")).awaitTermination()
    return s.read.schema("run_id long, at timestamp, action string").parquet(out).withColumn("at", F.col("at").cast("timestamp_ntz"))


def _ingested_bad(s, d):
    """Documents that arrive in several files, some twice, some with a bad source: each is analysed once or has a code."""
    folder, out, docs = _folder(s, "arriving"), _folder(s, "ingested"), read(s, d, "documents").select("doc_id", "text", "source")
    half = docs.where("doc_id % 2 = 0")
    for part in (half, docs.where("doc_id % 2 = 1").unionByName(half.where("doc_id % 3 = 0"))):
        part.write.mode("append").parquet(folder)
    n = F.size(F.split("text", "\n"))
    analyse = lambda b: b.select("doc_id", F.when(F.col("doc_id").isin(21, 42), F.raise_error(F.lit("broken"))).otherwise(n).cast("int").alias("lines"))
    streams.ingest_stream(s, folder, "doc_id long, text string, source string", analyse, out, _folder(s, "checkpoint"), checks={"other_source": F.col("doc_id") % 5 == 4}).awaitTermination()
    done = s.read.schema("doc_id long, lines int, batch long, part int").parquet(out)
    errors = s.read.schema("key string, code string, error string, batch long, part int").parquet(f"{out}-errors")
    return done.select("doc_id", "lines", F.lit(None).cast("string").alias("code")).unionByName(errors.select(F.col("key").cast("long").alias("doc_id"), F.lit(None).cast("int").alias("lines"), "code"))


def _children(s, d):
    """What a run has stored, from its line items: mappings, findings, evidence, repairs."""
    f = findings(s, d)
    own = _unique_findings(s, d)
    reviews = f.groupBy("run_id", "finding_no").agg(F.min("review").alias("review"))
    told = own.join(reviews, ["run_id", "finding_no"]).withColumn("reason", F.concat(F.lit("line "), "finding_no"))
    proof = f.select("run_id", "finding_no", F.col("standard").alias("ordinal"), F.lit("clause").alias("kind"), F.concat(F.lit("part "), "standard").alias("excerpt")).distinct()
    decision = F.when(F.col("review") == "accepted", "accepted").when(F.col("review") == "dismissed", "rejected")
    mend = told.where("kind = 'conflicting'").select("run_id", F.col("finding_no").alias("repair_no"), decision.alias("decision"), "reason", F.concat(F.lit("as "), "standard").alias("proposed"))
    mend = mend.select("run_id", "repair_no", "decision", F.col("reason").alias("original"), "proposed", F.when(F.col("repair_no") % 2 == 0, "own words").alias("final"))
    mapped = f.groupBy("run_id", "requirement", "standard").agg(F.max("confidence").alias("confidence")).withColumn("basis", F.when(F.col("standard") % 2 == 0, "cited | read").otherwise("retrieval"))
    return told, proof, mend, mapped


def _reassembled(s, d):
    told, proof, mend, mapped = _children(s, d)
    requirements = mapped.select("run_id", "requirement").distinct()
    children = {
        "requirements": (requirements, ["requirement"]),
        "mappings": (mapped.select("run_id", "requirement", "standard"), ["requirement", "standard"]),
        "findings": (told.select("run_id", "finding_no", "kind"), ["finding_no"]),
        "evidence": (proof.select("run_id", "finding_no", "ordinal", "excerpt"), ["finding_no", "ordinal"]),
        "repairs": (mend.select("run_id", "repair_no", "proposed"), ["repair_no"]),
    }
    whole = results.reassemble(w.latest_run(runs(s, d)).select("doc_id", "run_id"), children)
    shown = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ";").alias(name)
    return whole.select("doc_id", "run_id", shown("requirements", "requirement"), shown("mappings", "requirement", "standard"), shown("findings", "finding_no", "kind"), shown("evidence", "finding_no", "ordinal", "excerpt"), shown("repairs", "repair_no", "proposed"))


def _reviewed(s, d):
    return results.review_report(w.document_view(runs(s, d), findings(s, d)), *_children(s, d))


_CHILDREN = """told AS (SELECT run_id, finding_no, min(kind) AS kind, min(severity) AS severity, min(standard) AS standard, min(review) AS review, concat('line ', finding_no) AS reason FROM findings GROUP BY 1, 2),
  proof AS (SELECT DISTINCT run_id, finding_no, standard AS ordinal, concat('part ', standard) AS excerpt FROM findings),
  mend AS (SELECT run_id, finding_no AS repair_no, CASE review WHEN 'accepted' THEN 'accepted' WHEN 'dismissed' THEN 'rejected' END AS decision, reason AS original, concat('as ', standard) AS proposed, CASE WHEN finding_no % 2 = 0 THEN 'own words' END AS final FROM told WHERE kind = 'conflicting'),
  mapped AS (SELECT run_id, requirement, standard, max(confidence) AS confidence, CASE WHEN standard % 2 = 0 THEN 'cited | read' ELSE 'retrieval' END AS basis FROM findings GROUP BY 1, 2, 3)"""
_NL = "chr(10)"
_REPORT = f"""pr AS (SELECT run_id, finding_no, string_agg(concat('  - clause: ', excerpt), {_NL} ORDER BY ordinal) AS t FROM proof GROUP BY 1, 2),
  tx AS (SELECT run_id, string_agg(concat('### ', finding_no, '. ', kind, ' (', severity, ', ', review, ')', {_NL}, '- Standard: ', standard, {_NL}, '- Reason: ', reason, coalesce({_NL} || '- Evidence:' || {_NL} || t, '')), {_NL} || {_NL} ORDER BY finding_no) AS t FROM told LEFT JOIN pr USING (run_id, finding_no) GROUP BY 1),
  cx AS (SELECT run_id, string_agg(concat('- ', kind, ': ', n), {_NL} ORDER BY kind) AS t FROM (SELECT run_id, kind, count(*) AS n FROM told GROUP BY 1, 2) GROUP BY 1),
  mx AS (SELECT run_id, string_agg(concat('### Repair ', repair_no, ' (', coalesce(decision, 'pending'), ')', {_NL}, '- Original: ', original, {_NL}, '- Proposed: ', proposed, CASE WHEN decision = 'accepted' THEN concat({_NL}, '- Adopted: ', coalesce(final, proposed)) ELSE '' END), {_NL} || {_NL} ORDER BY repair_no) AS t FROM mend GROUP BY 1),
  px AS (SELECT run_id, string_agg(concat('| ', requirement, ' | ', standard, ' | ', replace(basis, '|', '\\|'), ' | ', format('{{:.2f}}', confidence), ' |'), {_NL} ORDER BY requirement, standard) AS t FROM mapped GROUP BY 1)
  SELECT doc_id, concat('# Review of document ', doc_id, {_NL}, {_NL}, 'Requirements: ', requirements, {_NL}, 'Standards: ', standards, {_NL}, {_NL}, '## Summary', {_NL}, {_NL}, coalesce(cx.t, 'No findings.'), {_NL}, {_NL}, '## Findings', {_NL}, {_NL}, coalesce(tx.t, 'None.'), {_NL}, {_NL}, '## Repairs', {_NL}, {_NL}, coalesce(mx.t, 'None.'), {_NL}, {_NL}, '## Requirement mapping', {_NL}, {_NL}, '| Requirement | Standard | Basis | Confidence |', {_NL}, '| --- | --- | --- | --- |', {_NL}, coalesce(px.t, '')) AS report
  FROM view_ v LEFT JOIN tx ON v.run_id = tx.run_id LEFT JOIN cx ON v.run_id = cx.run_id LEFT JOIN mx ON v.run_id = mx.run_id LEFT JOIN px ON v.run_id = px.run_id"""

QUERIES = {
    "s10_reassembled_runs": _reassembled,
    "s13_review_report": _reviewed,
    "st1_ingest_bad_rows": _ingested_bad,
    "st2_stalled_runs": _stalled,
    "s4_read_corpus": lambda s, d: _corpus(s, d)["clauses"].select("standard_id", "clause_no", "id", "heading", "text"),
    "s6_publish_corpus": _published,
    "s9_write_results": _rewritten,
    "s11_eval_runs": _eval_runs,
    "s12_run_metrics": lambda s, d: results.run_metrics(_records(s, d)),
    "s12_run_items": lambda s, d: results.run_items(_records(s, d)).select("run", "task", "key", F.array_join("items", ";").alias("items")),
    "st1_ingest_stream": _ingested,
    "s1_scan_uploads": lambda s, d: _files(s, d).select("path", F.inline(F.array(uploads.file_format(F.concat("path", F.when(F.length("path") % 2 == 0, ".txt").otherwise(".pdf")), F.col("content"), F.length("content").cast("long"))))),
    "s5_load_corpus": lambda s, d: uploads.load_corpus(read(s, d, "region").select(F.col("r_regionkey").alias("standard"), "r_name"), read(s, d, "nation").select(F.col("n_regionkey").alias("standard"), F.col("n_nationkey").alias("clause_no"), F.col("n_name").alias("heading"))).select("standard", "r_name", F.array_join("headings", ",").alias("headings")),
    "s7_validate_corpus": lambda s, d: uploads.validate_corpus(read(s, d, "part").select(F.col("p_partkey").alias("standard")), _references(s, d)),
    "s10_load_snapshots": lambda s, d: results.load_snapshots(w.latest_run(runs(s, d)), _unique_findings(s, d)),
    "s13_compliance_report": lambda s, d: results.compliance_report(w.document_view(runs(s, d), findings(s, d)), _unique_findings(s, d)),
    "s14_verify_dataset": lambda s, d: uploads.verify_dataset(_manifest(s, d), _files(s, d)),
    "s16_wire_view": lambda s, d: results.wire_view(runs(s, d).withColumn("status", F.nullif("status", F.lit("failed"))).select("run_id", "doc_id", "status")),
    "st2_session_gaps": lambda s, d: session_gaps(read(s, d, "events").select(F.col("user_id").alias("run_id"), "ts"), "3600 seconds"),
}

_UF = "uf AS (SELECT run_id, finding_no, min(kind) AS kind, min(severity) AS severity FROM findings GROUP BY 1, 2)"
SQL = {
    "s4_read_corpus": "SELECT concat('s-', p_partkey) AS standard_id, 0 AS clause_no, concat('c-', p_partkey) AS id, p_type AS heading, p_name AS text FROM part UNION ALL SELECT concat('s-', p_partkey), 1, concat('d-', p_partkey), p_brand, NULL FROM part",
    "s6_publish_corpus": "SELECT p_partkey, upper(p_name) AS p_name FROM part",
    "s9_write_results": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 25 AS run_id FROM lineitem WHERE l_suppkey % 25 % 3 <> 0 OR l_linenumber = 1",
    "s11_eval_runs": "SELECT doc_id, CAST(quality AS INTEGER) AS quality, 'base' AS run FROM labels UNION ALL SELECT doc_id, CAST(quality AS INTEGER), 'strict' FROM labels WHERE quality = 1",
    "s12_run_metrics": "WITH o AS (SELECT 'r' || o_custkey AS run, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'done' END AS task, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS p FROM orders GROUP BY 1, 2) SELECT run, task, 'n' AS metric, n AS value FROM o UNION ALL SELECT run, task, 'partial', p FROM o WHERE task = 'done'",
    "s12_run_items": """SELECT 'r' || o_custkey AS run, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'done' END AS task, o_orderstatus AS key, string_agg(concat('{"id":', o_orderkey, ',"key":"', o_orderstatus, '"}'), ';' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1, 2, 3""",
    "st1_ingest_stream": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents",
    "s1_scan_uploads": "SELECT concat('d/', doc_id) AS path, CASE WHEN length(concat('d/', doc_id)) % 2 = 0 AND length(text) > 0 THEN 'txt' END AS format, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(concat('d/', doc_id)) % 2 = 1 THEN 'corrupt' END AS error_code FROM documents",
    "s5_load_corpus": "SELECT r_regionkey AS standard, r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS headings FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "s7_validate_corpus": "SELECT 'lineitem' AS source, CAST(l_orderkey AS VARCHAR) AS id, CAST(l_partkey + 3 AS VARCHAR) AS missing FROM lineitem WHERE l_partkey + 3 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT p_partkey FROM part)",
    "s10_load_snapshots": ctes("runs", "findings", "latest") + f", {_UF} SELECT doc_id, l.run_id, coalesce(string_agg(concat_ws(':', finding_no, kind, severity), ';' ORDER BY finding_no), '') AS findings FROM latest l LEFT JOIN uf ON l.run_id = uf.run_id GROUP BY 1, 2",
    "s13_compliance_report": ctes("runs", "findings", "latest", "open", "status", "view") + f", {_UF} SELECT doc_id, concat('# Document ', doc_id, chr(10), chr(10), 'Open issues: ', open_issues, chr(10), chr(10), '| No | Kind | Severity |', chr(10), '| --- | --- | --- |', chr(10), coalesce(t, '')) AS report FROM view_ v LEFT JOIN (SELECT run_id, string_agg(concat('| ', finding_no, ' | ', kind, ' | ', severity, ' |'), chr(10) ORDER BY finding_no) AS t FROM uf GROUP BY 1) u ON v.run_id = u.run_id",
    "s14_verify_dataset": "WITH m AS (SELECT concat('d/', doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000 ELSE 0 END) AS path, CASE WHEN doc_id % 10 = 0 THEN '0' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 7 <> 0), f AS (SELECT concat('d/', doc_id) AS path, sha256(text) AS own FROM documents) SELECT path, state FROM (SELECT path, CASE WHEN own IS NULL THEN 'missing' WHEN sha IS NULL THEN 'unlisted' WHEN sha <> own THEN 'changed' END AS state FROM m FULL JOIN f USING (path)) WHERE state IS NOT NULL",
    "s16_wire_view": ctes("runs") + "SELECT CASE WHEN status = 'failed' THEN concat('{\"runId\":', run_id, ',\"docId\":', doc_id, '}') ELSE concat('{\"runId\":', run_id, ',\"docId\":', doc_id, ',\"status\":\"', status, '\"}') END AS json FROM runs",
    "s13_review_report": ctes("runs", "findings", "latest", "open", "status", "view") + ", " + _CHILDREN + ", " + _REPORT,
    "s10_reassembled_runs": ctes("runs", "findings", "latest") + f""", {_CHILDREN},
      a AS (SELECT run_id, string_agg(CAST(requirement AS VARCHAR), ';' ORDER BY requirement) AS t FROM (SELECT DISTINCT run_id, requirement FROM mapped) GROUP BY 1), b AS (SELECT run_id, string_agg(concat_ws(':', requirement, standard), ';' ORDER BY requirement, standard) AS t FROM mapped GROUP BY 1),
      c AS (SELECT run_id, string_agg(concat_ws(':', finding_no, kind), ';' ORDER BY finding_no) AS t FROM told GROUP BY 1), e AS (SELECT run_id, string_agg(concat_ws(':', finding_no, ordinal, excerpt), ';' ORDER BY finding_no, ordinal) AS t FROM proof GROUP BY 1), m AS (SELECT run_id, string_agg(concat_ws(':', repair_no, proposed), ';' ORDER BY repair_no) AS t FROM mend GROUP BY 1)
      SELECT doc_id, l.run_id, coalesce(a.t, '') AS requirements, coalesce(b.t, '') AS mappings, coalesce(c.t, '') AS findings, coalesce(e.t, '') AS evidence, coalesce(m.t, '') AS repairs FROM latest l LEFT JOIN a ON a.run_id = l.run_id LEFT JOIN b ON b.run_id = l.run_id LEFT JOIN c ON c.run_id = l.run_id LEFT JOIN e ON e.run_id = l.run_id LEFT JOIN m ON m.run_id = l.run_id""",
    "st1_ingest_bad_rows": "SELECT doc_id, CASE WHEN doc_id % 5 <> 4 AND doc_id NOT IN (21, 42) THEN CAST(len(string_split(text, chr(10))) AS INTEGER) END AS lines, CASE WHEN doc_id % 5 = 4 THEN 'other_source' WHEN doc_id IN (21, 42) THEN 'USER_RAISED_EXCEPTION' END AS code FROM documents",
    "st2_stalled_runs": """WITH e AS (SELECT user_id AS run_id, epoch_us(ts) // 1000 AS ms FROM events WHERE ts IS NOT NULL), w AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS now FROM events),
      g AS (SELECT run_id, ms, lead(ms) OVER (PARTITION BY run_id ORDER BY ms) AS next FROM e),
      d AS (SELECT run_id, ms + k * 21600000 AS due, k, next FROM g, (SELECT unnest([1, 2, 3]) AS k))
      SELECT run_id, epoch_ms(due) AS at, CASE WHEN k = 3 THEN 'fail' ELSE 'requeue' END AS action FROM d, w WHERE due <= now AND (next IS NULL OR due < next)""",
    "st2_session_gaps": "WITH e AS (SELECT user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts) AS i FROM e) SELECT run_id, min(ts) AS start, count(*) AS beats FROM g GROUP BY run_id, i",
}
