"""Workspace analytics: each operator is a DataFrame -> DataFrame function.

Tables: runs (run_id, doc_id, status, created_at), findings (run_id, finding_no, kind, severity,
review, standard, requirement, confidence), hits (run_id, requirement, rank, standard, confidence,
explicit). Small fixed dimensions (kinds, bands, severities) are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.numeric import half_up

KINDS = ("conflicting", "missing", "outdated", "certification", "verified")
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
BANDS = ((0, "strong", 80, 100), (1, "fair", 50, 79), (2, "weak", 0, 49))
MAPPING_THRESHOLD = 0.35


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEVERITY_ORDER.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def is_open() -> Column:
    return (F.col("kind") != "verified") & (F.col("review") != "dismissed")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each document; equal times go to the larger run_id."""
    newest = F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != "doc_id"]), F.struct("created_at", "run_id"))
    return runs.groupBy("doc_id").agg(newest.alias("r")).select("doc_id", "r.*")


def document_status(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Failed, Processing, Review required (an open finding above low), else Analyzed, of each latest run."""
    need = findings.where(is_open() & (F.col("severity") != "low")).select("run_id").distinct().withColumn("review_needed", F.lit(True))
    status = F.when(F.col("status") == "failed", "Failed").when(F.col("status").isin("queued", "running"), "Processing").when(F.col("review_needed"), "Review required").otherwise("Analyzed")
    return latest_run(runs).join(need, "run_id", "left").select("doc_id", "run_id", status.alias("document_status"))


def document_view(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of each document's latest run: requirements, standards, open issues, certification standards."""
    per_run = findings.groupBy("run_id").agg(
        F.countDistinct("requirement").alias("requirements"),
        F.countDistinct("standard").alias("standards"),
        F.count_if(is_open()).alias("open_issues"),
        F.countDistinct(F.when(F.col("kind") == "certification", F.col("standard"))).alias("schemes"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("requirements", "standards", "open_issues", "schemes")]
    return document_status(runs, findings).join(per_run, "run_id", "left").select("doc_id", "run_id", "document_status", *zero)


def top_mapped(hits: DataFrame, threshold: float = MAPPING_THRESHOLD) -> DataFrame:
    return hits.where((F.col("rank") == 0) & ((F.col("confidence") >= threshold) | F.col("explicit"))).select("run_id", "requirement", "standard", "confidence")


def summary_of(view: DataFrame, heavy: tuple[str, ...]) -> DataFrame:
    return view.drop(*heavy)


def findings_feed(findings: DataFrame, kind: str | None = None, severity: str | None = None, review: str | None = None, run_id: int | None = None) -> DataFrame:
    """Findings by equality filters, which reach the scan."""
    for column, value in (("kind", kind), ("severity", severity), ("review", review), ("run_id", run_id)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
    return findings


def standard_usage(findings: DataFrame) -> DataFrame:
    return findings.groupBy("standard").agg(F.count(F.lit(1)).alias("requirements"), F.countDistinct("run_id").alias("documents"), F.count_if(is_open()).alias("open_findings"))


def domain_rollup(usage: DataFrame, standards: DataFrame) -> DataFrame:
    """Usage by category; standards without use count, with zero requirements."""
    return standards.join(usage, "standard", "left").groupBy("category").agg(F.sum(F.coalesce("requirements", F.lit(0))).alias("requirements"), F.count("requirements").alias("standards_used"), F.count(F.lit(1)).alias("standards"))


def readiness(findings: DataFrame) -> DataFrame:
    """round(clamp(100 mapped / total - (8 high + 3 medium + low))) of each run; verified and dismissed ones cost nothing."""
    cost = F.when(~is_open(), 0).when(F.col("severity") == "high", 8).when(F.col("severity") == "medium", 3).otherwise(1)
    sums = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") >= MAPPING_THRESHOLD).alias("mapped"), F.sum(cost).alias("penalty"))
    raw = F.lit(100.0) * F.col("mapped") / F.col("total") - F.col("penalty")
    return sums.select("run_id", "total", "mapped", "penalty", half_up(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))).cast("int").alias("score"))


def readiness_bands(scores: DataFrame) -> DataFrame:
    """How many runs are in each band; empty bands count 0."""
    bands = scores.sparkSession.createDataFrame(BANDS, "band_no int, band string, low int, high int")
    named = scores.select(F.when(F.col("score") >= 80, 0).when(F.col("score") >= 50, 1).otherwise(2).alias("band_no"))
    counts = named.groupBy("band_no").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bands).join(counts, "band_no", "left").select("band", F.coalesce("n", F.lit(0)).alias("documents"))


def daily_activity(events: DataFrame, last: str, days: int = 14, zone: str = "Asia/Kolkata") -> DataFrame:
    """Events of each of the local calendar days up to last, zero-filled."""
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    counts = events.select(F.to_date(F.from_utc_timestamp("ts", zone)).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(spine).join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("events"))


def organisation_rollup(scores: DataFrame, owners: DataFrame, top: int = 5) -> DataFrame:
    """Documents and rounded mean readiness by organisation; the top ones by documents, then name."""
    per = scores.join(owners, "run_id").groupBy("organisation").agg(F.count(F.lit(1)).alias("documents"), half_up(F.sum("score") / F.count(F.lit(1))).cast("int").alias("readiness"))
    return per.orderBy(F.desc("documents"), "organisation").limit(top)


def usage_network(findings: DataFrame, documents: int = 6, standards: int = 8) -> DataFrame:
    """Edges between the busiest documents and the most used standards: weight and tone (conflict, gap, ok)."""
    docs = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run_id").limit(documents)
    stds = findings.groupBy("standard").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "standard").limit(standards)
    tone = F.max(F.when(F.col("kind") == "conflicting", 2).when(F.col("kind") == "missing", 1).otherwise(0))
    edges = findings.join(F.broadcast(docs), "run_id", "left_semi").join(F.broadcast(stds), "standard", "left_semi").groupBy("run_id", "standard").agg(F.count(F.lit(1)).alias("weight"), tone.alias("t"))
    return edges.select("run_id", "standard", "weight", F.element_at(F.array(F.lit("ok"), F.lit("gap"), F.lit("conflict")), F.col("t") + 1).alias("tone"))


def status_counts(findings: DataFrame) -> DataFrame:
    kinds = findings.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return F.broadcast(kinds).join(findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("findings"))


def count_by(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def priority_findings(findings: DataFrame, top: int = 6) -> DataFrame:
    """Open findings by severity, then run and number."""
    return findings.where(is_open()).orderBy(severity_rank(F.col("severity")), "run_id", "finding_no").limit(top).select("run_id", "finding_no", "kind", "severity")


def most_issues(view: DataFrame, top: int = 4) -> DataFrame:
    return view.where("open_issues > 0").orderBy(F.desc("open_issues"), "doc_id").limit(top).select("doc_id", "open_issues")


def workspace_stats(view: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of totals; the mean readiness of finished documents is null when there are none."""
    done = F.col("document_status").isin("Analyzed", "Review required")
    return view.join(scores.select("run_id", "score"), "run_id", "left").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(done).alias("done"),
        F.count_if(F.col("document_status") == "Processing").alias("processing"),
        F.count_if(F.col("document_status") == "Failed").alias("failed"),
        F.count_if(F.col("document_status") == "Review required").alias("need_attention"),
        half_up(F.avg(F.when(done, F.col("score")))).cast("int").alias("average_readiness"),
    )


def text_filter(table: DataFrame, columns: list[str], term: str, **equal) -> DataFrame:
    """Rows whose concatenated columns contain term in any case, with equality filters."""
    hit = F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.lower()))
    for column, value in equal.items():
        hit = hit & (F.col(column) == value)
    return table.where(hit)


def audit_trail(events: DataFrame, users: DataFrame) -> DataFrame:
    """(event_id, ts, user_id, event_type, props JSON) left-joined to (user_id, name), with a compact detail of non-null fields."""
    fields = ["page", "ref", "k"]
    parts = [F.concat(F.lit(f"{f}="), F.get_json_object("props", f"$.{f}")) for f in fields]
    return events.join(users, "user_id", "left").select("event_id", "user_id", F.coalesce("name", F.lit("system")).alias("actor"), "event_type", F.concat_ws("; ", *parts).alias("detail"))


def current_decision(events: DataFrame) -> DataFrame:
    """(entity, event_id, at, decision, edited, recommended) -> the state that the latest event of each entity leaves.

    edited text counts when edited, the recommended one when accepted, none when rejected; pending clears.
    """
    last = events.groupBy("entity").agg(F.max_by(F.struct("decision", "edited", "recommended"), F.struct("at", "event_id")).alias("e"))
    text = F.when(F.col("e.decision") == "edited", F.col("e.edited")).when(F.col("e.decision") == "accepted", F.col("e.recommended"))
    return last.select("entity", F.col("e.decision").alias("decision"), text.alias("applied"))


def stalled_runs(runs: DataFrame, now: str, stale_seconds: int = 90, attempts: int = 3) -> DataFrame:
    """(run_id, status, heartbeat, attempt) of running runs without a recent heartbeat -> requeue or fail."""
    old = F.col("heartbeat").isNull() | (F.col("heartbeat") < F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(stale_seconds)))
    return runs.where((F.col("status") == "running") & old).select("run_id", F.when(F.col("attempt") >= attempts, "fail").otherwise("requeue").alias("action"))


def needs_rerun(documents: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, old_type, new_type), (type, flags...) -> documents whose change of type alters the flags in force."""
    flags = [c for c in types.columns if c != "type"]
    old = F.broadcast(types.select(F.col("type").alias("old_type"), *[F.col(c).alias(f"old_{c}") for c in flags]))
    new = F.broadcast(types.select(F.col("type").alias("new_type"), *[F.col(c).alias(f"new_{c}") for c in flags]))
    differs = F.lit(False)
    for c in flags:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return documents.join(old, "old_type").join(new, "new_type").where(differs).select("doc_id", "old_type", "new_type")


def eval_headline(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(run, metric, value) long -> one column a metric."""
    return runs.groupBy("run").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def latest_per_config(runs: DataFrame) -> DataFrame:
    """(config, run, at, value) -> each configuration's latest run, with the best value of all its runs."""
    return runs.groupBy("config").agg(F.max_by("run", F.struct("at", "run")).alias("run"), F.max_by("value", F.struct("at", "run")).alias("latest"), F.max("value").alias("best"))


def change_impact(changes: DataFrame, usage: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Documents that a changed standard affects, directly or through a standard that builds on it.

    changes (change_id, standard, severity), usage (doc_id, standard), ancestors (standard, ancestor).
    A document in direct use is reported once, without via; otherwise via is its least ancestor used.
    """
    direct = changes.join(usage, "standard").select("change_id", "doc_id").distinct()
    via = changes.join(ancestors, "standard").select("change_id", "ancestor").join(usage.withColumnRenamed("standard", "ancestor"), "ancestor").groupBy("change_id", "doc_id").agg(F.min("ancestor").alias("via"))
    indirect = via.join(direct, ["change_id", "doc_id"], "left_anti")
    return direct.withColumn("via", F.lit(None).cast("long")).unionByName(indirect)


def change_kpis(changes: DataFrame, impact: DataFrame) -> DataFrame:
    per = impact.groupBy("change_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("via").isNull()).alias("direct"))
    return changes.join(per, "change_id", "left").agg(
        F.count_if(F.col("n") > 0).alias("affecting"), F.sum(F.coalesce("n", F.lit(0))).alias("affected"), F.count_if((F.col("severity") == "high") & (F.col("n") > 0)).alias("high"), F.sum(F.coalesce("direct", F.lit(0))).alias("direct"), F.sum(F.coalesce(F.col("n") - F.col("direct"), F.lit(0))).alias("indirect")
    )


def alerts(changes: DataFrame, impact: DataFrame, top: int = 5) -> DataFrame:
    per = impact.groupBy("change_id").agg(F.count(F.lit(1)).alias("n"))
    return changes.join(per, "change_id", "left").select("change_id", "severity", F.coalesce("n", F.lit(0)).alias("affected")).orderBy((F.col("affected") > 0).desc(), severity_rank(F.col("severity")), "change_id").limit(top)
