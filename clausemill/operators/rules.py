"""Rule operators: limits, inconsistencies, gaps, versions, findings and repairs as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.numeric import half_up
from clausemill.functions.scratch import keep, laid_out, none_left
from clausemill.functions.text import designation_key
from clausemill.operators import facts

SEVERITIES = ("high", "medium", "low")
KIND_ORDER = ("conflicting", "missing", "outdated", "certification", "verified")


def applicability(hits: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(doc, req, standard, confidence, explicit) -> one row per document and standard: confidence, explicit, requirements."""
    kept = hits.where((F.col("confidence") >= threshold) | F.col("explicit"))
    return kept.groupBy("doc", "standard").agg(F.max("confidence").alias("confidence"), F.bool_or("explicit").alias("explicit"), F.array_sort(F.collect_set("req")).alias("requirements"))


def strong_applicable(applicable: DataFrame, scope: DataFrame, competitors: DataFrame, gate: float = 0.5) -> DataFrame:
    """Explicit ones, or sure ones in scope (doc, standard) without a cited competitor (doc, standard)."""
    explicit = applicable.where("explicit")
    rest = applicable.where(f"not explicit and confidence >= {gate}").join(scope, ["doc", "standard"], "left_semi").join(competitors, ["doc", "standard"], "left_anti")
    return explicit.unionByName(rest)


def interval_compare(rmin: Column, rmax: Column, cmin: Column, cmax: Column) -> Column:
    """none, partial or disjoint, and the side, of a stated interval against a limit; null bounds are unstated."""
    below = F.coalesce(rmin < cmin, F.lit(False)) | (rmin.isNull() & F.coalesce(rmax < cmin, F.lit(False)))
    above = F.coalesce(rmax > cmax, F.lit(False)) | (rmax.isNull() & F.coalesce(rmin > cmax, F.lit(False)))
    outside = F.coalesce(rmax < cmin, F.lit(False)) | F.coalesce(rmin > cmax, F.lit(False))
    overlap = F.when(~below & ~above, "none").when(outside, "disjoint").otherwise("partial")
    return F.struct(overlap.alias("overlap"), F.when(above, "above").when(below, "below").alias("side"))


def check_constraints(values: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc, req, standard, parameter, lo, hi) against (standard, parameter, cmin, cmax): an equi-join, then the comparison."""
    both = values.join(limits, ["standard", "parameter"])
    return both.withColumn("c", interval_compare(F.col("lo"), F.col("hi"), F.col("cmin"), F.col("cmax"))).select("doc", "req", "standard", "parameter", "lo", "hi", "cmin", "cmax", "c.overlap", "c.side")


def drop_ambiguous(checks: DataFrame, hits: DataFrame, explicit: DataFrame, window: float = 0.15) -> DataFrame:
    """checks without violations that a close runner-up accepts: another hit of the requirement within `window` of its best one, whose limit of the parameter holds.

    checks (doc, req, standard, parameter, overlap …) over all hits (doc, req, standard, confidence);
    what a requirement cites itself (doc, req, standard) stays.
    """
    best = hits.groupBy("doc", "req").agg(F.max("confidence").alias("best"))
    close = hits.join(best, ["doc", "req"]).where(F.col("confidence") >= F.col("best") - window).select("doc", "req", F.col("standard").alias("rival")).distinct()
    accepts = checks.where("overlap = 'none'").select("doc", "req", "parameter", F.col("standard").alias("rival")).distinct().join(close, ["doc", "req", "rival"])
    keys = ["doc", "req", "standard", "parameter"]
    open_ = checks.where("overlap <> 'none'").select(*keys).distinct().join(explicit.select("doc", "req", "standard").distinct(), ["doc", "req", "standard"], "left_anti")
    doubtful = open_.join(accepts, ["doc", "req", "parameter"]).where("standard <> rival").select(*keys, F.lit("x").alias("_x")).distinct()
    marked = checks.join(doubtful, keys, "left")
    return marked.where("_x is null or overlap = 'none'").select(*checks.columns)


def constraint_conflicts(checks: DataFrame) -> DataFrame:
    """The first violation of each (doc, req, parameter, standard): high at .9 if disjoint, else medium at .75."""
    first = Window.partitionBy("doc", "req", "parameter", "standard").orderBy("cmin", "cmax", "lo", "hi")
    bad = checks.where("overlap <> 'none'").withColumn("n", F.row_number().over(first)).where("n = 1")
    disjoint = F.col("overlap") == "disjoint"
    return bad.select("doc", "req", "standard", "parameter", "side", F.when(disjoint, "high").otherwise("medium").alias("severity"), F.when(disjoint, 0.9).otherwise(0.75).alias("confidence"))


#: Rows, or blocks of the level below, in one block of the search for the first later disagreement, as a power of two.
BLOCK_BITS = 7


def _first_later(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows (group, req, lo, hi) -> (group, req, other): the first later requirement whose interval does not overlap.

    Rows lie in order of group and req. Blocks of 2**BLOCK_BITS neighbours of a group keep their largest
    lower and least upper bound, blocks of blocks likewise. A row looks behind itself in its block, then
    behind the block among its neighbours, and so on up; where bounds show a disagreement it goes down
    again to the first row that disagrees. Each step is an equi-join with one block, so the work grows
    with the rows times the number of levels, and a group of any size is spread over tasks.
    """
    laid = laid_out(rows.select(*group, "req", "lo", "hi"), *[F.col(c) for c in group], F.col("req"))
    parent = F.shiftright("idx", BLOCK_BITS).alias("parent")
    nodes, levels = laid.select(*group, F.col("at").alias("idx"), "lo", "hi", "req"), []
    while True:
        kid = F.struct("idx", "lo", "hi", *(["req"] if not levels else []))
        blocks = keep(nodes.groupBy(*group, parent).agg(F.array_sort(F.collect_list(kid)).alias("kids")))
        levels.append(blocks)
        nodes = blocks.select(*group, F.col("parent").alias("idx"), F.array_max(F.transform("kids", lambda x: x["lo"])).alias("lo"), F.array_min(F.transform("kids", lambda x: x["hi"])).alias("hi"))
        if none_left(nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")):
            break
    apart = lambda x: (x["lo"] > F.col("hi")) | (x["hi"] < F.col("lo"))
    # Up: pos is the row or block that the search has come from.
    climbing, turned = laid.select(*group, "req", "lo", "hi", F.col("at").alias("idx")), []
    for blocks in levels:
        looked = climbing.withColumn("parent", parent).join(blocks, [*group, "parent"])
        looked = keep(looked.select(*group, "req", "lo", "hi", "parent", F.get(F.filter("kids", lambda x: (x["idx"] > F.col("idx")) & apart(x)), F.lit(0)).alias("kid")))
        turned.append(looked.where("kid is not null").drop("parent"))
        climbing = looked.where("kid is null").select(*group, "req", "lo", "hi", F.col("parent").alias("idx"))
    # Down: from the highest level, to the first kid that disagrees.
    down = None
    for level in range(len(levels) - 1, 0, -1):
        here = turned[level].select(*group, "req", "lo", "hi", F.col("kid.idx").alias("parent"))
        if down is not None:
            here = here.unionByName(down.select(*group, "req", "lo", "hi", F.col("kid.idx").alias("parent")))
        down = here.join(levels[level - 1], [*group, "parent"]).select(*group, "req", "lo", "hi", F.get(F.filter("kids", apart), F.lit(0)).alias("kid"))
    found = turned[0] if down is None else turned[0].unionByName(down)
    return found.select(*group, "req", F.col("kid.req").alias("other"))


def internal_inconsistency(values: DataFrame) -> DataFrame:
    """(doc, req, parameter, lo, hi) -> (doc, parameter, req, other): a requirement and the first later one whose interval of the parameter does not overlap; open bounds are infinite.

    A group can only hold such a pair if its largest lower bound exceeds its least upper bound; other
    groups are left out. Groups of a block's size at most are searched in an array each, larger ones
    as _first_later() does. Rows without document, parameter or number disagree with nothing.
    """
    keys = ["doc", "parameter"]
    open_ = values.where("req is not null").withColumn("lo", F.coalesce("lo", F.lit(float("-inf")))).withColumn("hi", F.coalesce("hi", F.lit(float("inf"))))
    # Two requirements disagree by some values of theirs if and only if these extremes do.
    each = open_.groupBy(*keys, "req").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    torn = keep(each.groupBy(*keys).agg(F.max("lo").alias("a"), F.min("hi").alias("b"), F.count(F.lit(1)).alias("n")).where("a > b and doc is not null and parameter is not null").select(*keys, "n"))
    small = each.join(torn.where(F.col("n") <= 1 << BLOCK_BITS), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("req", "lo", "hi"))).alias("all"))
    later = lambda x: F.get(F.filter("all", lambda y: (y["req"] > x["req"]) & ((y["lo"] > x["hi"]) | (y["hi"] < x["lo"]))), F.lit(0))["req"]
    found = small.select(*keys, F.inline(F.transform("all", lambda x: F.struct(x["req"].alias("req"), later(x).alias("other"))))).where("other is not null")
    large = torn.where(F.col("n") > 1 << BLOCK_BITS).select(*keys)
    return found if none_left(large) else found.unionByName(_first_later(each.join(large, keys, "left_semi"), keys))


def edition_conflicts(citations: DataFrame) -> DataFrame:
    """(doc, standard, year): standards that a document cites by several years."""
    return citations.groupBy("doc", "standard").agg(F.countDistinct("year").alias("years"), F.min("year").alias("first"), F.max("year").alias("last")).where("years >= 2")


def version_findings(citations: DataFrame, standards: DataFrame) -> DataFrame:
    """(doc, req, standard, year, resolution) x (standard, own_year, status, amended) -> the first rule that holds for each citation."""
    rows = citations.join(standards, "standard")
    old, newer = F.col("year") < F.col("own_year"), F.col("year") > F.col("own_year")
    rules = [(F.col("status").isin("superseded", "withdrawn"), "superseded_reference", "high", F.col("resolution") * 0.85), (old, "superseded_edition", "medium", F.col("resolution") * 0.85), (newer, "newer_edition", "low", F.lit(0.6)), (F.col("amended"), "amendment_check", "low", F.lit(0.6))]
    found = F.lit(None).cast("struct<rule:string,severity:string,confidence:double>")
    for condition, rule, severity, confidence in reversed(rules):
        found = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), confidence.cast("double").alias("confidence"))).otherwise(found)
    return rows.withColumn("f", found).where("f is not null").select("doc", "req", "standard", "f.rule", "f.severity", F.round("f.confidence", 6).alias("confidence"))


def amendment_dedupe(findings: DataFrame) -> DataFrame:
    """One amendment reminder a document and standard; later ones become its evidence count."""
    reminder = F.col("rule") == "amendment_check"
    one = findings.where(reminder).groupBy("doc", "standard").agg(F.min("req").alias("req"), F.count(F.lit(1)).alias("citations"))
    rest = findings.where(~reminder).select("doc", "standard", "req", F.lit(1).cast("long").alias("citations"), "rule")
    return one.withColumn("rule", F.lit("amendment_check")).unionByName(rest)


def checklist_gaps(applicable: DataFrame, checklist: DataFrame, stated: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Items (standard, parameter, severity) that apply to a document and that it states no value of, first standard per parameter.

    Mentioned without a value: insufficient_specification at .75, low; never mentioned: checklist_gap at .7.
    """
    wanted = applicable.select("doc", "standard").join(checklist, "standard")
    missing = wanted.join(stated, ["doc", "parameter"], "left_anti").join(mentioned.select("doc", "parameter", F.lit(True).alias("mentioned")).distinct(), ["doc", "parameter"], "left")
    first = missing.groupBy("doc", "parameter").agg(F.min_by(F.struct("standard", "severity", "mentioned"), "standard").alias("m"))
    said = F.coalesce(F.col("m.mentioned"), F.lit(False))
    return first.select("doc", "parameter", "m.standard", F.when(said, "insufficient_specification").otherwise("checklist_gap").alias("rule"), F.when(said, "low").otherwise(F.col("m.severity")).alias("severity"), F.when(said, 0.75).otherwise(0.7).alias("confidence"))


def dependency_gaps(cited: DataFrame, edges: DataFrame, addressed: DataFrame, floor: float = 0.7) -> DataFrame:
    """Standards that a cited one requires or is tested by (confidence at least floor) and that the document does not address, once each."""
    sure = edges.where((F.col("confidence") >= floor) & F.col("type").isin("TESTED_BY", "REQUIRES"))
    wanted = cited.join(sure, cited["standard"] == sure["src"]).select("doc", "standard", F.col("dst").alias("target"), "confidence")
    gone = addressed.select("doc", F.col("standard").alias("target"))
    missing = wanted.join(gone, ["doc", "target"], "left_anti")
    return missing.groupBy("doc", "target").agg(F.min("standard").alias("standard"), F.round(F.least(F.lit(0.85), F.max("confidence")), 6).alias("confidence"))


def certification_gaps(applicable: DataFrame, schemes: DataFrame, evidence: DataFrame) -> DataFrame:
    """One finding a document: its applicable standards with a scheme and without covering evidence, in order."""
    open_ = applicable.select("doc", "standard").join(schemes, "standard", "left_semi").join(evidence, ["doc", "standard"], "left_anti")
    return open_.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set(F.col("standard").cast("string"))), ",").alias("standards"), F.countDistinct("standard").alias("n"))


def result_nonconformity(observed: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc, parameter, value) against (doc, parameter, low, high) with 1e-9 slack; severity by relative deviation."""
    rows = observed.join(limits, ["doc", "parameter"])
    over = F.greatest(F.col("value") - F.col("high"), F.col("low") - F.col("value"))
    share = over / F.greatest(F.abs(F.when(F.col("value") > F.col("high"), F.col("high")).otherwise(F.col("low"))), F.lit(1e-9))
    bad = rows.where(over > 1e-9).withColumn("severity", F.when(share > 0.1, "high").when(share <= 0.02, "low").otherwise("medium"))
    return bad.groupBy("doc", "parameter", "value").agg(F.min_by("severity", F.struct("low", "high")).alias("severity"))


# Which side of a bare declared value is acceptable, parameters of safety, and those accepted within a tolerance.
POLARITY = {
    "efficiency": "min", "pump_head": "min", "flow_rate": "min", "short_circuit_rating": "min", "compressive_strength": "min", "noise_level": "max", "earth_resistance": "max", "conductor_temperature": "max",
    "turbidity": "max", "tds": "max", "fluoride": "max", "nitrate": "max", "chloride": "max", "arsenic": "max", "total_hardness": "max",
}
SAFETY = ("earth_resistance", "turbidity", "tds", "fluoride", "nitrate", "chloride", "arsenic", "total_hardness")
TOLERATED = ("flow_rate", "pump_head")


def limit_bounds(limits: DataFrame) -> DataFrame:
    """(…, parameter, comparator, value, lo, hi) with what a limit admits as low and high: a bare value is a minimum or maximum by the parameter's polarity; bare values without one go."""
    side = F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])[F.col("parameter")]
    bare = F.coalesce(F.col("comparator").isin("eq", "tolerance"), F.lit(False)) & F.col("value").isNotNull()
    infinite = F.lit(float("inf"))
    low = F.when(~bare, F.coalesce("lo", -infinite)).when(side == "min", F.col("value")).when(side == "max", -infinite)
    high = F.when(~bare, F.coalesce("hi", infinite)).when(side == "min", infinite).when(side == "max", F.col("value"))
    return limits.withColumn("low", low).withColumn("high", high).where("low is not null")


def report_nonconformity(observed: DataFrame, limits: DataFrame) -> DataFrame:
    """Results of a report outside a limit that it states: (doc, req, parameter, value, side, bound, severity).

    observed and limits: (doc, req, ord, parameter, dimension, comparator, value, lo, hi), ord the place
    in the requirement. A result is held against the limits of its own requirement if that has any of
    its parameter and dimension, else against those of the whole report; the first that it breaks
    counts, and of equal results of a parameter the first. Severity is high for parameters of safety
    and deviations over 10 %, low for those accepted within a tolerance up to 2 %, else medium.

    Of a report's limits only those are looked at that are tighter than all before them: the first
    broken one is always among these, so results don't meet every limit.
    """
    keys = ["doc", "parameter", "dimension"]
    place = F.struct(F.col("req").alias("l_req"), F.col("ord").alias("l_ord"))
    bounds = limit_bounds(limits).select(*keys, "req", "ord", "low", "high")
    rows = observed.select(*keys, "req", "ord", "value", F.coalesce("lo", "value").alias("v_lo"), F.coalesce("hi", "value").alias("v_hi"))
    own = bounds.select(*keys, "req").distinct()
    inside = rows.join(own, [*keys, "req"], "left_semi").join(bounds.select(*keys, "req", "low", "high", place.alias("place")), [*keys, "req"])
    before = Window.partitionBy(*keys).orderBy("req", "ord").rowsBetween(Window.unboundedPreceding, -1)
    tighter = (F.col("high") < F.coalesce(F.min("high").over(before), F.lit(float("inf")))) | (F.col("low") > F.coalesce(F.max("low").over(before), F.lit(float("-inf"))))
    records = bounds.withColumn("_t", tighter).where("_t").select(*keys, "low", "high", place.alias("place"))
    across = rows.join(own, [*keys, "req"], "left_anti").join(records, keys)
    columns = ["doc", "req", "ord", "parameter", "value", "v_lo", "v_hi", "low", "high", "place"]
    over, under = F.col("v_hi") > F.col("high") + 1e-9, F.col("v_lo") < F.col("low") - 1e-9
    broken = inside.select(*columns).unionByName(across.select(*columns)).where(over | under)
    first = broken.groupBy("doc", "req", "ord", "parameter", "value", "v_lo", "v_hi").agg(F.min_by(F.struct("low", "high"), "place").alias("limit"))
    once = first.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "parameter", "value").orderBy("req", "ord", "v_lo", "v_hi"))).where("_n = 1")
    above = F.col("v_hi") > F.col("limit.high") + 1e-9
    bound = F.when(above, F.col("limit.high")).otherwise(F.col("limit.low"))
    out = once.select("doc", "req", "parameter", "value", F.when(above, "above").otherwise("below").alias("side"), bound.alias("bound"), F.when(above, F.col("v_hi")).otherwise(F.col("v_lo")).alias("_v"))
    deviation = F.when(F.col("bound") != 0, F.abs(F.col("_v") - F.col("bound")) / F.abs("bound")).otherwise(1.0)
    severity = F.when(F.col("parameter").isin(*SAFETY) | (deviation > 0.1), "high").when(F.col("parameter").isin(*TOLERATED) & (deviation <= 0.02), "low").otherwise("medium")
    return out.withColumn("severity", severity).drop("_v")


def qualified_checks(checks: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """checks (doc, …, qualifier) whose limit applies: it has no qualifier `key=value`, or the document states that value, in any case; qualifiers (doc, key, value)."""
    key, value = F.substring_index("qualifier", "=", 1), F.lower(F.substring(F.col("qualifier"), F.length(F.substring_index("qualifier", "=", 1)) + 2, F.length("qualifier")))
    stated = qualifiers.select("doc", F.col("key").alias("_key"), F.lower("value").alias("_value")).where("_key is not null").distinct().withColumn("_stated", F.lit(True))
    marked = checks.withColumn("_key", key).withColumn("_value", value).join(stated, ["doc", "_key", "_value"], "left")
    return marked.where("qualifier is null or qualifier = '' or _stated").select(*checks.columns)


def replaced_certification_gaps(applicable: DataFrame, standards: DataFrame, replacements: DataFrame, evidence: DataFrame) -> DataFrame:
    """certification_gaps() where a superseded standard (standard, status, kind, scheme) stands for what replaced it (node, latest); only product standards with a scheme need evidence."""
    status = standards.select("standard", F.col("status").isin("superseded", "withdrawn").alias("_old"))
    latest = replacements.select(F.col("node").alias("standard"), "latest")
    now = applicable.join(status, "standard").join(latest, "standard", "left").where("not _old or latest is not null")
    current = now.select("doc", F.when(F.col("_old"), F.col("latest")).otherwise(F.col("standard")).alias("standard")).distinct()
    return certification_gaps(current, standards.where("kind = 'product' and scheme is not null").select("standard"), evidence)


def verified_references(resolved: DataFrame, standards: DataFrame, taken: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc, req, standard, edition, confidence): of requirements not yet flagged or verified (doc, req) the first reference to a standard in force, of its current edition or none.

    resolved (doc, req, c_no, standard, edition, confidence) of at least `least`; the finding is 0.9
    times as sure.
    """
    live = standards.where("status not in ('superseded', 'withdrawn')").select("standard")
    rows = resolved.where(F.col("edition").isin("current", "unspecified") & (F.col("confidence") >= least)).join(live, "standard", "left_semi").join(taken.select("doc", "req").distinct(), ["doc", "req"], "left_anti")
    first = rows.groupBy("doc", "req").agg(F.min_by(F.struct("standard", "edition", "confidence"), F.struct("c_no", "standard")).alias("r"))
    return first.select("doc", "req", "r.standard", "r.edition", F.round(F.col("r.confidence") * 0.9, 6).alias("confidence"))


def verified_constraints(checks: DataFrame) -> DataFrame:
    """Satisfied checks of requirements without any violation, once a requirement."""
    bad = checks.where("overlap <> 'none'").select("doc", "req").distinct()
    return checks.where("overlap = 'none'").join(bad, ["doc", "req"], "left_anti").groupBy("doc", "req").agg(F.min("standard").alias("standard"))


def assemble_findings(findings: DataFrame) -> DataFrame:
    """Findings (doc, kind, severity, ord) numbered by kind, then severity, then their own order."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    order = Window.partitionBy("doc").orderBy(rank("kind", KIND_ORDER), rank("severity", SEVERITIES), "ord")
    return findings.withColumn("local_id", F.concat(F.lit("f-"), F.row_number().over(order)))


def report_cap(scores: DataFrame, conflicts: DataFrame) -> DataFrame:
    """A report's score is at most 40, 70 or 90 by its worst conflict."""
    cap = conflicts.groupBy("doc").agg(F.min(F.when(F.col("severity") == "high", 40).when(F.col("severity") == "medium", 70).otherwise(90)).alias("cap"))
    return scores.join(cap, "doc", "left").select("doc", F.least("score", F.coalesce("cap", F.lit(100))).alias("score"))


def repairs(conflicts: DataFrame) -> DataFrame:
    """(…, text, value, cmin, cmax, side): the stated number clamped to the limit, first occurrence in the text."""
    new = F.when(F.col("side") == "above", F.col("cmax")).otherwise(F.col("cmin")).cast("long").cast("string")
    old = F.col("value").cast("long").cast("string")
    at = F.instr("text", old)
    return conflicts.withColumn("repaired", F.when(at > 0, F.overlay("text", new, at, F.length(old))).otherwise(F.col("text")))


# The wording of repairs.
TESTS_CLAUSE = ("Tests shall be carried out in accordance with ", ", and the test certificates shall be submitted for acceptance.")
CONFORM_CLAUSE = ("The equipment shall also conform to ", " where applicable.")
EVIDENCE_CLAUSE = ("The supplier shall furnish evidence of conformity to ", ": a valid BIS licence (Standard Mark) for each offered product and/or type-test reports from an accredited laboratory, as decided by the purchaser.")
VAGUE_CLAUSE = (" — [state the measurable value or acceptance criterion", "].")


def repair_texts(findings: DataFrame) -> DataFrame:
    """Adds recommended: the wording that mends a finding, by its rule; null where none is known.

    findings (…, rule, text, raw, target, number, template, is_test, companions, heading): a limit
    puts target for raw and cites the standard, a gap takes its checklist item's template, a missing
    dependency or conformity evidence a clause, an old citation its replacement with companions, a
    vague requirement a placeholder. Only the first occurrence of raw is replaced.
    """
    at = F.instr("text", F.coalesce("raw", F.lit("\u0000")))
    put = lambda new: F.when(at > 0, F.overlay("text", new, at, F.length("raw"))).otherwise(F.col("text"))
    limited = F.regexp_replace(F.trim(put(F.col("target"))), r"\.$", "")
    cited = F.when(F.contains(limited, "number"), F.concat(limited, F.lit("."))).otherwise(F.concat(limited, F.lit(", in accordance with "), "number", F.lit(".")))
    around = lambda parts: F.concat(F.lit(parts[0]), F.col("number"), F.lit(parts[1]))
    replaced = put(F.when(F.coalesce("companions", F.lit("")) != "", F.concat("number", F.lit(" and "), "companions")).otherwise(F.col("number")))
    per = F.when(F.col("number").isNotNull(), F.concat(F.lit(" per "), "number", F.coalesce(F.concat(F.lit(" ("), "heading", F.lit(")")), F.lit("")))).otherwise("")
    rule = F.col("rule")
    text = (
        F.when((rule == "constraint_conflict") & F.col("target").isNotNull(), cited)
        .when(rule.isin("checklist_gap", "insufficient_specification"), F.replace("template", F.lit("{standard}"), "number"))
        .when(rule == "dependency_gap", F.when(F.col("is_test"), around(TESTS_CLAUSE)).otherwise(around(CONFORM_CLAUSE)))
        .when(rule.isin("superseded_reference", "superseded_edition") & (at > 0), replaced)
        .when(rule == "conformity_evidence_missing", around(EVIDENCE_CLAUSE))
        .when(rule == "vague_requirement", F.concat(F.regexp_replace("text", r"\.$", ""), F.lit(VAGUE_CLAUSE[0]), per, F.lit(VAGUE_CLAUSE[1])))
    )
    return findings.withColumn("recommended", F.trim(F.regexp_replace(text, r"\s+", " ")))


def rewrite_guard(rows: DataFrame) -> DataFrame:
    """(…, original, rewrite) -> ok and reason: same numbers as often, same citations, same placeholders, at most half longer plus 40 characters."""
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"([0-9]+(\.[0-9]+)?)"), F.lit(1)))
    holes = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\])"), F.lit(1)))
    cites = lambda c: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(f"({facts.CITATION})"), F.lit(1)), lambda x: designation_key(x)))
    reason = F.when(numbers(F.col("original")) != numbers(F.col("rewrite")), "numbers").when(cites("original") != cites("rewrite"), "citations").when(holes("original") != holes("rewrite"), "placeholders").when(F.length("rewrite") > F.length("original") * 1.5 + 40, "length")
    return rows.withColumn("reason", reason).withColumn("ok", reason.isNull())


def readiness_score(total: Column, mapped: Column, high: Column, medium: Column, low: Column) -> Column:
    raw = F.lit(100.0) * mapped / F.nullif(total, F.lit(0)) - (high * 8 + medium * 3 + low)
    return half_up(F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))).cast("int")


def in_scope(pairs: DataFrame, doc_terms: DataFrame, standard_terms: DataFrame) -> DataFrame:
    """(doc, standard) with scope: a term of the document matches the standard; documents without terms are in scope.

    Only the terms of the pairs' own standards are looked up: a term of many standards costs no more than another.
    """
    own = pairs.select("doc", "standard").distinct().join(standard_terms.select("standard", "term").distinct(), "standard")
    match = own.join(doc_terms.select("doc", "term"), ["doc", "term"], "left_semi").select("doc", "standard", F.lit(True).alias("hit")).distinct()
    some = doc_terms.select("doc", F.lit(True).alias("has_terms")).distinct()
    rows = pairs.join(match, ["doc", "standard"], "left").join(some, "doc", "left")
    return rows.select("doc", "standard", (F.coalesce("hit", F.lit(False)) | F.col("has_terms").isNull()).alias("scope"))


def qualifiers(attributes: DataFrame, parameters: list[str]) -> DataFrame:
    """The values that a document states of each qualifying parameter, in order."""
    return attributes.where(F.col("parameter").isin(parameters)).groupBy("doc", "parameter").agg(F.array_join(F.array_sort(F.collect_set("text")), ",").alias("stated"))


def candidate_standards(cited: DataFrame, top_hits: DataFrame, gate: float = 0.5) -> DataFrame:
    """(doc, req, standard): cited ones, and the own top hit where sure and in scope; a cited one counts once, as cited."""
    own = top_hits.where((F.col("confidence") >= gate) & F.col("scope")).select("doc", "req", "standard", F.lit(1).alias("ord"))
    both = cited.select("doc", "req", "standard", F.lit(0).alias("ord")).unionByName(own)
    return both.groupBy("doc", "req", "standard").agg(F.min("ord").alias("ord"))


def companion_parts(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """The standards that require a finding's replacement, as one text in order."""
    needs = edges.where("type = 'REQUIRES'").select(F.col("dst").alias("replacement"), F.col("src").alias("companion"))
    return findings.join(needs, "replacement").groupBy("doc", "replacement").agg(F.array_join(F.transform(F.array_sort(F.collect_set("companion")), lambda x: x.cast("string")), ",").alias("companions"))


def governed_requirements(mapped: DataFrame, matching: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc, standard, req): mapped and product-matching requirements; a code of practice needs at least two."""
    rows = mapped.unionByName(matching).distinct().join(kinds, "standard")
    counts = rows.groupBy("doc", "standard").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, ["doc", "standard"]).where((F.col("kind") != "code_of_practice") | (F.col("n") >= 2)).select("doc", "standard", "req")


def addressed_standards(cited: DataFrame, supersedes: DataFrame, latest: DataFrame) -> DataFrame:
    """(doc, standard): cited ones, those that a cited one replaces, and the latest replacement of each."""
    below = cited.join(supersedes.select(F.col("src").alias("standard"), "dst"), "standard").select("doc", F.col("dst").alias("standard"))
    above = cited.join(latest.select(F.col("node").alias("standard"), "latest"), "standard").select("doc", F.col("latest").alias("standard"))
    return cited.select("doc", "standard").unionByName(below).unionByName(above).distinct()


def nearest_missing(cited: DataFrame, edges: DataFrame, addressed: DataFrame) -> DataFrame:
    """(doc, target): standards that a document does not address, reached from a cited one over addressed ones only.

    Each round takes a step from what the last one newly reached; the rounds are as many as the
    longest such path.
    """
    known = keep(cited.select("doc", "standard").union(addressed.select("doc", "standard")).distinct())
    steps = edges.select(F.col("src").alias("standard"), F.col("dst").alias("target")).distinct()
    seen = front = keep(cited.select("doc", "standard").distinct())
    missing = None
    while True:
        ahead = keep(front.join(steps, "standard").select("doc", F.col("target").alias("standard")).distinct().join(seen, ["doc", "standard"], "left_anti"))
        if not ahead.limit(1).count():
            break
        gone = ahead.join(known, ["doc", "standard"], "left_anti")
        missing = gone if missing is None else missing.union(gone)
        front = ahead.join(known, ["doc", "standard"], "left_semi")
        seen = keep(seen.union(ahead))
    empty = known.where("false") if missing is None else missing
    return empty.select("doc", F.col("standard").alias("target")).distinct()


def quantity_role(rows: DataFrame) -> DataFrame:
    """(…, before): observed or limit, by the cue nearest to the value."""
    tail = F.lower("before")
    last = lambda cues: F.length(F.regexp_extract(tail, rf"^(.*)({cues})", 1)) + F.when(tail.rlike(cues), 1).otherwise(0)
    seen, limit = last("observed|measured|found|actual|result"), last("limit|maximum|minimum|permissible|specified|not exceed")
    return rows.withColumn("role", F.when((seen == 0) & (limit == 0), None).when(seen > limit, "observed").otherwise("limit"))


def evidence_rows(findings: DataFrame) -> DataFrame:
    """(doc, local_id, evidence array) -> one row an item, in order."""
    return findings.select("doc", "local_id", F.posexplode("evidence").alias("ordinal", "item"))
