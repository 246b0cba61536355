"""Rules by kind of document: roles, zones, headings, results against limits, scoped attributes, vague wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document type -> (label, whether bidding zones are left out, role).
DOCUMENT_TYPES = {
    "specification": ("Technical specification", True, "specification"),
    "tender": ("Tender document", True, "specification"),
    "boq": ("Bill of quantities", False, "schedule"),
    "datasheet": ("Vendor datasheet", False, "declaration"),
    "test_report": ("Test report", False, "report"),
    "inspection_report": ("Inspection report", False, "report"),
    "other": ("Other", False, "specification"),
}
DEFAULT_TYPE = "specification"
#: Headings of bidding and commercial material.
EXCLUDED_ZONES = [r"instructions?\s+to\s+(?:bidders|tenderers)", r"invitation\s+for\s+bids", r"general\s+conditions", r"special\s+conditions", r"conditions\s+of\s+contract", r"commercial\s+terms", r"terms\s+and\s+conditions", "eligibility", r"qualification\s+criteria", r"schedule\s+of\s+quantities", r"bill\s+of\s+quantities", r"approved\s+makes", r"price\s+bid", r"financial\s+bid", r"notice\s+inviting"]
#: Beginnings of lines that specify nothing.
BOILERPLATE = [r"name\s+of\s+(?:the\s+)?work", r"estimated\s+cost", r"earnest\s+money", r"period\s+of\s+completion", r"last\s+date", r"tender\s+(?:fee|no)", r"bid\s+security", r"subject\s*:", r"enquiry\s+no", r"notice\s+inviting", "annexure"]
PLACEHOLDER = r"(?i)\bto\s+be\s+(?:furnished|filled|quoted|specified|offered)\s+by\s+the\s+(?:bidder|tenderer|supplier)"
#: Cues of what a number in a report is.
OBSERVED_CUES = ["measured", "observed", "results?", "found", "recorded", "actual", "reading", "obtained", "achieved", "offered", "declared"]
LIMIT_CUES = ["specified", "specification", "guaranteed", "required", "requirement", "limits?", "permissible", "acceptable", "not more than", "not less than", "not exceeding", r"max(?:imum)?\.?", r"min(?:imum)?\.?", "shall", "should"]
#: Words that declare a failure.
FAILURES = ["fail(?:ed|s)?", "not complied", "non[- ]?complian(?:ce|t)", "does not (?:comply|conform|meet)", "exceeds? the (?:specified|guaranteed|permissible|acceptable|required|maximum)", "(?:is|are|was|were) below the (?:specified|guaranteed|required|minimum)", "rejected", "not acceptable", "unsatisfactory", "not satisfactory"]
#: What is said before a number that is no rating, by dimension.
GUARDS = {
    "voltage": r"withstand|high[\s-]voltage test|hv test|test voltage|impulse|power[\s-]frequency|tested at|test at",
    "resistance": r"insulation resistance|conductor resistance|resistance of (the )?conductor|protective circuit|loop impedance",
    "temperature": r"temperature rise|\brise\b",
    "power": r"\blosse?s?\b",
    "percent": "impedance",
}
#: Parameters of the whole supply, which any requirement of a document may state.
DOCUMENT_LEVEL = ["rated_voltage", "frequency", "ambient_temperature", "altitude"]


def document_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DOCUMENT_TYPES.items()], "type string, label string, zoning boolean, role string")


def role_of_documents(documents: DataFrame) -> DataFrame:
    """(doc, type) -> doc, type, role, zoning, tables, report, completeness; an unknown or missing type is a specification.

    The seven types are a dimension of fixed size.
    """
    types = document_types(documents.sparkSession)
    known = F.coalesce(F.when(F.lower(F.trim("type")).isin(*DOCUMENT_TYPES), F.lower(F.trim("type"))), F.lit(DEFAULT_TYPE))
    out = documents.select("doc", known.alias("type")).join(F.broadcast(types), "type")
    report = F.col("role") == "report"
    return out.select("doc", "type", "role", "zoning", (~F.col("zoning")).alias("tables"), report.alias("report"), (~F.col("role").isin("report", "schedule")).alias("completeness"))


def drop_headings(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, start, segment) without the segments that are a heading (doc, start, heading) and hardly longer."""
    heads = sections.select("doc", "start", F.length("heading").alias("_most")).where("_most is not null").groupBy("doc", "start").agg(F.max("_most").alias("_most"))
    joined = segments.join(heads, ["doc", "start"], "left")
    return joined.where("_most is null or length(segment) > _most + 2").select(*segments.columns)


def zone_filter(segments: DataFrame) -> DataFrame:
    """(…, segment, heading) without bidding and commercial zones, boilerplate, placeholders and table rows."""
    zone = F.coalesce(F.col("heading").rlike("(?i)" + "|".join(EXCLUDED_ZONES)), F.lit(False))
    s = F.col("segment")
    return segments.where(~zone & ~s.rlike(r"(?i)^(?:" + "|".join(BOILERPLATE) + r")\b") & ~s.rlike(PLACEHOLDER) & ~s.rlike(r"^(?:[^|]*\|){2,}"))


def report_guards(quantities: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(…, dimension, parameter, before, after) of reports: numbers of tests and losses lose their parameter, a current with a duration is a withstand rating.

    before is the text ahead of the number, of which the last 140 characters of its clause count.
    """
    clause = F.element_at(F.split(F.substring(F.lower(before), -140, 140), r"(?<=[a-z)])\.\s"), -1)
    guarded = F.lit(False)
    for dimension, cue in GUARDS.items():
        guarded = guarded | ((F.col("dimension") == dimension) & clause.rlike(cue))
    lasts = (F.col("dimension") == "current") & F.lower(after).rlike(r"^\s*(?:\(?rms\)?\s*)?for\s+\d+(?:\.\d+)?\s*(?:s|sec|secs|second|seconds)\b")
    return quantities.withColumn("parameter", F.when(guarded, F.lit(None).cast("string")).when(lasts, "short_circuit_rating").otherwise(F.col("parameter")))


def _last(text: Column, cues: list[str]) -> Column:
    """End of the last cue in text, or -1."""
    head = F.regexp_extract(text, r"(?is)^(.*\b(?:" + "|".join(cues) + r")\b)", 1)
    return F.when(head == "", -1).otherwise(F.length(head))


def quantity_roles(quantities: DataFrame, before: str = "before") -> DataFrame:
    """Adds role: limit or observed, by the nearest cue before the number, else by whether it has a comparator."""
    seen, limit = _last(F.col(before), OBSERVED_CUES), _last(F.col(before), LIMIT_CUES)
    bounded = F.coalesce(F.col("comparator").isin("min", "max"), F.lit(False))
    return quantities.withColumn("role", F.when(limit > seen, "limit").when(seen >= 0, "observed").when(bounded, "limit").otherwise("observed"))


def observed_only(quantities: DataFrame) -> DataFrame:
    """The quantities that are no limits: only they are held against a standard's limits in a report."""
    return quantities.where("role <> 'limit'")


def reported_nonconformity(requirements: DataFrame, attributes: DataFrame, flagged: DataFrame, cues: DataFrame) -> DataFrame:
    """(doc, req, text) that declare a failure which no number has shown: doc, req, cue, severity, confidence.

    attributes (doc, req, parameter), flagged (doc, parameter) by result_nonconformity, cues
    (parameter, cue): a requirement that has a flagged parameter, or names one, is covered.
    """
    cue = F.regexp_extract("text", r"(?i)\b(" + "|".join(FAILURES) + r")\b", 1)
    declared = requirements.withColumn("cue", F.lower(cue)).where("cue <> ''")
    covered = attributes.join(flagged, ["doc", "parameter"], "left_semi").select("doc", "req").distinct()
    words = flagged.join(cues, "parameter").select("doc", F.lower("cue").alias("word"))
    named = declared.select("doc", "req", F.lower("text").alias("low")).join(words, "doc").where(F.contains("low", "word")).select("doc", "req").distinct()
    left = declared.join(covered, ["doc", "req"], "left_anti").join(named, ["doc", "req"], "left_anti")
    return left.select("doc", "req", "cue", F.lit("high").alias("severity"), F.lit(0.85).alias("confidence"))


def report_routing(roles: DataFrame, standard_conflicts: DataFrame, results: DataFrame, internal: DataFrame, completeness: DataFrame) -> DataFrame:
    """Findings (doc, req, parameter, rule) by role of document.

    Reports take the conflicts with standards, reworded, and results that these do not cover; other
    documents take conflicts and internal ones; only documents with completeness take what is missing.
    """
    role = roles.select("doc", "report", "completeness")
    worded = F.when(F.col("report") & (F.col("rule") == "constraint_conflict"), "outside_limit").otherwise(F.col("rule"))
    columns = ["doc", "req", "parameter", "rule"]
    conflicts = standard_conflicts.join(role, "doc").withColumn("rule", worded).select(*columns)
    own = results.join(role.where("report"), "doc", "left_semi").join(standard_conflicts.select("doc", "req", "parameter").distinct(), ["doc", "req", "parameter"], "left_anti").select(*columns)
    others = internal.join(role.where("not report"), "doc", "left_semi").select(*columns)
    missing = completeness.join(role.where("completeness"), "doc", "left_semi").select(*columns)
    return conflicts.unionByName(own).unionByName(others).unionByName(missing)


def scoped_attributes(attributes: DataFrame, governed: DataFrame, family: DataFrame, uncited: DataFrame) -> DataFrame:
    """(doc, standard, req, parameter): attributes that can satisfy a checklist item of the standard.

    attributes (doc, req, parameter); governed (doc, standard, req); family (standard, relative);
    uncited (doc, standard, req) are requirements about a product of the standard that cite no other
    of its kind. Parameters of the whole supply count wherever they are stated.
    """
    relatives = family.select("standard", "relative").union(family.select("standard", "standard")).distinct()
    own = governed.select("doc", F.col("standard").alias("relative"), "req").join(relatives, "relative").select("doc", "standard", "req")
    standards = governed.select("doc", "standard").distinct()
    own = own.join(standards, ["doc", "standard"], "left_semi").union(governed.select("doc", "standard", "req")).union(uncited.select("doc", "standard", "req")).distinct()
    narrow = attributes.join(own, ["doc", "req"]).select("doc", "standard", "req", "parameter")
    wide = attributes.where(F.col("parameter").isin(DOCUMENT_LEVEL)).join(standards, "doc").select("doc", "standard", "req", "parameter")
    return narrow.union(wide).distinct()


def vague_findings(requirements: DataFrame, consumed: DataFrame, top: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(doc, req, vague) not consumed by a gap (doc, req): doc, req, standard (of the top hit, if sure enough), severity, confidence."""
    left = requirements.where("vague").join(consumed.select("doc", "req").distinct(), ["doc", "req"], "left_anti")
    hit = top.where(F.col("confidence") >= threshold).groupBy("doc", "req").agg(F.max_by("standard", F.struct("confidence", -F.col("standard"))).alias("standard"))
    return left.join(hit, ["doc", "req"], "left").select("doc", "req", "standard", F.lit("low").alias("severity"), F.lit(0.65).alias("confidence"))

