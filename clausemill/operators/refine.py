"""Text refinement: pages -> lines -> sections -> segments -> requirement rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as t


def normalize_text(docs: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """Characters mapped to one form, then NFKC, which only rows beyond ASCII need."""
    out = docs.withColumn(text, t.mapped_characters(F.col(text)))
    if not nfkc:
        return out

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return out.withColumn(text, fold(F.col(text)))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, start): lines with their character offsets."""
    parts = F.split(text, "\n")
    rows = docs.select(key, F.posexplode(parts).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def drop_page_counters(rows: DataFrame) -> DataFrame:
    return rows.where(~t.is_page_counter(F.col("line")))


def strip_repeated_lines(rows: DataFrame, share: float = 0.6, least_pages: int = 3, longest: int = 120) -> DataFrame:
    """(doc, page, line_no, line) without lines whose shape is on most pages of their document."""
    shaped = rows.withColumn("shape", t.line_shape(F.col("line")))
    per = shaped.where("shape <> ''").groupBy("doc", "shape").agg(F.countDistinct("page").alias("on_pages"))
    pages = rows.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    repeated = per.join(pages, "doc").where((F.col("pages") >= least_pages) & (F.col("on_pages") >= F.ceil(F.col("pages") * share)) & (F.length("shape") < longest)).select("doc", "shape")
    return shaped.join(repeated, ["doc", "shape"], "left_anti").drop("shape")


ENUMERATOR = r"^\s*([0-9]+(\.[0-9]+)*[.)]?\s|\(?[a-z]\)\s|\(?[ivx]{1,4}\)\s|•|-\s|\*\s)"
#: Words that leave a sentence open at the end of a line.
OPEN_WORDS = "and or of the to with in for at by as per than from a an shall be is are not".split()


def reflow_lines(rows: DataFrame) -> DataFrame:
    """(doc, line_no, line) -> (doc, line_no, line) with sentences joined that a line end had cut.

    A line goes on from the one before when it starts in lower case or with a bracket, or when that
    one ends openly; list items never do. Whether the one before ends openly is read from its own
    tail, so a word that only dehyphenation completes does not count.
    """
    order = Window.partitionBy("doc").orderBy("line_no")
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", " {2,}", " "))).withColumn("prev", F.lag("line").over(order))
    item = F.lower("line").rlike(ENUMERATOR)
    hyphen = F.col("prev").rlike("[a-z]-$") & F.col("line").rlike("^[a-z]")
    open_end = F.lower("prev").rlike(r"([,(–-]|(^|[^a-z0-9_])(" + "|".join(OPEN_WORDS) + r"))$") & ~F.col("prev").rlike(r"[0-9]\s*[Aa]$")
    goes_on = (F.col("line") != "") & (F.col("prev") != "") & (hyphen | (~item & (F.col("line").rlike("^[a-z(]") | open_end)))
    rows = rows.withColumn("hyphen", F.coalesce(hyphen & goes_on, F.lit(False))).withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order))
    glue = F.when(F.col("hyphen") | (F.col("new") == 1), F.col("line")).otherwise(F.concat(F.lit(" "), F.col("line")))
    next_hyphen = F.coalesce(F.lead("hyphen").over(order), F.lit(False))
    piece = F.when(next_hyphen, F.regexp_replace(glue, "-$", "")).otherwise(glue)
    pieces = rows.withColumn("piece", piece).groupBy("doc", "island").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("p"))
    return pieces.select("doc", "line_no", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("line"))


def sparse_page_report(pages: DataFrame, least: int = 40) -> DataFrame:
    """(doc, page, text) -> per document mean characters, number of sparse pages, code."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    out = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.avg(size).alias("mean_chars"), F.count_if(size < least).alias("sparse"))
    return out.withColumn("code", F.when(F.col("mean_chars") < least, "no_text_layer").when(F.col("sparse") > 0, "sparse_pages"))


def assemble_documents(pages: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Pages in order, joined by a blank line; documents that are empty or too long get a code instead of text."""
    # Lengths decide before any text is gathered.
    sizes = pages.groupBy("doc").agg((F.sum(F.coalesce(F.length("text"), F.lit(0))) + 2 * (F.count("text") - 1)).alias("size"))
    fits = pages.join(sizes.where(F.col("size") <= most).select("doc"), "doc", "left_semi")
    joined = fits.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    code = F.when(F.col("size") > most, "too_long").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty")
    return sizes.join(joined, "doc", "left").select("doc", code.alias("code"), F.when(code.isNull(), F.col("text")).alias("text"))


def page_of(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc, page, text), (doc, at) -> the page an offset of the assembled text lies on: the last that starts at or before it."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("doc", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).alias("at"), "page", F.lit(0).alias("probe"))
    probes = offsets.select("doc", F.col("at").cast("long"), F.lit(None).cast(pages.schema["page"].dataType).alias("page"), F.lit(1).alias("probe"))
    asof = Window.partitionBy("doc").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(probes).withColumn("page", F.last("page", ignorenulls=True).over(asof)).where("probe = 1").drop("probe")


#: Words that a title writes small; words that make a line a statement.
SMALL_WORDS = "and or of the for to in on with a an".split()
MODAL_WORDS = "shall must should will may required".split()


def _titled(line: Column) -> Column:
    """Whether a line is written like a title: at most twelve words, all but small ones with a capital, no value, no statement."""
    words = F.split(line, r"\s+")
    states = F.lower(line).rlike(r"(^|[^a-z0-9_])(" + "|".join(MODAL_WORDS) + r")([^a-z0-9_]|$)") | line.rlike(r":\s*\S") | line.rlike(r"[.;]$")
    valued = line.rlike(r"[0-9]([.,][0-9]+)?\s*([A-Za-z°%µ]|$)")
    small = F.filter(words, lambda w: w.rlike("^[a-z]") & ~w.isin(SMALL_WORDS))
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    return F.length(line).between(3, 80) & (F.size(words) <= 12) & line.rlike("^[A-Z0-9]") & (letters >= 3) & ~states & ~valued & (F.size(small) == 0)


def detect_sections(rows: DataFrame, titles: bool = False) -> DataFrame:
    """(doc, line_no, line, start) -> headings: numbered (level = dots + 1), labelled, or in capitals; with titles also lines written like a title."""
    line = F.trim("line")
    number = F.regexp_extract(line, r"^([0-9]{1,2}(\.[0-9]{1,3}){0,4})[.)]?\s+[A-Z]", 1)
    labelled = F.lower(line).rlike(r"^(section|chapter|part|annex|appendix|schedule)\s+[0-9a-z]{1,4}\b")
    letters, capitals = F.length(F.regexp_replace(line, "[^A-Za-z]", "")), F.length(F.regexp_replace(line, "[^A-Z]", ""))
    shouted = (letters >= 4) & (capitals > letters * 0.8) & (F.length(line) <= 80)
    short = F.length(line) <= 100
    numbered = (number != "") & short & ~line.rlike(r"[.;]$")
    level = F.when(numbered, F.length(F.regexp_replace(number, r"[^.]", "")) + 1).otherwise(F.lit(1))
    more = _titled(line) if titles else F.lit(False)
    found = rows.where(numbered | (labelled & short) | shouted | more).select("doc", "line_no", "start", F.nullif(number, F.lit("")).alias("number"), line.alias("heading"), level.cast("int").alias("level"))
    return found.withColumn("section_no", F.row_number().over(Window.partitionBy("doc").orderBy("line_no")))


def locate(sections: DataFrame, segments: DataFrame) -> DataFrame:
    """The nearest heading at or before each segment (doc, at)."""
    heads = sections.select("doc", F.col("start").alias("at"), "heading", F.lit(0).alias("probe"))
    rows = segments.select("doc", "at", F.lit(None).cast("string").alias("heading"), F.lit(1).alias("probe"))
    asof = Window.partitionBy("doc").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return heads.unionByName(rows).withColumn("heading", F.last("heading", ignorenulls=True).over(asof)).where("probe = 1").drop("probe")


#: Abbreviations whose stop ends no sentence.
ABBREVIATIONS = "No Nos approx min max Cl cl Fig Sr Rs sq Pt Sec deg hr Ltd Co St Ref vol Vol Nr".split()


def segment(rows: DataFrame) -> DataFrame:
    """(doc, line_no, line) -> (doc, line_no, seg_no, segment): list marks stripped, sentences split except after abbreviations and initials.

    A capital after a number is its unit and no initial ("at 90 deg C. Next").
    """
    body = F.regexp_replace(F.trim("line"), r"^([0-9]{1,2}(\.[0-9]{1,3}){0,4}[.)]?|\(?[a-z]\)|•|-|\*|–)\s+", "")
    ended = F.regexp_replace(body, r"([0-9]\s*(?:[°º]\s*)?(?:deg\.?\s*)?[A-Za-z/]*[A-Z])\. ", "$1.\u0003")
    guarded = F.regexp_replace(ended, r"(?<![A-Za-z])(" + "|".join(ABBREVIATIONS) + r"|[A-Z])\. ", "$1.\u0002")
    guarded = F.regexp_replace(guarded, "\u0003", " ")
    cut = F.split(F.regexp_replace(guarded, r"([.!?])\s+(?=[A-Z0-9\"'(•])", "$1\u0001"), "\u0001")
    out = rows.select("doc", "line_no", F.posexplode(cut).alias("seg_no", "segment"))
    return out.select("doc", "line_no", "seg_no", F.trim(F.regexp_replace("segment", "\u0002", " ")).alias("segment")).where("segment <> ''")


def identify(rows: DataFrame) -> DataFrame:
    """(…, segment, has_value, has_reference) -> modality and confidence by the first rule that holds; others go."""
    s = F.lower("segment")
    word = lambda alternatives: s.rlike(rf"(^|[^a-z0-9_])({alternatives})([^a-z0-9_]|$)")
    stated = F.col("has_value") | F.col("has_reference")
    rules = [
        (word("shall|must|is required to|are required to|required|mandatory"), "mandatory", F.when(stated, 0.95).otherwise(0.85)),
        (word("is to be|are to be|will be"), "mandatory", F.when(stated, 0.9).otherwise(0.8)),
        (word("should|recommended|preferably|desirable"), "recommended", F.lit(0.75)),
        (F.col("segment").rlike(r"^[A-Za-z][A-Za-z0-9 ()/&.,'-]{1,60}\s*(:|=|–)\s+\S") & stated, "declarative", F.lit(0.8)),
        (F.col("has_reference") & word("conforming|conforms|comply|complying|as per|in accordance with|according to"), "declarative", F.lit(0.75)),
        (word("may|optional") & F.col("has_value"), "permitted", F.lit(0.55)),
        (F.col("has_value") & (F.size(F.split(F.trim("segment"), r"\s+")) <= 16), "declarative", F.lit(0.6)),
    ]
    found = F.lit(None).cast("struct<modality:string,confidence:double>")
    for condition, modality, confidence in reversed(rules):
        found = F.when(condition, F.struct(F.lit(modality).alias("modality"), confidence.cast("double").alias("confidence"))).otherwise(found)
    boilerplate = s.rlike(r"^(tender|bid|date|dated|page|signature|name of|address|phone|fax|contact|note)([^a-z0-9_]|$)")
    return rows.where((F.length("segment") >= 8) & ~boilerplate).withColumn("_f", found).where("_f is not null").select(*rows.columns, "_f.modality", "_f.confidence")


def dedupe_requirements(rows: DataFrame) -> DataFrame:
    """(doc, at, segment): the first occurrence of each text, spaces and case aside, numbered in order."""
    norm = F.lower(F.trim(F.regexp_replace("segment", r"\s+", " ")))
    first = Window.partitionBy("doc", "norm").orderBy("at", "segment")
    kept = rows.withColumn("norm", norm).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "norm")
    return kept.withColumn("req_no", F.row_number().over(Window.partitionBy("doc").orderBy("at", "segment")))


#: Words of quality without a measure.
VAGUE_WORDS = "suitable adequate appropriate sufficient proper reliable robust efficient".split()
VAGUE_PHRASES = ["good quality", "best quality", "high quality", "standard make", "reputed make", "as required", "as per requirement", "energy[ -]efficient", "latest technology", "state[ -]of[ -]the[ -]art", "heavy duty", "relevant (is|standard|standards|code|codes)"]


def flag_vague(rows: DataFrame) -> DataFrame:
    """(…, segment, has_value, has_reference) with vague: a word of quality, and nothing measurable stated."""
    s = F.lower("segment")
    says = s.rlike(r"(^|[^a-z0-9_])(" + "|".join(VAGUE_WORDS + VAGUE_PHRASES) + r")([^a-z0-9_]|$)") | s.rlike(r"as (low|high|far|much) as possible")
    exempt = s.rlike(r"suitable for ") | s.rlike(r"approved make")
    return rows.withColumn("vague", says & ~exempt & ~F.col("has_value") & ~F.col("has_reference"))


def validate_types(documents: DataFrame, types: DataFrame) -> DataFrame:
    """(doc, type) against the dimension (type, ...): the normalised key and an error code."""
    key = F.regexp_replace(F.lower(F.trim("type")), r"[\s-]+", "_")
    known = types.select(F.col("type").alias("key"), F.lit(True).alias("known")).distinct()
    return documents.withColumn("key", key).join(known, "key", "left").select("doc", "key", F.when(F.coalesce("key", F.lit("")) == "", "missing").when(F.col("known").isNull(), "unknown").alias("code"))


def html_to_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of a row of two as 'A: B', of more joined by bars; list items as bullets; blocks end lines; tags and entities resolved."""
    h = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?i)<li[^>]*>", "\n• ")
    h = F.regexp_replace(h, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | ")
    h = F.regexp_replace(h, r"(?i)<br[^>]*>|</(p|div|tr|li|h[1-6]|table|ul|ol|article|title|nav)>", "\n")
    h = F.regexp_replace(h, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        h = F.replace(h, F.lit(entity), F.lit(char))
    rows = pages.select(key, F.posexplode(F.split(h, "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[ \t]+", " ")))
    pair = F.col("line").rlike(r"^[^|]+ \| [^|]+$")
    return rows.where("line <> ''").withColumn("line", F.when(pair, F.regexp_replace("line", r" \| ", ": ")).otherwise(F.col("line")))


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Text of bytes: UTF-8 without its mark, else Windows-1252."""
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(F.col(content), 4, 1 << 30)).otherwise(F.col(content))
    c1 = "\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f"
    latin = F.translate(F.decode(body, "ISO-8859-1"), c1, "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")
    return files.withColumn("text", F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(latin))
