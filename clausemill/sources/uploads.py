"""Scanning uploaded files, verifying datasets against a manifest, reading the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 20 * 1024 * 1024

#: The knowledge base as nested JSON, in camel case.
CORPUS = (
    "standards array<struct<id string, designation string, year int, number string, title string, scope string, category string, kind string, status string, aliases array<string>, keywords array<string>,"
    " certification struct<scheme string, bodies array<string>, relevance string>,"
    " checklist array<struct<parameter string, label string, rationale string, clauseId string, severity string, repairTemplate string>>,"
    " clauses array<struct<id string, standardId string, ref string, heading string, text string, constraints array<struct<parameter string, dimension string, unit string, min double, max double, condition string, qualifier string>>>>>>,"
    " relationships array<struct<id string, type string, fromId string, toId string, clauseId string, confidence double, method string, note string>>,"
    " events array<struct<id string, standardId string, date string, kind string, summary string, severity string, replacedById string>>,"
    " priorEditions array<struct<designation string, year int, replacedById string>>"
)


def file_format(path: Column, content: Column, length: Column) -> Column:
    """(format, error): magic bytes first, then the extension; bad files keep a code."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    pdf, zip_ = head == "25504446", F.substring(head, 1, 4) == "504B"
    kind = F.when(pdf, "pdf").when(zip_ & ext.isin("docx", ""), "docx").when(~zip_ & (ext == "txt"), "txt")
    error = F.when(length == 0, "empty").when(length > MOST_BYTES, "too_large").when(kind.isNotNull(), None).when(~zip_ & ext.isin("pdf", "docx"), "corrupt").otherwise("unsupported_format")
    return F.struct(F.when(error.isNull(), kind).alias("format"), error.alias("error_code"))


def scan_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, format, error_code, content); the content of files too large is left unread in later steps. Spark lists no files of length 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.withColumn("f", file_format(F.col("path"), F.col("content"), F.col("length"))).select("path", "length", "f.format", "f.error_code", "content")


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The flat tables of a knowledge base file, with ordinals where order matters."""
    root = spark.read.schema(CORPUS).json(path, multiLine=True)
    std = root.select(F.posexplode("standards").alias("std_no", "s"))
    clauses = std.select(F.col("s.id").alias("standard_id"), F.posexplode("s.clauses").alias("clause_no", "c"))
    return {
        "standards": std.select("std_no", "s.id", "s.designation", "s.year", "s.title", "s.scope", "s.category", "s.kind", "s.status", "s.aliases", "s.keywords", "s.certification"),
        "clauses": clauses.select("standard_id", "clause_no", "c.id", "c.ref", "c.heading", "c.text"),
        "constraints": clauses.select("standard_id", F.col("c.id").alias("clause_id"), F.posexplode("c.constraints").alias("constraint_no", "k")).select("standard_id", "clause_id", "constraint_no", "k.*"),
        "checklist": std.select(F.col("s.id").alias("standard_id"), F.posexplode("s.checklist").alias("item_no", "i")).select("standard_id", "item_no", "i.*"),
        "edges": root.select(F.posexplode("relationships").alias("edge_no", "e")).select("edge_no", "e.*"),
        "events": root.select(F.posexplode("events").alias("event_no", "e")).select("event_no", "e.*"),
        "prior_editions": root.select(F.explode("priorEditions").alias("p")).select("p.*"),
    }


def validate_corpus(standards: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Violations: references (id, standard) to standards that do not exist, by the table they come from."""
    known = standards.select("standard")
    out = None
    for name, table in references.items():
        bad = table.join(known, "standard", "left_anti").select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), F.col("standard").cast("string").alias("missing"))
        out = bad if out is None else out.unionByName(bad)
    return out


def verify_dataset(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sha) against (path, content): missing, changed and unlisted files."""
    own = files.select("path", F.sha2("content", 256).alias("own"))
    both = manifest.join(own, "path", "full")
    state = F.when(F.col("own").isNull(), "missing").when(F.col("sha").isNull(), "unlisted").when(F.col("sha") != F.col("own"), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def load_corpus(standards: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses grouped under their standards in order."""
    grouped = clauses.groupBy("standard").agg(F.array_sort(F.collect_list(F.struct("clause_no", "heading"))).alias("c"))
    return standards.join(grouped, "standard", "left").select(*standards.columns, F.coalesce(F.transform("c", lambda x: x["heading"]), F.array().cast("array<string>")).alias("headings"))


def read_gold(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(stem, gold columns, text): one gold JSON and the text file of the same stem for each document; text null where there is none."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.gold\.json|\.txt)$", 1)
    gold = spark.read.schema(schema).json(f"{folder}/*.gold.json", multiLine=True).withColumn("stem", stem)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem.alias("stem"), F.col("value").alias("text"))
    return gold.join(texts, "stem", "left")
