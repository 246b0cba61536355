"""WARC archives with revisit records for repeated payloads.

Headers are grouped by payload digest; the least page of each digest is the original. Short payloads
are never revisits and go straight to the writer; the others meet their digest's original in one join
(which moves their payloads once) and become WARC records: a response with its
payload, or a revisit that only refers to the response. Records are written by Spark's own text
writer (so by its committer: a lost executor leaves no half archive) into gzip files in a shared
folder, and read back by their Content-Length.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Records of one file at most: archives are read back file by file.
MOST_RECORDS = 10_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page, url, payload, digest, bytes, original): original is null for responses.

    Null payloads are empty. Of records with equal payloads of at least least_bytes the one with the
    smallest page is the response; repeated rows of that page are responses too, as nothing tells
    them apart. A null page comes after all others.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    long_enough = F.col("bytes") >= least_bytes
    # Only digests that several pages have need the join's other side: a header each.
    firsts = rows.where(long_enough).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    joined = rows.where(long_enough).join(firsts, "digest", "left")
    original = F.when(F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    columns = ["page", "url", "payload", "digest", "bytes"]
    return joined.select(*columns, original.alias("original")).unionByName(rows.where(~long_enough).select(*columns, F.lit(None).cast("long").alias("original")))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes resolved rows as gzip WARC files, with fresh headers and record identifiers.

    A null page is written as such; repeated rows give repeated records with one identifier; an empty
    table leaves no archive. Each file is compressed as a whole and holds at most MOST_RECORDS.
    """
    page = F.coalesce(F.col("page").cast("string"), F.lit("null"))
    # Identifiers are UUIDs of a digest, the same on every run; repeated rows get equal ones.
    name = lambda of: F.regexp_replace(F.substring(F.sha2(F.concat(F.lit("record "), of), 256), 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    revisit = F.col("original").isNotNull()
    # A line of a header can't hold line ends.
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    common = [F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), name(page), F.lit(">")), F.concat(F.lit("WARC-Page-ID: "), page), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), target), F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest")]
    response = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: response"), *common, F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), "bytes"), F.lit(""), F.col("payload"))
    refers = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: revisit"), *common, F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), name(F.col("original").cast("string")), F.lit(">")), F.concat(F.lit("WARC-Refers-To-Page: "), "original"), F.lit("Content-Length: 0"), F.lit(""), F.lit(""))
    resolved.select(F.when(revisit, refers).otherwise(response).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", MOST_RECORDS).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a WARC stream; header names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers.get("content-length", "0"))
        body = stream.read(length)
        if len(body) != length:
            raise ValueError("a record ends early")
        yield headers, body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page, record_type, url, refers_to, declared, payload) of each record of the archives under path; none of an empty folder."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "record_type", "url", "refers_to", "declared", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        number = lambda x: None if x in (None, "null") else int(x)
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                with gzip.open(io.BytesIO(content.as_buffer()), "rb") as stream:
                    for head, body in parse_records(stream):
                        out.append((number(head.get("warc-page-id")), head["warc-type"], head.get("warc-target-uri", ""), number(head.get("warc-refers-to-page")), head.get("warc-payload-digest", "").removeprefix("sha256:"), body))
                        held += len(body)
                        if held > 4_000_000 or len(out) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    return files.mapInArrow(records, "page long, record_type string, url string, refers_to long, declared string, payload binary")


def resolved_records(scratch: Scratch, records: DataFrame) -> DataFrame:
    """(page, record_type, refers_to, bytes, digest): revisits take what their response's payload gives."""
    own = records.select("page", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    own = scratch.keep(own, "records")
    responses = own.where("record_type = 'response'")
    # Repeated rows of one page have equal payloads here: a revisit meets one of them.
    originals = own.where("record_type = 'response' and bytes > 0").groupBy(F.col("page").alias("refers_to"), F.col("digest")).agg(F.max("bytes").alias("bytes"))
    declared = records.where("record_type = 'revisit'").select("page", "record_type", "refers_to", F.col("declared").alias("digest"))
    return responses.unionByName(declared.join(originals, ["refers_to", "digest"], "left").select("page", "record_type", "refers_to", "bytes", "digest"))


def archive_round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages as archives (in the shared folder unless path is given), reads them back, resolves revisits.

    One row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to. An
    empty table gives an empty result; columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = path or f"{scratch.root}/archives-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(pages, least_bytes=least_bytes), path)
    rows = resolved_records(scratch, read_archives(spark, path))
    return rows.select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
