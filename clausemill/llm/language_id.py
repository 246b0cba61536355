"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the text itself (byte trigram likelihoods), the
language that the markup declares, the suffix of the address, and a prior of the host. How far a
declaration or a suffix can be trusted, and what a host's pages are written in, is counted over all
pages by grouped aggregation, with the text's own posterior as soft label. Host priors are smoothed
by their domain's, domain priors by the whole corpus's.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, partitions

SLOTS = 1 << 16
#: Bounds of the training sample: texts of each language, and characters of one of them.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 20_000
#: Suffixes up to which their table is sent to the tasks; more are joined.
FEW_SUFFIXES = 20_000
#: Rows of the sample up to which its keys are sent to the tasks: those of 250 languages.
FEW_KEYS = 100_000
#: A trigram counts as this much of an independent observation, and a text as at most so many trigrams.
WEIGHT, MOST = 0.25, 400.0
#: Pages that a parent's prior weighs as.
STRENGTH = 5.0
# What is never closed hides the rest of the page, as in a browser; each alternative always matches, so a page is read once.
_HIDDEN = re.compile(r"(?is)<(script|style)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<!--.*?(?:-->|\Z)")
_TAG = re.compile(r"<[^<>]*>")


def visible(page: str) -> str:
    """The text of a page without markup, scripts, styles and comments."""
    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def _slots(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(13)) & np.uint32(SLOTS - 1) if len(b) > 2 else np.zeros(0, np.uint32)


def _plain(text: str) -> bytes:
    words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def _sampled(docs: DataFrame, lang: str, text: str, key: str) -> DataFrame:
    """(g, t): of each language the SAMPLE_TEXTS texts of least hash of their key; texts of 20 to SAMPLE_CHARS characters count."""
    rows = docs.select(F.col(lang).alias("g"), F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("g").isNotNull() & F.col("k").isNotNull() & F.length("t").between(20, SAMPLE_CHARS))
    # Ranks are limited before the shuffle too, so that each task sends SAMPLE_TEXTS keys of a language at most.
    order = Window.partitionBy("g").orderBy(F.xxhash64("k"), "k", "h")
    picked = rows.select("g", "k", F.xxhash64("t").alias("h")).withColumn("n", F.row_number().over(order)).where(f"n <= {SAMPLE_TEXTS}").select("g", "k", "h").distinct()
    picked = Scratch(docs.sparkSession, "language-sample").keep(picked, "picked")
    if picked.count() <= FEW_KEYS:
        picked = F.broadcast(picked)
    return rows.withColumn("h", F.xxhash64("t")).join(picked, ["g", "k", "h"], "left_semi").select("g", "t")


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of trigram slots by language) from a bounded sample of labelled texts of every language.

    Tasks count the slots of their texts; a vector of SLOTS counts for each language comes to the driver
    from each of them, and no text.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g not in counts:
                    counts[g] = np.zeros(SLOTS, np.int64)
                counts[g] += np.bincount(_slots(_plain(t)), minlength=SLOTS)
        for g, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([c.astype("<u4").tobytes()], pa.binary())], ["g", "c"])

    sample = _sampled(docs, lang, text, key)
    total: dict[str, np.ndarray] = {}
    dealt = sample.repartition(partitions(docs.sparkSession), "g")  # so a language's counts come from one task
    for r in dealt.mapInArrow(counted, "g string, c binary").toLocalIterator():
        total[r["g"]] = total.get(r["g"], 0) + np.frombuffer(bytes(r["c"]), "<u4").astype(np.float64)
    languages = sorted(total)
    counts = np.array([total[g] for g in languages]).reshape(len(languages), SLOTS) + 0.5
    return languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def declared_language(page: Column) -> Column:
    """The primary subtag that the html element (or a content-language header) declares, or null; scripts, styles and comments declare nothing."""
    markup = F.regexp_replace(page, _HIDDEN.pattern, " ")
    tag = F.regexp_extract(markup, r"(?is)<html\b[^<>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1)
    meta = F.regexp_extract(markup, r"(?is)<meta\b[^<>]*content-language[^<>]*content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1)
    return F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.nullif(meta, F.lit(""))))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The last two labels; three where the last but one is a short public one."""
    labels = F.split(host, r"\.")
    n = F.when(F.size(labels) < 3, F.size(labels)).when(F.element_at(F.reverse(labels), 2).isin("co", "com", "org", "net", "ac", "gov"), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def _likelihoods(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """Adds ll, the text's log likelihood by language less the largest, to pages (page, html, ...)."""
    sent = pages.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                at = _slots(_plain(visible(t or "")))
                if len(at):
                    s = logs[:, at].sum(1, dtype=np.float64) * (WEIGHT * min(1.0, MOST / len(at)))
                    out.append((s - s.max()).tolist())
                else:
                    out.append([0.0] * len(languages))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "ll"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(rows, f"{schema}, ll array<double>")


def _normal(z: Column) -> Column:
    """Probabilities from log odds."""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _vector(column: str, n: int) -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(n)]


def identify_languages(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: key, language, probability, text_language, declared, suffix, host.

    docs (doc_id, text, lang) trains the text model on a bounded sample of every language; a page's evidence from its
    text is tempered to that of MOST trigrams, all of which count. A page without text has the posterior of its
    other evidence; one without any has the corpus's most frequent language. Ties go to the first
    language in order of name. Null addresses have null host and suffix and the corpus prior. Without
    labelled docs the language is null. An empty table gives an empty result; other columns are
    ignored.
    """
    scratch = Scratch(pages.sparkSession, "language-id")
    languages, table = train(docs)
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select(F.col(key).alias(key), none.alias("language"), F.lit(None).cast("double").alias("probability"), none.alias("text_language"), declared_language(F.col(html)).alias("declared"), none.alias("suffix"), host_of(F.col(url)).alias("host"))
    n = len(languages)
    rows = pages.select(F.col(key).alias("page"), declared_language(F.col(html)).alias("declared"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    seen = _likelihoods(rows, languages, table)
    seen = scratch.keep(seen.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("p", _normal(F.col("ll"))), "seen")
    names = F.array(*[F.lit(g) for g in languages])
    # A declaration is one of the languages, another one, or none: a table of n + 2 rows.
    kind = F.when(F.col("declared").isNull(), F.lit("-")).when(F.array_contains(names, F.col("declared")), F.col("declared")).otherwise(F.lit("?"))
    seen = seen.withColumn("kind", kind)

    corpus = seen.agg(F.count(F.lit(1)).alias("n"), *_vector("p", n)).first()
    pages_n = corpus["n"] or 0
    if not pages_n:
        prior = [1.0 / n] * n
    else:
        prior = [(corpus[f"s{i}"] + 1.0) / (pages_n + n) for i in range(n)]
    base = F.array(*[F.lit(float(x)) for x in prior])

    def counts(by: str) -> DataFrame:
        return seen.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *_vector("p", n)).select(by, "n", F.array(*[f"s{i}" for i in range(n)]).alias("sums"))

    def likelihood(by: str) -> DataFrame:
        """log P(value | language), smoothed by the value's share of the corpus."""
        table_ = counts(by)
        mass = F.array(*[F.lit(max(float(x), 1e-9) * pages_n) for x in prior])
        smoothed = F.transform(F.arrays_zip(F.col("sums").alias("s"), mass.alias("m")), lambda x: F.log((x["s"] + STRENGTH * F.col("n") / F.lit(float(max(pages_n, 1)))) / (x["m"] + STRENGTH)))
        return table_.select(by, smoothed.alias(f"{by}_log"))

    # Host priors: corpus, then domain, then host.
    domains = counts("domain").select("domain", F.transform(F.arrays_zip(F.col("sums").alias("s"), base.alias("b")), lambda x: (x["s"] + STRENGTH * x["b"]) / (F.col("n") + STRENGTH)).alias("above"))
    hosts = seen.where("host is not null").groupBy("host", "domain").agg(F.count(F.lit(1)).alias("n"), *_vector("p", n)).select("host", "domain", "n", F.array(*[f"s{i}" for i in range(n)]).alias("sums"))
    hosts = hosts.join(domains, "domain").select("host", F.transform(F.arrays_zip(F.col("sums").alias("s"), F.col("above").alias("b")), lambda x: (x["s"] + STRENGTH * x["b"]) / (F.col("n") + STRENGTH)).alias("prior"))
    hosts = scratch.keep(hosts, "hosts")
    suffixes = scratch.keep(likelihood("suffix"), "suffixes")
    if suffixes.count() <= FEW_SUFFIXES:
        suffixes = F.broadcast(suffixes)
    # Pages without a host match none, and are dealt by their own key.
    alone = F.coalesce("host", F.concat(F.lit("\0"), F.xxhash64("page").cast("string")))
    out = seen.join(F.broadcast(likelihood("kind")), "kind", "left").join(suffixes, "suffix", "left")
    out = out.withColumn("_host", alone).join(hosts.withColumnRenamed("host", "_host"), "_host", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    z = F.transform(
        F.arrays_zip(F.col("ll").alias("t"), F.coalesce("kind_log", zero).alias("d"), F.coalesce("suffix_log", zero).alias("s"), F.transform(F.coalesce("prior", base), lambda x: F.log(x)).alias("h")),
        lambda x: x["t"] + x["d"] + x["s"] + x["h"],
    )
    out = out.withColumn("posterior", _normal(z))
    first = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    return out.select(F.col("page").alias(key), first(F.col("posterior")).alias("language"), F.round(F.array_max("posterior"), 6).alias("probability"), F.when(F.array_min("ll") == F.array_max("ll"), F.lit(None)).otherwise(first(F.col("ll"))).alias("text_language"), "declared", "suffix", "host")
