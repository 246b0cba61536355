"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its five-word shingles, weighted by how often each occurs. For
each of SAMPLES independent samples every term k of weight w draws r, c from Gamma(2, 1) and b
uniformly, the same in every text that has k; with t = floor(ln w / r + b) and a = c exp(r (b - t - 1))
the sample is the term and t of least a. Two texts agree in a sample with a probability equal to
their generalised Jaccard similarity, sum of min weights over sum of max weights.

Draws come from two pools: c by some bits of the term's hash, (r, b) by others, so that a pair of
terms shares all its draws in one of 2**28 cases. a is a function of the term and t, so the least a
itself names the sample; 16 mixed bits of it are kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import partitions
from clausemill.llm.shingles import U, in_blocks, shingle_hashes, word_hashes

SAMPLES = 128
POOL_BITS = 14
WIDTH = 5


@functools.cache
def _pools(samples: int) -> tuple[np.ndarray, ...]:
    draw = np.random.default_rng(8)
    shape = (1 << POOL_BITS, samples)
    r, c, b = draw.gamma(2.0, 1.0, shape), draw.gamma(2.0, 1.0, shape), draw.random(shape)
    once = np.exp(r * (b - 1.0))  # weight 1: t = 0
    return tuple(x.astype(np.float32) for x in (c, once, r, b))


def fingerprint(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The 16-bit samples of a text given the hashes of its shingles, repeats included; empty: all zero.

    A text with terms has no sample 0.
    """
    if not len(hashes):
        return np.zeros(samples, np.uint16)
    c, once, r, b = _pools(samples)
    terms, counts = np.unique(hashes, return_counts=True)
    low = (1 << POOL_BITS) - 1
    i, j = (terms >> U(64 - POOL_BITS)).astype(np.int64), (terms >> U(32)).astype(np.int64) & low
    least = np.full(samples, np.inf, np.float32)
    single = counts == 1
    for mask, many in ((single, False), (~single, True)):
        ii, jj = i[mask], j[mask]
        weights = counts[mask]
        for at in range(0, len(ii), 1024):
            p, q = ii[at : at + 1024], jj[at : at + 1024]
            if many:
                rate, start = r[q], b[q]
                t = np.floor(np.log(weights[at : at + 1024]).astype(np.float32)[:, None] / rate + start)
                a = c[p] * np.exp(rate * (start - t - 1))
            else:
                a = c[p] * once[q]
            least = np.minimum(least, a.min(axis=0))
    mixed = (least.view(np.uint32).astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(48)
    return np.maximum(mixed, U(1)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity. Two empty texts: 1."""
    return float(np.count_nonzero(x == y)) / len(x)


def fingerprints(texts: list[str], samples: int = SAMPLES, width: int = WIDTH) -> Iterator[np.ndarray]:
    raw = [t.encode() for t in texts]
    for part in in_blocks(raw, 1 << 18):
        hashes, n = shingle_hashes(*word_hashes(raw[part]), width)
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            yield fingerprint(hashes[a:b], samples)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by as many (or all) first ones of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_neighbour(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (id, text, head) so dealt that every partition holds a run of ids in order, then (head) the next id's rows.

    The one shuffle of texts: partition numbers come from quantiles of the ids, and the first id of
    each partition, one row a partition, is also sent to the partition before.
    """
    n = 2 * partitions(docs.sparkSession)  # small runs: a task holds one as an Arrow batch
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = sorted(set(rows.approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("place", F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(place).cast("int"))
    # One row a partition; an id is in one partition only.
    firsts = sorted((r["place"], r["first"]) for r in rows.groupBy("place").agg(F.min("id").alias("first")).collect())
    spark = docs.sparkSession
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = spark.createDataFrame(before, "first long, before int")
    rows = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("place").alias("place"), F.lit(False).alias("head"))
    also = F.struct(F.col("before").alias("place"), F.lit(True).alias("head"))
    rows = rows.select("id", "text", F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))))
    return rows.repartitionById(len(cuts) + 1, "place").sortWithinPartitions("head", F.col("id").asc_nulls_last(), F.xxhash64("text"), "text").select("id", "text", "head")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Fingerprints are hexadecimal, four digits a sample. The next document is the one of the next
    larger key, after the last the first; rows of one key follow each other in order of a hash of
    their text; null keys come last. A single row is its own next. Null texts are empty; an empty
    text has the fingerprint of all zeros, like any other empty text and unlike all else. An empty
    table gives an empty result. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []  # rows whose next is not yet known, then the ones before it
        mark: list[np.ndarray] = []

        def emit(pairs: list[tuple[int | None, str]], nexts: list[str], own: list[np.ndarray], following: list[np.ndarray]) -> pa.RecordBatch:
            new = [edited(t, f) for (_, t), f in zip(pairs, nexts, strict=True)]
            other = list(fingerprints(new, samples, width))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in pairs], pa.int64()),
                    pa.array([len(t) for _, t in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array([x.byteswap().tobytes().hex() for x in own]),
                    pa.array([x.byteswap().tobytes().hex() for x in other]),
                    pa.array([likeness(x, y) for x, y in zip(own, other, strict=True)], pa.float64()),
                    pa.array([likeness(x, y) for x, y in zip(own, following, strict=True)], pa.float64()),
                ],
                names,
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100).to_pydict()
                ids, texts, heads = part["id"], part["text"], part["head"]
                prints = list(fingerprints(texts, samples, width))
                ready, nexts, own, following = [], [], [], []
                for k, t, head, p in zip(ids, texts, heads, prints, strict=True):
                    if held:
                        ready.append(held.pop())
                        own.append(mark.pop())
                        nexts.append(t)
                        following.append(p)
                    elif head:
                        continue  # a further row of the next partition's first id
                    if not head:
                        held.append((k, t))
                        mark.append(p)
                if ready:
                    yield emit(ready, nexts, own, following)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return _with_neighbour(docs, key, text).mapInArrow(rows, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
