"""A stored index: postings written once in blocks with an upper bound of their gain, so that a search can skip blocks.

Clauses with the counts of their tokens are bucketed by clause. Postings of a token lie in order of gain,
the largest first. A block holds neighbours of one token and the largest gain among them. Blocks are
bucketed by token and slice (a token of very many clauses spans slices): queries move, postings don't.
Texts are shuffled once to make the first table, and its postings once to make the second.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions.scratch import keep, shared_folder
from clausemill.operators import knowledge

#: Postings of a block, as a power of two; a token of more clauses than SLICE is dealt to slices of about that many.
BLOCK_BITS, SLICE = 7, 1 << 16
#: Scores are compared at nine decimals: what is closer to the threshold than this may still tie.
MARGIN = 1e-6


@dataclass(frozen=True)
class StoredIndex:
    """Names of the tables: blocks (token, slice, bound, head, n, postings), tokens (token, idf, top), clauses (did, length, terms)."""

    spark: SparkSession
    name: str
    slices: int
    mean_length: float | None

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")


def _store(df: DataFrame, name: str, by: list[str], buckets: int) -> DataFrame:
    """df in buckets; it is dealt by these columns already, so that each task writes a file of each of its buckets."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *by).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def _saturated(tf: Column, length: Column, mean_length: float | None) -> Column:
    """What a token adds to a clause's BM25 score, but for its idf and the weight of the query's token."""
    k1, b = knowledge.K1, knowledge.B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean_length).cast("double")))


def write_index(documents: DataFrame, fields: dict[str, float], buckets: int | None = None) -> StoredIndex:
    """The index of (did, fields), as tables of the session's catalogue in the shared folder; a new one each time.

    Clauses without tokens are in no list. Null ids are left out.
    """
    spark = documents.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"index_{uuid.uuid4().hex}"
    # Texts move, tokens don't: those of a clause are counted where its text is.
    texts = documents.where("did is not null").repartition(buckets, "did")
    texts = texts.select("did", F.inline(F.array(*[F.struct(F.col(f).cast("string").alias("field"), F.lit(w).alias("w")) for f, w in fields.items()])))
    counts = knowledge.token_rows(texts).groupBy("did", "token").agg(F.sum("w").alias("tf"))
    clauses = _store(counts.groupBy("did").agg(F.sum("tf").alias("length"), F.collect_list(F.struct("token", "tf")).alias("terms")), f"{name}_clauses", ["did"], buckets)
    n, mean_length = clauses.agg(F.count(F.lit(1)), F.avg("length")).first()
    gains = clauses.select("did", F.inline("terms"), "length").select("token", "did", _saturated(F.col("tf"), F.col("length"), mean_length).alias("gain"))
    slices, slice_ = 1, F.lit(0)
    if n > SLICE:
        frequent = keep(gains.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > SLICE))
        slices = ((frequent.agg(F.max("df")).first()[0] or 1) - 1) // SLICE + 1
        gains = gains.join(F.broadcast(frequent.select("token", F.lit(True).alias("_dealt"))), "token", "left")  # one row for over SLICE postings
        slice_ = F.when(F.col("_dealt"), F.pmod(F.hash("did"), F.lit(slices))).otherwise(0)
    lists = gains.groupBy("token", slice_.cast("int").alias("slice")).agg(F.sort_array(F.collect_list(F.struct("gain", "did")), asc=False).alias("all"))
    last = F.size("all") - 1
    # By element: slice() would copy the whole list for each block.
    block = lambda i: F.sequence(F.shiftleft(i, BLOCK_BITS), F.least(F.shiftleft(i + 1, BLOCK_BITS) - 1, last))
    cut = F.transform(F.sequence(F.lit(0), F.shiftright(last, BLOCK_BITS)), lambda i: F.transform(block(i), lambda j: F.get("all", j)))
    blocks = lists.select("token", "slice", F.posexplode(cut).alias("block", "postings"))
    # The first two blocks of a token, in its first slice, make the threshold of a search.
    blocks = blocks.select("token", "slice", F.col("postings")[0]["gain"].alias("bound"), ((F.col("slice") == 0) & (F.col("block") < 2)).alias("head"), F.size("postings").alias("n"), "postings")
    blocks = _store(blocks, f"{name}_blocks", ["token", "slice"], buckets)
    df = blocks.groupBy("token").agg(F.sum("n").alias("df"), F.max("bound").alias("top"))
    _store(df.select("token", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "top"), f"{name}_tokens", ["token"], buckets)
    return StoredIndex(spark, name, slices, mean_length)


def _needed(index: StoredIndex, query: DataFrame, condition: Column) -> DataFrame:
    """(qid, did, gain) of the postings in the blocks that a condition on query and block lets through."""
    slices = query.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(index.slices - 1))))
    found = slices.join(index.table("blocks"), ["token", "slice"]).where(condition)
    return found.select("qid", "weight", F.inline("postings")).select("qid", "did", (F.col("weight") * F.col("gain")).alias("gain"))


def _scores(index: StoredIndex, clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """(did) -> qid, did, score of these clauses for all queries, from their stored counts: a clause's tokens are read once for all queries, and stay where they are."""
    counts = index.table("clauses").join(clauses.select("did").distinct(), "did").select("did", "length", F.inline("terms"))
    gain = F.col("weight") * _saturated(F.col("tf"), F.col("length"), index.mean_length)
    return counts.join(terms, "token").select("qid", "did", gain.alias("gain")).groupBy("qid", "did").agg(F.sum("gain").alias("score"))


def top_n(index: StoredIndex, query: DataFrame, n: int = 40) -> DataFrame:
    """(qid, token, weight) -> (qid, did, score, rank), what knowledge.top_n() gives on all scores.

    The clauses that gain most in the first blocks of the queries' tokens are scored: the n-th best of
    these is a threshold that a query's result reaches. A clause whose strongest token (by what it can
    add at most) lies in a block below cannot exceed that block's bound and all that weaker tokens can
    add; where that is less than the threshold, the block is skipped. Clauses of the other blocks are scored.
    """
    terms = query.join(index.table("tokens"), "token").withColumn("weight", F.col("weight") * F.col("idf")).withColumn("most", F.col("weight") * F.col("top"))
    weaker = Window.partitionBy("qid").orderBy("most", F.desc("token")).rowsBetween(Window.unboundedPreceding, -1)
    terms = keep(terms.withColumn("rest", F.coalesce(F.sum("most").over(weaker), F.lit(0.0))).select("qid", "token", "weight", "rest"))
    words = terms.select("qid", "token", "weight")
    partial = _needed(index, terms, F.col("head")).groupBy("qid", "did").agg(F.sum("gain").alias("part"))
    placed = lambda scores, by: scores.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by)))).where(F.col("_n") <= n)
    floor = placed(_scores(index, placed(partial, "part"), words), "score").where(F.col("_n") == n).select("qid", (F.col("score") - MARGIN).alias("least"))
    limited = keep(terms.join(floor, "qid", "left").fillna(0.0, "least"))
    candidates = _needed(index, limited, F.col("bound") * F.col("weight") + F.col("rest") >= F.col("least"))
    scores = _scores(index, candidates, words).join(limited.select("qid", "least").distinct(), "qid").where("score >= least")
    return knowledge.top_n(scores.select("qid", "did", "score"), n)
