"""Helpers that the training-data operators share."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text.

    In a text of ASCII, lower() does just that, and much faster than translate().
    """
    text = F.coalesce(text, F.lit(""))
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(letters)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A cluster names it in spark.checkpoint.dir. Only where that is unset (tests on one machine)
    a local folder is set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and not a rerun.

    keep(df) writes df as Parquet and returns the reread table; drop(df) deletes one that no later
    step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        conf, was = self.spark.conf, self.spark.conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")  # what was shuffled for it is not needed once it is written
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(docs: DataFrame) -> int:
    """How many ranges to deal packed hashes of docs into: the session's shuffle partitions, or the splits that docs are read in if those are more."""
    return max(partitions(docs.sparkSession), docs.rdd.getNumPartitions())


def numbered(scratch: Scratch, df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Dense integers 0, 1, ... in the given total order, without one task seeing all rows.

    A range shuffle sorts, each range counts its rows (one small row a range), and running sums of
    those counts are added to the position within the range.
    """
    sorted_ = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = scratch.keep(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # a row a range
    starts, total = {}, 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        starts[row["_part"]] = total
        total += row["_n"]
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    table = df.sparkSession.createDataFrame(list(starts.items()), "_part long, _start long")
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(name, F.col("_start") + low).drop("_part", "_start", "_at")


def laid_out(scratch: Scratch, rows: DataFrame, *order: Column) -> DataFrame:
    """rows, written in the given order, with a long `at` that grows along it; rows that are equal in all of order may lie in several ranges."""
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    sorted_ = salted.repartitionByRange(partitions(rows.sparkSession), *order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt"))
    return scratch.keep(sorted_.drop("_salt").withColumn("at", F.monotonically_increasing_id()), "laid-out")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the least node.

    Each round every node takes the least label among its neighbours and itself, then the label of
    that label (pointer jumping), until no label changes: rounds grow with the logarithm of the
    diameter. Labels live in written tables; only the count of changes reaches the driver.
    Empty edges give an empty table. Null ends are left out.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node is not null and other is not null and node <> other")
    both = scratch.keep(both.union(both.select("other", "node")).distinct(), "edges")
    labels = scratch.keep(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("seen"))
        best = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = labels.join(best, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("hop"))
        jump = labels.select(F.col("node").alias("hop"), F.col("component").alias("jumped"))
        new = hooked.join(jump, "hop", "left").select("node", "was", F.least("hop", F.coalesce("jumped", "hop")).alias("component"))
        moves = Observation()
        new = scratch.keep(new.observe(moves, F.count_if(F.col("was") != F.col("component")).alias("n")).drop("was"), "labels")
        scratch.drop(labels)
        labels = new
        if not moves.get["n"]:
            scratch.drop(both)
            return labels
