"""Written tables that cut lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; a local one only where none is set (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and reread: a lost executor costs a reread."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes kept tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_kept_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def each_text(rows: DataFrame, text: str, work: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows with the columns that work finds in their text alone: each text is read once, however many rows have it.

    work takes the texts and the name of their key (a column `text` beside it) and returns rows with that
    key; rows whose text has none there go. The texts are written in as many files as a shuffle has tasks:
    a small table is one file, whose patterns one task would read alone.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keep(rows.select(text).distinct().repartition(parts, text).withColumn("_id", F.monotonically_increasing_id()))
    found = keep(texts.withColumnRenamed(text, "_text").join(work(texts, "_id").drop(text), "_id").drop("_id"))
    return rows.join(found, F.col(text).eqNullSafe(F.col("_text"))).drop("_text")


def none_left(df: DataFrame) -> bool:
    return not df.limit(1).count()


def laid_out(df: DataFrame, *order: Column) -> DataFrame:
    """df, kept in the given order, with a long `at` that grows along it: a range shuffle sorts, no task sees all rows."""
    sorted_ = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return keep(sorted_.withColumn("at", F.monotonically_increasing_id()))


class Dealt:
    """A kept table in as many buckets by some columns as a shuffle has tasks, to which rounds add rows: joins on these columns don't move it.

    It is a table of the session's catalogue in the shared folder, with a folder for each value of `round_`.
    """

    def __init__(self, df: DataFrame, by: list[str], round_: str | None = None, placed: bool = False):
        self.spark, self.by, self.round_ = df.sparkSession, by, round_
        self.name = f"dealt_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.add(df, placed)

    def add(self, df: DataFrame, placed: bool = False) -> None:
        # Dealt as the buckets are, so that each task writes one file of each round. placed: df's tasks are so already.
        df = df if placed else df.repartition(self.buckets, *self.by)
        writer = df.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, *self.by)
        (writer.partitionBy(self.round_) if self.round_ else writer).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df, kept in buckets."""
    return Dealt(df, list(by)).table()
