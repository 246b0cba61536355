"""Streaming forms: documents analysed once as they arrive, and a watch over runs without heartbeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STALE_MS, ATTEMPTS = 90_000, 3
#: Halvings of a batch that fails, by bits of a 64-bit hash of the key: enough for any batch, as a part with one key is halved no more.
HALVINGS = 63
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _salvaged(rows: DataFrame, analyse: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, str, str, int], None], key: str) -> None:
    """Writes the analysis of rows; where it fails, of halves of them by a hash of the key, so that only rows that fail by themselves are left out."""
    n = 0
    todo = [(0, 0)]  # (bits, value): the rows whose hash ends in these bits
    while todo:
        bits, value = todo.pop()
        part = rows.where(F.xxhash64(F.col(key)).bitwiseAND((1 << bits) - 1) == value) if bits else rows
        n += 1
        try:
            write(analyse(part), n)
        except Exception as e:
            code = getattr(e, "getCondition", lambda: None)() or type(e).__name__
            # What can't be planned fails for any rows.
            if isinstance(e, AnalysisException) or bits == HALVINGS or part.select(key).distinct().limit(2).count() < 2:
                failed(part, str(code), str(e)[:500], n)
            else:
                todo += [(bits + 1, value), (bits + 1, value | 1 << bits)]


def ingest_stream(
    spark: SparkSession, folder: str, schema: str, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    key: str | None = None, checks: dict[str, Column] | None = None, repeats_within: str = "7 days",
) -> StreamingQuery:
    """Each new row of a folder's files goes through analyse once; a micro-batch that is run again overwrites its own output.

    key: the column that names a row, the first of the schema without one. A row that arrives again
    with equal values, in another file or the same, within repeats_within of its first arrival is
    dropped. checks: code -> condition; rows for which one is true are not analysed. They, and rows on
    which the analysis fails as it runs, go to out-errors as (key, error, batch), with the code of the
    check or the condition of the error, and stop neither the others nor the stream. A batch whose
    analysis can't even be planned leaves all of its rows there.
    """
    source = spark.readStream.schema(schema).format("parquet").option("maxFilesPerTrigger", 16).load(folder)
    key = key or source.columns[0]
    # Rows are dated by their arrival: none is ever too late, and what was seen is forgotten in time.
    new = source.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", repeats_within).dropDuplicatesWithinWatermark(source.columns).drop("_arrived")
    code = F.lit(None).cast("string")
    for name, condition in reversed((checks or {}).items()):
        code = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(code)

    def save(df: DataFrame, number: int, part: int, folder: str) -> None:
        df.withColumn("batch", F.lit(number)).withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_code", code).persist()
        try:
            errors = lambda df, code, error, part: save(df.select(F.col(key).cast("string").alias("key"), code.alias("code"), error.alias("error")), number, part, f"{out}-errors")
            bad = rows.where("_code is not null")
            if bad.limit(1).count():
                errors(bad, F.col("_code"), F.lit(None).cast("string"), 0)
            good = rows.where("_code is null").drop("_code")
            _salvaged(good, analyse, lambda df, part: save(df, number, part, out), lambda df, code, error, part: errors(df, F.lit(code), F.lit(error), part), key)
        finally:
            rows.unpersist()

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Watch(StatefulProcessor):
    """The state of a run: heartbeats that event time has not reached yet, the last one that it has, and how often the run was put back since."""

    def __init__(self, stale_ms: int, attempts: int):
        self.stale_ms, self.attempts = stale_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, tried int")
        self.ahead = handle.getListState("ahead", "ms long")

    def _upto(self, run, now: int) -> Iterator[pd.DataFrame]:
        """All that happened up to now, in order: heartbeats, and times at which the run had been silent for too long."""
        last, tried = self.last.get() if self.last.exists() else (None, 0)
        ahead = sorted(x[0] for x in self.ahead.get())
        reached = [x for x in ahead if x <= now]
        rows = []
        for beat in [*reached, None]:
            while last is not None and tried < self.attempts:
                due = last + (tried + 1) * self.stale_ms
                if due > now or (beat is not None and due >= beat):
                    break
                tried += 1
                rows.append((run, due, "fail" if tried >= self.attempts else "requeue"))
            if beat is not None:
                last, tried = beat, 0
        later = ahead[len(reached) :]
        if last is not None:
            self.last.update((last, tried))
        if reached:
            if later:
                self.ahead.put([(x,) for x in later])
            else:
                self.ahead.clear()
        waits = later[:1] + ([last + (tried + 1) * self.stale_ms] if last is not None and tried < self.attempts else [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if waits:
            self.handle.registerTimer(max(min(waits), now + 1))
        elif last is not None:
            self.last.clear()  # failed, and silent: nothing more is due
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "ms", "action"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            beats = part["ms"].dropna()
            if len(beats):
                self.ahead.appendList([(int(x),) for x in beats])
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._upto(key[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stalled_runs(heartbeats: DataFrame, stale_ms: int = STALE_MS, attempts: int = ATTEMPTS, delay: str = "1 minute") -> DataFrame:
    """(run_id, ts) stream -> (run_id, at, action): a run silent for stale_ms of event time is put back, and fails after so many times.

    Heartbeats wait until the watermark has passed them, so actions don't depend on how rows were
    dealt to batches. A heartbeat, also of a run that failed, makes the run alive again. Times are cut
    to milliseconds; rows without ts say nothing. Sets the session's state store to RocksDB, which
    states of several variables need.
    """
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    ts = F.col("ts").cast("timestamp")
    beats = heartbeats.select("run_id", ts.alias("ts"), F.unix_millis(ts).alias("ms")).withWatermark("ts", delay)
    kind = beats.schema["run_id"].dataType.simpleString()
    actions = beats.groupBy("run_id").transformWithStateInPandas(Watch(stale_ms, attempts), f"run_id {kind}, ms long, action string", "append", "eventTime")
    return actions.select("run_id", F.timestamp_millis("ms").alias("at"), "action")


def watch(actions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query of stalled_runs() that appends its actions to a folder until all that is there has been read."""
    return actions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_gaps(heartbeats: DataFrame, gap: str = "90 seconds") -> DataFrame:
    """Batch or stream: the sessions of each run, cut where it was silent for longer than gap."""
    return heartbeats.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select("run_id", F.col("w.start").alias("start"), "beats")
