"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document has an expected number of copies, its source's target over its source's size. Within
a source the documents are laid end to end by expected copies, one random offset is added, and a
document is emitted once for each whole number that its stretch crosses. Documents lie in order of
size, so every size is taken in proportion, and a source's taken words differ from its target by
about one document.

Expected copies are whole multiples of 1 / UNIT, so their sums are exact and the same in any order
of addition, and reruns agree. A source is not summed in one task: all rows are sorted by source, size
and key into ranges of about equal numbers of rows, so a large source spans many; each range is summed
by source, the running sums over the ranges of a source (a row a range) say where each begins, and
the running sum within a range goes on from there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import WORD, Scratch, numbered, partitions

#: One expected copy in fixed point.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most this many times its source's size.
MOST = 3


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_units(seed: int) -> int:
    """The random offset, below one expected copy, that a seed stands for."""
    return int.from_bytes(hashlib.sha256(str(seed).encode()).digest()[:8], "big") % UNIT


def source_targets(scratch: Scratch, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in order of code point, null last, take the weights in turn and share the sum of all
    sizes by weight. A target stops at most times its source's size; the excess is shared anew among
    the others until none is above. Each round is one sum over the table of sources.
    """
    ranked = numbered(scratch, sources, F.col("source").asc_nulls_last(), name="rank")
    turn = (F.col("rank") % len(weights) + 1).cast("int")
    state = scratch.keep(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")), "ranked")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level = -1.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = state.agg(F.sum(F.when(full, cap)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        above = (total - (row["given"] or 0.0)) / row["weight"] if row["weight"] else level
        if above <= level:
            break
        level = above
    return state.select("source", "source_size", F.round(F.least(cap, F.col("weight") * F.lit(max(level, 0.0))), 6).alias("target"))


def systematic_copies(scratch: Scratch, rows: DataFrame, offset: int) -> DataFrame:
    """Adds copies to rows (id, tie, source, size, units): how often each is taken.

    units are expected copies times UNIT, offset is below UNIT. Rows with equal id and tie are
    interchangeable.
    """
    # A null source is a source like others: sorted and joined by a key that is never null.
    rows = rows.withColumn("src", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")))
    order = [F.col("src"), F.col("size"), F.col("id").asc_nulls_first(), F.col("tie")]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    # Number of the range in the upper bits, place within it in the lower 33.
    placed = scratch.keep(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    sums = placed.groupBy("part", "src").agg(F.sum("units").alias("sum"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", "src", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("part", "src").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.col("upto") + F.lit(offset)
    crossed = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("units"), UNIT_BITS)
    return placed.withColumn("upto", F.sum("units").over(upto)).join(starts, ["part", "src"]).withColumn("copies", crossed).drop("part", "src", "at", "start", "upto")


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, tie, source, size, source_size, target, copies.

    Null texts have size 0. A null source is a source of its own, the last one. Empty documents have
    expected copies like others and add no words. A source of size 0 has target 0 and no copies. An
    empty table gives an empty result. tie is a hash of the text that orders repeated rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    sized = scratch.keep(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = scratch.keep(source_targets(scratch, totals, weights, most), "targets")
    units = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("long")
    wanted = wanted.withColumn("units", units).withColumnRenamed("source", "_source")
    placed = sized.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return systematic_copies(scratch, placed, offset_units(seed)).drop("units")


def _row_name(key: Column, source: Column, tie: Column) -> Column:
    """What tells rows apart: key, source and text, nulls included."""
    return F.concat_ws("/", F.coalesce(key.cast("long").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")), tie)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as mix_plan() takes it; columns as they were, whatever their names.

    Nulls and empty texts count as in mix_plan(). Of repeats (equal key, source and text) the copies
    are all of one of them, as nothing but other columns tells them apart. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    plan = mix_plan(docs, key, text, source, **options)
    named = plan.groupBy(_row_name(F.col("id"), F.col("source"), F.col("tie")).alias("name"))
    taken = scratch.keep(named.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "taken")
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), _row_name(docs[f"`{key}`"], docs[f"`{source}`"], F.xxhash64(docs[f"`{text}`"])).alias("name"))
    out = packed.join(taken.where("copies > 0"), "name")
    if taken.where("rows > 1").limit(1).count():  # repeats of one row: the first stands for all
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.lit(1)))).where("n = 1")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
