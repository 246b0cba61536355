"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of a fixed number of characters. All blocks are sorted into
integer names: equal blocks get one name, different blocks different names. Adjacent names are then
paired and each pair is named anew, until every row has one name. Names come from comparing whole
blocks and whole pairs, so two rows share their last name only if their texts are equal.

A 64-bit digest of a block only chooses where it is compared. Blocks that share a digest are
collected as a set, sorted, and told apart by their place in it; so a collision of digests costs a
second look and never a wrong name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, fold, numbered

#: Characters in a block. Most texts are one block; the longest known need a few rounds of pairs.
BLOCK = 4096


def _name_blocks(scratch: Scratch, narrow: DataFrame, blocks: DataFrame) -> DataFrame:
    """narrow (keys, pos, digest) -> (keys, pos, name); blocks (keys, pos, digest, block) has the texts as well."""
    # The text moves once, after each task has dropped what it has twice; only counts are written.
    sizes = scratch.keep(blocks.groupBy("digest").agg(F.size(F.collect_set("block")).alias("n")), "alphabet")
    slots = sizes.select("digest", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    named = scratch.keep(numbered(scratch, slots, F.col("digest"), F.col("slot"), name="name"), "names")
    shared = sizes.where("n > 1").select("digest")
    if not shared.limit(1).count():
        return narrow.join(named.drop("slot"), "digest").drop("digest")
    # Digests with several texts: sort and compare the texts themselves.
    alone = narrow.join(shared, "digest", "left_anti").join(named.where("slot = 0").drop("slot"), "digest").drop("digest")
    alphabet = blocks.join(shared, "digest", "left_semi").groupBy("digest").agg(F.array_sort(F.collect_set("block")).alias("texts"))
    texts = alphabet.select("digest", F.posexplode("texts").alias("slot", "block")).join(named, ["digest", "slot"]).drop("slot")
    several = blocks.join(texts, ["digest", "block"]).drop("block", "digest")
    return alone.unionByName(several.select(*alone.columns))


def _cut(text: str, block: int, digest: Callable[[Column], Column], whole: bool) -> Column:
    """The blocks of a text as structs (pos, digest) or (pos, digest, block)."""
    n = F.ceil(F.length(text) / F.lit(block)).cast("int")
    one = lambda pos, b: F.struct(pos.alias("pos"), digest(b).alias("digest"), *([b.alias("block")] if whole else []))
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(i, F.substring(F.col(text), i * block + 1, F.lit(block))))
    return F.when(F.length(text) <= block, F.array(one(F.lit(0), F.col(text)))).otherwise(many)


def identities(scratch: Scratch, rows: DataFrame, keys: list[str], text: str, block: int = BLOCK, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(keys, text) -> (keys, identity, blocks, rows): rows says for how many rows of the input one stands.

    Two rows have equal (identity, blocks) exactly when their texts are equal: each number of blocks
    has its own rounds of pairs. Rows that repeat in all keys must have equal texts.
    """
    n = F.greatest(F.ceil(F.length(text) / F.lit(block)), F.lit(1)).cast("int")
    narrow = scratch.keep(rows.select(*keys, n.alias("blocks"), F.inline(_cut(text, block, digest, False))), "digests")
    names = scratch.keep(_name_blocks(scratch, narrow, rows.select(*keys, n.alias("blocks"), F.inline(_cut(text, block, digest, True)))), "level")
    done = names.where("blocks = 1").select(*keys, "name", "blocks", F.lit(1).cast("long").alias("rows"))
    level = names.where("blocks > 1").withColumn("left", F.col("blocks")).withColumn("rows", F.lit(None).cast("long"))
    while level.limit(1).count():
        # Pairs (2i, 2i + 1); a last one alone pairs with -1. Then one row a pair, at most two rows a group.
        pair = level.groupBy(*keys, "blocks", "left", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            # Rows that repeat become one here; the first round counts them.
            F.coalesce(F.max("rows"), F.sum(F.when(F.col("pos") % 2 == 0, 1))).alias("rows"),
        )
        pair = scratch.keep(pair, "pairs")
        named = numbered(scratch, pair.select("first", "second").distinct(), F.col("first"), F.col("second"), name="name")
        level = scratch.keep(pair.join(named, ["first", "second"]).select(*keys, "blocks", ((F.col("left") + 1) / 2).cast("int").alias("left"), "pos", "name", "rows"), "level")
        done = done.unionByName(level.where("left = 1").select(*keys, "name", "blocks", "rows"))
        level = level.where("left > 1")
    return done.select(*keys, F.col("name").alias("identity"), "blocks", "rows")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
    the row with the largest key stays. Repeated rows (equal key and text) are counted in group_size
    and each returned; the largest key's row is kept, and of its repeats all are marked kept, as
    nothing tells them apart. A null key is smaller than any other; where all keys of a group are
    null, keep_id is null and the rows are kept. An empty table gives an empty result. Other columns
    of docs are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(key).alias("k"), fold(F.col(text)).alias("t")).withColumn("h", F.sha2("t", 256))
    # Rows are told apart by key and digest while their blocks travel.
    placed = scratch.keep(identities(scratch, rows, ["k", "h"], "t", block, digest), "placed")
    groups = placed.groupBy("identity", "blocks").agg(F.max("k").alias("keep_id"), F.sum("rows").alias("group_size"))
    out = placed.join(groups, ["identity", "blocks"]).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(F.col("k").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("h").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() drops; columns and texts as they were, whatever their names.

    Null and empty texts are equal texts. A null key is smaller than any other. Of repeats of the kept
    row (equal key and text) one stays, whichever. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup-keep")
    key_text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    kept = exact_duplicates(docs, key, text).where("kept").select(key_text(F.col(key)).alias("k"), F.col("text_sha256").alias("h"))
    kept = scratch.keep(kept.groupBy("k", "h").agg(F.count(F.lit(1)).alias("rows")), "kept")
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), key_text(docs[f"`{key}`"]).alias("k"), F.sha2(fold(docs[f"`{text}`"]), 256).alias("h"))
    joined = packed.join(kept, ["k", "h"])
    if kept.where("rows > 1").limit(1).count():
        same = Window.partitionBy("k", "h").orderBy(F.lit(1))  # the join has brought them together
        joined = joined.withColumn("n", F.row_number().over(same)).where("n = 1")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
