"""Repeated passages: paragraph MinHash banding, exact Jaccard, components; stretches by equal words.

A paragraph is a line of at least LEAST_WORDS words. Paragraphs with equal words are one class.
MinHash signatures of a class's five-word shingles are cut into bands, tuned for recall at the
threshold; classes that share a band are candidates, compared exactly by their Jaccard similarity,
and linked ones form components. Of a component's occurrences in all documents the first stays and
the others are to be removed.

A passage pasted into the middle of a line, or made of several short lines, is found by stretches,
which are compared by equal words only. A stretch begins at an anchor and ends at the first anchor
at least LEAST_WORDS words on. Anchors depend on the words nearby alone (beginnings of sentences
come first, of the rest those whose hash is the least near them), so copies have them at the same
places whatever stands around. Every word of a text is in a stretch: the first word is an anchor, a
gap of more than LONGEST words gets anchors of its own, the last stretch reaches the end, and a text
of fewer words is one stretch. Shorter repeats, such as one common line, are left alone: they say
nothing about the documents that share them.

Which stretches occur more than once is counted in packed form by ranges of hashes. They come back
as a bitmap whose size follows their number, 32 MiB at most; a stretch that it names by chance only
costs its own row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, ranges
from clausemill.llm.jaccard_join import class_components
from clausemill.llm.shingles import U, Words, in_blocks, mix, shingle_hashes, window_sums

LEAST_WORDS, WIDTH, PERCENT = 25, 5, 75
RECALL = 0.99
#: An anchor's hash is the least of the words up to so many places away; between anchors lie at most so many words.
NEAR, LONGEST = 3, 40
#: Hashes that a task packs at a time; bits of a bitmap at most and at least.
PACKED, MOST_BITS, FEWEST_BITS = 1 << 20, 1 << 28, 1 << 20


def tuned_bands(percent: int = PERCENT, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(bands, rows) of the least signature of three rows a band or more that finds a pair at the threshold with probability recall."""
    s = percent / 100
    fitting = [(b * r, r, b) for r in range(3, 9) for b in range(1, most) if expected_recall(b, r, s) >= recall]
    _, r, b = min(fitting)
    return b, r


def expected_recall(bands: int, rows: int, similarity: float) -> float:
    """Probability that two sets of this similarity share a band."""
    return 1 - math.pow(1 - similarity**rows, bands)


# --- units of texts, for blocks of texts at once ----------------------------------------------


class Units:
    """Some units of the words of a block: owner (text), first word, word after the last, key."""

    def __init__(self, words: Words, first: np.ndarray, end: np.ndarray):
        self.words, self.first, self.end = words, first, end
        self.owner = words.owner[first]
        self.keys = np.stack(window_sums(words.hashes, first, end), 1)

    def take(self, at: np.ndarray) -> Units:
        out = object.__new__(Units)
        out.words, out.first, out.end, out.owner, out.keys = self.words, self.first[at], self.end[at], self.owner[at], self.keys[at]
        return out

    def __len__(self) -> int:
        return len(self.first)

    def packed_keys(self) -> pa.Array:
        data = np.ascontiguousarray(self.keys)
        offsets = np.arange(0, 16 * len(data) + 1, 16, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

    def columns(self, base: int, batch: pa.RecordBatch) -> list[pa.Array]:
        """id, text_hash, start, end, words, class of each; base: the block's first row in the batch."""
        rows = pa.array(self.owner + base)
        ints = (self.words.starts[self.first], self.words.ends[self.end - 1], self.end - self.first)
        return [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x.astype(np.int32)) for x in ints), self.packed_keys()]


UNIT, NAMES = "id long, text_hash long, start int, end int, words int, class binary", ["id", "text_hash", "start", "end", "words", "class"]


def lines(words: Words, least: int) -> Units:
    """The lines of at least so many words."""
    first = np.flatnonzero(words.line)
    end = np.append(first[1:], len(words.hashes))[: len(first)]
    keep = end - first >= least
    return Units(words, first[keep], end[keep])


def anchors(words: Words) -> np.ndarray:
    """Numbers of the words where stretches begin and end, those put into long gaps included."""
    n = len(words.hashes)
    start = words.line.copy()
    start[1:] |= words.stop[:-1]
    value = mix(words.hashes + U(0x632BE59BD9B4E019)) >> U(1)
    value[~start] |= U(1 << 63)
    least = np.ones(n, bool)
    for k in range(1, min(NEAR + 1, n)):
        same = words.owner[k:] == words.owner[:-k]
        least[k:] &= ~same | (value[k:] < value[:-k])  # of equal words in a row the first
        least[:-k] &= ~same | (value[:-k] <= value[k:])
    least[words.begin] = True
    at = np.flatnonzero(least)
    until = np.append(at[1:], n)[: len(at)]
    more = (until - at - 1) // LONGEST
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.concatenate([at, np.repeat(at, more) + step * LONGEST]))


def stretches(words: Words, least: int) -> Units:
    """The stretches of every text; of equal ones that overlap in a text the first."""
    at = anchors(words)
    if not len(at):
        return Units(words, at, at)
    stop = words.text_end[words.owner[at]]
    bounds = np.unique(np.concatenate([at, stop]))
    fits = at + least <= stop
    first = at[fits]
    end = bounds[np.searchsorted(bounds, first + least)]
    # The last that fits also goes to the end of its text; a short text is one stretch.
    last = np.flatnonzero(np.append(words.owner[first][1:] != words.owner[first][:-1], True)[: len(first)])
    tail, goal = first[last], words.text_end[words.owner[first[last]]]
    open_ = end[last] < goal
    short = words.begin[words.text_end[words.owner[words.begin]] - words.begin < least]
    found = Units(words, np.concatenate([first, tail[open_], short]), np.concatenate([end, goal[open_], words.text_end[words.owner[short]]]))
    order = np.lexsort((found.first, found.keys[:, 0], found.owner))
    owner, key, begin, stop = found.owner[order], found.keys[order, 0], found.first[order], found.end[order]
    again = np.flatnonzero((owner[1:] == owner[:-1]) & (key[1:] == key[:-1])) + 1
    keep, until, was = np.ones(len(order), bool), 0, -1
    for i in again.tolist():
        if i - 1 != was:  # a new run of equal keys
            until = stop[i - 1]
        was = i
        if begin[i] < until:
            keep[i] = False
        else:
            until = stop[i]
    return found.take(np.sort(order[keep]))


def bands(units: Units, n_bands: int, rows: int) -> np.ndarray:
    """The band hashes of each unit, one column a band."""
    grams, sizes = shingle_hashes(units.words.hashes[_places(units)], units.end - units.first, WIDTH)
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(units), n_bands), U)
    for b in range(n_bands):
        band = np.full(len(units), U(b + 1))
        for r in range(rows):
            seed = U((b * rows + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            band = mix(band * U(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix(grams ^ seed), first))
        out[:, b] = band
    return out


def _places(units: Units) -> np.ndarray:
    n = units.end - units.first
    return np.repeat(units.first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, Words]]:
    """(batch, row of the block's first text, words of the block)."""
    for batch in batches:
        texts = [t.encode() for t in batch.column(column).to_pylist()]
        for part in in_blocks(texts):
            yield batch, part.start, Words(texts[part])


# --- distributed steps ------------------------------------------------------------------------


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(whole).alias("text_hash"), whole.alias("t"))


def paragraph_rows(texts: DataFrame, least: int, n_bands: int, rows: int) -> DataFrame:
    """Every paragraph with its bands."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, words in _blocks(batches, 2):
            units = lines(words, least)
            if len(units):
                own = bands(units, n_bands, rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, n_bands, dtype=np.int32)), pa.array(own.view(np.int64).ravel()))
                half = pa.array(np.ascontiguousarray(units.keys[:, 0]).view(np.int64))
                yield pa.RecordBatch.from_arrays([*units.columns(base, batch), half, flat], [*NAMES, "key", "bands"])

    return texts.mapInArrow(found, f"{UNIT}, key long, bands array<long>")


def _repeated_keys(texts: DataFrame, least: int, parts: int) -> DataFrame:
    """(key) of stretches that occur more than once: first key halves, so now and then one of another stretch."""

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # A key met here more than once is sent twice, however often it occurs: hot ones are cut down before the shuffle.
            keys = np.repeat(keys, np.minimum(n, 2))
            part = ((keys >> U(32)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist() + [len(order)]
            for a, b in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[order[a]])], pa.int32()), pa.array([keys[order[a:b]].tobytes()], pa.binary())], ["part", "blob"])

        n = 0
        for _, _, words in _blocks(batches, 0):
            held.append(stretches(words, least).keys[:, 0])
            n += len(held[-1])
            if n >= PACKED:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(b, U) for batch in batches for b in batch.column(1).to_pylist()]
        if blobs:
            keys = np.sort(np.concatenate(blobs))
            again = np.unique(keys[1:][keys[1:] == keys[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], ["key"])

    dealt = texts.select("t").mapInArrow(to_ranges, "part int, blob binary").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(several, "key long")


def _bitmap(keys: DataFrame) -> bytes:
    """The bits that the keys of a written table name: some 16 for each, MOST_BITS (32 MiB) at most."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (16 * keys.count()).bit_length()))
    at = keys.select((F.pmod("key", F.lit(bits)) + 1).alias("at"))  # bitmap positions count from 1
    grouped = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = bytearray(bits // 8)
    for row in grouped.collect():  # at most MOST_BITS / 32768 rows of 4 KiB
        bitmap[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = row["bits"]
    return bytes(bitmap)


def _named(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys % U(8 * len(bitmap))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _stretch_rows(texts: DataFrame, least: int, bitmap: bytes) -> DataFrame:
    """The stretches that the bitmap names, with the beginning of the line that a stretch lies in, or null."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch, base, words in _blocks(batches, 2):
            units = stretches(words, least)
            units = units.take(np.flatnonzero(_named(bits, units.keys[:, 0])))
            if len(units):
                heads = np.flatnonzero(words.line)
                of = np.searchsorted(heads, units.first, "right") - 1
                within = np.append(heads, len(words.hashes))[of + 1] >= units.end
                line = pa.array(words.starts[heads[of]].astype(np.int32), mask=~within)
                yield pa.RecordBatch.from_arrays([*units.columns(base, batch), line], [*NAMES, "line"])

    return texts.mapInArrow(found, f"{UNIT}, line int")


def _sets(texts: DataFrame, least: int, bitmap: bytes) -> DataFrame:
    """(class, n, shared) of the paragraphs that the bitmap names: their shingles."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for _, _, words in _blocks(batches, 0):
            units = lines(words, least)
            units = units.take(np.flatnonzero(_named(bits, units.keys[:, 0])))
            if len(units):
                units = units.take(np.unique(units.keys[:, 0], return_index=True)[1])
                grams, sizes = shingle_hashes(words.hashes[_places(units)], units.end - units.first, WIDTH)
                sets = [np.unique(s) for s in np.split(grams, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([units.packed_keys(), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "n", "shared"])

    found = texts.select("t").mapInArrow(candidates, "class binary, n long, shared binary")
    return found.groupBy("class").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "start")


def _paragraph_labels(scratch: Scratch, texts: DataFrame, classes: DataFrame, least: int, percent: int) -> DataFrame:
    """(class, component) of the classes (class, key, bands) that have links."""
    banded = classes.select("class", "key", F.explode("bands").alias("band"))
    several = banded.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band")
    named = scratch.keep(banded.join(several, "band").groupBy("class").agg(F.collect_list("band").alias("prefix"), F.first("key").alias("key")), "candidates")
    bitmap = _bitmap(named.select("key"))
    sets = scratch.keep(_sets(texts, least, bitmap).join(named.drop("key"), "class"), "sets")
    labels = class_components(scratch, sets, percent, nearest=True).withColumnRenamed("node", "class")
    scratch.drop(named, sets)
    return labels


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """One row per occurrence of a repeated paragraph or stretch: key, text_hash, kind, start, end, words, copies, kept_id, kept_start, removed.

    kind is 'paragraph' (a line of at least `least` words that occurs again, equal or with a Jaccard
    similarity of at least `percent` %) or 'stretch' (at least `least` equal words). A stretch has no
    row where it adds nothing: within a repeated paragraph that is removed, or that stays as it does.
    start and end are character offsets, text_hash tells texts of one key apart.

    Of the occurrences of a component, or of equal stretches, the first by (key, text_hash, start)
    stays, null keys last; kept_id and kept_start name it. Repeats within one text count. Rows with
    equal key and text are one document: they have equal rows. Null and empty texts have no words and
    no rows; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "paragraphs")
    n_bands, rows = tuned_bands(percent, recall)
    texts = _texts(docs, key, text)
    found = scratch.keep(paragraph_rows(texts, least, n_bands, rows), "paragraphs")
    classes = scratch.keep(found.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(_order()).alias("first"), F.first("key").alias("key"), F.first("bands").alias("bands")), "classes")
    labels = _paragraph_labels(scratch, texts, classes, least, percent)
    placed = scratch.keep(classes.join(labels, "class", "left").select("class", F.coalesce("component", "class").alias("component"), "copies", "first"), "placed")
    groups = placed.groupBy("component").agg(F.sum("copies").alias("copies"), F.min("first").alias("first")).where("copies > 1")
    repeated = placed.select("class", "component").join(groups, "component").drop("component")
    removed = ~F.struct("id", "text_hash", "start").eqNullSafe(F.struct("first.id", "first.text_hash", "first.start"))
    whole = scratch.keep(found.drop("bands", "key").join(repeated, "class").withColumn("removed", removed), "whole")
    scratch.drop(found, classes, placed)

    keys = scratch.keep(_repeated_keys(texts, least, ranges(docs)), "keys")
    parts = scratch.keep(_stretch_rows(texts, least, _bitmap(keys)), "stretches")
    firsts = parts.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(_order()).alias("first")).where("copies > 1")
    parts = parts.join(firsts, "class").withColumn("removed", removed)
    around = whole.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("start").alias("_start"), F.col("removed").alias("_gone")).distinct()
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("line") == F.col("_start"))
    parts = parts.join(around, same, "left").where("_gone is null or not _gone and removed")
    scratch.drop(keys)
    columns = lambda kind: [F.col("id").alias(key), "text_hash", F.lit(kind).alias("kind"), "start", "end", "words", "copies", F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"), "removed"]
    return whole.select(*columns("paragraph")).unionByName(parts.select(*columns("stretch")))


def short_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 8, least: int = LEAST_WORDS) -> DataFrame:
    """One row per occurrence of a repeated short line: key, text_hash, start, end, words, copies, kept_id, kept_start, removed.

    Short lines have `shortest` to `least` - 1 words; two are equal when their words are. They are
    counted apart from the passages of repeated_paragraphs(), as a line that many documents share says
    little about them; whoever wants them gone can cut what is marked removed. The first occurrence
    stays, as there. Equality is exact, so there are no bands. Rows with equal key and text have equal
    rows; null and empty texts have none; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "short-lines")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, words in _blocks(batches, 2):
            units = lines(words, shortest)
            units = units.take(np.flatnonzero(units.end - units.first < least))
            if len(units):
                yield pa.RecordBatch.from_arrays(units.columns(base, batch), NAMES)

    rows = scratch.keep(_texts(docs, key, text).mapInArrow(found, UNIT), "lines")
    firsts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(_order()).alias("first")).where("copies > 1")
    removed = ~F.struct("id", "text_hash", "start").eqNullSafe(F.struct("first.id", "first.text_hash", "first.start"))
    placed = rows.join(firsts, "class").withColumn("removed", removed)
    return placed.select(F.col("id").alias(key), "text_hash", "start", "end", "words", "copies", F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"), "removed")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with what repeated_paragraphs() removes cut out of their texts; other columns as they were, whatever their names.

    Rows are told apart by key and text, null keys included; rows equal in both lose the same. Null
    and empty texts stay as they are; a text all of whose words are removed keeps its white space.
    An empty table gives an empty result.
    """
    gone = repeated_paragraphs(docs, key, text, **options).where("removed")
    cuts = gone.groupBy(F.col(key).alias("k"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    # Stretches overlap: cuts that meet become one.
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, c: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], c["end"]).alias("end"))))
    grow = lambda a, c: F.when(last(a)["end"] >= c["start"], joined(a, c)).otherwise(F.concat(a, F.array(c)))
    cuts = cuts.select("k", "h", F.aggregate("cuts", F.slice("cuts", 1, 1), grow).alias("cuts"))
    # From the last cut to the first, so that offsets stay right.
    cut = lambda t, c: F.concat(F.substring(t, F.lit(1), c["start"]), t.substr(c["end"] + 1, F.length(t)))
    whole = docs[f"`{text}`"].cast("string")
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[f"`{key}`"].cast("long").alias("k"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("h"), whole.alias("t"))
    same = packed["k"].eqNullSafe(cuts["k"]) & (packed["h"] == cuts["h"])
    left = packed.join(cuts, same, "left")
    new = F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.aggregate(F.reverse("cuts"), F.col("t"), cut))
    return left.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
