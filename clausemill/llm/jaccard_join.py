"""N-gram Jaccard join by T-occurrence search, with connected components.

Documents link when intersection over union of their sets of five-word shingles is at least 75 %.

1. Texts with equal words are one class; classes, not copies, are joined.
2. Inverted lists. Tasks pack the shingles of their classes by ranges of shingle hashes; each range
   learns how many classes have each shingle. A shingle of one class can link nothing and is dropped
   here, which leaves few.
3. Prefixes. The rest returns to its class. A class of n shingles can only have a partner if at
   least ceil(0.75 n) of its shingles are shared; others are done. In one global order, rarest first,
   two linked classes share a shingle among the first n - ceil(0.75 n) + 1 of each, unshared ones
   counted. These prefix shingles are the only ones that make candidates, and common passages, which
   come last in the order, seldom are among them.
4. Search. In each list of a prefix shingle (one of those with equal members) the most central class
   is the hub. A hub is the query of a T-occurrence search over candidates: T is the least overlap
   that a link needs; short lists are merged by a heap, long ones probed by bisection (DivideSkip),
   and classes that reach their overlap are linked. All classes of a list are candidates of its hub.
   Lists with several components left are compared pair by pair where short; in long ones the classes
   outside the largest component are queries that search the others block by block. So every two
   classes that share a prefix shingle are compared or already connected, and a large group of copies
   costs a comparison or two a class instead of all pairs.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, components, ranges
from clausemill.llm.shingles import U, shingle_sets

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 5, 75
#: Shingles that a task packs at a time.
PACKED = 1 << 19
#: Lists of at most this many classes are compared pair by pair after their hub; classes in a block of a larger one.
SMALL, BLOCK = 32, 256
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOW = U((1 << 48) - 1)


def class_key(raw: bytes) -> bytes:
    """16 bytes that stand for a text's sequence of words."""
    return hashlib.blake2b(b" ".join(raw.translate(_FOLD).split()), digest_size=16).digest()


def least_overlap(n, m, percent: int = PERCENT):
    """Least intersection of sets of n and m members that reaches percent of the union."""
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(query: np.ndarray, records: list[np.ndarray], least: int) -> dict[int, int]:
    """Overlaps with query of the records that share at least `least` members with it; all sorted and distinct."""
    sizes = np.fromiter(map(len, records), np.int64, len(records))
    members = np.concatenate(records) if records else np.zeros(0, query.dtype)
    owner = np.repeat(np.arange(len(records)), sizes)
    at = np.searchsorted(query, members)
    hit = at < len(query)
    hit[hit] = query[at[hit]] == members[hit]
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    bounds = np.flatnonzero(np.diff(at[order], prepend=-1))
    lists = [x.tolist() for x in np.split(owner[order], bounds[1:])] if len(order) else []
    if len(lists) < least:
        return {}
    lists.sort(key=len)
    longest = len(lists[-1])
    # The rule of the method for the number of long lists: longer ones to probe cost more a probe.
    far = max(0, min(least - 1, int(least / (0.0085 * np.log2(max(longest, 2)) + 1))))
    short, long_ = lists[: len(lists) - far], lists[len(lists) - far :]
    found = {}
    for record, run in groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        if count < least - far:
            continue
        for k, one in enumerate(long_):
            if count + far - k < least:
                break
            i = bisect_left(one, record)
            count += i < len(one) and one[i] == record
        if count >= least:
            found[record] = count
    return found


# --- packed lists -----------------------------------------------------------------------------


def _pack(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, extra: list[np.ndarray]) -> bytes:
    return b"".join([len(keys).to_bytes(4, "little"), keys.tobytes(), sizes.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), *(x.tobytes() for x in extra)])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview]:
    m = int.from_bytes(blob[:4], "little")
    a, b, c = 4 + 16 * m, 4 + 20 * m, 4 + 24 * m
    return np.frombuffer(blob[4:a], "V16"), np.frombuffer(blob[a:b], "<i4"), np.frombuffer(blob[b:c], "<i4"), memoryview(blob)[c:]


def _six(values: np.ndarray) -> np.ndarray:
    """The low 48 bits of each value in six bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: memoryview, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw[: 6 * n], np.uint8).reshape(n, 6)
    return wide.view("<u8").ravel()


def _dealt(keys: np.ndarray, sizes: np.ndarray, owner: np.ndarray, part: np.ndarray, values: list[np.ndarray], head: bytes = b"") -> Iterator[tuple[int, bytes]]:
    """(part, packed lists) for entries sorted by owner: owner indexes keys and sizes, values go along."""
    order = np.argsort(part, kind="stable")
    part, owner = part[order], owner[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
    for a, b in zip(cuts, cuts[1:]):
        own, counts = np.unique(owner[a:b], return_counts=True)
        yield int(part[a]), head + _pack(keys[own], sizes[own], counts, [v[order[a:b]] for v in values])


def _rows(batches: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, blob in batches:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])


def _classes(docs: DataFrame, key: str, text: str, digest: bool = False) -> DataFrame:
    """(id, class, n), with digest also h, that of the text: class null and n 0 for texts without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                raw = [t.encode() for t in batch.column(1).slice(at, 500).to_pylist()]
                n = [len(s) for s in shingle_sets(raw, WIDTH)]
                keys = [class_key(t) if k else None for t, k in zip(raw, n, strict=True)]
                own = [batch.column(2).slice(at, 500)] if digest else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), *own], ["id", "class", "n", "h"][: 3 + len(own)])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    if digest:
        plain = plain.withColumn("h", F.sha2("t", 256))
    return plain.mapInArrow(rows, "id long, class binary, n long" + ", h string" * digest)


def _shared(docs: DataFrame, text: str, parts: int, percent: int) -> DataFrame:
    """(class, n, shared, prefix): classes that may have a partner, with the shingles that other classes have too."""

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys: list[bytes] = []
        sets: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            values = np.concatenate(sets)
            part = ((values >> U(48)) % U(parts)).astype(np.uint16)
            yield from _rows(_dealt(np.frombuffer(b"".join(keys), "V16"), sizes, np.repeat(np.arange(len(sets)), sizes), part, [_six(values)]))
            keys.clear()
            sets.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                raw = []
                for t in batch.column(0).slice(at, 500).to_pylist():
                    b = t.encode()
                    k = class_key(b)
                    if k not in seen:
                        seen.add(k)
                        raw.append(b)
                        keys.append(k)
                for s in shingle_sets(raw, WIDTH):
                    sets.append(s)
                    held += len(s)
                if held >= PACKED:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, owner, values, here, base = [], [], [], [], 0, 0
        for batch in batches:
            for here, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, n, c, rest = _unpack(blob)
                keys.append(k)
                sizes.append(n)
                owner.append(np.repeat(np.arange(base, base + len(k), dtype=np.int64), c))
                values.append(_from_six(rest, int(c.sum())))
                base += len(k)
        if not keys:
            return
        keys, sizes, owner, values = map(np.concatenate, (keys, sizes, owner, values))
        # A class that several tasks met counts once.
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        again = first[which] != np.arange(len(which))
        if again.any():
            keep = ~again[owner]
            owner, values = owner[keep], values[keep]
        sizes, owner = sizes[first], which[owner]
        order = np.argsort(values, kind="stable")
        starts = np.flatnonzero(np.diff(values[order], prepend=U(1 << 63)))
        runs = np.diff(np.append(starts, len(order)))
        classes = np.empty(len(order), np.int64)
        classes[order] = np.repeat(runs, runs)
        keep = classes > 1
        owner, values, classes = owner[keep], values[keep], classes[keep]
        if not len(owner):
            return
        order = np.argsort(owner, kind="stable")
        owner, values, classes = owner[order], values[order], classes[order]
        # Eighths of the binary logarithm: rarity in one byte.
        rarity = np.minimum(255, np.log2(classes) * 8).astype(np.uint8)
        head = np.frombuffer(keys.tobytes(), "<u8").reshape(-1, 2)[:, 0]
        part = (head[owner] % U(parts)).astype(np.uint16)
        yield from _rows(_dealt(keys, sizes, owner, part, [_six(values), rarity], here.to_bytes(4, "little")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, owner, values, rarity, base = [], [], [], [], [], 0
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                here = int.from_bytes(blob[:4], "little")
                k, n, c, rest = _unpack(blob[4:])
                m = int(c.sum())
                keys.append(k)
                sizes.append(n)
                owner.append(np.repeat(np.arange(base, base + len(k), dtype=np.int64), c))
                values.append(_from_six(rest, m) | U(here << 48))
                rarity.append(np.frombuffer(rest[6 * m :], np.uint8))
                base += len(k)
        if not keys:
            return
        keys, sizes, owner, values, rarity = map(np.concatenate, (keys, sizes, owner, values, rarity))
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        sizes, owner = sizes[first].astype(np.int64), which[owner]
        shared = np.bincount(owner, minlength=len(keys))
        needed = -(-percent * sizes // 100)
        keep = (shared >= needed)[owner]
        owner, values, rarity = owner[keep], values[keep], rarity[keep]
        order = np.lexsort((values, rarity, owner))
        owner, values = owner[order], values[order]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(owner)]
        out = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            k = int(owner[a])
            mine = values[a:b]
            first_few = mine[: b - a - int(needed[k]) + 1]
            out.append((keys[k].tobytes(), int(sizes[k]), np.sort(mine).tobytes(), first_few.view(np.int64).tolist()))
            if len(out) == 500 or i == len(cuts) - 2:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.list_(pa.int64()))], ["class", "n", "shared", "prefix"])
                out = []

    plain = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    packed = "part int, blob binary"
    ranged = plain.mapInArrow(to_ranges, packed).repartitionById(parts, F.col("part"))
    counted = ranged.mapInArrow(count, packed).repartitionById(parts, F.col("part"))
    return counted.mapInArrow(prefixes, "class binary, n long, shared binary, prefix array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among candidate pairs (a, b): each a is searched for over its candidates."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                a, b, n, m = (part.column(i).to_pylist() for i in range(4))
                mine, other = part.column(4), part.column(5)
                groups: dict[bytes, list[int]] = {}
                for i, k in enumerate(a):
                    groups.setdefault(k, []).append(i)
                links = []
                for k, rows in groups.items():
                    query = np.frombuffer(mine[rows[0]].as_buffer(), "<u8")
                    records = [np.frombuffer(other[i].as_buffer(), "<u8") for i in rows]
                    least = min(least_overlap(n[i], m[i], percent) for i in rows)
                    for r, overlap in divide_skip(query, records, least).items():
                        i = rows[r]
                        if 100 * overlap >= percent * (n[i] + m[i] - overlap):
                            links.append((k, b[i]))
                if links:
                    x, y = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    one = sets.select(F.col("class").alias("a"), F.col("n").alias("an"), F.col("shared").alias("as"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bs"))
    full = pairs.join(two, "b").join(one, "a").select("a", "b", "an", "bn", "as", "bs")
    return full.mapInArrow(search, "a binary, b binary")


def _searched(scratch: Scratch, big: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links that lists (gram, class, n, label) of many classes still hide.

    Lists that share components form a cluster. Of each cluster the classes outside its largest
    component are queries; all its classes are dealt into blocks, and every block is searched by
    every query. A task holds one block and one part of the queries, however large the cluster.
    """
    shares = big.select("gram", F.col("label").alias("b")).distinct()
    leaders = shares.groupBy("gram").agg(F.min("b").alias("a"))
    clusters = components(scratch, shares.join(leaders, "gram").select("a", "b").where("a <> b").distinct())
    members = big.select("class", "n", "label").distinct().join(clusters.select(F.col("node").alias("label"), F.col("component").alias("cluster")), "label")
    members = scratch.keep(members, "members")
    per = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("out"))
    dealt = per.select("cluster", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil(F.col("out") / BLOCK).alias("parts"))
    rows = members.join(dealt, "cluster")
    own = lambda n: F.pmod(F.xxhash64("class", F.lit(2)), n)
    searched = rows.select("class", "label", "cluster", own(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"))
    queries = rows.where("label <> main").select("class", "label", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), own(F.col("parts")).alias("part"), F.lit(True).alias("query"))
    full = searched.unionByName(queries).join(sets.select("class", "n", "shared"), "class")

    def search(table: pa.Table) -> pa.Table:
        query = np.asarray(table.column("query").combine_chunks().to_pylist(), bool)
        keys, labels, n = table.column("class").to_pylist(), table.column("label").to_pylist(), np.asarray(table.column("n").to_pylist())
        shared = [np.frombuffer(x, "<u8") for x in table.column("shared").to_pylist()]
        records = np.flatnonzero(~query)
        links = []
        for q in np.flatnonzero(query).tolist():
            # Sizes too far apart can't link; of the rest the smallest says what a link needs at least.
            near = records[(np.minimum(n[records], n[q]) * 100 >= np.maximum(n[records], n[q]) * percent)]
            near = [i for i in near.tolist() if labels[i] != labels[q]]
            if near:
                least = int(least_overlap(n[q], min(n[i] for i in near), percent))
                for r, overlap in divide_skip(shared[q], [shared[i] for i in near], least).items():
                    i = near[r]
                    if 100 * overlap >= percent * (n[i] + n[q] - overlap):
                        links.append((keys[q], keys[i]))
        x, y = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary())})

    return full.groupBy("cluster", "block", "part").applyInArrow(search, "a binary, b binary")


def class_components(scratch: Scratch, sets: DataFrame, percent: int = PERCENT, nearest: bool = False) -> DataFrame:
    """(node, component) for classes with links.

    With nearest, each class first meets one hub only, that of its largest list: fewer links where
    copies share many lists, as they do the bands of a signature.
    """
    # A class with few shingles of its own is near the middle of its copies: it is the better hub.
    own = (F.col("n") - F.octet_length("shared") / 8) / F.col("n")
    lists = sets.select(F.col("class"), "n", F.round(own, 3).alias("own"), F.explode("prefix").alias("gram"))
    # Of lists with equal members (two 64-bit sums and the length agree) one is enough.
    members = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).where("k > 1")
    several = members.groupBy("k", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "k")
    lists = scratch.keep(lists.join(several, "gram"), "lists")
    fits = f"least(n, m) * 100 >= greatest(n, m) * {percent}"
    two = lambda df: df.select("gram", F.col("class").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))

    # The hub of each list against its other classes.
    hubs = lists.groupBy("gram").agg(F.min_by(F.struct("class", "n"), F.struct("own", "class")).alias("hub")).select("gram", F.col("hub.class").alias("a"), F.col("hub.n").alias("n"))
    pairs = lists.select("gram", "k", F.col("class").alias("b"), F.col("n").alias("m")).join(hubs, "gram").where("a <> b").where(fits)
    if nearest:
        best = pairs.groupBy("b").agg(F.min(F.struct((-F.col("k")).alias("k"), "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        labels = components(scratch, scratch.keep(_linked(best, sets, percent), "links"))
        # Then only in lists that still have several components.
        lists = _torn(scratch, lists, labels)
        hub = lists.join(hubs.select("gram", "a"), "gram").where(F.col("class") == F.col("a")).select("gram", "a", "n", "label")
        pairs = two(lists).join(hub, "gram").where("label <> other").where(fits)
        labels = _merged(scratch, labels, _linked(pairs.select("a", "b").distinct(), sets, percent))
        lists = lists.drop("label")
    else:
        labels = components(scratch, scratch.keep(_linked(pairs.select("a", "b").distinct(), sets, percent), "links"))

    # Then what is left of lists with several components, the hub taken out.
    left = _torn(scratch, lists, labels, hubs.select("gram", F.col("a").alias("hub")))
    one = left.where(f"k <= {SMALL}")
    pairs = one.select("gram", F.col("class").alias("a"), "n", "label").join(two(one), "gram").where("a < b and label <> other").where(fits)
    more = _linked(pairs.select("a", "b").distinct(), sets, percent)
    big = left.where(f"k > {SMALL}")
    if big.limit(1).count():
        more = more.unionByName(_searched(scratch, big, sets, percent))
    return _merged(scratch, labels, more)


def _torn(scratch: Scratch, lists: DataFrame, labels: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """The lists (gram, k, class, n) whose classes, hubs left out, have several components, with label."""
    named = lists.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")
    if hubs is not None:
        named = named.join(hubs, "gram").where("class <> hub")
    torn = named.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    return scratch.keep(named.join(torn, "gram").select("gram", "k", "class", "n", "label"), "left")


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: an edge for each class and each two components that links join, however many do."""
    links = scratch.keep(links, "links")
    if not links.limit(1).count():
        return labels
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    both = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    joined = both.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
    return components(scratch, labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joined))


def near_duplicate_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id.

    component_id is the smallest key that links lead to, the row's own included. A null key is
    larger than any other; a component of null keys only has a null component_id. Rows without
    words or text have no shingles and are linked with nothing: their component is their own key.
    Rows with equal words are linked. An empty table gives an empty result; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    rows = scratch.keep(_classes(docs, key, text), "classes")
    sets = scratch.keep(_shared(docs, text, ranges(docs), percent), "sets")
    labels = class_components(scratch, sets, percent)
    placed = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = scratch.keep(placed.select("id", "n", "component"), "placed")
    least = placed.where("component is not null").groupBy("component").agg(F.min("id").alias("low"))
    out = placed.join(least, "component", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest key, null keys last; columns and texts as they were, whatever their names.

    Of rows that share this key the one of the smallest text digest stays, of its repeats (equal key
    and text) one. Rows without words stay. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-keep")
    rows = scratch.keep(_classes(docs, key, text, digest=True).where("class is not null"), "classes")
    sets = scratch.keep(_shared(docs, text, ranges(docs), percent), "sets")
    labels = class_components(scratch, sets, percent).withColumnRenamed("node", "class")
    named = rows.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = scratch.keep(named.groupBy("component", "id", "h").agg(F.count(F.lit(1)).alias("rows")), "named")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    first = named.groupBy("component").agg(F.min(order).alias("first"))
    placed = named.join(first, "component").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
    placed = scratch.keep(placed.select("id", "h", "rows", "stays"), "placed")
    whole = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[f"`{key}`"].cast("long").alias("k"), F.sha2(whole, 256).alias("d"))
    same = lambda df, other: df["k"].eqNullSafe(other["id"]) & (df["d"] == other["h"])
    gone = placed.where("not stays")
    left = packed.join(gone, same(packed, gone), "left_anti")
    again = placed.where("stays and rows > 1")
    if again.limit(1).count():
        one = left.join(again, same(left, again), "left_semi").dropDuplicates(["k", "d"])
        left = left.join(again, same(left, again), "left_anti").unionByName(one)
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
