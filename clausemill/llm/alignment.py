"""Alignment of two tokenizers over whole documents: an associative fragment monoid.

Both tokenizers always end a token where a word ends before a space. Between two such cuts lies a
unit, whose tokens do not depend on what stands around it. A byte range of a document is a fragment:
an open prefix (bytes up to its first cut), the closed groups of the units inside, and an open suffix
(bytes after its last cut). Two neighbours compose by closing what lies between them: the suffix of
the first with the prefix of the second. That is associative, so the fragments of a very long
document, made by many tasks, are composed as a tree, FAN at a time; whole prefixes and suffixes of
a document are closed at its ends.

Within a unit a group ends where tokens of both sides end at one byte. In a group of m and n tokens
no other ends meet, so m + n - 1 pairs of tokens overlap; they are its links.

How many documents hold a pair of ids is counted over the corpus. The few pairs that make up a
2**-HOT_BITS share of all (document, pair) rows each, at most 2**HOT_BITS of them, are sent to the
tasks; the others are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.bpe import byte_characters
from clausemill.llm.common import Scratch, partitions

#: Bytes of a fragment, and how many are composed at a time.
CHUNK, FAN = 1 << 16, 16
#: Units of more characters are not remembered; so many are, then a task forgets all and starts again.
LONG, REMEMBERED = 80, 300_000
HOT_BITS = 18
#: An id pair is one number: the first side's id times 2**B_BITS, and the second's.
B_BITS = 15
#: Letters that both libraries of the first tokenizer tell from others alike, whatever their version of Unicode.
PLAIN = re.compile(r"[\n -~¡-ɏ]+")
#: A cut lies before a space that ends a word, or that one word follows after other white space.
CUT = re.compile(r"(?<=\S)(?= )|(?<=[^\S ])(?= \S)")
#: Where every space of a text but the first is a cut, it can be split at spaces.
ODD = re.compile(r"  |[^\S ] (?:\s|$)")


class Closed(NamedTuple):
    """The closed groups of a stretch: tokens of the first side, text of the groups, packed links.

    UNLIKE has no groups: its tokens' bytes are not those of the text.
    """

    n_a: int
    groups: str
    links: bytes

    @property
    def n_groups(self) -> int:
        return self.groups.count(";") + 1 if self.groups else 0

    @property
    def n_b(self) -> int:
        return len(self.links) // 4 + self.n_groups - self.n_a


UNLIKE = Closed(-1, "", b"")
EMPTY = Closed(0, "", b"")


@dataclass
class Fragment:
    """Open prefix, closed groups, open suffix. Without a cut, closed is empty and all bytes are the prefix."""

    prefix: bytes = b""
    closed: list[Closed] | None = None
    suffix: bytes = b""


class Aligner:
    """Tokenizes units with both tokenizers and remembers their groups."""

    def __init__(self, a_source: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_source)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = {c: i for i, c in enumerate(byte_characters())}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # Each id with what may follow it: , or | after the first side's; , or ; or the end of the unit after the second's.
        self.a_texts = np.array([f"{i}{x}" for i in range(len(entries)) for x in ",|"], object)
        self.b_texts = np.array([f"{i}{x}" for i in range(len(pieces)) for x in ",;\n"], object)
        self.quick = _by_ranks(json.loads(a_source), byte)
        self.known: dict[str, Closed] = {}

    def encode_first(self, some: list[str]) -> list[list[int]]:
        """The first tokenizer's ids; common letters take the faster library, which has the same merges."""
        out: list[list[int] | None] = [self.quick(u) if PLAIN.fullmatch(u) else None for u in some] if self.quick else [None] * len(some)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([some[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode_second(self, some: list[str]) -> list[list[int]]:
        """The second tokenizer's ids of units; the model adds the space that a unit starts with, but not to an empty text."""
        space = [self.b.piece_to_id("▁")]
        return [ids if u != " " else space for u, ids in zip(some, self.b.encode([u[1:] for u in some], num_threads=1))]

    def _together(self, some: list[str]) -> list[Closed] | None:
        """The groups of units that don't end in white space, tokenized as one text; None if that text is not spelled by its tokens."""
        text = "".join(some)
        first, second = self.quick(text), self.b.encode(text[1:])
        raw = text.encode()
        if b"".join([self.a_bytes[t] for t in first]) != raw or b"".join([self.b_bytes[t] for t in second]) != raw:
            return None
        return self._grouped(np.array(first), np.array(second), np.cumsum([len(u.encode()) for u in some]))

    def _grouped(self, first: np.ndarray, second: np.ndarray, units_end: np.ndarray) -> list[Closed]:
        """The groups of each unit; all tokens of the units on both sides, and the byte at which each unit ends."""
        ends_a, ends_b = np.cumsum(self.a_sizes[first]), np.cumsum(self.b_sizes[second])
        ends = np.union1d(ends_a, ends_b)
        links = (first[np.searchsorted(ends_a, ends)] << B_BITS | second[np.searchsorted(ends_b, ends)]).astype("<u4").tobytes()
        # A group ends where both sides do; the group of each token; its place in the text of all groups.
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
        texts = np.empty(len(first) + len(second), object)
        texts[np.arange(len(first)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = self.a_texts[first * 2 + last_a]
        units_b = np.searchsorted(ends_b, units_end) + 1
        ended = np.zeros(len(second), np.int64)
        ended[units_b - 1] = 1
        texts[np.arange(len(second)) + np.cumsum(sizes_a)[group_b]] = self.b_texts[second * 3 + last_b + ended]
        groups = "".join(texts.tolist()).split("\n")
        links_end = (4 * (np.searchsorted(ends, units_end) + 1)).tolist()
        n_a = np.diff(np.searchsorted(ends_a, units_end) + 1, prepend=0).tolist()
        return [Closed(n, text, links[start:end]) for n, text, start, end in zip(n_a, groups, [0, *links_end], links_end)]

    def align(self, some: list[str]) -> list[Closed]:
        """The groups of units, each of which starts with a space."""
        if self.quick:
            joint = [i for i, u in enumerate(some) if not u[-1].isspace() and PLAIN.fullmatch(u)]
            made = self._together([some[i] for i in joint]) if joint else None
            if made is not None:
                out = dict(zip(joint, made))
                rest = [i for i in range(len(some)) if i not in out]
                out |= zip(rest, self._each([some[i] for i in rest]))
                return [out[i] for i in range(len(some))]
        return self._each(some)

    def _each(self, some: list[str]) -> list[Closed]:
        a, b = self.encode_first(some), self.encode_second(some)
        spelled = [u.encode() for u in some]
        out = [UNLIKE] * len(some)
        good = [i for i, raw in enumerate(spelled) if b"".join([self.b_bytes[t] for t in b[i]]) == raw and b"".join([self.a_bytes[t] for t in a[i]]) == raw]
        if good:
            first, second = (np.array([t for i in good for t in side[i]]) for side in (a, b))
            for i, c in zip(good, self._grouped(first, second, np.cumsum([len(spelled[i]) for i in good]))):
                out[i] = c
        return out

    def learn(self, units: set[str]) -> dict[str, Closed]:
        """The closed groups of units that are not remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted(units - self.known.keys())
        found = {}
        for at in range(0, len(new), 4096):
            found.update(zip(new[at : at + 4096], self.align(new[at : at + 4096])))
        self.known.update((u, c) for u, c in found.items() if len(u) <= LONG)
        return found

    def closed(self, texts: list[list[str]]) -> list[list[Closed]]:
        """The closed groups of lists of units."""
        all_ = set().union(*texts)
        known = self.known
        new = self.learn(all_)
        if len(new) < len(all_):
            new |= {u: known[u] for u in all_ if u not in new}
        return [list(map(new.__getitem__, units)) for units in texts]


def _by_ranks(spec: dict, byte: dict[str, int]) -> Callable[[str], list[int]] | None:
    """The first tokenizer by ranks, if its ids are in the order of its merges and its words are the usual ones."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(set(merged)) < len(merged) or len(ranks) != 256 + len(merged):
        return None
    import tiktoken

    words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("first", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def units(text: str) -> list[str]:
    """The units of a text that starts with a space."""
    if ODD.search(text) is None:
        return [" " + w for w in text[1:].split(" ")]
    return [u for u in CUT.split(text) if u]


def fragment(raw: bytes) -> tuple[bytes, list[str] | None, bytes]:
    """(prefix, units inside or None without a cut, suffix) of a byte range, which may begin and end within a character."""
    low, high = 0, len(raw)
    while low < min(3, len(raw)) and raw[low] & 0xC0 == 0x80:
        low += 1
    for back in range(1, min(4, high - low) + 1):
        if raw[high - back] & 0xC0 != 0x80:
            need = 1 if raw[high - back] < 0x80 else 2 if raw[high - back] < 0xE0 else 3 if raw[high - back] < 0xF0 else 4
            high -= back if need > back else 0
            break
    text = raw[low:high].decode()
    cuts = [m.start() for m in CUT.finditer(text)]
    # A cut that the last character decides may look otherwise with what follows.
    while cuts and cuts[-1] + 1 >= len(text):
        cuts.pop()
    if not cuts:
        return raw, None, b""
    first, last = cuts[0], cuts[-1]
    inside = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return raw[:low] + text[:first].encode(), inside, text[last:].encode() + raw[high:]


def merge(closed: list[Closed]) -> Closed:
    """Neighbouring closed groups as one."""
    if len(closed) == 1:
        return closed[0]
    n_a, groups, links = zip(*closed) if closed else ((), (), ())
    if -1 in n_a:
        return UNLIKE
    return Closed(sum(n_a), ";".join(filter(None, groups)), b"".join(links))


def compose(aligner: Aligner, parts: list[Fragment]) -> Fragment:
    """Fragments that follow each other as one."""
    out = Fragment()
    for p in parts:
        if out.closed is None:
            out = Fragment(out.prefix + p.prefix, p.closed, p.suffix)
        elif p.closed is None:
            out = Fragment(out.prefix, out.closed, out.suffix + p.prefix)
        else:
            between = aligner.closed([units((out.suffix + p.prefix).decode())])[0]
            out = Fragment(out.prefix, [*out.closed, *between, *p.closed], p.suffix)
    return Fragment(out.prefix, None if out.closed is None else [merge(out.closed)], out.suffix)


def close(aligner: Aligner, whole: Fragment) -> Closed:
    """The groups of a document: its prefix and suffix end with it."""
    ends = [units(x.decode()) if x else [] for x in (whole.prefix, whole.suffix)]
    first, last = aligner.closed(ends)
    return merge([*first, *(whole.closed or []), *last])


_loaded: dict[str, Aligner] = {}

#: The columns of a document's alignment that align_documents() can give, with their types.
COLUMNS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "groups_sha256": "string"}
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _document(whole: Closed) -> dict:
    """A document's values; without tokens all are zero and the text of groups is empty."""
    if whole is UNLIKE or whole.n_a < 0:
        whole = EMPTY
    ids, times = np.unique(np.frombuffer(whole.links, "<u4"), return_counts=True)
    digest = hashlib.sha256(whole.groups.encode()).hexdigest() if whole.n_groups else ""
    return {"n_a": whole.n_a, "n_b": whole.n_b, "n_groups": whole.n_groups, "n_links": len(whole.links) // 4, "groups": whole.groups, "groups_sha256": digest, "pairs": ids.astype(np.int32), "times": times.astype(np.int32)}


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def _columns(made: list[dict], names: tuple[str, ...]) -> list[pa.Array]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return [*(pa.array([m[c] for m in made], kinds[COLUMNS[c]]) for c in names), _lists([m["pairs"] for m in made]), _lists([m["times"] for m in made])]


class _Sources:
    """Both tokenizer files, read by the driver and sent to the tasks; they have a fixed size."""

    def __init__(self, spark, a_path: str | None, b_path: str | None):
        if a_path is None or b_path is None:
            import public_tokenizers

            a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
        with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
            a, b = f.read(), g.read()
        self.name = hashlib.sha256(a.encode() + b).hexdigest()
        self.sent = spark.sparkContext.broadcast((a, b))

    def aligner(self) -> Aligner:
        if self.name not in _loaded:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _loaded[self.name] = Aligner(*self.sent.value)
        return _loaded[self.name]


def _short(rows: DataFrame, sources: _Sources, names: tuple[str, ...]) -> DataFrame:
    """(row, k, t) of documents that are one fragment -> (row, k, columns, pairs, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sources.aligner()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [units(" " + t) if t else [] for t in part.column(2).to_pylist()]
                made = [_document(merge(c)) for c in aligner.closed(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_columns(made, names)], ["row", "k", *names, "pairs", "times"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, k {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in names) + ", pairs array<int>, times array<int>")


_FRAGMENT = "row long, i long, n long, prefix binary, inside boolean, suffix binary, n_a long, groups string, links binary"


def _packed(rows: list[tuple[int, int, int, Fragment]]) -> pa.RecordBatch:
    body = [merge(f.closed or []) for *_, f in rows]
    arrays = [
        *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
        pa.array([f.prefix for *_, f in rows], pa.binary()),
        pa.array([f.closed is not None for *_, f in rows], pa.bool_()),
        pa.array([f.suffix for *_, f in rows], pa.binary()),
        pa.array([c.n_a for c in body], pa.int64()),
        pa.array([c.groups for c in body], pa.string()),
        pa.array([c.links for c in body], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _FRAGMENT.split(", ")])


def _fragments(rows: DataFrame, sources: _Sources) -> DataFrame:
    """(row, i, n, raw), the byte ranges of documents, as fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sources.aligner()
        for batch in batches:
            for r in batch.to_pylist():
                prefix, inside, suffix = fragment(r["raw"])
                closed = None if inside is None else aligner.closed([inside])[0]
                yield _packed([(r["row"], r["i"], r["n"], Fragment(prefix, closed, suffix))])

    return rows.mapInArrow(run, _FRAGMENT)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[Fragment]]]:
    """FAN fragments of a row at a time, as they lie in sorted batches."""
    at, parts = None, []
    for batch in batches:
        for start in range(batch.num_rows):
            r = batch.slice(start, 1).to_pylist()[0]
            key = (r["row"], r["i"] // FAN, -(-r["n"] // FAN))
            if key != at and at is not None:
                yield (*at, parts)
                parts = []
            at = key
            parts.append(Fragment(r["prefix"], [Closed(r["n_a"], r["groups"], r["links"])] if r["inside"] else None, r["suffix"]))
    if at is not None:
        yield (*at, parts)


def _composed(rows: DataFrame, sources: _Sources) -> DataFrame:
    """One level of the tree: FAN neighbours become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sources.aligner()
        for row, i, n, parts in _neighbours(batches):
            yield _packed([(row, i, n, compose(aligner, parts))])

    together = rows.repartition(partitions(rows.sparkSession), F.col("row"), F.floor(F.col("i") / FAN)).sortWithinPartitions("row", "i")
    return together.mapInArrow(run, _FRAGMENT)


def _finished(rows: DataFrame, sources: _Sources, names: tuple[str, ...]) -> DataFrame:
    """Fragments that are whole documents -> (row, columns, pairs, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sources.aligner()
        for row, _, _, parts in _neighbours(batches):
            made = [_document(close(aligner, parts[0]))]
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *_columns(made, names)], ["row", *names, "pairs", "times"])

    return rows.mapInArrow(run, "row long, " + ", ".join(f"{c} {COLUMNS[c]}" for c in names) + ", pairs array<int>, times array<int>")


def _aligned(scratch: Scratch, docs: DataFrame, key: str, text: str, sources: _Sources, names: tuple[str, ...], chunk: int) -> DataFrame:
    """(row, k, columns, pairs, times), one row a document, written."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("row", F.monotonically_increasing_id())
    is_long = F.coalesce(F.octet_length("t") >= chunk, F.lit(False))
    short = _short(plain.where(~is_long).select((F.col("row") * 2).alias("row"), "k", "t"), sources, names)
    long = scratch.keep(plain.where(is_long).select((F.col("row") * 2 + 1).alias("row"), "k", F.concat(F.lit(" ").cast("binary"), F.col("t").cast("binary")).alias("raw")), "long")
    short = scratch.keep(short, "short")
    most = long.agg(F.max(F.octet_length("raw"))).first()[0]
    if most is None:
        return short
    n = F.ceil(F.octet_length("raw") / F.lit(chunk))
    ranges = long.select("row", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"), n.alias("n"), "raw")
    ranges = ranges.select("row", "i", "n", F.expr(f"substring(raw, cast(i * {chunk} + 1 as int), {chunk})").alias("raw"))
    level = scratch.keep(_fragments(ranges.repartition(partitions(spark), "row", "i"), sources), "fragments")
    left = -(-most // chunk)
    while left > 1:
        above = scratch.keep(_composed(level, sources), "fragments")
        scratch.drop(level)
        level, left = above, -(-left // FAN)
    whole = _finished(level, sources, names).join(long.select("row", "k"), "row")
    whole = scratch.keep(whole.select(*short.columns), "whole")
    scratch.drop(level)
    return short.unionByName(whole)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair, and whether that is the most of its first id."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    first = F.shiftright("pair", B_BITS)
    # A row a pair of ids and, per first id, at most one row a task after partial aggregation.
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return counts.withColumn("first", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = tuple(COLUMNS), chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: key, the named columns, n_best and count_sum.

    n_a, n_b: tokens of space + text by the first (byte-level BPE) and second tokenizer (a piece model
    that adds the space), special tokens as plain text. groups: their ids, cut where tokens of both end
    at one byte. n_links: pairs of token occurrences whose byte ranges overlap. count_sum: sum over
    links of the number of documents that hold the pair of ids; n_best: links whose number is the
    highest of their first id, ties included.

    Texts that are null or empty, or whose tokens of either side don't spell space + text, have no
    tokens: zeros and empty texts. Whole texts count, however long; those of chunk bytes or more are
    made by several tasks. Repeated rows each have a row and count as documents each. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    aligned = _aligned(scratch, docs, key, text, _Sources(spark, a_path, b_path), columns, chunk)
    counts = scratch.keep(pair_counts(aligned), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most 2**HOT_BITS pairs have a larger share than 2**-HOT_BITS of the total.
    often = F.col("n") > total >> HOT_BITS
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    hot = F.broadcast(counts.where(often))
    by_hot = links.join(hot, "pair").groupBy("row").agg(*sums)
    by_rare = links.join(hot, "pair", "left_anti").join(counts.where(~often), "pair").groupBy("row").agg(*sums)
    summed = by_hot.unionByName(by_rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.select("row", "k", *columns).join(summed, "row", "left")
    return out.select(F.col("k").alias(key), *columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))
