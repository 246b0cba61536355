"""Byte-pair encoding and decoding of a word vocabulary, over whole documents.

A word's parts and the ranks of its adjacent pairs lie in two contiguous arrays. The least rank is
looked for again and again; its boundary is deleted and the ranks of its two neighbours are looked up
anew. Words over LONG parts, which are rare, take the same merges from a heap, so that their time
does not grow with the square of their length.

The vocabulary file is read by the driver and sent to the tasks as it is; it has a fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts above which a word takes the heap.
LONG = 128
#: Words that a task remembers; then it forgets all and starts again.
REMEMBERED = 400_000
NONE = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A tokenizer file with lower-casing, a split into words, and word-end symbols."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        letters = byte_characters()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + self.suffix) for c in letters]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}"))
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = special
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return b"".join(i.to_bytes(4, "little") for i in ids), " ".join(self.tokens[i] for i in ids)

    def merged(self, parts: list[int]) -> list[int]:
        """The ids of a word's parts after all merges."""
        merges = self.merges
        if len(parts) > LONG:
            return self._merged_long(parts)
        found = merges.get
        absent = (NONE, 0)
        ranks = [found(a << 32 | b, absent)[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = merges[parts[at] << 32 | parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = found(parts[at - 1] << 32 | parts[at], absent)[0]
            if at < len(ranks):
                ranks[at] = found(parts[at] << 32 | parts[at + 1], absent)[0]
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get(parts[i] << 32 | parts[j])):
                heapq.heappush(queue, (m[0], i, parts[i], parts[j], m[1]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            if parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue  # a neighbour has merged since
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [p for p in parts if p != -1]

    def word(self, word: str) -> tuple[bytes, str]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self._packed(self.merged([p for p in parts if p is not None]))

    def _plain(self, text: str, out: list[tuple[bytes, str]]) -> None:
        if not text.isascii():
            # Letter by letter: a capital sigma has one small form here, at the end of a word too.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known = self.known
        for w in self.words.findall(text.lower()):
            if (got := known.get(w)) is None:
                got = known[w] = self.word(w)
            out.append(got)

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list[tuple[bytes, str]] = []
        if self.marks is not None and "<" in text:
            for piece in self.marks.split(text):
                if piece in self.special:
                    out.append(self._packed([self.special[piece]]))
                elif piece:
                    self._plain(piece, out)
        else:
            self._plain(text, out)
        return b"".join([i for i, _ in out]), " ".join([t for _, t in out if t])


_loaded: dict[str, WordBPE] = {}

#: The columns that encode_documents() can give, with their types.
COLUMNS = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """One row per row of docs: key and the named columns; ids are packed little-endian 32-bit integers.

    path: a tokenizer file that the driver can read; None takes the installed word vocabulary. Null
    texts are empty; an empty text has no ids and decodes to the empty text. Whole texts are encoded,
    however long. Repeated rows give repeated rows, an empty table an empty one. Other columns are
    ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        source = f.read()
    name = hashlib.sha256(source.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(source)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = WordBPE(sent.value)
        bpe = _loaded[name]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                made = [bpe.encode(t) for t in texts.slice(at, 256).to_pylist()]
                give = {
                    "n_tokens": lambda: pa.array([len(i) // 4 for i, _ in made], pa.int64()),
                    "ids": lambda: pa.array([i for i, _ in made], pa.binary()),
                    "decoded": lambda: pa.array([t for _, t in made], pa.string()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(i).hexdigest() for i, _ in made], pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in made], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *(give[c]() for c in columns)], ["k", *columns])

    plain = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = plain.schema["k"].dataType.simpleString()
    return plain.mapInArrow(rows, f"k {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns)).withColumnRenamed("k", key)
