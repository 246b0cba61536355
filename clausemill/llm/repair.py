"""Repair of conversation structure: the cheapest edits, with a persistent audit.

A conversation's turns are read in order by a small automaton (nothing yet, system, user, assistant).
For each state the cheapest edits that lead there are kept. Their audit, one letter an edit, is a
linked node that shares its prefix with others; each node has a rolling hash of its prefix and
binary-lifting ancestors. Of equally cheap edits the ASCII-least audit counts: the longest common
prefix of two nodes is searched by hashes of ancestors, letters are compared after it, and the letters
before it as well, so that a collision of hashes costs time and never a wrong choice.

At one place and state, equally cheap audits are never a prefix of each other, as every letter more
costs more. So pieces of a conversation can be solved apart: a fragment of at most 2**FRAGMENT_BITS turns
gives the best audit from each state to each, and neighbouring fragments compose. A conversation of any
number of turns is spread over tasks; only the letters of its audit come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, laid_out, partitions

#: Turns of a fragment, as a power of two.
FRAGMENT_BITS = 10
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits and of leaving a truncated turn in place.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The role that may be made in a state, and the state after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after keeping a role with this initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
BASE, MODULUS = 1_000_003, (1 << 61) - 1


class Audits:
    """Audits as linked nodes; node 0 is the empty audit."""

    def __init__(self, base: int = BASE, modulus: int = MODULUS):
        self.base, self.modulus = base, modulus
        self.letters, self.depths, self.hashes = [""], [0], [0]
        self.ups: list[list[int]] = [[]]

    def add(self, parent: int, letter: str) -> int:
        """The audit of parent with one more letter; ups are its ancestors 1, 2, 4, ... letters before."""
        ups, ups_of = [parent], self.ups
        k, at = 0, parent
        while k < len(ups_of[at]):
            at = ups_of[at][k]
            ups.append(at)
            k += 1
        ups_of.append(ups)
        self.letters.append(letter)
        self.depths.append(self.depths[parent] + 1)
        self.hashes.append((self.hashes[parent] * self.base + ord(letter)) % self.modulus)
        return len(ups_of) - 1

    def ancestor(self, node: int, depth: int) -> int:
        left = self.depths[node] - depth
        while left:
            k = left.bit_length() - 1
            node = self.ups[node][k]
            left -= 1 << k
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ups[node][0]
        return "".join(reversed(out))

    def less(self, x: int, y: int) -> bool:
        """Whether the audit x comes before y; a prefix comes before what it is a prefix of."""
        if x == y:
            return False
        depth = min(self.depths[x], self.depths[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        order = None
        if self.hashes[a] != self.hashes[b]:
            # Down to the first letters that differ: their parents have equal hashes.
            for k in range(len(self.ups[a]) - 1, -1, -1):
                if k < len(self.ups[a]) and self.hashes[self.ups[a][k]] != self.hashes[self.ups[b][k]]:
                    a, b = self.ups[a][k], self.ups[b][k]
            order = self.letters[a] < self.letters[b]
            a, b = self.ups[a][0], self.ups[b][0]
        # Equal hashes are no proof: the letters before are compared up to a shared node.
        while a != b:
            if self.letters[a] != self.letters[b]:
                order = self.letters[a] < self.letters[b]
            a, b = self.ups[a][0], self.ups[b][0]
        return self.depths[x] < self.depths[y] if order is None else order


class Solver:
    """Reads turns in order; for each first state the best (cost, audit) of each state now."""

    def __init__(self, starts: tuple[int, ...], audits: Audits | None = None):
        self.audits = audits or Audits()
        self.best = {s: self._filled({s: (0, 0)}) for s in starts}

    def _better(self, best: dict, state: int, cost: int, parent: int, letter: str) -> None:
        """Takes an edit if it is cheaper, or as cheap and earlier in ASCII order, than what leads to the state so far."""
        was = best.get(state)
        if was is None or cost < was[0]:
            best[state] = (cost, self.audits.add(parent, letter))
        elif cost == was[0] and self.audits.less(node := self.audits.add(parent, letter), was[1]):
            best[state] = (cost, node)

    def _filled(self, best: dict) -> dict:
        """With turns inserted here: user turns first, then assistant ones, which more insertions can't make cheaper."""
        for state in (START, SYSTEM, ASSISTANT, USER):
            if state in best:
                cost, node = best[state]
                self._better(best, NEXT[state], cost + INSERT, node, "I")
        return best

    def read(self, initial: str, gone: bool, truncated: bool) -> None:
        """One turn; gone: it is blank or a duplicate and must be deleted."""
        extra = TRUNCATED if truncated else 0
        for start, was in self.best.items():
            best: dict[int, tuple[int, int]] = {}
            for state, (cost, node) in was.items():
                self._better(best, state, cost + DELETE, node, "D")
                if not gone:
                    if (kept := KEPT.get((state, initial))) is not None:
                        self._better(best, kept, cost + KEEP + extra, node, "K")
                    self._better(best, NEXT[state], cost + REROLE + extra, node, "R")
            self.best[start] = self._filled(best)

    def table(self) -> list[tuple[int, int, int, str]]:
        """(first state, last state, cost, audit)."""
        return [(s, t, cost, self.audits.text(node)) for s, best in self.best.items() for t, (cost, node) in sorted(best.items())]


def edited(state: int, letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, str, str]]:
    """(number of the row, letter, role, text) of each edit; an inserted turn has the number of the row that follows."""
    i = 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield i, letter, ROLES[state], ""
            continue
        role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            role = ROLES[state]
        elif letter == "K":
            state = KEPT[state, role[:1]]
        yield i, letter, role, text
        i += 1


_FRAGMENT = "conv {}, chunk long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_initial string, last_initial string, first_turn long, table array<struct<a:int,b:int,cost:long,audit:string>>"
_NAMES = [c.split()[0] for c in _FRAGMENT.split(", ")]
_TABLE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


class _Fragment:
    """What is counted of a fragment's turns while they pass."""

    def __init__(self, conv, at: int, bits: int):
        self.conv, self.chunk = conv, at >> bits
        # A conversation that begins inside a chunk begins there; one at its edge may go on from the chunk before.
        self.solver = Solver((START,) if at & ((1 << bits) - 1) else (START, SYSTEM, USER, ASSISTANT))
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.first_initial = self.last_initial = None

    def read(self, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.first_initial is None:
            self.first_initial, self.first_turn = initial, turn
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.solver.read(initial, blank or duplicate, truncated)

    def row(self) -> list:
        table = [{"a": a, "b": b, "cost": c, "audit": x} for a, b, c, x in self.solver.table()]
        return [self.conv, self.chunk, self.blank, self.duplicate, self.truncated, self.illegal, self.low, self.high, self.turns, self.first_initial, self.last_initial, self.first_turn, table]


def _batch(rows: list[list], kind: pa.DataType, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([kind, *types])], names)


def _solved(rows: DataFrame, bits: int) -> DataFrame:
    """(conv, at, turn, initial, blank, duplicate, truncated) -> a row a fragment, with its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 8 + [pa.string()] * 2 + [pa.int64(), _TABLE]
        now, done, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, at, turn, initial, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv or at >> bits != now.chunk:
                    if now is not None:
                        done.append(now.row())
                    now = _Fragment(conv, at, bits)
                now.read(turn, initial, blank, duplicate, truncated)
                if len(done) >= 512:
                    yield _batch(done, kind, types, _NAMES)
                    done = []
        if now is not None:
            yield _batch([*done, now.row()], kind, types, _NAMES)

    chunk = F.shiftright("at", bits)
    together = rows.repartition(partitions(rows.sparkSession), chunk).sortWithinPartitions("at")
    return together.mapInArrow(run, _FRAGMENT.format(rows.schema["conv"].dataType.simpleString()))


class _Chain:
    """An audit of several fragments: pieces linked to the one before, with the state each starts from."""

    __slots__ = ("before", "chunk", "state", "piece")

    def __init__(self, before, chunk, state, piece):
        self.before, self.chunk, self.state, self.piece = before, chunk, state, piece

    def pieces(self, stop=None) -> list:
        out, at = [], self
        while at is not None and at is not stop:
            out.append(at)
            at = at.before
        return out[::-1]


def _less(x: _Chain, y: _Chain) -> bool:
    """Whether x comes before y: chains have equally many pieces, and share their first ones."""
    a, b = x, y
    while a.before is not b.before:
        a, b = a.before, b.before
    return "".join(c.piece for c in x.pieces(a.before)) < "".join(c.piece for c in y.pieces(a.before))


_SUMMARY = "conv {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, plan array<struct<chunk:long,state:int,letters:string>>"
_PLAN = pa.list_(pa.struct([("chunk", pa.int64()), ("state", pa.int32()), ("letters", pa.string())]))


class _Whole:
    """The fragments of a conversation, one after the other."""

    def __init__(self, conv):
        self.conv, self.best = conv, {START: (0, None)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_initial = None

    def read(self, f: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + f[name])
        if self.last_initial is not None:
            self.illegal += self.last_initial + f["first_initial"] not in LEGAL
        self.last_initial = f["last_initial"]
        if f["low"] is not None:
            self.turns += f["turns"] - (f["low"] == self.high)
            self.low, self.high = f["low"] if self.low is None else self.low, f["high"]
        best: dict[int, tuple[int, _Chain]] = {}
        for x in f["table"]:
            if x["a"] in self.best:
                cost, before = self.best[x["a"]]
                new = (cost + x["cost"], _Chain(before, f["chunk"], x["a"], x["audit"]))
                was = best.get(x["b"])
                if was is None or new[0] < was[0] or new[0] == was[0] and _less(new[1], was[1]):
                    best[x["b"]] = new
        self.best = best

    def row(self) -> list:
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, chain = ends[0]
        for other in ends[1:]:
            if other[0] < cost or other[0] == cost and _less(other[1], chain):
                cost, chain = other
        pieces = chain.pieces()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        plan = [{"chunk": c.chunk, "state": c.state, "letters": c.piece} for c in pieces]
        return [self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(c.piece for c in pieces), plan]


def _summed(fragments: DataFrame) -> DataFrame:
    """Fragments -> a row a conversation, with its audit and what of it falls on each fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string(), _PLAN]
        names = [c.split()[0] for c in _SUMMARY.split(", ")]
        now, kind = None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for f in batch.to_pylist():
                if now is None or f["conv"] != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Whole(f["conv"])
                now.read(f)
            if done:
                yield _batch(done, kind, types, names)
        if now is not None:
            yield _batch([now.row()], kind, types, names)

    together = fragments.repartition(partitions(fragments.sparkSession), "conv").sortWithinPartitions("conv", "chunk")
    return together.mapInArrow(run, _SUMMARY.format(fragments.schema["conv"].dataType.simpleString()))


def _applied(laid: DataFrame, plans: DataFrame, bits: int) -> DataFrame:
    """(conv, at, k, edit, turn, role, text): every edit with the turn it leaves, deleted turns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["conv", "at", "k", "edit", "turn", "role", "text"]

        def made(head, rows):
            conv, state, letters = head
            for k, (i, letter, role, text) in enumerate(edited(state, letters, iter([r[2:] for r in rows]))):
                place = rows[min(i, len(rows) - 1)]
                yield [conv, place[0], k, letter, place[1] if letter != "I" else None, role, text]

        head, rows, kind = None, [], None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, _, at, state, letters, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:  # the first row of a fragment holds its letters
                    if head is not None:
                        out += made(head, rows)
                    head, rows = (conv, state, letters), []
                else:
                    rows.append((at, turn, role, text))
                if len(out) >= 1024:
                    yield _batch(out, kind, types, names)
                    out = []
            if out:
                yield _batch(out, kind, types, names)
        if head is not None:
            yield _batch(list(made(head, rows)), kind, types, names)

    none = lambda kind: F.lit(None).cast(kind)
    letters = plans.select("conv", F.inline("plan")).select("conv", "chunk", F.lit(-1).cast("long").alias("at"), "state", "letters", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"))
    turns = laid.select("conv", F.shiftright("at", bits).alias("chunk"), "at", none("int").alias("state"), none("string").alias("letters"), "turn", "role", "text")
    together = letters.unionByName(turns).repartition(partitions(laid.sparkSession), "chunk", "conv").sortWithinPartitions("chunk", "conv", "at")
    return together.mapInArrow(run, f"conv {laid.schema['conv'].dataType.simpleString()}, at long, k long, edit string, turn long, role string, text string")


#: A turn that has no character but ASCII white space is blank; one whose last other character is no full stop is truncated.
_SEEN = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = FRAGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """(conversations, edits) of damaged conversations.

    conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each
    conversation with turns. edits: conv, at, k, edit (K, R, D, I), turn, role, text: one row an edit,
    in the order of (at, k); those that are not D are the repaired conversation.

    Null roles and texts count as one space. Turns are read by number, nulls first; turns of equal
    number by role and a hash of their text. The first fault of a turn counts: blank, duplicate (role
    and text seen earlier), truncated. Keep costs 0, a change of role 1, Delete 2 (required for blank
    and duplicate turns), Insert of an empty turn 5; truncated turns that stay cost 5 more. The cheapest edits that give
    role initials (s?(ua)+)? are taken, of equally cheap ones those with the ASCII-least audit. A role
    of no characters can't be kept. Turns without conversation are one conversation. Conversations of
    any number of turns are spread over tasks. An empty table gives empty results; other columns are
    ignored, whatever their names.
    """
    scratch = Scratch(turns.sparkSession, "repair")
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    laid = laid_out(scratch, rows, F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text"))
    named = F.col("conv").cast("string")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.length(named), F.lit(-1)), F.coalesce(named, F.lit("")), F.length("role"), "role", "text"), 256))
    blank = ~F.col("text").rlike(_SEEN)
    facts = laid.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~F.col("text").rlike(_ENDED)).alias("open"), digest.alias("digest"))
    facts = scratch.keep(facts, "facts")
    repeated = facts.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    facts = facts.join(repeated, "digest", "left").select("conv", "at", "turn", "initial", "blank", again.alias("duplicate"), (F.col("open") & ~again).alias("truncated"))
    plans = scratch.keep(_summed(scratch.keep(_solved(facts, bits), "fragments")), "plans")
    named_back = F.col("conv").alias(conv)
    return plans.select(named_back, *[c for c in plans.columns if c not in ("conv", "plan")]), _applied(laid, plans, bits).withColumnRenamed("conv", conv)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns (conv, turn, role, text) as a careless export leaves them, by the checksum of `conv:turn`: a twentieth each is dropped, emptied, robbed of its full stops, repeated, given to the user. Nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = turns.select(conv, turn, code.alias("_code"), shown(role).alias(role), shown(text).alias(text)).where("_code <> 0")
    new_text: Column = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    new_role: Column = F.when(F.col("_code") == 4, "user").otherwise(F.col(role))
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(conv, turn, new_role.alias(role), new_text.alias(text), F.explode(copies).alias("_copy")).drop("_copy")


def repaired_digests(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256): the digest of the repaired `role:text`, joined by line feeds.

    A task hashes the turns of a conversation as they pass, in order, and holds none of them.
    """
    rows = edits.where("edit <> 'D'").select(F.col(conv).alias("conv"), "at", "k", F.concat_ws(":", "role", "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, digest = [], None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if [conv_id] != now:
                    if now:
                        done.append([now[0], digest.hexdigest()])
                    now, digest = [conv_id], hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            if done:
                yield _batch(done, kind, [pa.string()], ["conv", "repaired_sha256"])
        if now:
            yield _batch([[now[0], digest.hexdigest()]], kind, [pa.string()], ["conv", "repaired_sha256"])

    together = rows.repartition(partitions(edits.sparkSession), "conv").sortWithinPartitions("conv", "at", "k")
    return together.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string").withColumnRenamed("conv", conv)
