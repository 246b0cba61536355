"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from clausemill.llm import queries, repair

EDGE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        letters = EDGE.findall(text)
        kind = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """All edit sequences by state (last initial), as (cost, audit, repaired): a plain dictionary of whole strings."""
    def inserted(states):
        best = dict(states)
        todo = list(states.items())
        while todo:
            last, (cost, audit, made) = todo.pop()
            for role in ("user", "assistant"):
                if (role == "user" and last in ("", "s", "a")) or (role == "assistant" and last == "u"):
                    new = (cost + 5, audit + "I", made + [f"{role}:"])
                    if role[0] not in best or new[:2] < best[role[0]][:2]:
                        best[role[0]] = new
                        todo.append((role[0], new))
        return best

    states = inserted({"": (0, "", [])})
    for (_, _, role, text), kind in zip(rows, kinds):
        new = {}

        def put(last, cost, audit, made):
            if last not in new or (cost, audit) < new[last][:2]:
                new[last] = (cost, audit, made)

        for last, (cost, audit, made) in states.items():
            put(last, cost + 2, audit + "D", made)
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind == "truncated" else 0
            for edit, r in (("K", role), ("R", "user"), ("R", "assistant")):
                i = r[:1]
                if (i == "s" and last == "") or (i == "u" and last in ("", "s", "a")) or (i == "a" and last == "u"):
                    put(i, cost + more + (edit == "R"), audit + edit, made + [f"{r}:{text}"])
        states = inserted(new)
    return min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damaged(sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1])))
        kinds = faults(own)
        turns = [t for _, t, _, _ in own if t is not None]
        starts = [r[2][:1] for r in own]
        cost, audit, made = cheapest(own, kinds)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])),
            cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def some_rows(draw):
    rows = []
    for conv in [*range(120), None]:
        n = draw.choice([1, 2, 3, 5, 8, 20]) if conv != 7 else 300
        for turn in range(n):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", None]) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, draw.choice([turn, turn * 2 + 1000, None]) if draw.random() < 0.05 else turn * 1, role, draw.choice(["Yes.", "No!", "so", None, "", " \t", f"w{turn}?", "Yes.", "ends .\n"])))
    # One row a (conv, turn), as only such rows have a defined order.
    return list({r[:2]: r for r in rows}.values())


@pytest.mark.parametrize("bits", [10, 2])
def test_repair_equals_search(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(repair, "repair_conversations", functools.partial(repair.repair_conversations, bits=bits))
    rows = some_rows(random.Random(bits))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, `a.b` string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_repeated_rows_and_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "open"), (2, None, "user", ""), (3, 5, "assistant", "Late.")]
    whole, edits = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.duplicate, r.blank, r.truncated, r.cost, r.audit) for r in whole.collect()} == {1: (1, 0, 1, 4, "KDKD"), 2: (0, 1, 0, 2, "D"), 3: (0, 0, 0, 2, "D")}
    made = sorted(((r.conv_id, r.at, r.k, r.edit, r.turn, r.role, r.text) for r in edits.collect()))
    assert [(r[0], *r[3:]) for r in made] == [(1, "K", 0, "user", "Hi."), (1, "D", 0, "user", "Hi."), (1, "K", 1, "assistant", "Yes."), (1, "D", 2, "assistant", "open"), (2, "D", None, "user", ""), (3, "D", 5, "assistant", "Late.")]


def test_audits_compare_as_texts_whatever_the_hashes():
    draw = random.Random(5)
    for base, modulus in ((repair.BASE, repair.MODULUS), (3, 5), (1, 1)):  # the last ones collide all the time
        audits = repair.Audits(base, modulus)
        nodes = [0]
        for _ in range(400):
            nodes.append(audits.add(draw.choice(nodes[-12:]), draw.choice("DIKR" if draw.random() < 0.3 else "D")))
        for _ in range(3000):
            x, y = draw.choice(nodes), draw.choice(nodes)
            assert audits.less(x, y) == (audits.text(x) < audits.text(y))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    whole, edits = repair.repair_conversations(repair.damage(empty))
    assert whole.collect() == [] and edits.collect() == [] and repair.repaired_digests(edits).collect() == []
