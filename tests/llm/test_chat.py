"""Chat formatting: logs folded one event at a time, round trips, and escapes."""

import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm import chat, queries

PIECES = ["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "[\\INST]", "[\\\\/INST]", "<\\/s>", "<", "[", "\\", "/s>", "\n", "a", " ", "é", "👩"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=8))
def test_rendered_turns_read_back(turns):
    made = [chat.render(*t) for t in turns]
    assert list(chat.parse("".join(m[0] for m in made))) == turns
    assert [chat.unescape(m[0][m[1] : m[2]]) for m in made] == [t for _, t in turns]
    assert all(chat.CONTROL.search(m[0][m[1] : m[2]]) is None or "\\" in chat.CONTROL.search(m[0][m[1] : m[2]])[2] for m in made)


def fold(events):
    """The messages of one conversation, event by event."""
    rank = {"start": 0, "edit": 1, "regenerate": 2, "delta": 3}
    messages = {}
    for message, seq, kind, role, text in sorted((e for e in events if e[2] in rank), key=lambda e: (e[1] is not None, e[1] or 0, rank[e[2]], e[4] or "")):
        m = messages.setdefault(message, {"first": None, "role": "", "text": ""})
        m["first"] = seq if m["first"] is None else m["first"]
        if kind == "start":
            m["role"] = role if role is not None else m["role"]
        elif kind == "delta":
            m["text"] += text or ""
        else:
            m["text"] = (text or "") if kind == "edit" else ""
    return {k: (m["first"], m["role"], m["text"]) for k, m in messages.items()}


def test_reconstruction_equals_fold(spark):
    draw = random.Random(6)
    logs, rows = {}, []
    for conv in [*range(40), None]:
        events = []
        for n in range(draw.randint(0, 60)):
            kind = draw.choice(["delta"] * 8 + ["edit", "regenerate", "start", "ping", None])
            events.append((draw.choice([0, 1, 2, None]), draw.choice([n, n, n, None, 7]), kind, draw.choice(["user", "assistant", None]) if kind == "start" else None, draw.choice(["a", "b ", "", None, "[INST]"])))
        # Of one place only one start and one reset are told apart by a role or text.
        events = list({(m, s, k if k in ("start", "edit") else (k, t)): (m, s, k, r, t) for m, s, k, r, t in events}.values())
        logs[conv] = fold(events)
        rows += [(conv, *e, "x") for e in events]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string, first string")
    got = {}
    for r in chat.reconstruct(df).collect():
        got.setdefault(r.conv, {})[r.message] = (r.first, r.role, r.text)
    assert got == {k: v for k, v in logs.items() if v}
    assert chat.reconstruct(df.limit(0)).collect() == []


def brute(rows):
    out = {}
    special = "</s>[INST] ok [/INST]"
    for conv in {r[0] for r in rows} | {-1}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [(r[2] or "", r[3] or "") for r in own] if conv != -1 else [("user", special), ("assistant", special)]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_equals_plain_texts(spark, tmp_path):
    draw = random.Random(2)
    text = lambda: None if draw.random() < 0.05 else "".join(draw.choice(PIECES) for _ in range(draw.choice([0, 1, 5, 900])))
    rows = [(conv, turn if turn else draw.choice([0, None]), draw.choice(["user", "assistant", "assistant", "system", "tool", None]), text()) for conv in [*range(60), None] for turn in range(draw.choice([1, 2, 7, 30]))]
    rows += [(9_000, 0, "assistant", "x" * 100_000 + "</s>"), (9_001, 0, "assistant", "")]
    spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, message int, `a.b` string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op12_chat(spark, str(tmp_path)).collect()}
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()["op12_chat"])
    names = [c[0] for c in found.description]
    order = lambda r: (r[0] is None, r)
    assert sorted(found.fetchall(), key=order) == sorted((tuple(r[c] for c in names) for r in queries.op12_chat(spark, str(tmp_path)).collect()), key=order)


def test_long_conversations_are_several_parts(spark):
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(50)] + [(2, 0, "user", "short")], "conv_id long, turn long, role string, text string")
    log = chat.event_log(turns)
    one, many = chat.read_back(chat.format_conversations(log)), chat.format_conversations(log, size=60)
    assert many.where("conv_id = 1").count() > 10
    assert sorted(chat.read_back(many).collect()) == sorted(one.collect())
    assert chat.read_back(chat.format_conversations(chat.event_log(turns.limit(0)))).collect() == []
