"""Jaccard join, repeated paragraphs, mixing, WARC and the pipeline, against brute force and round trips."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import common, jaccard_join, mixing, paragraphs, warc
from clausemill.llm.shingles import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(fold(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def families(seed=3):
    draw = random.Random(seed)
    rows = []
    for f in range(8):
        base = [f"w{draw.randrange(2000)}" for _ in range(draw.randint(3, 120))]
        for _ in range(draw.choice([1, 2, 12])):
            w = list(base)
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = f"e{draw.randrange(5)}"
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(100 + i, passage + " " + " ".join(f"q{draw.randrange(9999)}" for _ in range(60))) for i in range(12)]
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one TWO"), (205, "a b c d e f"), (None, "a b c d e f"), (206, "that " * 50), (207, "that " * 9), (203, "One two")]


def components(sets, linked):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def near(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def test_jaccard_join_equals_brute_force(spark):
    rows = families()
    got = jaccard_join.near_duplicate_components(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")).collect()
    sets = [shingles(t) for _, t in rows]
    roots = components(sets, near)
    low = defaultdict(list)
    for (k, _), r in zip(rows, roots):
        low[r].append(k)
    want = sorted((str(k), len(s), str(min((x for x in low[r] if x is not None), default=None) if s else k)) for (k, _), s, r in zip(rows, sets, roots))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    rows = families(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicate_components(df).collect()}
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    assert {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicate_components(df).collect()} == want


def test_near_duplicates_dropped(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", "x"), (2, "a b c d e f g H", "y"), (3, "", "z"), (4, None, "z")], "doc_id long, text string, _k string")
    assert sorted(r.doc_id for r in jaccard_join.drop_near_duplicates(df).collect()) == [1, 3, 4]
    assert jaccard_join.near_duplicate_components(df.limit(0)).collect() == []


def test_near_duplicates_of_null_and_repeated_keys(spark):
    near, other, alone = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [(1, near, "first"), (None, near + " I", "copy"), (None, alone, "alone"), (None, "", "wordless"), (None, None, "wordless"), (2, near + " J", "copy"), (2, "un like any thing else here", "clean"), (None, other, "nulls"), (None, other + " S", "nulls"), (3, "one two", "repeat"), (3, "one two", "repeat"), (4, "Two words", "case"), (4, "two words", "case")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k string")
    kept = jaccard_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["_k"] for r in kept.collect()) == ["alone", "case", "clean", "first", "nulls", "repeat", "wordless", "wordless"]


def test_divide_skip_counts():
    draw = random.Random(1)
    query = np.unique(np.array([draw.randrange(400) for _ in range(90)], np.uint64))
    records = [np.unique(np.array([draw.randrange(400) for _ in range(draw.randint(1, 200))], np.uint64)) for _ in range(80)]
    for least in (1, 5, 20, 40):
        want = {i: n for i, r in enumerate(records) if (n := len(np.intersect1d(query, r))) >= least}
        assert jaccard_join.divide_skip(query, records, least) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201)]
    got = common.components(common.Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def lines(t):
    out, at = [], 0
    for line in (t or "").split("\n"):
        if len(found := [(m.start() + at, m.end() + at) for m in WORD.finditer(line)]) >= paragraphs.LEAST_WORDS:
            out.append((found[0][0], found[-1][1]))
        at += len(line) + 1
    return out


def repeated_lines(rows):
    """{(key, start): (copies, kept key, kept start, removed)} by comparing all lines with each other."""
    found = [(k, a, shingles(t[a:b])) for k, t in rows for a, b in lines(t)]
    roots = components([s for *_, s in found], near)
    groups = defaultdict(list)
    for (k, a, _), r in zip(found, roots):
        groups[r].append((k is None, k, a))
    want = {}
    for members in groups.values():
        if len(members) > 1:
            first = min(members, key=lambda m: (m[0], m[1] or 0, m[2]))
            for m in members:
                want[m[1:]] = (len(members), first[1], first[2], m != first)
    return want


def test_repeated_paragraphs_equal_brute_force(spark):
    draw = random.Random(7)
    sentence = lambda n: " ".join(f"v{draw.randrange(3000)}" for _ in range(n)).capitalize() + "."
    shared = [" ".join(sentence(12) for _ in range(n)) for n in (3, 5, 9)]
    rows = []
    for i in range(60):
        own = [sentence(draw.randint(4, 70)) for _ in range(4)]
        if i % 3 == 0:
            words = draw.choice(shared).split()
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(len(words))] = f"x{i}"
            own.insert(draw.randrange(4), " ".join(words))
        rows.append((i, "\n".join(own)))
    long = sentence(40)
    rows += [(70, long), (71, long[:-1] + " tail."), (72, None), (73, ""), (74, f"{long}\n{long}"), (None, long), (None, f"É {long}"), (75, "that " * 400), (76, "that " * 300), (77, " \n\t ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start long")
    got = paragraphs.repeated_paragraphs(df).collect()
    texts = dict(rows) | {None: None}
    assert {(r.doc_id, r.start): (r.copies, r.kept_id, r.kept_start, r.removed) for r in got if r.kind == "paragraph" and r.doc_id is not None} == {k: v for k, v in repeated_lines(rows).items() if k[0] is not None}
    for r in got:
        if r.kind == "stretch" and r.doc_id is not None and r.kept_id is not None:
            mine, kept = WORD.findall(fold(texts[r.doc_id][r.start : r.end])), WORD.findall(fold(texts[r.kept_id][r.kept_start :]))
            assert len(mine) == r.words >= 25 and mine == kept[: len(mine)] and r.removed == ((r.doc_id, r.start) != (r.kept_id, r.kept_start))
    assert paragraphs.repeated_paragraphs(df.limit(0)).collect() == []
    kept = {r.doc_id: r.text for r in paragraphs.remove_repeats(df.where("doc_id is not null")).collect()}
    assert kept[70] == long and kept[71].strip() == "" and kept[72] is None and kept[73] == "" and kept[74].strip() == "" and kept[77] == " \n\t "
    assert kept[75].split() == ["that"] * 40 and kept[76].split() == []


@pytest.mark.parametrize("lengths", [(3, 7), (5, 5), (60, 70)])
def test_passages_of_short_sentences_or_inside_a_sentence(spark, lengths):
    draw = random.Random(12)
    fresh = iter(range(10**6))
    sentence = lambda a, b: [f"v{next(fresh)}" for _ in range(draw.randint(a, b))]
    passage = []
    while len(passage) < 60:
        passage += sentence(*lengths)
        passage[-1] += "."
    passage[-1] = passage[-1].rstrip(".")
    rows = []
    for i in range(12):
        before, after = sentence(12, 20), sentence(12, 20)
        rows.append((i, " ".join(["Own", *before, *passage, *after]) + "."))
    rows += [(20, "One two"), (21, "one TWO"), (22, None), (23, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = defaultdict(set)
    for r in paragraphs.repeated_paragraphs(df).where("removed").collect():
        hit[r.doc_id] |= set(range(r.start, r.end))
    assert set(hit) == {*range(1, 12), 21}
    for k, t in rows[1:12]:
        words = [(m[0], m.start() in hit[k]) for m in WORD.finditer(t)]
        assert sum(x for w, x in words if w in passage) >= 0.6 * len(passage)
        assert not any(x for w, x in words if w not in passage)
    kept = {r.doc_id: r.text for r in paragraphs.remove_repeats(df).collect()}
    assert kept[0] == rows[0][1] and kept[21] == ""
    for k, t in rows[1:12]:
        assert kept[k] == "".join(c for i, c in enumerate(t) if i not in hit[k])


def test_planted_passages_of_over_fifty_words_are_caught():
    """2,000 passages of 51 words in fresh surroundings, cut anywhere out of sentences of any length: some stretch is in both."""
    draw = random.Random(5)
    fresh = iter(range(10**7))

    def prose(n):
        out = []
        while len(out) < n:
            out += [f"v{next(fresh)}" for _ in range(draw.choice([1, 4, 8, 15, 30, 60]))]
            out[-1] += draw.choice([".", ".", "!\n"])
        return out[:n]

    missed = 0
    for _ in range(2000):
        passage = prose(120)[30:81]
        pair = [" ".join([*prose(40), *passage, *prose(40)]).encode() for _ in range(2)]
        units = paragraphs.stretches(Words(pair), paragraphs.LEAST_WORDS)
        missed += not set(units.keys[units.owner == 0, 0].tolist()) & set(units.keys[units.owner == 1, 0].tolist())
    assert missed <= 20


def test_every_word_is_in_a_stretch():
    draw = random.Random(3)
    texts = [" ".join(" ".join(f"é{draw.randrange(500)}" for _ in range(draw.choice([1, 2, 3, 5, 7, 12, 30]))) + draw.choice([".", "!", "", ".\n"]) for _ in range(draw.randint(0, 12))) for _ in range(50)]
    texts += ["", " ", "one two", "that " * 150, "w " * 24, "w " * 25, "that. " * 150]
    units = paragraphs.stretches(Words([t.encode() for t in texts]), paragraphs.LEAST_WORDS)
    starts, ends = units.words.starts[units.first], units.words.ends[units.end - 1]
    assert (units.end - units.first).max() <= 25 + 2 * paragraphs.LONGEST
    for o, t in enumerate(texts):
        spans = list(zip(starts[units.owner == o].tolist(), ends[units.owner == o].tolist()))
        places = [(m.start(), m.end()) for m in WORD.finditer(t)]
        if len(set(WORD.findall(t))) > 1:
            assert all(any(a <= x and y <= b for a, b in spans) for x, y in places)
        assert {x for a, b in spans for x in (a, b)} <= {x for place in places for x in place}


def test_repeats_of_repeated_keys_and_clashing_columns(spark):
    draw = random.Random(9)
    prose = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    shared, other, last = prose(60), prose(60), prose(300_000)
    rows = [(1, shared, "a"), (2, f"{shared}\n{prose(5)}", "b"), (2, other, "c"), (None, shared, "d"), (None, prose(40), "e"), (None, None, "f"), (3, other, "g"), (3, other, "g"), (4, last, "h"), (5, f"x {last}", "i")]
    df = spark.createDataFrame([(*r, r[2] * 2, r[2] * 3) for r in rows], "doc_id long, text string, cuts string, k string, h string")
    kept = paragraphs.remove_repeats(df)
    assert kept.columns == df.columns
    left = {r.cuts: (r.doc_id, r.text and r.text.strip(), r.k, r.h) for r in kept.collect()}
    assert all((k, k * 2, k * 3) == (k, *left[k][2:]) for k in "abcdefghi") and kept.count() == len(rows)
    assert left["a"][1] == shared and left["b"][1] == rows[1][1].split("\n")[1] and left["c"][1] == other and left["d"][:2] == (None, "")
    assert left["e"][1] == rows[4][1] and left["f"][1] is None and left["g"][1] == "" and left["h"][1] == last and left["i"][1] in ("", "x")
    assert paragraphs.remove_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_tuned_bands_reach_recall(threshold):
    b, r = paragraphs.tuned_bands(int(threshold * 100), 0.99)
    assert paragraphs.expected_recall(b, r, threshold) >= 0.99


def test_mixing_targets_and_bounds(spark):
    draw = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(draw.randint(0, 60))), draw.choice(["a", "a", "a", "b", "ä", None])) for i in range(600)] + [(700, None, "zero"), (701, "", "zero"), (3, "w w w", "b"), (3, "w w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in plan:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert r.copies <= 3
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 200
    free = [s for s in size if target[s] < 3 * size[s] - 1e-6]
    assert len({round(target[s] / weight[s], 4) for s in free}) == 1
    again = mixing.mix_plan(df.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, plan))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(df.limit(0)).collect() == []


def test_warc_round_trip(spark, tmp_path):
    big = "WARC/1.1\r\n\r\n<p>é漢</p>" * 20
    rows = [(5, "http://a/", big), (3, "http://b/ x\r\ny", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, "http://b/", big), (None, "u", big), (7, "u", "z" * 99), (8, "u", "z" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, page int")
    got = warc.archive_round_trip(df, str(tmp_path / "w")).collect()
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        first = min((x for x, _, g in rows if (g or "") == (h or "") and x is not None), default=None)
        again = len(raw) >= 100 and k != first
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    texts = {(r.page, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    assert (3, big.encode()) in texts and (4, b"") in texts
    assert warc.archive_round_trip(df.limit(0)).collect() == []
