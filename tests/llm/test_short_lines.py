"""Repeated short lines against a count in plain Python."""

import random
import string
from collections import defaultdict

from clausemill.llm import paragraphs

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_short_lines_equal_counts(spark):
    draw = random.Random(7)
    lines = [" ".join(draw.choice("alpha beta gamma delta epsilon".split()) for _ in range(draw.choice([3, 7, 8, 9, 24, 25]))) for _ in range(40)]
    rows = [(i, "\n".join(draw.choice([str.upper, str])(draw.choice(lines)) for _ in range(draw.randint(0, 6)))) for i in range(60)] + [(None, lines[0] + "\n" + lines[1]), (100, None), (101, "")]
    seen = defaultdict(list)
    for doc, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            words = line.translate(FOLD).split()
            if 8 <= len(words) < 25:
                seen[tuple(words)].append((doc is None, doc if doc is not None else 0, at, len(words), doc))
            at += len(line) + 1
    want = set()
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            want |= {(p[4], p[2], p[3], len(places), first[4], first[2], p != first) for p in places}
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    got = [(r.doc_id, r.start, r.words, r.copies, r.kept_id, r.kept_start, r.removed) for r in paragraphs.short_repeats(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert paragraphs.short_repeats(df.limit(0)).collect() == []
