"""Alignment of two tokenizers against both libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clausemill.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n  b", "a\n\n b \n", "tab\tand\r\n\r\n more", "don't they'll 'tis", "<|endoftext|> is plain", "<s>[INST]</s>", "a▁b", "▁", "x▁ y", "no break space　 here",
    "漢字かな交じり文 と 空白", "한글 텍스트", "👩‍👩‍👧 fam", "ﬁ ½ é n é", "\x00 \x1c \x1f\x85 x", "x" * 400, "word​ ​zero", "1234 5,678.90 $%&", "a\x1c b\x1d  c", "same words here", "same words here", "\n", " \n ", "end\n", "\t x", "ÀÉ ñandú ß",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return alignment.Aligner(f.read(), g.read())


def tokens(libraries, text):
    """Ids with their byte ranges, of both sides; none where bytes differ."""
    a, b = libraries
    if not text:
        return [], []
    byte = {c: i for i, c in enumerate(alignment.byte_characters())}
    out = []
    for ids, raw in (
        (x := a.encode(" " + text, add_special_tokens=False).ids, [bytes(byte[c] for c in a.id_to_token(i)) for i in x]),
        (y := b.encode(text), [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]),
    ):
        if b"".join(raw) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i, piece in zip(ids, raw):
            side.append((i, at, at + len(piece)))
            at += len(piece)
        out.append(side)
    return out


def brute(libraries, text):
    a, b = tokens(libraries, text)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    groups = [[",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b)] for low, high in zip([0, *ends], ends)]
    links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
    return len(a), len(b), len(groups), ";".join("|".join(g) for g in groups), Counter(links)


def check(libraries, rows, got):
    made = [(k, *brute(libraries, t)) for k, t in rows]
    holds = Counter(pair for *_, links in made for pair in links)
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    want = [
        (k, n_a, n_b, n_groups, sum(links.values()), groups, hashlib.sha256(groups.encode()).hexdigest() if groups else "", sum(n for p, n in links.items() if holds[p] == most[p[0]]), sum(n * holds[p] for p, n in links.items()))
        for k, n_a, n_b, n_groups, groups, links in made
    ]
    found = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.groups_sha256, r.n_best, r.count_sum) for r in got.collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(found, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("chunk", [1 << 16, 7, 64])
def test_alignment_equals_libraries(spark, libraries, chunk):
    draw = random.Random(3)
    letters = ["a", "be", "the", "ção", "漢", " ", "  ", "\n", ".", "'s", "▁", "é", "0", "👩", "　", "\t"]
    texts = TEXTS + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(80)] + [" ".join(draw.choice(["alpha", "beta.", "gamma\n", "d", "漢字"]) for _ in range(400)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null key"), (3, "repeated row"), (3, "repeated row")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row int, `a.b` string, k int")
    check(libraries, rows, alignment.align_documents(df, chunk=chunk))


def test_pairs_beyond_the_hot_ones_are_joined(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_BITS", 4)
    rows = [(i, "alpha " * (i % 3) + "beta gamma delta"[: i % 17] + f" {i}") for i in range(40)]
    check(libraries, rows, alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string")))


def test_fragments_compose_in_any_order(aligner):
    draw = random.Random(8)
    for text in ["漢字 " * 30 + "a\n  b \n c" * 9, "é" * 50, "one two  three\n four " * 12]:
        raw = (" " + text).encode()
        cuts = sorted(draw.sample(range(1, len(raw)), 9))
        parts = []
        for low, high in zip([0, *cuts], [*cuts, len(raw)]):
            prefix, inside, suffix = alignment.fragment(raw[low:high])
            parts.append(alignment.Fragment(prefix, None if inside is None else aligner.closed([inside])[0], suffix))
        whole = alignment.close(aligner, alignment.Fragment(raw, None, b""))
        left = alignment.compose(aligner, parts)
        k = draw.randrange(1, 9)
        right = alignment.compose(aligner, [alignment.compose(aligner, parts[:k]), alignment.compose(aligner, parts[k:])])
        assert alignment.close(aligner, left) == alignment.close(aligner, right) == whole


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
