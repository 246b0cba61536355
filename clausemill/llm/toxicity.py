"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained in numpy.

A word is the bag of its character n-grams (with word bounds) and itself, hashed into BUCKETS; its
vector is the mean of theirs. Only n-grams whose texts differ in label by more than chance have one,
so that bystanders of a few toxic texts are not learned. A text is read in passages of PASSAGE words; a passage's vector is the
mean of its words', so that a few words of abuse count in a long text as they do in a short one. The
text's logits are those of its passages, pooled by how toxic they are. Embeddings and softmax are
trained jointly on a bounded sample of labelled texts, so a misspelling that was never seen still
shares most of its n-grams with the word it stands for.

As the softmax is linear, a bucket's part in the score is one number. The table of these numbers has
a fixed size and is sent to the tasks, which remember the score of each word.
"""

from __future__ import annotations

import math
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shingles import U, mix

BUCKETS = 1 << 21
SIZES = (3, 4, 5)
DIMENSIONS = 8
#: Bounds of the training sample: labelled texts of each label, and the characters of one of them.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1800, 4000, 20_000
#: Words of a passage; scale of its vector before the softmax; how sharply the most toxic passage prevails.
PASSAGE, SCALE, SHARP = 24, 12.0, 2.0
#: Steps of training; how far a row that says nothing is drawn to zero; how far small gradients stay small steps.
EPOCHS, SHRINK, FLOOR = 80, 0.2, 0.02
#: Texts that an n-gram with a vector occurs in, at least; and how far from chance its labels are (about 4 in a million by chance).
LEAST_TEXTS, TELLING = 3, 21.0
EDGE = " \t\n\v\f\r.,;:!?\"'()[]{}|#*%&$<>-_/\\"
#: Tokens of more characters are cut at Unicode's punctuation, signs and format characters, and what is longer still into windows.
LONG, WINDOW = 60, 20
BETWEEN = frozenset("Pc Pd Ps Pe Pi Pf Po Zs Zl Zp Cc Cf Sc Sk Sm".split())
REMEMBERED = 500_000


def _cut(token: str) -> list[str]:
    """The words of a token of over LONG characters: cut at the punctuation inside, longer ones into windows.

    A window starts with a line feed, which no token holds; windows overlap by as much as the longest
    n-gram needs to lie whole in one of them.
    """
    out = []
    for word in "".join(" " if unicodedata.category(c) in BETWEEN else c for c in token).split():
        marked = f"<{word}>"
        step = WINDOW - max(SIZES) + 1
        out += [word] if len(word) <= LONG else ["\n" + marked[i : i + WINDOW] for i in range(0, len(marked) - max(SIZES) + 1, step)]
    return out or [token]


def tokens(text: str) -> list[str]:
    words = text.lower().split()
    return words if max(map(len, words), default=0) <= LONG else [t for w in words for t in ([w] if len(w) <= LONG else _cut(w))]


def bags(words: list[str], count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each word), the punctuation around words left out; none for punctuation alone."""
    marked = [w[1:] if w[:1] == "\n" else f"<{x}>" if (x := w.strip(EDGE)) else "" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(U)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the end of the word
    owner = np.repeat(np.arange(len(marked)), lengths)
    padded = np.concatenate([codes, np.zeros(max(SIZES), U)])
    total = np.zeros(len(codes), U)
    owners, hashes = [], []
    for n in range(1, max(SIZES) + 1):
        total = total * U(0x9E3779B97F4A7C15) + padded[n - 1 : n - 1 + len(codes)] + U(1)
        if n in SIZES:
            at = np.flatnonzero(left >= n)
            owners.append(owner[at])
            hashes.append(mix(total[at] + U(n)))
    # The word itself: a polynomial by prefix sums.
    place = np.cumsum(mix(codes + U(7)) * _powers(len(codes)))
    whole = np.flatnonzero(lengths > 0)
    first = ends[whole] - lengths[whole]
    sums = place[ends[whole] - 1] - np.where(first > 0, place[first - 1], U(0))
    owners.append(whole)
    hashes.append(mix(sums * _powers(len(codes), True)[first] + lengths[whole].astype(U)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(hashes)[order] % U(count)).astype(np.int64), np.bincount(owner, minlength=len(words))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = 0xD6E8FEB86659FD93
    return np.cumprod(np.full(n, U(pow(base, -1, 1 << 64) if inverse else base)))


class Model:
    """The part of each bucket in the log odds of label 1, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; remembers each word's part in the log odds."""

    def __init__(self, model: Model):
        self.weights, self.bias, self.known = model.weights, model.bias, {}

    def learn(self, words: set[str]) -> None:
        """The parts of words that are not known yet, all at once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted(words - self.known.keys())
        if new:
            found, counts = bags(new, len(self.weights))
            values = np.zeros(len(new))
            some = np.flatnonzero(counts)
            if len(some):
                values[some] = np.add.reduceat(self.weights[found], (np.cumsum(counts) - counts)[some]) / counts[some]
            self.known.update(zip(new, values.tolist()))

    def scores(self, texts: list[str]) -> list[float]:
        split = [tokens(t) for t in texts]
        self.learn(set().union(*split))
        part = self.known.__getitem__
        out = []
        for words in split:
            parts = list(map(part, words))
            z = [self.bias + sum(parts[a:b]) / (b - a) for a, b in passages(len(parts))]
            top = max(z, default=self.bias)
            pooled = top + math.log(sum(math.exp(SHARP * (x - top)) for x in z)) / SHARP if len(z) > 1 else top
            out.append(1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, pooled)))))
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def passages(n: int) -> list[tuple[int, int]]:
    """The passages of n words: a last one of less than half the words goes to the one before."""
    starts = list(range(0, n, PASSAGE))
    if len(starts) > 1 and 2 * (n - starts[-1]) < PASSAGE:
        starts.pop()
    return list(zip(starts, [*starts[1:], n]))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; no run is empty."""
    return np.add.reduceat(values, starts, axis=0)


def _telling(texts: list[str], y: np.ndarray, least: int, telling: float) -> tuple[dict[str, int], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(words that have telling n-grams, (word, bucket) of each telling n-gram, number of all n-grams of each word)."""
    place: dict[str, int] = {}
    held = [np.unique(np.fromiter((place.setdefault(w, len(place)) for w in tokens(t)), np.int32)) for t in texts]
    names = list(place)
    del place
    grams, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(names), 20_000):
        some, n = bags(names[i : i + 20_000])
        grams.append(some.astype(np.int32))
        counts.append(n)
    gram, per_word = np.concatenate(grams), np.concatenate(counts)
    del grams, counts
    starts = np.cumsum(per_word) - per_word
    seen = np.zeros((2, BUCKETS), np.int32)
    for own, label in zip(held, y):
        n = per_word[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen[int(label), np.unique(gram[at])] += 1
    del held
    # Likelihood ratio of two by two tables: texts with and without the n-gram, by label.
    with_, totals = seen.astype(np.float64), np.array([[(y == 0).sum()], [(y == 1).sum()]], np.float64)
    rate, overall = with_ / totals, with_.sum(0) / totals.sum()
    some = lambda n, p, q: np.where(n > 0, n * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0.0)
    ratio = 2 * (some(with_, rate, overall) + some(totals - with_, 1 - rate, 1 - overall)).sum(0)
    tells = (ratio >= telling) & (with_.sum(0) >= least)
    kept = np.flatnonzero(tells[gram])
    words, at = np.unique(np.searchsorted(np.cumsum(per_word), kept, side="right"), return_inverse=True)
    return {names[w]: i for i, w in enumerate(words)}, (at, gram[kept].astype(np.int64)), per_word[words]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 0.1, shrink: float = SHRINK, floor: float = FLOOR, least: int = LEAST_TEXTS, telling: float = TELLING, seed: int = 9) -> Model:
    """Gradient steps over the whole sample; embeddings and softmax together, and rows that say nothing shrink to zero. One label only, or none: its rate alone.

    Only telling n-grams are embedded: those of at least `least` texts whose texts differ in label by
    more than chance, at `telling` of the likelihood ratio statistic. Others have no vector, and count
    in the mean of their word.
    """
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        odds = (y.sum() + 1) / (len(y) - y.sum() + 1) if len(y) else 1e-3
        return Model(np.zeros(BUCKETS), math.log(odds))
    vocabulary, gram, per_word = _telling(texts, y, least, telling)
    # (passage, word, share of the passage) of each word of the vocabulary, packed: the driver holds nothing else of the texts.
    at: tuple[array, array, array] = (array("i"), array("i"), array("f"))
    owner_of = array("i")
    for d, t in enumerate(texts):
        words = tokens(t)
        for a, b in passages(len(words)) or [(0, 0)]:
            for w, n in Counter(vocabulary[w] for w in words[a:b] if w in vocabulary).items():
                for column, x in zip(at, (len(owner_of), w, n / (b - a))):
                    column.append(x)
            owner_of.append(d)
    if not at[0]:
        return Model(np.zeros(BUCKETS), math.log(y.mean() / (1 - y.mean())))
    passage_at, word_at, share = (np.asarray(x) for x in at)
    share = share * np.float32(SCALE)
    n_passages, of = len(owner_of), np.asarray(owner_of)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    # gram (word, bucket): the telling n-grams of each word; per_word: all of its n-grams, which share its vector.
    owner, gram = gram
    used, gram_at = np.unique(gram, return_inverse=True)
    with_grams, word_starts = np.unique(owner, return_index=True)
    part = (1.0 / np.maximum(per_word, 1)).astype(np.float32)[:, None]
    seen, seen_starts = np.unique(passage_at, return_index=True)
    by_word = np.argsort(word_at, kind="stable")
    of_words, words_starts = np.unique(word_at[by_word], return_index=True)
    passage_of, share_of = passage_at[by_word], share[by_word]
    by_gram = np.argsort(gram_at, kind="stable")
    gram_starts = np.unique(gram_at[by_gram], return_index=True)[1]

    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.05, (len(used), DIMENSIONS)).astype(np.float32)
    top = random.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log([1 - y.mean(), y.mean()]).astype(np.float32)
    state = [np.zeros_like(p) for p in (embed, top, bias) for _ in range(2)]
    for step in range(1, epochs + 1):
        words = np.zeros((len(per_word), DIMENSIONS), np.float32)
        words[with_grams] = _sums(embed[gram_at], word_starts)
        words *= part
        vectors = np.zeros((n_passages, DIMENSIONS), np.float32)
        for k in range(DIMENSIONS):
            vectors[seen, k] = np.add.reduceat(words[:, k][word_at] * share, seen_starts)
        logits = vectors @ top + bias
        z = logits[:, 1] - logits[:, 0]
        # Pooled over the passages of a text; weight: a passage's part in the pooled value.
        high = np.maximum.reduceat(z, first)
        e = np.exp(SHARP * (z - high[of]))
        total = np.add.reduceat(e, first)
        pooled, weight = high + np.log(total) / SHARP, e / total[of]
        p = 1 / (1 + np.exp(-np.clip(pooled, -60, 60)))
        g1 = ((p - y) / len(y))[of] * weight
        g = np.stack([-g1, g1], 1).astype(np.float32)
        d_vectors = g @ top.T
        d_words = np.zeros_like(words)
        for k in range(DIMENSIONS):
            d_words[of_words, k] = np.add.reduceat(d_vectors[:, k][passage_of] * share_of, words_starts)
        d_words *= part
        d_embed = _sums(d_words[owner[by_gram]], gram_starts)
        for k, (value, grad) in enumerate(((embed, d_embed), (top, vectors.T @ g), (bias, g.sum(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            # Rows far below the steepest one say nothing: the floor keeps their steps small.
            scale = np.sqrt(v / (1 - 0.99**step)) + floor * np.abs(grad).max()
            value -= (rate * (m / (1 - 0.9**step)) / (scale + 1e-12)).astype(np.float32)
        size = np.sqrt((embed * embed).sum(1, keepdims=True)) + 1e-12
        embed *= np.maximum(0, 1 - shrink * rate / size)
    weights = np.zeros(BUCKETS)
    weights[used] = (embed @ (top[:, 1] - top[:, 0])) * SCALE
    return Model(weights, bias[1] - bias[0])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[str], list[int]]:
    """Labelled texts that are not held out: of each label those of least hash of their key, up to the bounds above.

    Labels other than 0 and 1, null keys, and texts over SAMPLE_CHARS characters are left out of the
    sample (they are scored all the same).
    """
    rows = labels.select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out(F.col("k")))
    fits = docs.select(F.col(key).alias("k"), F.length(text).alias("n")).where(f"n <= {SAMPLE_CHARS}").select("k").distinct()
    rows = rows.groupBy("k").agg(F.max("y").alias("y"))
    order = [F.xxhash64("k"), F.col("k")]
    picked = [rows.where(f"y = {y}").join(fits, "k", "left_semi").orderBy(*order).limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = picked[0].unionByName(picked[1])
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows: small enough to send to every task.
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= SAMPLE_CHARS).join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.min("t").alias("t")).orderBy("k").collect()
    return [r["t"] or "" for r in found], [r["y"] for r in found]


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), below: float | None = None) -> DataFrame:
    """The columns keep of each row of docs, and score (0 to 1); with below, only rows of a lower score, without it. Null texts are empty; an empty text has the score of the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            own = batch.columns[:-1]
            scores = []
            for at in range(0, batch.num_rows, 256):
                scores += scorer.scores([t or "" for t in batch.column(batch.num_columns - 1).slice(at, 256).to_pylist()])
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    plain = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)], docs[f"`{text}`"].cast("string").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    out = plain.mapInArrow(rows, f"{schema}, score double")
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*named, "score") if below is None else out.where(F.col("score") < below).select(*named)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Whole texts count, however long; null texts are empty, and an empty text has the score of the bias.
    A score of 0.5 or more predicts 1. Repeated rows each have a row of equal score; equal texts have
    equal scores. Rows of a null doc_id are scored and not held out. Of several labels of one doc_id
    the larger counts, of several texts the least is learned from. Without labels of both kinds every
    text has the rate of the labels. An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    model = train(*training_sample(docs, labels))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is 0.5 or more, scored as score_documents() does; columns and texts as they were, whatever their names. An empty table gives an empty result."""
    model = train(*training_sample(docs, labels))
    return score_texts(docs, model, keep=tuple(docs.columns), below=0.5)
