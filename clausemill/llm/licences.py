"""Licence scans with a trained paragraph classifier, DataFrame functions only on the main path.

A paragraph is a line with those that it wraps onto: a line that does not end a sentence goes on in
the next. A sparse multinomial logistic regression over word 1- to 3-grams gives each paragraph a
probability of each licence family and of none. It is trained here on statements made of the names
below and common frames, on passages of licence texts, and, for none, on near misses and on licences
that have no family here. The probabilities are calibrated by a temperature fitted to statements in
frames, and to unknown licences, that the training had not seen. A prediction is confirmed when the
paragraph holds most word pairs of one template of its family.

Only n-grams with a key word (a word of a template that is not a common one) are features; so a
paragraph without key words has none, gets the bias alone and is of no family, and is passed by. The tables of weights and of template pairs have the size of the
vocabulary, whatever the input, and go to every task.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names and identifiers of each family, as licences are cited.
NAMES = {
    "apache": (["apache license, version 2.0", "apache license version 2.0", "apache license 2.0", "apache software license"], ["apache-2.0"]),
    "mit": (["mit license", "mit licence", "expat license"], ["mit"]),
    "bsd": (["bsd license", "3-clause bsd license", "2-clause bsd license", "new bsd license", "simplified bsd license"], ["bsd-3-clause", "bsd-2-clause"]),
    "isc": (["isc license"], ["isc"]),
    "zlib": (["zlib license", "zlib/libpng license"], ["zlib"]),
    "boost": (["boost software license, version 1.0", "boost software license 1.0"], ["bsl-1.0"]),
    "gpl": (["gnu general public license, version 3", "gnu general public license version 2", "gnu general public license", "gnu gpl version 3 or later", "gnu gpl", "gpl v3"], ["gpl-3.0-or-later", "gpl-2.0-only", "gpl-3.0"]),
    "lgpl": (["gnu lesser general public license, version 2.1", "gnu lesser general public license", "gnu library general public license", "gnu lgpl"], ["lgpl-2.1-or-later", "lgpl-3.0-only"]),
    "agpl": (["gnu affero general public license, version 3", "gnu affero general public license", "gnu affero general public license v3", "gnu agpl"], ["agpl-3.0-or-later", "agpl-3.0"]),
    "mpl": (["mozilla public license, v. 2.0", "mozilla public license, version 2.0", "mozilla public license 2.0", "mozilla public license"], ["mpl-2.0"]),
    "epl": (["eclipse public license, version 2.0", "eclipse public license v1.0", "eclipse public license 2.0", "eclipse public license"], ["epl-2.0", "epl-1.0"]),
    "artistic": (["artistic license 2.0", "artistic license", "perl artistic license"], ["artistic-2.0"]),
    "unlicense": (["unlicense", "the unlicense"], ["unlicense"]),
    "cc0": (["cc0 1.0 universal", "creative commons zero", "cc0 1.0", "creative commons cc0 1.0 universal public domain dedication"], ["cc0-1.0"]),
    "cc-by": (["cc by 4.0", "creative commons attribution 4.0 international license", "creative commons attribution license", "cc-by 4.0", "cc by 3.0"], ["cc-by-4.0", "cc-by-3.0"]),
    "cc-by-sa": (["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike license", "cc by-sa 3.0"], ["cc-by-sa-4.0"]),
    "cc-by-nc": (["cc by-nc 4.0", "cc by-nc-sa 4.0", "creative commons attribution-noncommercial 4.0 international license", "creative commons attribution-noncommercial license", "cc by-nc-nd 4.0"], ["cc-by-nc-4.0", "cc-by-nc-sa-4.0"]),
    "cc-by-nd": (["cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license"], ["cc-by-nd-4.0"]),
    "proprietary": ([], []),
}
# Passages of licence texts and notices, by family.
PASSAGES = {
    "apache": ["you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"],
    "mit": ["permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "bsd": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software", "the origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "boost": ["permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the software"],
    "gpl": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version", "you should have received a copy of the gnu general public license along with this program. if not, see https://www.gnu.org/licenses/"],
    "lgpl": ["this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "you should have received a copy of the gnu lesser general public license along with this library"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation", "you should have received a copy of the gnu affero general public license along with this program"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "artistic": ["you may distribute this package under the terms of either the gnu general public license or the artistic license, as specified in the perl readme file", "the artistic license preamble: the intent of this document is to state the conditions under which a package may be copied"],
    "unlicense": ["this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"],
    "cc0": ["to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by": ["you are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit"],
    "cc-by-sa": ["if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"],
    "cc-by-nc": ["you may not use the material for commercial purposes under this creative commons attribution-noncommercial license"],
    "cc-by-nd": ["if you remix, transform, or build upon the material, you may not distribute the modified material under this creative commons attribution-noderivatives license"],
    "proprietary": ["copyright the authors. all rights reserved.", "all rights reserved. no part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission", "this document is proprietary and confidential. all rights reserved.", "unauthorized copying of this file, via any medium, is strictly prohibited. proprietary and confidential"],
}
# How a licence is named. The first are for training, the others only for calibration.
FRAMES = ["licensed under the {}.", "licensed under {}.", "released under the {}.", "released under {}.", "this work is licensed under the {}.", "this work is licensed under a {}", "distributed under the terms of the {}", "this software is licensed under the terms of the {}", "this file is made available under the terms of the {}", "available under the {}", "{}"]
UNSEEN_FRAMES = ["use of this code is governed by the {}", "published by its authors under the {}.", "see the {} for details", "dual licensed, also under the {}"]
IDENTIFIER = "spdx-license-identifier: {}"
# Licences without a family here; the last are only for calibration.
UNKNOWN_NAMES = ["acme community license", "sleepycat license", "open software license 3.0", "academic free license", "common development and distribution license", "server side public license", "business source license 1.1", "elastic license 2.0", "qt commercial license", "sun public license", "apple public source license", "python software foundation license", "open data commons database license", "ibm public license", "microsoft public license", "game license of the studio"]
UNSEEN_UNKNOWN = ["european union public licence", "cecill license", "ruby license", "php license", "nokia open source license", "sil open font license", "reciprocal public license"]
#: Sentences with words of licences that license nothing.
NEAR_MISSES = ["you need a driving license to rent a car", "the license plate was found in the river", "copyright law is taught in the second year", "the apache helicopter landed at noon", "she studied at mit for three years", "he asked for permission to leave the room", "a new version of the program was released", "all rights are explained in the annex", "the public library is free of charge", "the software runs on any source of power", "the terms of the contract are general", "version 2.0 of the form is available", "the file was copied without modification", "a person obtaining work may use the form", "the license fee of the public broadcaster rose", "general public opinion was against the terms", "the commons were open to all", "a creative mind needs attribution and credit", "an artistic work of great value", "the eclipse was public and free to watch", "a boost for the software industry", "the lesser library of the foundation", "no warranties were given by the seller", "the notice was published in the public domain of the town", "redistribution of income is a matter of conditions"]
#: Words too common to be key words.
COMMON = set("the a an of to in is are be this that it its and or for with you may any no as at by can not on from your part all use work file form terms version person free charge copy code program document source available made under http https www mit which if one was will shall must into who what when their there other following above provided use used using purpose purposes even long give given most more material same original law legal either see should have received along them these those also only than then such each had has he she we our us name names list set out up new old author authors holder event held through including include included without within prior written law required".split())
UNKNOWN = "none"
TOKEN = r"[a-z0-9][a-z0-9.+-]*"
#: A family needs this probability, and this share of a template's word pairs confirms it.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6


def _tokens(text: str) -> list[str]:
    return [t.rstrip(".+-") for t in re.findall(TOKEN, text.lower())]


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def templates() -> dict[str, list[str]]:
    """What confirms a family: its names as they are cited, its identifiers, the sentences of its passages."""
    sentences = {f: [x for t in ts for x in re.split(r"(?<=[.;]) ", t) if len(x.split()) >= 3] for f, ts in PASSAGES.items()}
    return {f: [*names, *(IDENTIFIER.format(i) for i in ids), *sentences[f]] for f, (names, ids) in NAMES.items()}


@functools.cache
def key_words() -> tuple[str, ...]:
    texts = [*(t for ts in templates().values() for t in ts), "licensed under"]
    return tuple(sorted({t for x in texts for t in _tokens(x) if t not in COMMON and not t.replace(".", "").isdigit() and len(t) > 1 and "/" not in t}))


def _features(text: str) -> set[str]:
    keys = set(key_words())
    return {g for g in grams(_tokens(text)) if not keys.isdisjoint(g.split(" "))}


def statements(frames: list[str], unknown: list[str]) -> list[tuple[str, str]]:
    """(text, family) of every name in every frame, and of unknown licences in them."""
    named = [(frame.format(n), f) for f, (names, _) in NAMES.items() for n in names for frame in frames]
    return named + [(frame.format(n), UNKNOWN) for n in unknown for frame in frames]


def _fit(texts: list[set[str]], labels: np.ndarray, classes: int, vocabulary: dict[str, int], steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(texts), len(vocabulary)))
    for i, t in enumerate(texts):
        for g in t:
            if g in vocabulary:
                x[i, vocabulary[g]] = 1
    x /= np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))  # long and short texts weigh alike
    target = np.eye(classes)[labels]
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    for _ in range(steps):
        p = _softmax(x @ w + b)
        g = (p - target) / len(x)
        w -= 8.0 * (x.T @ g + ridge * w)
        b -= 8.0 * g.sum(0)
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.cache
def trained() -> tuple[tuple[str, ...], dict[str, list[float]], list[float], float]:
    """(families, none last; weights by n-gram; biases; temperature), trained on the fixed texts above."""
    families = (*NAMES, UNKNOWN)
    data = statements(FRAMES, UNKNOWN_NAMES)
    data += [(IDENTIFIER.format(i), f) for f, (_, ids) in NAMES.items() for i in ids] * 3
    data += [(t, f) for f, ts in PASSAGES.items() for t in ts] * 3
    data += [(t, f) for f, ts in templates().items() for t in ts if t in " ".join(PASSAGES[f])] * 2
    data += [(" ".join(words[i : i + 14]), f) for f, ts in PASSAGES.items() for t in ts for words in [t.split()] for i in range(0, max(1, len(words) - 7), 7)]
    data += [(t, UNKNOWN) for t in (*NEAR_MISSES, "", "")] * 3
    texts, labels = [_features(t) for t, _ in data], np.array([families.index(f) for _, f in data])
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*texts)))}
    w, b = _fit(texts, labels, len(families), vocabulary)
    # Temperature: scores of frames and unknown licences that the training has not seen.
    unseen = statements(UNSEEN_FRAMES, UNSEEN_UNKNOWN)
    scores = np.zeros((len(unseen), len(families)))
    for i, (t, _) in enumerate(unseen):
        own = [vocabulary[g] for g in _features(t) if g in vocabulary]
        scores[i] = w[own].sum(0) / max(1.0, math.sqrt(len(own))) + b
    wanted = np.array([families.index(f) for _, f in unseen])
    loss = lambda t: -np.log(_softmax(scores / t)[np.arange(len(unseen)), wanted] + 1e-12).mean()
    temperature = min((0.25 * 1.15**k for k in range(28)), key=loss)
    return families, {g: w[i].tolist() for g, i in vocabulary.items()}, b.tolist(), float(temperature)


def _words(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.regexp_replace(t, r"[.+-]+$", ""))


def _grams(words: Column) -> Column:
    """The distinct 1- to 3-grams of an array of words."""
    size = F.size(words)
    at = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(at(1), at(2), at(3)))


def scan_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph with a licence: id, digest (of the row's text), paragraph, family, probability, share, confirmed.

    Null and empty texts have no paragraphs; repeated rows of one key and text count once; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    families, weights, biases, temperature = trained()
    # A key word's longest piece of letters and digits stands in every text that has the word: texts and lines without one have no feature.
    pieces = sorted({max(re.findall("[a-z0-9]+", k), key=len) for k in key_words()})
    may = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*[F.lit(p) for p in pieces]))
    # A line that ends without a stop goes on in the next one.
    unwrapped = F.regexp_replace(text, r"(?<![.!?:;\s])[ \t]*\r?\n(?=[^\s])", " ")
    rows = docs.where(may(F.col(text))).select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(unwrapped, "\n")).alias("paragraph", "line"))
    lines = rows.where(may(F.col("line"))).select("id", "digest", "paragraph", F.explode(F.array(_words(F.col("line")))).alias("words")).withColumn("gram", _grams(F.col("words"))).drop("words")
    vocabulary = spark.createDataFrame([(g, [float(x) for x in w]) for g, w in weights.items()], "gram string, weights array<double>")
    # Features by line: joined with the vocabulary, a table of fixed size.
    one = ["id", "digest", "paragraph"]
    found = lines.select(*one, F.explode("gram").alias("gram")).join(F.broadcast(vocabulary), "gram")
    sums = [F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(families))]
    # Repeated rows of one key and text have the same paragraphs: counted once more each, then divided out.
    scored = found.groupBy(*one).agg(F.count(F.lit(1)).alias("n"), F.collect_set("gram").alias("own"), *sums)
    times = F.col("n") / F.size("own")
    logits = F.array(*[(F.col(f"w{i}") / times / F.sqrt(F.greatest(F.size("own"), F.lit(1))) + b) / temperature for i, b in enumerate(biases)])
    scored = scored.select(*one, "own", logits.alias("z"))
    top = F.array_max("z")
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("z", top).cast("int")
    scored = scored.select(*one, "own", F.element_at(F.array(*[F.lit(f) for f in families]), best).alias("family"), F.round(1 / total, 6).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
    # Template comparison: the word pairs of each template, another table of fixed size.
    pairs = [(f, i, g, len(own)) for f, ts in templates().items() for i, t in enumerate(ts) if (own := sorted(g for g in _features(t) if g.count(" ") == 1) or sorted(_features(t))) for g in own]
    table = spark.createDataFrame(pairs, "family string, template int, gram string, of int")
    shared = scored.select(*one, "family", F.explode("own").alias("gram")).join(F.broadcast(table), ["family", "gram"])
    share = shared.groupBy(*one, "template").agg((F.countDistinct("gram") / F.max("of")).alias("share")).groupBy(*one).agg(F.max("share").alias("share"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in one]
    out = scored.drop("own").join(share.select(*(F.col(c).alias(f"_{c}") for c in one), "share"), same[0] & same[1] & same[2], "left").select(*one, "family", "probability", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))
    return out.withColumn("confirmed", F.col("share") >= LEAST_SHARE)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, licence, probability, paragraphs, unconfirmed, families.

    licence is the family of the most probable confirmed paragraph, else 'none'; ties go to the
    earliest paragraph. paragraphs counts the confirmed paragraphs, families lists their families in
    order of name; unconfirmed counts predictions that no template confirms. Null and empty texts have none; repeated rows give
    repeated rows, an empty table an empty one. Other columns are ignored.
    """
    hits = scan_paragraphs(docs, key, text)
    order = F.struct("probability", (-F.col("paragraph")).alias("at"), "family")
    sure = F.col("confirmed")
    by_text = hits.groupBy("id", "digest").agg(
        F.max(F.when(sure, order)).alias("top"), F.count_if(sure).alias("paragraphs"), F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"), F.count_if(~sure).alias("unconfirmed")
    )
    by_text = by_text.withColumnRenamed("id", "_id").withColumnRenamed("digest", "_digest")
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"))
    out = rows.join(by_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("top.family", F.lit(UNKNOWN)).alias("licence"),
        F.col("top.probability").alias("probability"),
        F.coalesce("paragraphs", F.lit(0)).cast("long").alias("paragraphs"),
        F.coalesce("unconfirmed", F.lit(0)).cast("long").alias("unconfirmed"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )
