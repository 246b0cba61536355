"""The fused posterior of a page's language, computed again page by page."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from clausemill.llm import language_id as li

WORDS = {"en": "the and with this that from have which".split(), "de": "der und das nicht mit eine auch sich".split(), "fr": "les des une dans pour qui avec sur".split()}


def soft(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def posterior(pages, languages, table):
    """(id, url, html) -> id: (language, probability)."""
    n = len(languages)
    facts = []
    for page, url, html in pages:
        at = li._slots(li._plain(li.visible(html or "")))
        if len(at):
            s = table[:, at].sum(1, dtype=np.float64) * (li.WEIGHT * min(1.0, li.MOST / len(at)))
            ll = [float(x - s.max()) for x in s]
        else:
            ll = [0.0] * n
        declared = (html or "").split("lang=")[1][:2] if "lang=" in (html or "") else None
        host = url.split("//")[1].split("/")[0] if url else None
        suffix, domain = (host.split(".")[-1], ".".join(host.split(".")[-2:])) if host else (None, None)
        kind = "-" if declared is None else declared if declared in languages else "?"
        facts.append((page, ll, soft(ll), kind, suffix, domain, host))
    total = len(facts)
    prior = [(sum(f[2][i] for f in facts) + 1) / (total + n) for i in range(n)]

    def grouped(column):
        out = defaultdict(lambda: [0, [0.0] * n])
        for f in facts:
            if f[column] is not None:
                out[f[column]][0] += 1
                out[f[column]][1] = [a + b for a, b in zip(out[f[column]][1], f[2])]
        return out

    def told(column):
        return {v: [math.log((s[i] + li.STRENGTH * k / total) / (max(prior[i], 1e-9) * total + li.STRENGTH)) for i in range(n)] for v, (k, s) in grouped(column).items()}

    kinds, suffixes = told(3), told(4)
    domains = {v: [(s[i] + li.STRENGTH * prior[i]) / (k + li.STRENGTH) for i in range(n)] for v, (k, s) in grouped(5).items()}
    hosts = {v: [(s[i] + li.STRENGTH * domains[".".join(v.split(".")[-2:])][i]) / (k + li.STRENGTH) for i in range(n)] for v, (k, s) in grouped(6).items()}
    out = {}
    for page, ll, _, kind, suffix, _, host in facts:
        z = [ll[i] + kinds[kind][i] + (suffixes[suffix][i] if suffix else 0.0) + math.log((hosts[host] if host else prior)[i]) for i in range(n)]
        p = soft(z)
        out[page] = (languages[p.index(max(p))], max(p))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_posterior_equals_page_by_page(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(li, "FEW_SUFFIXES", 0)
    draw = random.Random(12)
    text = lambda g, k: " ".join(draw.choice(WORDS[g]) for _ in range(k))
    docs = [(i, text(g, 30), g) for i, g in enumerate(["en", "de", "fr"] * 20)] + [(900, "short", "xx"), (None, text("en", 30), "en"), (901, None, "de")]
    pages = []
    for i in range(300):
        g = draw.choice(["en", "de", "fr"])
        host = draw.choice([None, f"a{draw.randrange(4)}.site{draw.randrange(5)}.{draw.choice(['de', 'com', 'fr'])}", "big.example.com"])
        tag = draw.choice(["", "", f"<html lang={g}>", "<html lang=de>", "<html lang=zz>"])
        pages.append((i, None if host is None else f"http://{host}/p", draw.choice([None, tag, tag + "<p>" + text(g, draw.choice([1, 4, 40]))])))
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    labelled = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    languages, table = li.train(labelled)
    assert languages == ["de", "en", "fr"]
    want = posterior(pages, languages, table)
    got = {r.page_id: (r.language, r.probability) for r in li.identify_languages(df, labelled).collect()}
    assert got.keys() == want.keys()
    for k, (g, p) in want.items():
        assert abs(got[k][1] - p) < 2e-6 and (got[k][0] == g or abs(p - 0.5) < 1e-6)


def test_every_language_is_learned(spark):
    docs = [(100 * k + i, " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}word"] * 8), f"l{k:03d}") for k in range(150) for i in range(2)]
    languages, table = li.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert len(languages) == 150 and table.shape == (150, li.SLOTS)
