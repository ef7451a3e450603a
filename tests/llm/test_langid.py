from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid as G

SETS = {"en": ["the", "with", "and", "shore", "thing"], "fr": ["été", "avec", "dans", "leçon", "être"], "de": ["über", "straße", "nicht", "schön", "und"]}
PAGES = "page_id long, url string, html string"


def tables():
    r = random.Random(14)
    say = lambda k, n: " ".join(r.choice(SETS[k]) for _ in range(n))
    docs = [(i, say(k, 40), k) for i, k in enumerate(list(SETS) * 10)]
    pages = []
    for i in range(120):
        k = r.choice(list(SETS))
        tag = r.choice([k, k, k, "xx", None])
        body = say(k, r.choice([0, 1, 2, 30]))
        pages.append((i, f"https://{k}{r.randint(0, 2)}.example.{r.choice(['com', k])}/p{i}", (f'<html lang="{tag}-X">' if tag else "<html>") + f"<script>the the the</script><p>{body}&nbsp;</p></html>", k))
    return docs, pages


def brute(pages, names, table):
    """Posteriors in plain loops."""
    import html as _html  # noqa: F401
    import re

    rows = []
    for i, url, page, *_ in pages:
        text = re.sub(r"&[a-zA-Z]+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", page or ""))
        like = G.likelihoods(pa.array([text]), table)[0]
        host = (re.match(r"https?://([^/]+)", url or "") or [None, ""])[1]
        tag = re.search(r'<html[^>]*lang="([a-z]{2,3})', page or "")
        rows.append((i, host, host.split(".")[-1], tag[1] if tag else "", like, np.exp(like) / np.exp(like).sum()))
    n = len(names)
    by = {k: defaultdict(lambda: np.zeros(n)) for k in (1, 2, 3)}
    count = {k: Counter(r[k] for r in rows) for k in (1, 2)}
    for r in rows:
        for k in (1, 2, 3):
            by[k][r[k]] = by[k][r[k]] + r[5]
    every = sum(r[5] for r in rows)
    out = {}
    for i, host, suffix, tag, like, own in rows:
        base = (every + 1.0) / (len(rows) + n)
        suf = (by[2][suffix] + G.SUFFIX_WEIGHT * base) / (count[2][suffix] + G.SUFFIX_WEIGHT)
        prior = (np.maximum(by[1][host] - own, 0) + G.HOST_WEIGHT * suf) / (count[1][host] - 1 + G.HOST_WEIGHT)
        said = (by[3][tag] + G.DECLARED_WEIGHT / n) / (every + G.DECLARED_WEIGHT * len(by[3]) / n)
        t = like + np.log(said) + np.log(prior)
        p = np.exp(t - t.max())
        out[i] = (names[int(t.argmax())], float(p.max() / p.sum()))
    return out


def test_equals_brute_force_and_is_right(spark):
    docs, pages = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = spark.createDataFrame([x[:3] for x in pages], PAGES)
    names, table = G.train(d)
    got = {x.page_id: x for x in G.identify(p, d, (names, table)).collect()}
    want = brute(pages, names, table)
    assert len(got) == 120
    for i, (lang, post) in want.items():
        assert got[i].lang == lang and got[i].posterior == pytest.approx(post, abs=2e-6)
    true = {x[0]: x[3] for x in pages}
    assert np.mean([got[i].lang == true[i] for i in true]) > 0.97
    assert np.mean([got[i].lang == true[i] for i in true]) >= np.mean([got[i].text_lang == true[i] for i in true])


def test_counts_cover_all_documents(spark):
    docs, _ = tables()
    got = G.counts(spark.createDataFrame(docs, "doc_id long, text string, lang string")).toPandas()
    want = defaultdict(int)
    for _, t, k in docs:
        want[k] += len(G.trigrams(pa.array([t]))[0])
    assert got.groupby("lang").n.sum().to_dict() == dict(want)


def test_odd_rows(spark):
    docs, pages = tables()
    d = spark.createDataFrame(docs + [(900, None, "en"), (901, "x", None), (902, "", "fr")], "doc_id long, text string, lang string")
    odd = [(1, None, None), (2, "", ""), (3, "not an address", "<p>"), (None, "https://en0.example.com/", "<p>the thing"), (4, "https://en0.example.com/", "the " * 100_000), (4, "https://en0.example.com/", "the " * 100_000)]
    p = spark.createDataFrame([(*x, "z", 1) for x in odd], PAGES + ", host string, h0 int")
    got = G.identify(p, d).collect()
    assert len(got) == len(odd) and all(x.lang for x in got) and [x.lang for x in got if x.page_id in (None, 4)] == ["en"] * 3
    assert G.identify(p.limit(0), d).collect() == [] and G.identify(p, d.limit(0)).collect() == []
