from __future__ import annotations

import random

import numpy as np
from helpers import DOCS, edited, grams, linked, odd_rows, prose

from tessera.llm import _cluster as C
from tessera.llm import neardup as N


def family():
    r = random.Random(5)
    rows = []
    for _ in range(25):
        base = prose(r, r.randint(40, 120))
        rows += [base] + [base] * r.choice([0, 1, 3]) + [edited(r, base, r.randint(1, 5)) for _ in range(r.randint(0, 6))]
    rows += [prose(r, 60) for _ in range(30)] + ["one two", "One, TWO!", "la la la la la la la"]
    r.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, threshold=N.THRESHOLD):
    g = {i: grams(t) for i, t in rows if i is not None}
    ids = sorted(i for i in g if g[i])
    pairs = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (s := len(g[a] & g[b])) >= threshold * (len(g[a]) + len(g[b]) - s)}
    return pairs, linked(ids, pairs)


def test_recall_and_groups(spark):
    rows = family()
    got = {r.doc_id: r.group_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs, want = brute(rows)
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.9 * len(pairs)
    # groups are those of brute force or parts of them: none holds two documents that brute force keeps apart
    assert set(got) <= set(want) and all(want[i] == want[g] for i, g in got.items())


def test_posterior_bound():
    least = N.least_matches(0.5, 0.005)
    r = np.random.default_rng(1)
    s = r.uniform(size=400_000)
    for n, m in zip(range(N.BATCH, N.CHECKS + 1, N.BATCH), least):
        hits = r.binomial(n, s + (1 - s) / 256)
        if m:
            assert (s[hits == m - 1] >= 0.5).mean() < 0.01
        assert (s[hits == m] >= 0.5).mean() > 0.001


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    for local in (0, C.LOCAL_EDGES):
        got = {x.id: x.root for x in C.components(spark.createDataFrame(pairs, "a long, b long"), local).collect()}
        assert got == linked({x for p in pairs for x in p}, [p for p in pairs if p[0] != p[1]])


def test_big_bucket_takes_few_pairs(spark):
    members = spark.createDataFrame([(b, i) for b in range(3) for i in range(200)] + [(0, 999)], "bucket long, id long")
    seen = []

    def verify(pairs):
        rows = [tuple(p) for p in pairs.collect()]
        seen.extend(rows)
        return spark.createDataFrame([p for p in rows if 999 not in p], "a long, b long")

    got = C.clusters(members, verify).collect()
    assert {r.id for r in got} == set(range(200)) and {r.root for r in got} == {0}
    assert len(seen) <= 199 + 1 + 199


def test_deduplicate(spark):
    rows = family()
    docs = spark.createDataFrame([(i, t, f"r{i}", i) for i, t in rows], "doc_id long, text string, gone string, rank long")
    out = N.deduplicate(docs).collect()
    groups = {r.doc_id: r.group_id for r in N.groups(docs).collect()}
    assert {r.doc_id for r in out} == {i for i, _ in rows if groups.get(i, i) == i} and all(r.gone == f"r{r.doc_id}" for r in out)


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    assert N.groups(docs).collect() == []
    left = [r.doc_id for r in N.deduplicate(docs).collect()]
    assert sorted(x for x in left if x) == [1, 2, 3, 4, 5, 6, 7, 8, 9] and left.count(None) == 2
    none = spark.createDataFrame([], DOCS)
    assert N.groups(none).collect() == [] and N.deduplicate(none).collect() == []


def test_each_text_of_a_repeated_id_is_compared(spark):
    r = random.Random(8)
    rows, want = [], {}
    for k in range(0, 60, 10):
        one, other = prose(r, 80), prose(r, 80)
        # k + 1 has a text equal to that of k, and another that k + 2 nearly has
        rows += [(k, one), (k + 1, one), (k + 1, other), (k + 2, edited(r, other, 2)), (k + 3, prose(r, 80))]
        want |= {k: k, k + 1: k, k + 2: k}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.group_id for x in N.groups(docs).collect()} == want
    assert sorted(x.doc_id for x in N.deduplicate(docs).collect()) == sorted(i for i, _ in rows if i % 10 in (0, 3))


def test_hot_buckets_lose_no_pair_that_their_checks_keep(spark, monkeypatch):
    """Ids of one large bucket, whose checks agree in just enough places, are all verified, in one part or in several."""
    r = np.random.default_rng(9)
    least = N.least_matches()
    checks = r.integers(0, 256, (120, N.CHECKS), dtype=np.uint8)
    for i in range(60, 120):
        # as many of each batch as the posterior asks for, after the batches before
        checks[i] = checks[i - 60] + np.uint8(1)
        for k, m in enumerate(np.diff(least, prepend=0)):
            at = r.permutation(N.BATCH)[:m] + k * N.BATCH
            checks[i, at] = checks[i - 60, at]
    rows = spark.createDataFrame([(i, bytes(c)) for i, c in enumerate(checks)], "id long, sketch binary")
    members = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(120)], "bucket long, id long")
    want = {(i, i + 60) for i in range(60)}
    assert N.bayes_keep([bytes(checks[a]) for a, _ in want], [bytes(checks[b]) for _, b in want], N.THRESHOLD, N.MISS).all()

    def verify(pairs, near=False):
        return spark.createDataFrame([p for p in map(tuple, pairs.collect()) if p in want], "a long, b long")

    near = N.bayes_near(N.THRESHOLD, N.MISS)
    for small, block in ((48, 1 << 14), (200, 1 << 14), (8, 50), (48, 20)):
        monkeypatch.setattr(C, "SMALL", small)
        monkeypatch.setattr(C, "BLOCK", block)
        got = {x.id: x.root for x in C.clusters(members, verify, rows, near).collect()}
        assert got == {i: i % 60 for i in range(120)}, (small, block)


def test_bayes_near_is_bayes_keep():
    r = np.random.default_rng(10)
    x = r.integers(0, 3, (40, N.CHECKS), dtype=np.uint8)
    y = np.where(r.random((30, N.CHECKS)) < 0.4, x[:30], r.integers(0, 3, (30, N.CHECKS))).astype(np.uint8)
    got = N.bayes_near(0.5, 0.005)(x.T[:, :, None], y.T[:, None, :])
    want = [N.bayes_keep([bytes(a)] * 30, [bytes(b) for b in y], 0.5, 0.005) for a in x]
    assert 0 < got.sum() < got.size and (got == np.stack(want)).all()
