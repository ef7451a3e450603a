from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from helpers import DOCS, odd_rows, prose

from tessera.llm import quality as Q


def labelled(n=600, seed=11):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t, bad = prose(r, r.randint(20, 120)), i % 5 == 0
        if bad:
            w = t.split(" ")
            t = r.choice([" ".join(x + r.choice(["###", "$$$", "&&&"]) for x in w), t.upper().replace(" ", "!! "), " | ".join(w), " ".join(x for x in w[:12] for _ in range(15))])
        rows.append((i, t, 0 if bad else 1))
    return rows


def test_held_out_accuracy(spark):
    train, test = labelled(), labelled(300, 12)
    model = Q.train(spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string"))
    got = {x.doc_id: x.kept for x in Q.scores(spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string"), model).collect()}
    assert all(got[i] for i, _, y in test if y)
    assert np.mean([not got[i] for i, _, y in test if not y]) > 0.95


def test_driver_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = Q.scores(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1


def test_em_finds_the_accuracies():
    r = np.random.default_rng(13)
    y = r.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8])
    votes = np.where(r.random((len(y), 4)) < right, y[:, None], ~y[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, prior, theta = Q.em(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03 and np.abs(theta[:, 1, Q.GOOD] - right).max() < 0.05


def test_patterns_count_all_documents(spark):
    rows = [(i, t) for i, t, _ in labelled(200)]
    got = Q.vote_patterns(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    votes = Q.Items(pa.array([t for _, t in rows])).votes()
    want, n = np.unique((votes * 3 ** np.arange(len(Q.LABELLERS))).sum(1), return_counts=True)
    assert got.n.sum() == 200 and dict(zip(got.pattern, got.n)) == dict(zip(want, n))


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled(400)], "doc_id long, text string")
    assert Q.train(docs, sample=50) is not None


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows() + [(100 + i, t, None, None, i) for i, t, _ in labelled(100)], DOCS).withColumnRenamed("lang", "score")
    got = Q.scores(docs).collect()
    assert len(got) == len(odd_rows()) + 100
    assert {x.doc_id for x in got if x.doc_id in (1, 2, 3) and x.score == 0 and not x.kept} == {1, 2, 3}
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in got)
    none = spark.createDataFrame([], DOCS)
    assert Q.train(none) is None and Q.scores(none).collect() == [] and Q.keep_good(none).collect() == []
    alike = spark.createDataFrame([(1, "plain words here. and there."), (2, "other words now. all good.")], "doc_id long, text string")
    assert all(x.kept for x in Q.scores(alike).collect())


def test_many_copies_of_one_text(spark):
    texts = [t for _, t, y in labelled(400) if y]
    keys = {r.text: r.k for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) AS k").collect()}
    late = max(keys, key=keys.get)
    docs = spark.createDataFrame([(i, late) for i in range(3000)], "doc_id long, text string")
    assert Q.train(docs, sample=100) is not None
    kept = {x.kept for x in Q.scores(docs, Q.train(docs, sample=100)).collect()}
    assert kept == {True}
    few = spark.createDataFrame([(i, late) for i in range(3000)] + list(enumerate(texts[:60])), "doc_id long, text string")
    assert Q.train(few, sample=100) is not None
