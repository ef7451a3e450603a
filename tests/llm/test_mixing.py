from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from helpers import DOCS, odd_rows, prose
from pyspark.sql import functions as F

from tessera.llm import mixing as M


def brute(rows, parts, budget, seed=M.SEED):
    by = defaultdict(list)
    for i, t, s in rows:
        n = len((t or "").split())
        if n:
            by[s].append((hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), i, n))
    names = sorted(by, key=lambda s: (s is not None, s))
    parts = parts or {s: 1 for s in names}
    every = sum(parts.values())
    budget = sum(n for v in by.values() for _, _, n in v) if budget is None else budget
    named = [s for s in names if parts.get(s)]
    share = {s: budget * parts[s] // every for s in named}
    if sum(parts[s] for s in named) == every:
        for s in named[: budget - sum(share.values())]:
            share[s] += 1
    out = []
    for s in named:
        left, epoch, at = share[s], 0, 0
        while left:
            for _, i, n in sorted(by[s], key=lambda x: (x[0], x[1] is not None, x[1], x[2])):
                if left:
                    out.append((i, s, epoch, at, min(n, left), n))
                    at, left = at + n, left - min(n, left)
            epoch += 1
    return sorted(out, key=repr)


def table():
    r = random.Random(4)
    return [(i, prose(r, r.randint(1, 60)), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(150)]


def test_plan_equals_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts, budget in ((None, None), ({"a": 1, "b": 5, "x": 2}, 3000), ({"b": 1}, 7), ({None: 3, "c": 1}, 5001)):
        assert sorted(map(tuple, M.plan(docs, parts, budget).collect()), key=repr) == brute(rows, parts, budget), parts


def test_mix_is_the_plan(spark):
    rows = table() + [(900, "tie tie tie tie", "b")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"end": F.lit(1), "o": F.lit("x"), "n_chars": F.lit(0)})
    for parts, budget in ((None, None), ({"a": 1, "b": 5}, 3001)):
        plan, out = M.plan(docs, parts, budget).toPandas(), M.mix(docs, parts, budget, n_chars="n_chars")
        assert out.columns == docs.columns
        got = out.toPandas()
        texts = {i: t for i, t, _ in rows}
        assert sorted((r.doc_id, len(r.text.split())) for r in got.itertuples()) == sorted((r.doc_id, r.take) for r in plan.itertuples())
        assert all(texts[r.doc_id].startswith(r.text) and len(r.text) == r.n_chars for r in got.itertuples())


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    plan = M.plan(docs)
    assert sorted(map(tuple, plan.collect()), key=repr) == brute([(i, t, s) for i, t, _, s, _ in odd_rows()], None, None)
    assert M.mix(docs, n_chars="n_chars").count() == plan.count()
    none = spark.createDataFrame([], DOCS)
    assert M.plan(none).collect() == [] and M.mix(none).collect() == []


def test_small_source_with_a_large_share(spark):
    docs = spark.createDataFrame([(1, "one", "x"), (2, "two three", "y")], "doc_id long, text string, source string")
    far = M.plan(docs, {"x": 1}, 3 * 10**9).limit(5).collect()
    assert len({r.epoch for r in far}) == 5 and all((r.doc_id, r.source, r.start, r.take, r.n_tokens) == (1, "x", r.epoch, 1, 1) for r in far)
    assert len(M.mix(docs, {"x": 1}, 3 * 10**9).limit(5).collect()) == 5


def test_long_lists_of_epochs(spark, monkeypatch):
    monkeypatch.setattr(M, "LISTED", 4)
    rows = [(1, "one", "x"), (2, "two three", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, M.plan(docs, {"x": 3, "y": 2}, 55).collect()), key=repr) == brute(rows, {"x": 3, "y": 2}, 55)
    assert M.mix(docs, {"x": 3, "y": 2}, 55).groupBy("text").count().collect().__len__() == 2


def test_cut_text_keeps_every_character(spark):
    text = "\u0001\u0001 one\ttwo \u0001\u0001 three"
    got = [r.text for r in M.mix(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, source string"), None, 4).collect()]
    assert got == ["\u0001\u0001 one\ttwo \u0001\u0001"]
