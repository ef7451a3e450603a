from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
from helpers import DOCS, edited, odd_rows, prose, words
from test_decontaminate import brute as leaks
from test_mixing import brute as mixed
from test_neardup import brute as near
from test_quality import labelled

import corpus_pipeline as P
from tessera.llm import decontaminate, quality
from tessera.llm import tokenids as K


def corpus(tmp_path, spark, extra=()):
    r = random.Random(15)
    items = [(i, prose(r, 20)) for i in range(6)]
    rows = [(i, t) for i, t, _ in labelled(150)]
    base = [t for _, t in rows[1:20]]
    rows += [(1000 + i, t) for i, t in enumerate(base[:6])] + [(1100 + i, edited(r, t, 1)) for i, t in enumerate(base[6:14])]
    rows += [(1200 + i, prose(r, 60) + " " + items[i][1] + " " + prose(r, 30)) for i in range(6)] + [(1300, items[0][1])]
    rows = [(i, t, "en", r.choice("aaab"), len(t)) for i, t in rows] + list(extra)
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, items


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = corpus(tmp_path, spark)
    got = P.run(spark, str(tmp_path)).collect()

    weights, bias = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    score = quality.Items(pa.array([x[1] for x in rows])).score(weights, bias).round(6)
    rows = [x for x, s in zip(rows, score) if s >= quality.KEEP]
    groups = near([(x[0], x[1]) for x in rows])[1]
    rows = [x for x in rows if groups.get(x[0], x[0]) == x[0]]
    found = {x[0]: x[1] for x in leaks([(x[0], x[1]) for x in rows], items)}
    assert {"cut", "drop"} == set(found.values())
    clean = []
    for x in rows:
        if found.get(x[0]) == "drop":
            continue
        if x[0] in found:
            spans = []
            w, t = words(x[1]), [tuple(words(y)) for _, y in items]
            for k in range(len(w) - decontaminate.N + 1):
                if any(tuple(w[k : k + decontaminate.N]) == g[j : j + decontaminate.N] for g in t for j in range(len(g))):
                    spans += [k, decontaminate.N, 0]
            x = (x[0], decontaminate.cut_text(x[1], decontaminate.merged(spans)), *x[2:])
        clean.append(x)
    enc, _ = K.encoder(K.VOCABULARY)
    want = defaultdict(list)
    texts = {x[0]: x[1] for x in clean}
    for i, _, _, _, take, n in mixed([(x[0], x[1], x[3]) for x in clean], None, None):
        t = texts[i]
        if take < n:
            at = -1
            parts = t.split()
            at = 0
            for p in parts[:take]:
                at = t.index(p, at) + len(p)
            t = t[:at]
        want[i].append(enc.encode_ordinary(t))
    have = defaultdict(list)
    for x in got:
        have[x.doc_id].append(K.unpack(x.payload, x.block_starts).astype(int).tolist())
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows, _ = corpus(tmp_path, spark, odd_rows())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), DOCS)
    assert docs.count() > 100 and P.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
