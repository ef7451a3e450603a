from __future__ import annotations

import hashlib
import random

from helpers import DOCS, odd_rows

from tessera.llm import sharding as S


def brute(rows, limit):
    bits = {i: f"{int(hashlib.md5(('null' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    out = {}

    def split(prefix, some):
        if sum(len((t or "").encode()) for _, t in some) > limit and len({bits[i] for i, _ in some}) > 1:
            for b in "01":
                split(prefix + b, [x for x in some if bits[x[0]][len(prefix)] == b])
        else:
            out.update({i: prefix for i, _ in some})

    split("", rows)
    return out


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, "é" * r.randint(0, 400)) for i in range(400)] + [(500, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (3000, 900, 10**9, 60):
        got = S.assign(docs, limit).collect()
        assert {x.doc_id: x.shard for x in got} == brute(rows, limit) and len(got) == len(rows)
        for s in S.shard_sizes(docs, limit).collect():
            assert s.shard_bytes <= limit or s.shard_docs == 1
            assert s.shard_bytes == sum(x.n_bytes for x in got if x.shard == s.shard)
    S.write_shards(docs, str(tmp_path / "out"), 3000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_odd_rows(spark):
    rows = odd_rows()
    got = S.assign(spark.createDataFrame(rows, DOCS), 1000).collect()
    want = brute([(i, t) for i, t, *_ in rows], 1000)
    assert len(got) == len(rows) and all(want[x.doc_id] == x.shard for x in got)
    assert S.assign(spark.createDataFrame([], DOCS)).collect() == []


def test_a_column_named_shard_stays(spark, tmp_path, monkeypatch):
    rows = [(i, "x" * (i % 50), f"s{i}") for i in range(300)] + [(None, "null id", "n"), (7, "again", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string")
    want = {x.doc_id: x.shard for x in S.assign(docs, 900).collect()}
    for k, listed in enumerate((S.LISTED, 0)):
        monkeypatch.setattr(S, "LISTED", listed)
        name = S.write_shards(docs, str(tmp_path / str(k)), 900)
        got = spark.read.parquet(str(tmp_path / str(k)))
        assert name not in docs.columns and set(got.columns) == {*docs.columns, name}
        out = got.collect()
        assert sorted(((x.doc_id, x.text, x.Shard) for x in out), key=repr) == sorted(rows, key=repr)
        assert all(x[name] == "p" + want[x.doc_id] for x in out)
    S.write_shards(spark.createDataFrame([], docs.schema), str(tmp_path / "none"), 900)
