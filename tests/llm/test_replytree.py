from __future__ import annotations

import random

from tessera.llm import replytree as R

SCHEMA = "conv long, msg long, parent long, role string, text string, score double"


def brute(rows):
    nodes = {(c, m): p for c, m, p in rows}
    kids = {}
    for (c, m), p in nodes.items():
        if (c, p) in nodes:
            kids.setdefault((c, p), []).append(m)
    out, todo = set(), [(c, (m,)) for (c, m), p in nodes.items() if (c, p) not in nodes]
    while todo:
        c, path = todo.pop()
        more = kids.get((c, path[-1]), [])
        todo += [(c, (*path, m)) for m in more]
        if not more:
            out.add((c, path))
    return out


def test_paths_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(c, m, r.randrange(max(1, m)) if m and r.random() < 0.95 else None) for c in range(6) for m in range(r.randint(1, 40))]
    rows += [(50, m, m - 1 if m else None) for m in range(70)] + [(60, 1, 2), (60, 2, 1), (60, 3, 2), (60, 4, None), (61, 1, 77), (62, 1, 1)]
    df = spark.createDataFrame(rows, "conv long, msg long, parent long")
    assert {(x.conv, tuple(x.path)) for x in R.paths(df).collect()} == brute(rows)


def test_branches_are_ranked_and_formatted(spark):
    rows = [(1, 0, None, "user", "hi", 1.0), (1, 1, 0, "assistant", "good", 2.0), (1, 2, 0, "assistant", "better", 3.0), (1, 3, 1, "user", "thanks", 1.0), (1, 4, 2, None, None, None), (2, 0, None, "user", "alone", 0.0)]
    got = {(x.conv_id, x["rank"]): x for x in R.conversations(spark.createDataFrame(rows, SCHEMA), top=2).collect()}
    assert (got[1, 1].leaf, got[1, 1].score, got[1, 2].leaf, got[1, 2].n_messages) == (3, 4.0, 4, 3)
    assert got[1, 2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nbetter<|im_end|>\n<|im_start|>user\n<|im_end|>"
    assert got[2, 1].chat == "<|im_start|>user\nalone<|im_end|>"
    assert len(R.conversations(spark.createDataFrame(rows, SCHEMA), top=1).collect()) == 2


def test_turns_of_one_role_are_alternatives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b b"), (1, 5, "user", "z")], "conv_id long, turn long, role string, text string")
    assert {(m.msg, m.parent) for m in R.from_turns(turns).collect()} == {(0, None), (1, 0), (2, 1), (3, 1), (5, 3)}


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [(1, 0, "user", long, "x"), (1, 0, "user", long, "x"), (1, 1, None, None, "x"), (None, 1, "user", "t", "x"), (2, None, "user", "t", "x"), (3, 4, "", "", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    got = {x.conv_id: x for x in R.conversations(R.from_turns(t)).collect() if x["rank"] == 1}
    assert set(got) == {1, 3} and len(got[1].chat) > len(long) and got[3].chat == "<|im_start|>\n<|im_end|>"
    assert R.conversations(R.from_turns(t.limit(0))).collect() == [] and R.conversations(spark.createDataFrame([], SCHEMA)).collect() == []
