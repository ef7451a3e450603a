from __future__ import annotations

import itertools

import numpy as np
from helpers import DOCS, odd_rows

from tessera.llm import pii as P


def test_held_out_accuracy():
    d = P.Decoder(P.default_model())
    right = total = 0
    for items, tags in P.labelled(400, 77):
        got = P.viterbi(d.emissions(items)[None], np.array([len(items)]), d.t)[0]
        right += sum(P.TAGS[g] == t for g, t in zip(got, tags))
        total += len(tags)
    assert right / total > 0.99


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    e, t = r.normal(size=(6, 4, P.L)), r.normal(size=(P.L, P.L))
    lengths = np.array([4, 4, 3, 2, 1, 1])
    got = P.viterbi(e, lengths, t)
    for i, n in enumerate(lengths):
        best = max(itertools.product(range(P.L), repeat=int(n)), key=lambda y: sum(e[i, k, y[k]] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
        assert tuple(got[i, :n]) == best


def test_skipping_lines_changes_nothing():
    model = P.default_model()
    assert not P.decode_all(model)
    d = P.Decoder(model)
    text = "plain words, here!\ntoken = key: secret\nmail me: ann.07@mail.example.com, or call +1 (555) 555-0100\n= = token password"
    some = d.spans([text])
    d.all = True
    assert d.spans([text]) == some and len(some[0]) == 2


def test_find_and_redact(spark):
    text = 'Reach bob.12@mail3.example.com!! or +1 (361) 555-0271 then card 2390409500648960 at 10.20.30.40. token = "87e15d78b9d8ef29b6c10061e3551a60fa07e990" in 1999, v2.1'
    docs = spark.createDataFrame([(1, text, "x"), (2, "clean words of 1998", "y")], "doc_id long, text string, start string")
    got = {(r.kind, text[r.start : r.end]) for r in P.find(docs).collect()}
    assert got == {("EMAIL", "bob.12@mail3.example.com"), ("PHONE", "+1 (361) 555-0271"), ("CARD", "2390409500648960"), ("IP", "10.20.30.40"), ("SECRET", "87e15d78b9d8ef29b6c10061e3551a60fa07e990")}
    out = {r.doc_id: r for r in P.redact(docs).collect()}
    assert out[1].text == 'Reach <EMAIL>!! or <PHONE> then card <CARD> at <IP>. token = "<SECRET>" in 1999, v2.1' and out[2].text == "clean words of 1998" and out[1].start == "x"


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    assert P.find(docs).collect() == [] and P.redact(docs).count() == len(odd_rows())
    twice = spark.createDataFrame([(1, "a@b.org")] * 2 + [(None, "a@b.org")], "doc_id long, text string")
    assert len(P.find(twice).collect()) == 3
    assert P.find(spark.createDataFrame([], DOCS)).collect() == []
