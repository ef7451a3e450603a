"""Questions with a known best source, and properties that must hold whatever the data."""

from __future__ import annotations

import pytest

from tessera.operators import answer as A
from tessera.operators import search as S

COLS = "id long, source_type string, location string, title string, text string, extension string, size_bytes long, indexed_at long"

CASES = [
    ("founder", "who founded netflix?", "Beginnings of a company", [
        ("Beginnings of a company", "Netflix was founded in 1997 by Reed Hastings and Marc Randolph. The founders established the company in California; this is its early history."),
        ("Plans", "Netflix pricing, subscription and account help. Download the app and sign in to Netflix."), ("Account", "Login to your Netflix account. Netflix support and products."),
    ]),
    ("inventor", "who invented the telescope and when?", "Makers of lenses", [
        ("Makers of lenses", "The telescope was invented in 1608. Hans Lipperhey, a pioneer, applied for a patent; others developed it. A timeline of its invention and discovery."),
        ("Mirror types", "A telescope with mirrors is called a reflector. Buy a telescope in our store."), ("Optics", "Optics is about light. A telescope gathers it."),
    ]),
    ("statistic", "how many otters are in norway?", "Counting otters", [
        ("Counting otters", "A survey gives an estimated population of 20 thousand otters in Norway, 5 percent more than in the last census."),
        ("Otter breeds", "Otters of Norway: breeds, adoption, names and toys."), ("Otter life", "Otters in Norway eat fish and play."),
    ]),
    ("explanation", "why do geese migrate?", "Reasons", [("Reasons", "Geese migrate because food is scarce in winter. The cause and mechanism of the process are explained by science."), ("Geese", "Geese are birds that migrate. Geese live by lakes.")]),
]


def sources(spark, chunks, extra=()):
    rows = [(i, "file", f"/fixtures/{t}.txt", t, x, "txt", len(x), i) for i, (t, x) in enumerate(chunks)]
    return spark.createDataFrame([*rows, *extra], COLS)


def ask(spark, q):
    return spark.createDataFrame([(1, q)], "query_id long, query string")


@pytest.mark.parametrize("name,question,title,chunks", CASES)
def test_best_source(spark, name, question, title, chunks):
    got = S.search(sources(spark, chunks), ask(spark, question), 5).orderBy("rank").collect()
    assert got[0].title == title and got[0].intent == name


def test_batch_equals_single_and_order_of_rows_is_nothing(spark):
    table = sources(spark, [c for case in CASES for c in case[3]])
    qs = [(i, c[1]) for i, c in enumerate(CASES)]
    batch = S.search(table, spark.createDataFrame(qs, "query_id long, query string"), 4).select("query_id", "rank", "id", "score").collect()
    again = S.search(table.repartition(7).orderBy("text"), spark.createDataFrame(qs[::-1], "query_id long, query string"), 4).select("query_id", "rank", "id", "score").collect()
    assert sorted(batch) == sorted(again)
    for i, q in qs:
        single = S.search(table, ask(spark, q), 4).select("rank", "id", "score").collect()
        assert sorted(tuple(r) for r in single) == sorted((r["rank"], r.id, r.score) for r in batch if r.query_id == i)


def test_no_terms_no_hits(spark):
    table = sources(spark, CASES[0][3])
    assert S.search(table, ask(spark, "the of and?")).collect() == [] and S.search(table, ask(spark, None)).collect() == []
    assert S.search(table.limit(0), ask(spark, "netflix")).collect() == []


def test_answer_cites_without_gaps(spark):
    got = A.paragraphs(S.search(sources(spark, CASES[0][3]), ask(spark, CASES[0][1]))).collect()
    text = A.render(got)
    assert sorted(r.number for r in got) == list(range(1, len(got) + 1)) and text.startswith("[1] Netflix was founded") and "Sources:\n[1] file: Beginnings" in text
