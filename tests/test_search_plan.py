from __future__ import annotations

from tessera.operators import search as S
from tessera.plans import catalogue
from test_golden import CASES, sources


def test_matches_are_summed_in_parts_that_grow_in_number_only(spark, monkeypatch):
    """No exchange by question, whose partitions would grow with the table; the same scores from many parts."""
    monkeypatch.setattr(S, "FEW_QUESTIONS", 0)
    table = sources(spark, [c for case in CASES for c in case[3]])
    asked = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "query_id long, query string")
    found = S.scores(table, asked)
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().sparkPlan().toString()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(query_id#" not in plan.split("hashpartitioning(id")[0]
    want = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(S, "MATCHES", 2)
    assert S.parts(table, len(CASES)) == table.count() * len(CASES) // 2
    assert want and sorted(map(tuple, S.scores(table, asked).collect())) == want


def test_pages_are_extracted_once_before_the_pool(spark):
    """The text of a page is a long chain of patterns: not again for the filter, the count of sources, or all texts."""
    plan = catalogue.queries()["search_by_type"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # once in each of the three branches (df, sums, count) that share an exchange, twice over, and once for the pool
    lines = [x for x in plan.splitlines() if "<!--" in x]
    assert lines and all("Filter" not in x for x in lines) and max(x.count("<!--") for x in lines) == 1
