from __future__ import annotations

import random

from helpers import DOCS, odd_rows, prose, words

from tessera.llm import decontaminate as D
from tessera.llm import queries

ITEMS = "item_id long, text string"


def brute(docs, items, n=8):
    out = []
    gram = {}
    for i, t in items:
        w = words(t)
        if len(w) >= 5:
            s = min(n, len(w))
            for k in range(len(w) - s + 1):
                g = tuple(w[k : k + s])
                gram[g] = min(gram.get(g, i), i)
    sizes = {len(g) for g in gram}
    for d, t in docs:
        w = words(t)
        hits = [(k, s, gram[tuple(w[k : k + s])]) for s in sizes for k in range(len(w) - s + 1) if tuple(w[k : k + s]) in gram]
        if hits:
            gone = {p for k, s, _ in hits for p in range(k, k + s)}
            spans = sum(p - 1 not in gone for p in gone)
            out.append((d, "drop" if len(gone) >= 0.5 * len(w) else "cut", len(w), len(hits), spans, len(gone), min(x[2] for x in hits)))
    return sorted(out)


def test_report_equals_brute_force(spark):
    r = random.Random(1)
    items = [(i, prose(r, r.choice([3, 5, 6, 12, 30]))) for i in range(12)] + [(40, None), (41, "")]
    docs = []
    for i in range(80):
        t = prose(r, r.randint(5, 80))
        if i % 4 == 0:
            t += " " + r.choice(items[:12])[1].upper()
        docs.append((i, t))
    docs += [(90, items[4][1]), (91, "x " + items[3][1] + " y " + items[3][1])]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got)) == brute(docs, items)
    assert len(got) > 5


def test_cut_and_drop(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, "Start here, now. " + passage.title() + "! And the rest of the text stays as it was before.", 9, "k"), (2, passage, 9, "k"), (3, "clean text of some words only", 9, "k")], "doc_id long, text string, hits int, n_chars string")
    out = {r.doc_id: r for r in D.decontaminate(docs, spark.createDataFrame([(1, passage)], ITEMS)).collect()}
    assert set(out) == {1, 3}
    assert out[1].text == "Start here, now. ! And the rest of the text stays as it was before."
    assert out[3].hits == 9 and out[3].n_chars == "k"


def test_parts_of_the_index_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    items = [(i, prose(r, 20)) for i in range(9)]
    docs = [(i, prose(r, 30) + " " + items[i % 9][1]) for i in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    one = sorted(map(tuple, D.report(d, b).collect()))
    monkeypatch.setattr(D, "INDEX_WORDS", 60)
    assert sorted(map(tuple, D.report(d, b).collect())) == one == brute(docs, items)


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    items = spark.createDataFrame([(1, "same row again and again here"), (2, "istanbul ünïcode ßtraße ωmega naïve")], ITEMS)
    got = D.report(docs, items).collect()
    assert sorted((r.doc_id, r.action) for r in got) == [(8, "drop"), (9, "drop"), (9, "drop"), (9, "drop")]
    left = D.decontaminate(docs, items, n_chars="n_chars").collect()
    assert len(left) == len(odd_rows()) - 4
    none = spark.createDataFrame([], DOCS)
    assert D.report(none, items).collect() == [] and D.decontaminate(none, items).collect() == []
    empty = spark.createDataFrame([], ITEMS)
    assert D.report(docs, empty).collect() == [] and D.decontaminate(docs, empty).count() == len(odd_rows())


def test_width_case_accents_and_punctuation_do_not_matter(spark):
    plain = "The naive cafe in the old town was closed on that cold grey morning"
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in plain)
    chinese = "研究人员在实验室里发现了一种新的材料它可以在高温下保持稳定的结构"
    docs = [
        (1, plain),
        (2, plain.replace(" ", "\u00a0")),
        (3, "“" + plain.replace(" ", "” — “") + "”"),
        (4, wide),
        (5, plain.replace("naive", "naïve").replace("cafe", "café").upper()),
        (6, "前面的文字。" + chinese + "。后面还有很多别的文字一直写下去没有任何重复的内容在这里出现过所以这个文档应该被剪切而不是删除掉"),
        (7, "Nothing of it is in here, however long this text may go on."),
    ]
    items = spark.createDataFrame([(1, plain), (2, chinese)], ITEMS)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in D.report(frame, items).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and all(got[i].n_windows == 7 for i in range(1, 6))
    assert got[6].action == "cut" and got[6].first_item == 2 and got[6].words_removed == len(chinese)
    out = {x.doc_id: x.text for x in D.decontaminate(frame, items).collect()}
    assert set(out) == {6, 7} and out[6] == docs[5][1].replace(chinese, "")


def test_cut_text_with_marks():
    text = "a café́ x"
    assert D.cut_text(text, [(1, 2)]) == "a  x" and D.cut_text("café", [(0, 1)]) == ""


def test_a_query_cuts_and_drops(spark, tmp_path):
    r = random.Random(4)
    passage, own = prose(r, 20), [prose(r, 60) for _ in range(3)]
    texts = [own[0], own[1] + " " + passage + " " + own[2], passage]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in queries.QUERIES["op1_decontaminated_documents"](spark, str(tmp_path)).collect()}
    assert set(out) == {0, 1} and out[0].text == texts[0]
    assert words(out[1].text) == words(own[1] + " " + own[2]) and out[1].n_chars == len(out[1].text) and out[1].lang == "en"
    verdicts = {x.doc_id: x.action for x in queries.QUERIES["op1_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert verdicts == {1: "cut", 2: "drop"}
