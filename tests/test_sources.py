from __future__ import annotations

import zipfile
import zlib

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.functions import urls as U
from tessera.plans import fixtures as T
from tessera.sources import formats as FM
from tessera.sources import providers as PR


def put(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)


def test_discover_and_extract(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    (d / "b.CSV").write_text('x,"two\nlines", y\n , ,\n1,2,3\n')
    (d / "c.json").write_text('{"b":1,"a":[2,"é"]}')
    (d / "d.jsonl").write_text('{"b":1,"a":2}\n\nbad\n')
    (d / "e.html").write_text("<p>One</p><script>x</script><p>Two &amp; three</p>")
    (d / "README").write_text("read me")
    (d / "skip.exe").write_text("no")
    put(d / "f.docx", {"word/document.xml": "<w><t>Hello</t><t>docx</t></w>", "other.xml": "<t>no</t>"})
    put(d / "g.pptx", {"ppt/slides/slide2.xml": "<s>second</s>", "ppt/slides/slide1.xml": "<s>first</s>", "ppt/notesSlides/n1.xml": "<s>note</s>"})
    put(d / "h.xlsx", {"xl/worksheets/sheet1.xml": "<s>7</s>", "xl/sharedStrings.xml": "<s>shared</s>"})
    put(d / "i.odt", {"content.xml": "<o>odt text</o>", "meta.xml": "<o>no</o>"})
    (d / "j.pdf").write_bytes(b"%PDF (plain \\(x\\)) stream\n" + zlib.compress(b"BT (packed) Tj ET") + b"\nendstream")
    (d / "k.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in FM.extract(FM.discover(spark, [str(tmp_path / "in")])).collect()}
    assert set(got) == {"a.txt", "b.CSV", "c.json", "d.jsonl", "e.html", "README", "f.docx", "g.pptx", "h.xlsx", "i.odt", "j.pdf", "k.docx"}
    assert got["a.txt"].text == "café � end" and got["b.CSV"].text == "x | two\nlines | y\n1 | 2 | 3"
    assert got["c.json"].text == '{\n  "a": [\n    2,\n    "é"\n  ],\n  "b": 1\n}' and got["d.jsonl"].text == '{\n  "a": 2,\n  "b": 1\n}\nbad'
    assert got["e.html"].text == "One\nTwo & three" and got["README"].text == "read me"
    assert got["f.docx"].text == "Hello\ndocx" and got["g.pptx"].text == "note\nfirst\nsecond" and got["h.xlsx"].text == "shared\n7" and got["i.odt"].text == "odt text"
    assert got["j.pdf"].text == "plain (x) packed" and got["k.docx"].text is None and "BadZipFile" in got["k.docx"].error


def test_pattern_and_parser_agree_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = pages.select(H.text(F.col("html")).alias("a"), H.exact_text(F.col("html")).alias("b")).collect()
    assert sum(r.a == r.b for r in got) / len(got) > 0.95


def test_self_closing_skipped_tag_does_not_swallow_the_page(spark):
    df = spark.createDataFrame([("<p>a</p><svg/><p>b</p>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(H.text(F.col("h"))).collect()] == ["a\nb", "", ""]


def test_redirects_and_result_urls(spark):
    got = {r.id: r.url for r in T.REDIRECTS.df(spark).select("id", U.unwrap_second(U.unwrap_first(F.col("href"))).alias("url")).collect()}
    assert got[1] == "https://example.org/a?b=1" and got[2] == "https://example.org/twice" and got[5] == "https://example.org/deep/page?x=1"
    assert all(got[i] == T.REDIRECTS.rows[i - 1][1] for i in (3, 4, 6, 7, 8, 9))
    got = {r.id: r.url for r in T.RESULTS_RAW.df(spark).select("id", U.result_url(F.col("href"), F.lit("https://en.wikipedia.org/w/index")).alias("url")).collect()}
    assert got == {1: "https://example.org/a?k=2", 2: None, 3: "https://en.wikipedia.org/wiki/Loom", 4: None, 5: "https://example.org/b", 6: None, 7: None, 8: None, 9: None, 10: "https://en.wikipedia.org/up?q=1", 11: None}


def test_links_are_resolved(spark):
    html = '<a href="/x">1</a><a class=k href=\'y?z=1\'>2</a><a href="../up">3</a><a href="#top">4</a><a href="mailto:a@b.c">5</a><a href="/x#f">6</a><a href="//other.org">7</a>'
    got = spark.createDataFrame([(html,)], "h string").select(H.links(F.col("h"), F.lit("https://a.example/d/e/f"))).first()[0]
    assert got == ["https://a.example/x", "https://a.example/d/e/y?z=1", "https://a.example/d/up", "https://a.example/d/e/f", "https://other.org/"]


def test_waterfall_and_replies(spark):
    s = "query string, position int, url string, title string"
    one = PR.TableProvider("one", spark.createDataFrame([("herons count", i, f"https://example.com/{i}", "Flights") for i in range(3)], s))
    two = PR.TableProvider("two", spark.createDataFrame([("herons count", 1, "https://example.org/herons", "Herons"), ("herons count", 2, "https://EXAMPLE.org/herons/", "Again")], s))
    assert PR.waterfall([one, two], "herons  count", 4) == ["https://example.org/herons"]
    assert PR.waterfall([one, two], "herons count", 2)[:2] == ["https://example.com/0", "https://example.com/1"] and PR.waterfall([one], " ", 3) == []
    bodies = spark.createDataFrame([("https://a.org/", "text/html; charset=x", "<title>T</title><p>hi</p>"), ("https://a.org/t", "text/plain", "raw"), ("https://a.org/p", "image/png", "x"), ("https://a.org/n", None, None)], "url string, content_type string, body string")
    got = {r.url: r for r in PR.fetched(bodies).collect()}
    assert got["https://a.org/"].title == "T" and got["https://a.org/t"].text == "raw" and got["https://a.org/p"].error == "unsupported type image/png" and got["https://a.org/n"].error == "no reply"
    reply = spark.createDataFrame([('{"query":{"search":[{"title":"Ada Weaver"},{"title":" "}]}}',), ("bad",)], "p string")
    assert [[tuple(x) for x in r[0]] for r in reply.select(PR.article_results(F.col("p"))).collect()] == [[("https://en.wikipedia.org/wiki/Ada_Weaver", "Ada Weaver")], []]
    page = spark.createDataFrame([('<h2><a href="/r">R one</a></h2><a href="/n">nav</a><a class="result__a" href="/c">C</a>',)], "p string")
    assert [tuple(x) for x in page.select(PR.organic_links("p")).first()[0]] == [("/r", "R one"), ("/c", "C")]
