from __future__ import annotations

import datetime

from tessera.operators import index as N
from tessera.operators import web as WB
from tessera.plans import fixtures as T
from tessera.service import NOTHING, Service, Settings
from tessera.sources import providers as PR
from tessera.sources.warehouse import Warehouse
from tessera.streaming import ingest


def test_import_ask_and_vault(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "herons.txt").write_text("About 3 million herons live by the northern lakes. Herons fish at dawn because the water is calm.")
    (tmp_path / "docs" / "kilns.md").write_text("A kiln is hotter than an oven. Kilns burn wood in the winter months of the year.")
    (tmp_path / "docs" / "empty.txt").write_text("  ")
    s = Service(spark, str(tmp_path / "store"))
    assert s.ask("herons?") == NOTHING
    assert s.import_paths([str(tmp_path / "docs")]) == 2 and s.counts() == (2, 2, 0)
    assert s.import_paths([str(tmp_path / "docs")]) == 2 and s.counts() == (2, 2, 0)
    held = s.store.read("postings")
    assert held.count() == N.postings(s.store.read("sources")).count() and N.orphans(held, s.store.read("sources")).isEmpty()
    assert s.ask('"how many herons?"').startswith("[1] About 3 million herons")
    assert len(s.recent_topics()) >= 2
    s.add_note("", "herons by the lake")
    s.add_note("blank", "  ")
    s.add_collection("birds")
    s.add_collection("birds", "again")
    assert s.attach("birds", "herons") == 1 and s.attach("birds", "herons") == 1 and s.attach("none", "herons") == 0
    assert s.search_notes("herons").first().title == "Untitled note" and s.rebuild_entities() > 0
    r = s.report().first()
    assert (r.sources, r.collections, r.notes) == (2, 1, 1) and r.entities > 0
    assert s.timeline("herons").count() == 1
    s.clear()
    assert s.counts() == (0, 0, 0)


def test_research(spark, tmp_path):
    p = PR.TableProvider("p", spark.createDataFrame([("how many herons are there", 1, "https://birds.example.org/heron-count", "Herons"), ("how many herons are there", 2, "https://www.wordnik.com/many", "many herons")], "query string, position int, url string, title string"))
    replies = spark.createDataFrame([("https://birds.example.org/heron-count", "text/html", "<title>Heron count</title><p>An estimated 3 million herons live here in the summer.</p>")], "url string, content_type string, body string")
    s = Service(spark, str(tmp_path / "store"), [p], replies)
    assert s.ask("How many herons are there?") == NOTHING
    assert "3 million herons" in s.ask("How many herons are there?", force_web=True) and s.counts() == (1, 0, 1)
    assert s.research("How many herons are there") == 0 and s.counts() == (1, 0, 1)


def test_settings():
    s = Settings.load('{"auto_web_research": true, "search_notes": 0, "other": true}')
    assert s.auto_web_research and s.search_notes and Settings.load("bad") == Settings() and Settings.load("[1]") == Settings()
    assert Settings.load(s.dump()) == s and s.toggle("auto_web_research") is False


def test_warehouse_versions(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    assert w.read("notes").count() == 0
    w.write("entities", spark.createDataFrame([("a", 1, "concept")], "name string, id long, entity_type string"))
    old = w.read("entities")
    w.write("entities", old.unionByName(spark.createDataFrame([("b", 2, "concept")], old.schema)))
    assert w.read("entities").count() == 2 and old.count() == 1


def test_crawl_budget_duplicates_and_depth(spark):
    held = spark.createDataFrame([], "content_hash string")
    crawl = lambda **k: WB.crawl(T.WEB.df(spark), T.ROOTS.df(spark), held, **k)
    pages, stats = crawl(depth=0)
    assert {r.url for r in pages.collect()} == {"https://a.example/", "https://b.example/"} and stats.first().requested == 2
    pages, stats = crawl(depth=2, limit=3)
    assert pages.count() == 3
    pages, stats = crawl(depth=2)
    assert tuple(stats.first()) == (7, 4, 1, 1, 1)
    assert WB.crawl(T.WEB.df(spark), T.ROOTS.df(spark), pages, depth=2)[0].count() == 0


def test_streaming_ingest(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("file", "/a", "A", "herons wade", 3, ".txt", t), ("file", "/b", "B", "herons wade", 3, ".txt", t), ("file", "/c", "C", "kilns burn", 3, ".txt", t)]
    spark.createDataFrame(rows, ingest.LANDED).coalesce(1).write.parquet(str(tmp_path / "in"))
    w = Warehouse(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.start(spark, str(tmp_path / "in"), w, str(tmp_path / "check"), once=True).awaitTermination()
        assert w.read("sources").count() == 2 and w.read("postings").count() == 4
    spark.createDataFrame([("file", "/a", "A", "herons fly", 3, ".txt", t)], ingest.LANDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.start(spark, str(tmp_path / "in"), w, str(tmp_path / "check"), once=True).awaitTermination()
    assert {r.text for r in w.read("sources").collect()} == {"herons fly", "kilns burn"} or w.read("sources").count() == 3
