"""The engine behind one object: import, ask, research, notes, collections, reports."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls as U
from .operators import answer as A
from .operators import index as N
from .operators import search as S
from .operators import vault as VA
from .operators import web as WB
from .sources import formats as FM
from .sources import providers as PR
from .sources.tables import source_key
from .sources.warehouse import Warehouse

NOTHING = "Nothing that is indexed answers this yet."
NO_PASSAGE = "There are related sources, but no passage in them answers this."


@dataclass
class Settings:
    auto_web_research: bool = False
    search_collections: bool = True
    search_local_files: bool = True
    search_notes: bool = True

    @classmethod
    def load(cls, raw: str | None) -> Settings:
        """From JSON; unknown keys and values that are no booleans are ignored."""
        try:
            given = json.loads(raw or "{}")
        except ValueError:
            given = {}
        given = given if isinstance(given, dict) else {}
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__ and isinstance(v, bool)})

    def dump(self) -> str:
        return json.dumps(self.__dict__, indent=2, sort_keys=True)

    def toggle(self, name: str) -> bool:
        setattr(self, name, not getattr(self, name))
        return getattr(self, name)


@dataclass
class Service:
    spark: SparkSession
    root: str
    providers: list[PR.Provider] = field(default_factory=list)
    replies: DataFrame | None = None  # (url, content_type, body), the pages that research may fetch
    rules: DataFrame | None = None  # (site_root, rule_order, path_prefix, allow)
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        self.store = Warehouse(self.spark, self.root)
        self.diagnostics: list[str] = []
        held = self.store.read("sources")
        left = N.purge(held)
        if not held.join(left.select("id"), "id", "left_anti").isEmpty():
            self._replace(left)

    def _replace(self, sources: DataFrame) -> None:
        self.store.write("sources", sources)
        self.store.write("postings", self.store.read("postings").join(self.store.read("sources").select("id"), "id", "left_semi"))

    def add(self, batch: DataFrame) -> int:
        """Upsert (source_type, location, title, text, size_bytes, extension); how many rows were written."""
        rows = batch.withColumns({"batch": F.lit(1), "position": F.monotonically_increasing_id()})
        new = N.upsert(rows).withColumns({"id": F.xxhash64("source_key"), "content_hash": F.sha2("text", 256), "indexed_at": F.lit(int(time.time())).cast("long")}).drop("batch", "position")
        old, held = self.store.read("sources"), self.store.read("postings")
        self.store.write("sources", old.join(new.select("source_key"), "source_key", "left_anti").select(new.columns).unionByName(new))
        self.store.write("postings", N.replace_postings(held, new))
        return new.count()

    def import_paths(self, paths: list[str]) -> int:
        files = FM.discover(self.spark, paths)
        got = FM.extract(files)
        self.diagnostics = [f"ERROR {r.path}: {r.error}" for r in got.where("error IS NOT NULL").limit(5).collect()]
        named = got.where("text IS NOT NULL").join(files.select("path", "length"), "path")
        return self.add(named.select(F.lit("file").alias("source_type"), F.col("path").alias("location"), FM.file_name(F.col("path")).alias("title"), "text", F.col("length").alias("size_bytes"), F.concat(F.lit("."), "extension").alias("extension")))

    def counts(self) -> tuple[int, int, int]:
        return tuple(N.counts(self.store.read("sources")).first())

    def search(self, query: str, limit: int = S.LIMIT, source_type: str | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(1, query)], "query_id long, query string")
        return S.search(self.store.read("sources"), q, limit, source_type)

    def research(self, query: str, limit: int = 5, depth: int = 0) -> int:
        """Search both phrasings, drop junk, rank, crawl the best and index what is new; how many pages were."""
        one = self.spark.createDataFrame([(query,)], "q string")
        natural, bare, topics = one.select(X.clean_query(F.col("q")), X.keyword_form(F.col("q")), F.array_union(X.topic_terms(X.clean_query(F.col("q"))), X.topic_terms(X.keyword_form(F.col("q"))))).first()
        urls = PR.waterfall(self.providers, natural, limit)
        if bare and bare != natural:
            urls += PR.waterfall(self.providers, bare, limit)
        if not urls or self.replies is None:
            self.diagnostics = ["WARN no usable results"]
            return 0
        rows = self.spark.createDataFrame([(1, query, i, u) for i, u in enumerate(urls)], "query_id long, query string, position int, url string").where(~U.is_junk(F.col("url"), X.strings(topics)))
        best = WB.rank_urls(rows).where(F.col("place") <= limit).select("url", F.col("place").alias("position"))
        if self.rules is not None:
            best = WB.allowed(best, self.rules).where("allowed").drop("allowed")
        pages, stats = WB.crawl(PR.fetched(self.replies), best, self.store.read("sources"), limit, depth, topics)
        s = stats.first()
        self.diagnostics = [f"SKIP {s.skipped_duplicates} duplicates"] * bool(s.skipped_duplicates) + [f"WARN {s.errors} errors"] * bool(s.errors)
        return self.add(pages.select(F.lit("web").alias("source_type"), F.col("url").alias("location"), "title", "text", F.octet_length("text").cast("long").alias("size_bytes"), F.lit(".html").alias("extension")))

    def ask(self, query: str, limit: int = S.LIMIT, force_web: bool | None = None) -> str:
        """An answer from ranked sources. The web is searched first if forced, by default as the settings say."""
        cleaned = self.spark.createDataFrame([(query,)], "q string").select(X.clean_input(F.col("q"))).first()[0]
        web = self.settings.auto_web_research if force_web is None else force_web
        if web:
            self.research(cleaned)
        hits = self.search(cleaned, limit)
        rows = A.paragraphs(hits).collect()  # of one question, at most ten
        text = A.render(rows) if rows else NO_PASSAGE if not hits.isEmpty() else NOTHING
        self.remember(cleaned, text)
        return text

    def remember(self, query: str, text: str, conv_id: int = 1) -> None:
        old = self.store.read("memory")
        n = old.where(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0]
        self.store.write("memory", old.unionByName(self.spark.createDataFrame([(conv_id, n + 1, "user", query), (conv_id, n + 2, "assistant", text)], old.schema)))

    def recent_topics(self, limit: int = 6) -> list[str]:
        return [r.topic for r in VA.recent_topics(self.store.read("memory"), limit).where("conv_id = 1").orderBy("place").collect()]

    def add_note(self, title: str, body: str, collection_id: int | None = None) -> None:
        now, old = int(time.time()), self.store.read("notes")
        key = old.count() + 1
        self.store.write("notes", VA.add_notes(old, self.spark.createDataFrame([(key, title, body, collection_id, now, now)], old.schema)))

    def search_notes(self, query: str, limit: int = 10) -> DataFrame:
        return VA.search_notes(self.store.read("notes"), self.store.read("collections"), query, limit)

    def add_collection(self, name: str, description: str = "") -> None:
        old = self.store.read("collections")
        new = self.spark.createDataFrame([(0, name, description, int(time.time()))], old.schema).withColumn("id", F.xxhash64("name"))
        self.store.write("collections", VA.add_collections(old, new))

    def attach(self, name: str, query: str) -> int:
        """Attach sources that match query to a collection; how many match."""
        key = self.store.read("collections").where(F.col("name") == name).select("id").first()
        if key is None:
            return 0
        sources = self.store.read("sources")
        self.store.write("source_collections", VA.attach(self.store.read("source_collections"), sources, query, key[0]))
        return VA.matching(sources, query).count()

    def rebuild_entities(self, max_sources: int = 5000) -> int:
        links = VA.entity_links(self.store.read("sources"), max_sources)
        self.store.write("source_entities", links)
        links = self.store.read("source_entities")
        self.store.write("entities", VA.entities(self.store.read("entities"), links))
        return links.count()

    def report(self) -> DataFrame:
        return VA.report(self.store.read("sources"), self.store.read("collections"), self.store.read("notes"), self.store.read("source_entities"))

    def timeline(self, query: str, limit: int = 30) -> DataFrame:
        return VA.timeline(self.store.read("sources"), query, limit)

    def clear(self) -> None:
        self.store.clear("sources", "postings", "source_collections", "source_entities")

    @staticmethod
    def key(source_type: str, location: str):  # noqa: ANN205
        return source_key(F.lit(source_type), F.lit(location))
