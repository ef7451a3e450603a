"""Collections, notes, entities and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def add_collections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Collections with new ones added; a name that exists stays as it is."""
    return old.unionByName(new.dropDuplicates(["name"]).join(old.select("name"), "name", "left_anti").select(old.columns))


def collection_counts(collections: DataFrame, links: DataFrame) -> DataFrame:
    n = links.groupBy("collection_id").agg(F.count("*").alias("n_sources"))
    return collections.join(n, collections["id"] == n["collection_id"], "left").select("name", "description", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def matching(sources: DataFrame, query: str) -> DataFrame:
    """Sources of which title, location or text contains some token of query."""
    spark = sources.sparkSession
    terms = [r[0] for r in spark.range(1).select(F.explode(X.tokens(F.lit(query)))).collect()]  # the tokens of one phrase
    blob = F.lower(F.concat_ws(" ", "title", "location", "text"))
    return sources.where(X.any_of(blob, sorted(set(terms))) if terms else F.lit(False))


def attach(links: DataFrame, sources: DataFrame, query: str, collection_id: int) -> DataFrame:
    new = matching(sources, query).select(F.col("id").alias("source_id"), F.lit(collection_id).cast("long").alias("collection_id"))
    return links.select("source_id", "collection_id").unionByName(new).distinct()


def add_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes with new ones; a blank title gets a name, a blank body is refused."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ok = new.where(t("body") != "").withColumn("title", F.coalesce(F.nullif(t("title"), F.lit("")), F.lit("Untitled note"))).withColumn("body", t("body"))
    return old.unionByName(ok.select(old.columns))


def hit_count(blob, query):  # noqa: ANN001, ANN201
    """Occurrences of the query's tokens, a repeated token counted again."""
    return F.aggregate(X.tokens(query), F.lit(0).cast("long"), lambda acc, t: acc + X.occurrences(blob, t))


def list_notes(notes: DataFrame, collections: DataFrame, limit: int = 20) -> DataFrame:
    c = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    named = notes.join(c, "collection_id", "left").withColumn("collection", F.coalesce("collection", F.lit("unassigned")))
    return named.orderBy(F.col("updated_at").desc(), "id").limit(limit).select("id", "title", "collection", X.preview(F.col("body"), 160).alias("preview"))


def search_notes(notes: DataFrame, collections: DataFrame, query: str, limit: int = 10) -> DataFrame:
    c = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    blob = F.lower(F.concat("title", F.lit(" "), "body"))
    scored = notes.withColumn("score", hit_count(blob, F.lit(query))).where("score > 0")
    top = scored.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "id").limit(limit)
    return top.join(c, "collection_id", "left").select("id", "title", "score", F.coalesce("collection", F.lit("unassigned")).alias("collection"), X.preview(F.col("body"), 220).alias("preview"))


def entity_links(sources: DataFrame, max_sources: int | None = None) -> DataFrame:
    """(source_id, name, weight): the entities of each source, of the latest max_sources if given."""
    if max_sources is not None:
        sources = sources.orderBy(F.col("indexed_at").desc(), "id").limit(max_sources)
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return sources.select(F.col("id").alias("source_id"), F.explode(X.entities(blob)).alias("name")).withColumn("weight", F.lit(1))


def entities(old: DataFrame, links: DataFrame) -> DataFrame:
    """Known entities, of which none is ever dropped."""
    return old.select("name").unionByName(links.select("name")).distinct().withColumn("id", F.xxhash64("name")).withColumn("entity_type", F.lit("concept"))


def top_entities(links: DataFrame, limit: int = 25) -> DataFrame:
    return links.groupBy("name").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "name").limit(limit)


def report(sources: DataFrame, collections: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts."""
    s = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("source_type") == "file").alias("files"), F.count_if(F.col("source_type") == "web").alias("pages"))
    c = collections.agg(F.count("*").alias("collections"))
    n = notes.agg(F.count("*").alias("notes"))
    e = links.agg(F.countDistinct("name").alias("entities"), F.count("*").alias("mentions"))
    return s.crossJoin(c).crossJoin(n).crossJoin(e)


def timeline(sources: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The first limit sources that mention query, by time, with how many more there are."""
    blob = F.lower(F.concat_ws(" ", "title", "location", "text"))
    found = sources.select("id", "source_type", "location", F.coalesce(F.nullif("title", F.lit("")), "location").alias("label"), "indexed_at", hit_count(blob, F.lit(query)).alias("score")).where("score > 0")
    more = found.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("not_shown"))
    return found.orderBy("indexed_at", F.col("score").desc(), "id").limit(limit).crossJoin(more)


def recent_topics(turns: DataFrame, limit: int = 6) -> DataFrame:
    """(conv_id, topic, place): distinct compressed turns among the latest limit of each conversation, latest first."""
    kept = turns.withColumn("content", X.compress(X.clean_input(F.col("text")))).where("content <> ''")
    w = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = kept.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).withColumn("topic", X.preview(F.col("content"), 120))
    first = last.groupBy("conv_id", "topic").agg(F.min("rn").alias("rn"))
    return first.select("conv_id", "topic", F.row_number().over(W.partitionBy("conv_id").orderBy("rn")).alias("place"))


def diagnostics(lines: DataFrame, limit: int = 5) -> DataFrame:
    """The first distinct lines that warn, skip or fail: of (pos, line)."""
    t = F.trim("line")
    some = lines.select("pos", t.alias("line")).where(X.any_of(F.col("line"), ["WARN", "SKIP", "ERROR"]))
    return some.groupBy("line").agg(F.min("pos").alias("pos")).orderBy("pos").limit(limit)
