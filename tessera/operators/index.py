"""The inverted index: postings, document frequencies, upserts and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..sources.tables import source_key


def occurrences(sources: DataFrame, mark: str | None = None) -> DataFrame:
    """(id, term) for each token of title, location and text, and one of mark for each source."""
    found = X.tokens(F.concat_ws(" ", "title", "location", "text"))
    return sources.select("id", F.explode(found if mark is None else F.concat(found, F.array(F.lit(mark)))).alias("term"))


def postings(sources: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf). With terms, of those alone: tokens are matched before anything is shuffled."""
    found = occurrences(sources)
    if terms is not None:
        found = found.join(terms, "term", "left_semi")
    return found.groupBy("term", "id").agg(F.count("*").alias("tf"))


def document_frequency(table: DataFrame) -> DataFrame:
    return table.groupBy("term").agg(F.count("*").alias("df"))


def write(table: DataFrame, name: str, buckets: int = 64) -> None:
    """Postings as a table bucketed and sorted by term, so that searches read few files and joins need no exchange."""
    table.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)


def counts(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count("*").alias("total"), F.count_if(F.col("source_type") == "file").alias("files"), F.count_if(F.col("source_type") == "web").alias("web"))


def duplicates(sources: DataFrame) -> DataFrame:
    """(content_hash, n, first_id) of contents held more than once."""
    return sources.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def new_content(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of incoming whose content is not held yet, whatever its type."""
    return incoming.join(sources.select("content_hash").distinct(), "content_hash", "left_anti")


def cleaned(batch: DataFrame) -> DataFrame:
    """Trimmed input rows with their key; rows of blank text are not written, those of blank type or location are errors."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    b = batch.withColumns({c: t(c) for c in ("source_type", "location", "title", "text")}).withColumn("extension", F.lower(t("extension"))).withColumn("size_bytes", F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0)))
    return b.where("text <> ''").withColumn("error", F.when((F.col("source_type") == "") | (F.col("location") == ""), "blank type or location")).withColumn("source_key", source_key(F.col("source_type"), F.col("location")))


def upsert(batches: DataFrame) -> DataFrame:
    """The latest row of each source: of rows with a batch number and its position. Errors are left out."""
    w = W.partitionBy("source_key").orderBy(F.col("batch").desc(), F.col("position").desc())
    return cleaned(batches).where("error IS NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "error")


def replace_postings(old: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of changed sources replaced."""
    return old.join(changed.select("id").distinct(), "id", "left_anti").unionByName(postings(changed))


def purge(sources: DataFrame) -> DataFrame:
    """Sources without web pages of blocked hosts or off-topic titles."""
    none = F.array().cast("array<string>")
    return sources.where(~((F.col("source_type") == "web") & U.is_junk(F.col("location"), none)))


def orphans(postings_table: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings whose source is gone."""
    return postings_table.join(sources.select("id"), "id", "left_anti")
