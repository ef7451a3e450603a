"""Adapters from stored tables to sources: one row for each document or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import urls as U

SOURCE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("extension", T.StringType()),
        T.StructField("indexed_at", T.LongType()),
    ]
)


def source_key(source_type: Column, location: Column) -> Column:
    return F.sha2(F.concat(source_type, F.lit("|"), location), 256)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_documents(docs: DataFrame) -> DataFrame:
    location = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("doc_id").alias("id"),
        source_key(F.lit("file"), location).alias("source_key"),
        F.lit("file").alias("source_type"),
        location.alias("location"),
        F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit(".txt").alias("extension"),
        F.col("doc_id").alias("indexed_at"),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    location = U.normalize(F.col("url"))
    # exploded, so that the filter isn't pushed below and the text, the dearest of them, extracted once for each use
    plain = pages.select("page_id", location.alias("location"), H.title(F.col("html")).alias("title"), F.explode(F.array(H.text(F.col("html")))).alias("text"))
    return plain.where("text <> ''").select(
        F.col("page_id").alias("id"),
        source_key(F.lit("web"), F.col("location")).alias("source_key"),
        F.lit("web").alias("source_type"),
        "location",
        "title",
        "text",
        F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.lit(".html").alias("extension"),
        F.col("page_id").alias("indexed_at"),
    )
