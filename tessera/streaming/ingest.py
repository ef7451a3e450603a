"""Continuous ingestion: files that land in a folder become sources, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as N
from ..sources.warehouse import Warehouse

LANDED = "source_type string, location string, title string, text string, size_bytes long, extension string, indexed_at timestamp"


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_content(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows whose content was not seen within the watermark; older state is dropped, so it stays bounded."""
    hashed = stream.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withWatermark("indexed_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def apply_batch(warehouse: Warehouse, batch: DataFrame, batch_id: int) -> None:
    """Upsert one batch and its postings. Applying it again changes nothing, so a restart is safe."""
    rows = batch.withColumn("batch", F.lit(1)).withColumn("position", F.unix_micros("indexed_at")).drop("content_hash")
    new = N.upsert(rows).withColumn("id", F.xxhash64("source_key")).withColumn("content_hash", F.sha2("text", 256)).withColumn("indexed_at", F.unix_seconds("indexed_at")).drop("batch", "position")
    old, held = warehouse.read("sources"), warehouse.read("postings")
    warehouse.write("sources", old.join(new.select("source_key"), "source_key", "left_anti").select(new.columns).unionByName(new))
    warehouse.write("postings", N.replace_postings(held, new))


def start(spark: SparkSession, folder: str, warehouse: Warehouse, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = distinct_content(landed(spark, folder)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: apply_batch(warehouse, b, i))
    return (writer.trigger(availableNow=True) if once else writer).start()
