"""Tables kept as Parquet versions under one folder. A write makes a new version and then moves a pointer to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SOURCE

SCHEMAS = {
    "sources": SOURCE.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", "),
    "postings": "term string, id long, tf long",
    "collections": "id long, name string, description string, created_at long",
    "source_collections": "source_id long, collection_id long",
    "notes": "id long, title string, body string, collection_id long, created_at long, updated_at long",
    "entities": "name string, id long, entity_type string",
    "source_entities": "source_id long, name string, weight int",
    "memory": "conv_id long, turn long, role string, text string",
}


class Warehouse:
    """Readers see the version that the pointer names, whole; a failed write leaves the pointer where it was."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def version(self, name: str) -> str | None:
        """The greatest pointer file's content is its name; older ones are left for readers that began before."""
        folder = self._path(self._pointer(name))
        if not self._fs.exists(folder):
            return None
        marks = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        return marks[-1].split("-", 1)[1] if marks else None

    def read(self, name: str) -> DataFrame:
        v = self.version(name)
        if v is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{v}")

    def write(self, name: str, table: DataFrame, partition_by: str | None = None) -> None:
        v = uuid.uuid4().hex
        writer = table.select(*[c.split(" ")[0] for c in SCHEMAS[name].split(", ")]).write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{v}")
        folder = self._path(self._pointer(name))
        last = max((int(s.getPath().getName().split("-")[0]) for s in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0
        self._fs.create(self._path(f"{self._pointer(name)}/{last + 1:012d}-{v}")).close()

    def clear(self, *names: str) -> None:
        for n in names:
            self.write(n, self.spark.createDataFrame([], SCHEMAS[n]))
