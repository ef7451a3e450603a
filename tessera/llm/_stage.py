"""Intermediate tables in the folder that all executors share, and joins whose broadcast side is counted first."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slim (one or two longs) table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 4_000_000

BATCH_BYTES = 8 << 20
#: Spark's own setting, read when a write is planned: remove its shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; what lies in the shared folder is then its owner's to sweep
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back: lineage ends here and survives a lost executor.

    Once the table is written nothing reads the shuffle files that it was made from, so Spark removes them.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if root not in _made:
        _made.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    held = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if held is None else spark.conf.set(CLEAN, held)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        _drop(df.sparkSession, os.path.dirname(name))


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, for the session: they are held several times over, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(name)).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def counted(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """side with a broadcast hint if it has few enough rows; otherwise as it is, and the join shuffles both sides."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name += "_"
    return name
