"""Sharding by extendible hashing.

A document's hash is 60 bits of the MD5 of its id. A shard is a prefix of bits. The directory starts at one empty
prefix; a bucket whose bytes exceed the limit, and only that, splits on its next bit. Bytes are summed by the deepest
prefix of a round, and rolled up to find the shallowest prefix that fits; prefixes that are still too large go another
round, STEP bits deeper. Texts are never shuffled.

Defined cases: a bucket that holds one hash only (one document of more than the limit, or rows of one id) stays over
the limit, as no bit divides it. Null and empty texts have 0 bytes. Null ids hash as the word null. Repeated rows are
in the same shard. An empty table has no shard. Other columns are not read. Very long texts count whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import counted, fresh, staged

#: Small, so that streaming readers get many shards; for large files pass 256 MiB.
LIMIT = 2 << 20
BITS = 60
STEP = 12
#: Shards that write_shards() broadcasts.
LISTED = 1_000_000


def bits(doc_id: Column) -> Column:
    """60 bits of the id's MD5 as a string of 0 and 1."""
    return F.lpad(F.bin(number(doc_id)), BITS, "0")


def number(doc_id: Column) -> Column:
    """The same as a number."""
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("long").cast("string"), F.lit("null"))), 1, BITS // 4)
    return F.conv(digest, 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(shard, depth, shard_bytes, shard_docs) of each shard, from (bits, bytes) of the documents.

    A prefix is a leaf if it fits, or can't be divided, while the prefix one bit shorter does not fit and can.
    """
    spark = sizes.sparkSession
    rows = sizes.groupBy("bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    found: list[DataFrame] = []
    open_rows, base = staged(rows, "sizes"), 0
    while True:
        deep = min(base + STEP, BITS)
        cells = open_rows.groupBy(F.substring("bits", 1, deep).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.count("*").alias("keys"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")).select("depth", F.expr("substring(cell, 1, depth)").alias("shard"), "bytes", "docs", "keys")
        nodes = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.sum("keys").alias("keys"))
        nodes = nodes.withColumn("splits", (F.col("bytes") > limit) & (F.col("keys") > 1))
        up = nodes.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("up"))
        with_up = nodes.where("NOT splits").withColumn("up", F.expr("substring(shard, 1, depth - 1)"))
        leaves = with_up.where(F.col("depth") > base).join(up, ["depth", "up"], "left_semi").select("shard", "depth", "bytes", "docs")
        if base == 0:
            leaves = leaves.unionByName(with_up.where("depth = 0").select("shard", "depth", "bytes", "docs"))
        found.append(staged(leaves, "leaves"))
        over = staged(nodes.where((F.col("depth") == deep) & F.col("splits")).select(F.col("shard").alias("cell")), "over")
        if deep == BITS or over.isEmpty():
            break
        open_rows = staged(open_rows.withColumn("cell", F.substring("bits", 1, deep)).join(counted(over), "cell", "left_semi").drop("cell"), "sizes")
        base = deep
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("shard", F.col("depth").cast("long").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))


def assign(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard, depth, n_bytes, shard_bytes, shard_docs) of each document; the shard of depth 0 is ''."""
    i = F.col(doc_id).cast("long")
    slim = staged(docs.select(i.alias("doc_id"), bits(i).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), "shard")
    leaves = staged(directory(slim, limit), "directory")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    table = counted(leaves, 1_000_000)
    # the leaf is the one of a document's prefixes that is in the directory
    prefixes = F.explode(F.array(*[F.substring("bits", 1, int(d)) for d in sorted(depths)]) if depths else F.array(F.lit("")))
    rows = slim.select("doc_id", "bits", "bytes", prefixes.alias("shard")) if len(depths) > 1 else slim.withColumn("shard", F.expr(f"substring(bits, 1, {int(depths[0]) if depths else 0})"))
    return rows.join(table, "shard").select("doc_id", "shard", "depth", F.col("bytes").alias("n_bytes"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> str:
    """docs as Parquet, a folder for each shard, named by the column returned: 'shard', or a fresh name if docs has that.

    The one exchange of texts groups the rows of a shard. A row finds its shard by its id: shards are ranges of hashes,
    in a sorted list that is broadcast if it is of at most LISTED shards; a longer one is joined.
    """
    name = "shard" if "shard" not in map(str.lower, docs.columns) else fresh(docs, "shard")
    i = F.col(doc_id).cast("long")
    sizes = staged(docs.select(bits(i).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), "shard")
    leaves = staged(directory(sizes, limit).select("shard"), "directory")
    if leaves.limit(LISTED + 1).count() <= LISTED:
        shards = sorted(r[0] for r in leaves.collect())
        lows = np.array([int(s.ljust(BITS, "0"), 2) for s in shards], np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((np.array(["p" + s for s in shards], object), lows))

        @F.pandas_udf("string")
        def shard_of(key: pd.Series) -> pd.Series:
            names, at = shared.value
            return pd.Series(names[np.searchsorted(at, key.to_numpy(), side="right") - 1])

        rows = docs.withColumn(name, shard_of(number(i)))
    else:
        key = fresh(docs, "key")
        table = assign(docs, limit, doc_id, text).select(F.col("doc_id").alias(key), F.concat(F.lit("p"), F.col("shard")).alias(name)).distinct()
        rows = docs.join(table, i.eqNullSafe(F.col(key))).drop(key)
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return name


def shard_sizes(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    w = W.partitionBy("shard").orderBy("doc_id")
    return assign(docs, limit, doc_id, text).withColumn("r", F.row_number().over(w)).where("r = 1").select("shard", "depth", "shard_bytes", "shard_docs")
