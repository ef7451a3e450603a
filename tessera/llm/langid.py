"""Language identification by Bayesian evidence fusion.

The posterior of a page's language is the product of four pieces of evidence:
1. the likelihood of its text, from byte trigrams hashed to BUCKETS, counted over all labelled documents by language
   and smoothed; its logarithm is divided by TEMPER, as overlapping trigrams are not independent;
2. the language that its markup declares: how often each is declared by pages of each language;
3. its host's prior: the languages of the host's other pages, smoothed by
4. the prior of its address suffix, which is smoothed by that of all pages.
The tables of 2 to 4 are grouped sums over all pages of the posteriors by text alone. The languages are those of the
labelled documents.

Defined cases: a null or empty page has no text evidence, and is decided by the other three. A null or malformed
address has the host and suffix ''. No declaration is a declaration of its own. Null ids are classified; repeated rows
count each for itself. Ties go to the first language by name. Without labelled documents, or pages, the result is
empty. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X
from ._stage import lean, staged

BUCKETS = 1 << 14
TEMPER = 3.0
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 1.0
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts, lower-cased, anything but letters a space; the n + 1 offsets."""
    import pyarrow.compute as pc

    buf, offsets = X.raw(pc.utf8_lower(pc.fill_null(texts, "")))
    b = _LETTER[buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    where = np.arange(len(code))
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(code)]
    # inside one text, and not of two spaces or more
    real = (where + 3 <= end) & ~((b[1:-1] == 32) & ((b[:-2] == 32) | (b[2:] == 32)))
    at = np.flatnonzero(real)
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64), np.searchsorted(at, offsets)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over all labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in X.chunks(batch, "text"):
                grams, first = trigrams(b.column("text"))
                names = b.column("lang").to_pylist()
                for name in set(names):
                    on = np.repeat(np.array([x == name for x in names]), np.diff(first))
                    total[name] = total.get(name, 0) + np.bincount(grams[on], minlength=BUCKETS)
        for name, n in sorted(total.items()):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])

    slim = docs.where(F.col(lang).isNotNull()).select(F.lower(lang).alias("lang"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities (language, bucket), of at most languages x BUCKETS counts."""
    rows = counts(docs, lang, text).toPandas()
    names = sorted(rows["lang"].unique().tolist())
    table = np.full((len(names), BUCKETS), 0.5)
    if len(rows):
        np.add.at(table, (rows["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    return names, np.log(table / table.sum(1, keepdims=True)) if names else table


def likelihoods(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Log likelihoods (text, language), divided by TEMPER and less their greatest."""
    grams, first = trigrams(texts)
    out = np.stack([X.segment_sums(row[grams], first) for row in table], 1) / TEMPER
    return out - out.max(1, keepdims=True)


def text_of(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z]+;|&#[0-9]+;", " ")


def declared(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


RESULT = "page_id long, host string, declared string, lang string, posterior double, text_lang string"


def identify(pages: DataFrame, docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, declared, lang, posterior, text_lang) of each page; text_lang is the language by text alone."""
    lean(pages.sparkSession)
    spark = pages.sparkSession
    names, table = model or train(docs)
    if not names:
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(table)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in X.chunks(batch, "text"):
                like = likelihoods(b.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(k) for k in range(3)] + [pa.array(like.tolist(), pa.list_(pa.float64()))], names=["page_id", "host", "declared", "like"])

    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), host(F.col(url)).alias("host"), declared(F.col(html)).alias("declared"), text_of(F.col(html)).alias("text"))
    seen = staged(slim.mapInArrow(run, "page_id long, host string, declared string, like array<double>"), "pages")
    seen = seen.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    n = len(names)
    like = [F.col("like")[k] for k in range(n)]
    norm = sum((F.exp(x) for x in like[1:]), F.exp(like[0]))
    soft = seen.select("*", *[(F.exp(x) / norm).alias(f"p{k}") for k, x in enumerate(like)])
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in range(n)]
    by_declared = soft.groupBy("declared").agg(*sums)
    kinds = W.partitionBy(F.lit(1))
    # of the pages of each language, the share that declares this
    said = by_declared.select(F.col("declared").alias("declared_of"), *[F.log((F.col(f"s{k}") + DECLARED_WEIGHT / n) / (F.sum(f"s{k}").over(kinds) + DECLARED_WEIGHT * F.count("*").over(kinds) / n)).alias(f"d{k}") for k in range(n)])
    suffixes = soft.groupBy("suffix").agg(*sums, F.count("*").alias("pages"))
    all_pages = [(F.sum(f"s{k}").over(kinds) + 1.0) / (F.sum("pages").over(kinds) + float(n)) for k in range(n)]
    of_suffix = suffixes.select(F.col("suffix").alias("suffix_of"), *[((F.col(f"s{k}") + SUFFIX_WEIGHT * all_pages[k]) / (F.col("pages") + SUFFIX_WEIGHT)).alias(f"x{k}") for k in range(n)])
    of_host = soft.groupBy("host").agg(*[F.sum(f"p{k}").alias(f"h{k}") for k in range(n)], F.count("*").alias("host_pages")).withColumnRenamed("host", "host_of")
    joined = soft.join(of_host, F.col("host") == F.col("host_of")).join(of_suffix, F.col("suffix") == F.col("suffix_of")).join(said, F.col("declared") == F.col("declared_of"))
    # without the page itself
    prior = [F.log((F.greatest(F.col(f"h{k}") - F.col(f"p{k}"), F.lit(0.0)) + HOST_WEIGHT * F.col(f"x{k}")) / (F.col("host_pages") - 1 + HOST_WEIGHT)) for k in range(n)]
    total = joined.select("page_id", "host", "declared", "like", *[(like[k] + F.col(f"d{k}") + prior[k]).alias(f"t{k}") for k in range(n)])
    order = F.array(*[F.struct((-F.round(f"t{k}", 9)).alias("v"), F.lit(names[k]).alias("lang")) for k in range(n)])
    text_order = F.array(*[F.struct((-F.round(like[k], 9)).alias("v"), F.lit(names[k]).alias("lang")) for k in range(n)])
    best = total.withColumn("best", F.array_min(order)).withColumn("top", -F.col("best.v"))
    mass = sum((F.exp(F.col(f"t{k}") - F.col("top")) for k in range(1, n)), F.exp(F.col("t0") - F.col("top")))
    return best.select("page_id", "host", "declared", F.col("best.lang").alias("lang"), F.round(1 / mass, 6).alias("posterior"), F.array_min(text_order)["lang"].alias("text_lang"))
