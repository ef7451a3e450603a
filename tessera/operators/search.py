"""Ranked search, for many questions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as X
from ..functions import vocab as V
from .index import document_frequency, occurrences

LIMIT, LIGHT, FLOOR = 8, 0.15, 0.15
INTENT_WEIGHT, LEAST_FACTOR, MOST_FACTOR, INTENT_CHARS = 0.30, 0.40, 1.90, 2000
#: Questions that are broadcast; a larger batch is joined by shuffling.
BROADCAST_QUESTIONS = 200_000
#: Matches of a source and a question in a task, at most and about; batches of at most FEW_QUESTIONS are left to Spark.
MATCHES, FEW_QUESTIONS = 500_000, 16
#: Stands for the source itself among its terms: no token is empty.
MARK = ""


def query_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, weight, meaningful, total) of distinct terms; total counts a question's meaningful ones."""
    terms = questions.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term"))
    light = F.col("term").isin(V.RANK_STOPWORDS)
    w = W.partitionBy("query_id")
    return terms.withColumn("weight", F.when(light, LIGHT).otherwise(1.0)).withColumn("meaningful", F.when(light, 0).otherwise(1)).withColumn("total", F.sum("meaningful").over(w))


def few(questions: DataFrame) -> int:
    """How many questions there are, up to one more than may be broadcast."""
    return questions.limit(BROADCAST_QUESTIONS + 1).count()


def small(side: DataFrame, rows: int) -> DataFrame:
    """side with a broadcast hint if it has at most so many rows; beyond it joins shuffle."""
    return F.broadcast(side) if rows <= BROADCAST_QUESTIONS else side


def parts(sources: DataFrame, n_questions: int) -> int | None:
    """Into how many parts sources are cut by id, so that a task's matches don't grow with the tables."""
    if n_questions <= FEW_QUESTIONS:
        return None
    return max(sources.sparkSession.sparkContext.defaultParallelism, -(-sources.count() * n_questions // MATCHES))


def scores(sources: DataFrame, questions: DataFrame, n_questions: int | None = None) -> DataFrame:
    """(query_id, id, base, matched, total, score) of each match, without intent.

    Only tokens that some question asks for pass the explode; text goes no further. They are shuffled once, by id: the
    counts of terms and the sums of questions are then made within a part, and sources are read and counted in one pass.
    """
    n_questions = few(questions) if n_questions is None else n_questions
    terms = query_terms(questions)
    asked = terms.select("term").unionByName(sources.sparkSession.createDataFrame([(MARK,)], "term string")).distinct()
    of = occurrences(sources, MARK).join(small(asked, n_questions), "term", "left_semi")
    k = parts(sources, n_questions)
    held = (of.repartition("id") if k is None else of.repartition(k, "id")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    df = document_frequency(held)
    # not a filter, which would be pushed below the exchange and have the texts read again
    n = df.agg(F.max(F.when(F.col("term") == MARK, F.col("df"))).alias("n"))
    weighed = small(terms.join(df, "term").crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0).select("query_id", "term", "weight", "meaningful", "total", "idf"), n_questions)
    part = F.col("weight") * (1.0 + F.log("tf")) * F.col("idf")
    found = held.join(weighed, "term").groupBy("query_id", "id", "total").agg(F.sum(part).alias("base"), F.sum("meaningful").alias("matched"))
    cover = F.when(F.col("total") > 0, FLOOR + (1 - FLOOR) * F.col("matched") / F.col("total")).otherwise(1.0)
    return found.select("query_id", "id", F.round("base", 6).alias("base"), "matched", "total", F.round(F.col("base") * cover, 6).alias("score"))


def ranked(found: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search(sources: DataFrame, questions: DataFrame, limit: int = LIMIT, source_type: str | None = None, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best limit sources of each question, with intent applied to a pool of 5 * limit + 10.

    questions: (query_id, query). Text is joined to the pool alone. of: the sources of a table of ids, for sources that
    are extracted at each reading; those outside the pool are then extracted once.
    """
    if source_type is not None:
        sources = sources.where(F.col("source_type") == source_type)
    n, size = few(questions), 5 * max(0, limit) + 10
    pool = ranked(scores(sources, questions, n), size).drop("rank")
    kinds = questions.select("query_id", "query", I.detect(F.col("query")).alias("intent"))
    # a small pool goes to the texts, not the texts to the pool
    if of is not None:
        sources = of(small(pool.select("id").distinct(), n * size))
        sources = sources if source_type is None else sources.where(F.col("source_type") == source_type)
    near = sources.join(small(pool.join(small(kinds, n), "query_id"), n * size), "id")
    name = F.coalesce(F.nullif("title", F.lit("")), "location")
    hay = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif("location", F.lit("")), F.nullif(F.substring("text", 1, INTENT_CHARS), F.lit("")))
    topic = F.array_except(X.tokens(F.col("query")), X.strings(V.RANK_STOPWORDS))
    verdict = I.score(F.col("hay"), F.col("intent"), F.col("query"), topic)
    general = F.col("intent") == V.GENERAL
    judged = near.withColumn("hay", hay).withColumn("verdict", verdict).select("*", "verdict.*").drop("verdict")
    factor = F.greatest(F.lit(LEAST_FACTOR), F.least(F.lit(MOST_FACTOR), 1.0 + F.col("delta") * INTENT_WEIGHT))
    none = F.array().cast("array<string>")
    final = judged.withColumn("score", F.round(F.when(general, F.col("score")).otherwise(F.col("score") * factor), 6)).withColumn("boosts", F.when(general, none).otherwise(F.col("boosts"))).withColumn("penalties", F.when(general, none).otherwise(F.col("penalties")))
    return ranked(final, limit).select("query_id", "query", "rank", "id", "score", "source_type", "location", "title", "text", "extension", "size_bytes", "indexed_at", "intent", "boosts", "penalties")
