"""Answers put together from sentences of ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab as V

MAX_SOURCES, MAX_SENTENCES, PER_SOURCE = 6, 10, 3


def modes(query: Column) -> dict[str, Column]:
    q = F.coalesce(query, F.lit(""))
    return {
        "quantity": F.arrays_overlap(X.tokens(q), X.strings(V.QUANTITY_WORDS)),
        "comparison": q.rlike(X.COMPARISON_QUERY),
        "reason": q.rlike(X.REASON_QUERY),
    }


def sentence_score(sentence: Column, terms: Column, quantity: Column, comparison: Column, reason: Column) -> Column:
    """Query words in the sentence, plus their share of it, plus what the question's mode looks for."""
    words = X.tokens(sentence)
    overlap = F.size(F.filter(words, lambda t: F.array_contains(terms, t)))
    number = F.when(sentence.rlike(X.QUANTITY), 10.0).when(sentence.rlike("[0-9]"), 3.0).otherwise(0.0)
    extra = F.when(quantity, number).otherwise(0.0) + F.when(comparison & sentence.rlike(X.COMPARISON), 8.0).otherwise(0.0) + F.when(reason & sentence.rlike(X.REASON), 8.0).otherwise(0.0)
    return F.when(overlap > 0, overlap + overlap / F.size(words) + extra).otherwise(0.0)


def sentences(hits: DataFrame) -> DataFrame:
    """(query_id, rank, id, position, sentence, score) of hits' sentences that score: hits have query, text and rank."""
    m = modes(F.col("query"))
    top = hits.where(F.col("rank") <= MAX_SOURCES).withColumns(m).withColumn("terms", F.array_distinct(X.tokens(F.col("query"))))
    rows = top.select("query_id", "rank", "id", "source_type", "title", "location", "quantity", "comparison", "reason", "terms", F.posexplode(X.sentences(F.col("text"))).alias("position", "sentence"))
    s = sentence_score(F.col("sentence"), F.col("terms"), F.col("quantity"), F.col("comparison"), F.col("reason"))
    return rows.withColumn("score", F.round(s, 6)).where("score > 0").drop("terms")


def chosen(hits: DataFrame) -> DataFrame:
    """The best sentences of each question, first of equal keys, those that carry the wanted signal in front."""
    scored = sentences(hits).withColumn("key", X.sentence_key(F.col("sentence"))).where("key <> ''")
    order = [F.col("score").desc(), F.col("rank"), F.col("position")]
    first = scored.withColumn("same", F.row_number().over(W.partitionBy("query_id", "key").orderBy(*order))).where("same = 1")
    best = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= MAX_SENTENCES)
    s = F.col("sentence")
    signal = F.when(F.col("quantity"), s.rlike(X.QUANTITY)).when(F.col("comparison"), s.rlike(X.COMPARISON)).when(F.col("reason"), s.rlike(X.REASON)).otherwise(F.lit(True))
    lead = W.partitionBy("query_id").orderBy(F.when(signal, 0).otherwise(1), "place")
    return best.withColumn("place", F.row_number().over(lead)).select("query_id", "place", "rank", "id", "position", "sentence", "score", "source_type", "title", "location")


def paragraphs(hits: DataFrame) -> DataFrame:
    """(query_id, number, id, paragraph, label): at most three sentences a source, sources numbered as they appear."""
    best = chosen(hits).withColumn("first", F.min("place").over(W.partitionBy("query_id", "id"))).withColumn("nth", F.row_number().over(W.partitionBy("query_id", "id").orderBy("place")))
    best = best.withColumn("number", F.dense_rank().over(W.partitionBy("query_id").orderBy("first"))).where(F.col("nth") <= PER_SOURCE)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", X.display_sentence(F.col("sentence")).alias("s")))), lambda x: x["s"]), " ")
    label = X.source_label(F.first("source_type"), F.first("title"), F.first("location"))
    return best.groupBy("query_id", "number", "id").agg(text.alias("paragraph"), label.alias("label"))


def render(rows: list) -> str:
    """One question's paragraphs and source list as text."""
    rows = sorted(rows, key=lambda r: r["number"])
    lines = [f"[{r['number']}] {r['paragraph']}\n" for r in rows] + ["Sources:"] + [f"[{r['number']}] {r['label']}" for r in rows]
    return "\n".join(lines)
