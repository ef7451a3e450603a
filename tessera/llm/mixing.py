"""Mixing sources to target weights, to the token.

Every document gets a hash-random key. Within each source the keys are range-sorted: a key's leading hex digits name
its range, so the ranges hold about equally many documents whatever the source's size. Token counts are summed by
range, ranges are prefix-summed within their source, and documents within their range; so a source of any size is
spread over the cluster. A source whose budget exceeds its tokens is repeated for whole epochs, and its last epoch is
cut where the budget ends, within a document if need be.

A token is a run of characters other than white space. Budgets are exact: budget * parts / sum of parts, rounded down,
and what that leaves over goes one each to the first sources by name.

Defined cases: documents of null or empty text have no token and are not drawn. A null source is a source of its own.
Repeated rows count each for itself; equal keys are ordered by id, tokens and a hash of the text. A source without
weight, or without tokens, gets nothing, and its share is not given to others. A small source with a large share is
repeated as often as that takes, one row an epoch. An empty table gives an empty result.
Null ids are drawn like others. Very long documents are counted whole. Other columns pass through mix() as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import counted, fresh, staged

SEED = "mix-1"
#: Hex digits of a key that name its range: 4096 ranges in a source.
RANGE_DIGITS = 3
#: Epochs that one array lists; of more, as a tiny source with a large share takes, each block is a row to be spread.
LISTED = 1 << 16


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def _slim(docs: DataFrame, seed: str, doc_id: str, source: str, text: str) -> DataFrame:
    i, s, t = F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(text)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(i.cast("string"), F.lit("null"))))
    return docs.select(F.struct(key.alias("key"), i.alias("id"), tokens(t).alias("n"), F.xxhash64(t).alias("h")).alias("o"), s.alias("source")).where("o.n > 0")


def budgets(slim: DataFrame, parts: dict[str | None, int] | None, budget: int | None) -> DataFrame:
    """(source, total, budget) for each source that has tokens."""
    totals = slim.groupBy("source").agg(F.sum("o.n").alias("total"))
    if parts is None:
        weighed = totals.withColumn("parts", F.lit(1).cast("long"))
    else:
        table = slim.sparkSession.createDataFrame([(k, int(v)) for k, v in parts.items()], "s string, parts long")
        weighed = totals.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("parts > 0")
    every = W.partitionBy(F.lit(1))
    whole = F.sum("total").over(every) if budget is None else F.lit(int(budget)).cast("long")
    all_parts = F.sum("parts").over(every) if parts is None else F.lit(sum(max(0, int(v)) for v in parts.values())).cast("long")
    share = weighed.withColumn("whole", whole).withColumn("all", all_parts).withColumn("share", F.expr("CAST(whole * CAST(parts AS DECIMAL(38,0)) DIV all AS LONG)"))
    share = share.withColumn("left", F.col("whole") - F.sum("share").over(every)).withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_first())))
    exact = F.when(F.sum("parts").over(every) == F.col("all"), F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).otherwise(0)
    return share.select("source", "total", (F.col("share") + exact).alias("budget"))


def plan(docs: DataFrame, parts: dict[str | None, int] | None = None, budget: int | None = None, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, epoch, start, take, n_tokens) of each document drawn: its place in the source's token stream.

    parts are integer weights by source, equal for all sources if not given; budget is in tokens, the corpus's if not given.
    """
    drawn, shares = _drawn(docs, parts, budget, seed, doc_id, source, text)
    full = F.expr("budget DIV total")
    most = (shares.agg(F.max(full)).first()[0] or 0) + 1
    times = drawn.withColumn("epochs", full + F.when(F.col("before") < F.col("budget") - full * F.col("total"), 1).otherwise(0)).where("epochs > 0")
    return (
        _repeated(times, "epochs", "epoch", "block", most)
        .withColumn("start", F.col("before") + F.col("epoch") * F.col("total"))
        .select(F.col("o.id").alias("doc_id"), "source", "epoch", "start", F.least(F.col("o.n"), F.col("budget") - F.col("start")).alias("take"), F.col("o.n").alias("n_tokens"))
    )


def _repeated(rows: DataFrame, times: str, number: str, block: str, most: int) -> DataFrame:
    """Each row as often as its column times says, with a number from 0 on. Where most, the largest of times, is over LISTED, blocks of a row are dealt to all tasks."""
    if most <= LISTED:
        return rows.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    blocks = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) DIV {LISTED} * {LISTED}"), F.lit(LISTED).cast("long"))))
    dealt = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn(number, F.explode(F.sequence(F.col(block), F.least(F.col(block) + LISTED, F.col(times)) - 1))).drop(block)


def _drawn(docs: DataFrame, parts, budget, seed: str, doc_id: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(source, o, before, total, budget), and (source, total, budget): before is the sum of tokens in front of a document in its source."""
    slim = staged(_slim(docs, seed, doc_id, source, text), "mix")
    shares = staged(budgets(slim, parts, budget), "shares")
    r = F.substring("o.key", 1, RANGE_DIGITS)
    ranges = slim.groupBy("source", r.alias("range")).agg(F.sum("o.n").alias("n"))
    ranges = ranges.withColumn("front", F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n"))
    given = shares.select(F.col("source").alias("of"), "total", "budget")
    offsets = ranges.join(given, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("range").alias("r2"), "front", "total", "budget")
    w = W.partitionBy("source", "range").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    sums = slim.withColumn("range", r).withColumn("inside", F.sum("o.n").over(w) - F.col("o.n"))
    placed = sums.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("r2")))
    return placed.select("source", "o", (F.col("front") + F.col("inside")).alias("before"), "total", "budget"), shares


def mix(docs: DataFrame, parts: dict[str | None, int] | None = None, budget: int | None = None, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents drawn, with docs' columns: as many rows as epochs draw, the last one's text cut where the budget ends.

    Texts are not shuffled: where a source's last epoch ends is one document, so each row is decided by comparing its
    key to that of its source's last one. Only rows equal to a last one in key, id, tokens and text are ranked.
    """
    drawn = staged(_drawn(docs, parts, budget, seed, doc_id, source, text)[0], "drawn")
    full = F.expr("budget DIV total")
    rest = F.col("budget") - full * F.col("total")
    # the document in which the last epoch ends; none if the budget is whole epochs
    last = drawn.where((F.col("before") < rest) & (F.col("before") + F.col("o.n") >= rest)).select("source", "o")
    final = last.select(F.col("source").alias("s2"), F.col("o").alias("cut"))
    same = drawn.join(final, F.col("source").eqNullSafe(F.col("s2")) & (F.col("o") == F.col("cut")))
    last = same.groupBy("s2", "cut").agg(F.max(rest - F.col("before")).alias("room"))
    shares = drawn.groupBy("source").agg(F.max("total").alias("total"), F.max("budget").alias("budget"))
    ends = staged(shares.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", F.expr("CAST(budget DIV total AS LONG)").alias("full"), "cut", "room"), "ends")

    end, o, rank = fresh(docs, "end"), fresh(docs, "o"), fresh(docs, "rank")
    names = docs.columns
    i, t = F.col(doc_id).cast("long"), F.col(text)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(i.cast("string"), F.lit("null"))))
    keyed = docs.withColumn(o, F.struct(key.alias("key"), i.alias("id"), tokens(t).alias("n"), F.xxhash64(t).alias("h"))).where(F.col(f"{o}.n") > 0)
    table = ends.select(F.struct("source", "full", "cut", "room").alias(end))
    rows = keyed.join(counted(table), F.col(source).cast("string").eqNullSafe(F.col(f"{end}.source")))
    here, at = F.col(o), F.col(f"{end}.cut")
    epochs, take = fresh(docs, "epochs"), fresh(docs, "take")
    inner = rows.where(at.isNull() | (here != at)).withColumn(epochs, F.col(f"{end}.full") + F.when(here < at, 1).otherwise(0)).withColumn(take, F.lit(None).cast("long"))
    ties = rows.where(here == at).withColumn(rank, F.row_number().over(W.partitionBy(source).orderBy(doc_id)) - 1)
    room = F.col(f"{end}.room") - F.col(rank) * F.col(f"{o}.n")
    ties = ties.withColumn(epochs, F.col(f"{end}.full") + F.when(room > 0, 1).otherwise(0)).withColumn(take, F.when((room > 0) & (room < F.col(f"{o}.n")), room)).drop(rank)
    e = fresh(docs, "e")
    out = _repeated(inner.unionByName(ties).where(F.col(epochs) > 0), epochs, e, fresh(docs, "block"), (ends.agg(F.max("full")).first()[0] or 0) + 1)
    cut = _head(t, F.when(F.col(e) == F.col(epochs) - 1, F.col(take)))
    out = out.withColumn(text, cut)
    if n_chars:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*[F.col(f"`{c}`") for c in names])


def _head(text: Column, n: Column) -> Column:
    """text up to its n-th token, whole if n is null."""
    parts = F.regexp_extract_all(text, F.lit(r"[ \t\n\r\f\x0B]*[^ \t\n\r\f\x0B]+"), F.lit(0))
    return F.when(n.isNull(), text).otherwise(F.array_join(F.slice(parts, 1, n.cast("int")), ""))
