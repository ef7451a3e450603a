"""Chat formatting from reply trees.

Messages are nodes, replies point to their parent. Paths from root to leaf are enumerated by iterative self-joins that
double: after round k a node knows its nearest 2**k ancestors, and joins the paths of the farthest one. So a tree of
depth d takes log2(d) joins, of ids only; each round is a written table. A path's score is the sum of its messages'
scores; a conversation's paths are ranked by it and the best TOP are formatted, each as one conversation.

Defined cases: a message whose parent is null or does not exist is a root. Rows of null conversation or id are
dropped. Repeated rows, and rows of one id, count once: the least by parent, role and text stays. Null text is empty,
a null role is 'user', a null score 0. Messages on a cycle have no root and are in no path. Ties of score go to the
smaller leaf id. An empty table gives an empty result. Other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._stage import staged

TOP = 3
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def from_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, msg, parent, role, text, score) of a table of turns.

    Successive turns of one role are alternatives: they share as parent the last turn before them of another role.
    The score is the number of distinct words.
    """
    t = turns.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("msg"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv IS NOT NULL AND msg IS NOT NULL")
    one = t.groupBy("conv", "msg").agg(F.min(F.struct("role", "text")).alias("m")).select("conv", "msg", "m.role", "m.text")
    w = W.partitionBy("conv").orderBy("msg")
    runs = one.withColumn("before", F.lag("msg").over(w)).withColumn("change", F.lag("role").over(w) != F.col("role"))
    parent = F.last(F.when(F.col("change"), F.col("before")), ignorenulls=True).over(w)
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t\n\r]+"), F.lit(0))))
    return runs.select("conv", "msg", parent.alias("parent"), "role", "text", words.cast("double").alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, path): ids from root to leaf, of (conv, msg, parent)."""
    nodes = messages.where("conv IS NOT NULL AND msg IS NOT NULL").groupBy("conv", "msg").agg(F.min("parent").alias("parent"))
    known = nodes.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("known"))
    edges = nodes.join(known, ["conv", "parent"], "left").select("conv", "msg", F.when(F.col("known"), F.col("parent")).alias("next"))
    # path: the node and its ancestors known so far, nearest first; next: the one above them
    now = staged(edges.select("conv", "msg", F.array("msg").alias("path"), "next"), "paths")
    size = now.count()
    span = 1
    while span <= size and not now.where("next IS NOT NULL").isEmpty():
        up = now.select("conv", F.col("msg").alias("next"), F.col("path").alias("more"), F.col("next").alias("after"))
        now = staged(now.join(up, ["conv", "next"], "left").select("conv", "msg", F.concat("path", F.coalesce("more", F.array().cast("array<long>"))).alias("path"), F.col("after").alias("next")), "paths")
        if not now.where("next IS NOT NULL AND array_contains(path, next)").isEmpty():
            # a cycle: who is on it, or below it, never reaches a root
            now = staged(now.where("next IS NULL OR NOT array_contains(path, next)"), "paths")
            now = staged(now.join(now.select("conv", F.col("msg").alias("next"), F.lit(True).alias("known")), ["conv", "next"], "left").where("next IS NULL OR known").select("conv", "msg", "path", "next"), "paths")
        span *= 2
    inner = edges.where("next IS NOT NULL").select("conv", F.col("next").alias("msg")).distinct()
    return now.where("next IS NULL").join(inner, ["conv", "msg"], "left_anti").select("conv", F.col("msg").alias("leaf"), F.reverse("path").alias("path"))


def conversations(messages: DataFrame, top: int = TOP) -> DataFrame:
    """(conv_id, leaf, rank, n_messages, score, chat) of the best top paths of each conversation."""
    m = messages.where("conv IS NOT NULL AND msg IS NOT NULL").select("conv", "msg", "parent", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    m = staged(m.groupBy("conv", "msg").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("conv", "msg", "m.*"), "messages")
    steps = paths(m).select("conv", "leaf", F.posexplode("path").alias("at", "msg"))
    scored = steps.join(m.select("conv", "msg", "score"), ["conv", "msg"]).groupBy("conv", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("at", "msg"))).alias("steps"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("conv").orderBy(F.col("score").desc(), "leaf"))).where(F.col("rank") <= top)
    texts = ranked.select("conv", "leaf", "rank", "n_messages", F.col("score").alias("total"), F.explode("steps").alias("s")).select("*", "s.at", "s.msg").join(m.select("conv", "msg", "role", "text"), ["conv", "msg"])
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
    return texts.groupBy("conv", "leaf", "rank", "n_messages", "total").agg(chat.alias("chat")).select(F.col("conv").alias("conv_id"), "leaf", F.col("rank").cast("long").alias("rank"), "n_messages", F.col("total").alias("score"), "chat")
