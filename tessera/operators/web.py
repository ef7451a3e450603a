"""Search results and pages of the web, as stored tables: merging, filtering, ranking, crawling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as X
from ..functions import urls as U
from ..functions import vocab as V
from ..sources.tables import source_key


def merge(results: DataFrame) -> DataFrame:
    """Provider results, first of each address (case and trailing slash aside), in order of provider and position."""
    key = F.lower(F.regexp_replace("url", "/+$", ""))
    w = W.partitionBy("query_id", "key").orderBy("provider_order", "position")
    first = results.withColumn("key", key).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("provider_order", "position"))).select("query_id", "place", "provider", "url", "title")


def related_terms(query):  # noqa: ANN001, ANN201
    w = F.array_distinct(X.words(F.lower(query), "[a-z0-9]+"))
    return F.filter(w, lambda x: (F.length(x) > 3) & ~x.isin(V.FUNCTION_WORDS))


def unrelated_batches(results: DataFrame) -> DataFrame:
    """(query_id, provider, n) of batches of three or more in which no result has a word of the query, or its stem."""
    hay = F.lower(F.concat("url", F.lit(" "), "title"))

    def hit(t):  # noqa: ANN001, ANN202
        short = F.regexp_replace(t, "s+$", "")
        return F.col("hay").contains(t) | ((F.length(short) >= 3) & F.col("hay").contains(short))

    judged = results.withColumn("hay", hay).withColumn("terms", related_terms(F.col("query"))).withColumn("hit", F.exists("terms", hit))
    by = judged.groupBy("query_id", "provider").agg(F.count("*").alias("n"), F.bool_or("hit").alias("any"), F.max(F.size("terms")).alias("terms"))
    return by.where("n >= 3 AND terms > 0 AND NOT any").select("query_id", "provider", "n")


def challenged(responses: DataFrame) -> DataFrame:
    return responses.withColumn("challenged", X.any_of(F.lower(F.coalesce("body", F.lit(""))), V.CHALLENGE_MARKERS))


def score_urls(rows: DataFrame) -> DataFrame:
    """rows (query, url) with matched, intent_delta and score."""
    u, q = F.col("url"), F.col("query")
    rows = rows.withColumns({"_host": U.hostname(u), "_path": F.lower(U.path(u)), "_topic": X.topic_terms(X.clean_query(q)), "_intent": I.detect(q)})
    rows = rows.withColumns({"_pw": U.url_words(F.col("_path")), "_hw": U.url_words(F.col("_host"))})
    stems = lambda c: F.transform(c, X.stem)
    rows = rows.withColumns({"_ps": stems(F.col("_pw")), "_hs": stems(F.col("_hw"))})
    in_path = F.filter("_topic", lambda t: F.array_contains(F.col("_pw"), t) | F.array_contains(F.col("_ps"), X.stem(t)))
    rows = rows.withColumn("_inp", in_path)
    in_host = F.filter(F.array_except("_topic", "_inp"), lambda t: F.array_contains(F.col("_hw"), t) | F.array_contains(F.col("_hs"), X.stem(t)))
    rows = rows.withColumns({"_np": F.size("_inp"), "_nh": F.size(in_host)})
    matched = F.col("_np") + F.col("_nh")
    slug = F.exists(F.split("_path", "/"), lambda s: (F.length(s) > 8) & (s.contains("-") | s.contains("_")))
    account = F.col("_host").rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in V.ACCOUNT_PREFIXES) + ")")
    base = (
        3 * F.col("_np") + 2 * F.col("_nh") + F.when(matched > 1, 2 * (matched - 1)).otherwise(0) + F.when((matched > 0) & slug, 2).otherwise(0)
        - F.when(account, 4).otherwise(0) - F.when((F.size("_topic") > 0) & (matched == 0), 2).otherwise(0)
        - F.when(U.on_hosts(F.col("_host"), V.LOW_VALUE_HOSTS), 4).otherwise(0) - F.when(U.has_marker(F.col("_path")), 3).otherwise(0)
    )
    rows = rows.withColumn("_s", I.score(U.intent_text(u), F.col("_intent"), q, F.col("_topic")))
    s = F.col("_s")
    delta = F.when(F.col("_intent") == V.GENERAL, 0.0).otherwise(s["delta"])
    out = rows.withColumns({"matched": matched, "base_score": base, "intent_delta": F.bround(2 * delta).cast("int"), "intent": F.col("_intent"), "boosts": s["boosts"], "penalties": s["penalties"]})
    return out.withColumn("score", (F.col("base_score") + F.col("intent_delta")).cast("int")).drop(*[c for c in out.columns if c.startswith("_")])


def rank_urls(rows: DataFrame) -> DataFrame:
    """(query_id, place, url, matched, score): distinct addresses by score, then position."""
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("query_id", "url").orderBy("position"))).where("rn = 1").drop("rn")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "position")
    return score_urls(first).withColumn("place", F.row_number().over(w)).select("query_id", "place", "url", "matched", "base_score", "intent_delta", "score", "intent")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls with allowed: http(s), not private, and the site's first rule whose prefix fits, if any, allows it.

    rules: (site_root, rule_order, path_prefix, allow).
    """
    u = F.col("url")
    root = F.concat(U.scheme(u), F.lit("://"), U.authority(u))
    full = F.concat(F.coalesce(F.nullif(U.path(u), F.lit("")), F.lit("/")), F.when(U.query(u) != "", F.concat(F.lit("?"), U.query(u))).otherwise(""))
    keyed = urls.withColumn("site_root", root).withColumn("full", full)
    hit = keyed.select("url", "site_root", "full").distinct().join(rules, "site_root").where(F.col("full").startswith(F.col("path_prefix"))).groupBy("url").agg(F.min_by("allow", "rule_order").alias("rule"))
    fine = U.scheme(u).isin("http", "https") & ~U.is_private_host(U.hostname(u))
    return keyed.join(hit, "url", "left").withColumn("allowed", fine & F.coalesce("rule", F.lit(True))).drop("site_root", "full", "rule")


def reach(pages: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(url, level, root): breadth-first closure over stored links within each root's site, a join for each level.

    pages: (url, links), addresses normalised. The first root, by order, and the least level of an address win.
    """
    seen = roots.select("url", F.lit(0).alias("level"), F.col("url").alias("root"), "position")
    frontier = seen
    edges = pages.select("url", F.posexplode("links").alias("at", "link"))
    for level in range(1, depth + 1):
        found = frontier.join(edges, "url").where(U.authority(F.col("link")) == U.authority(F.col("root")))
        w = W.partitionBy("link").orderBy("position", "at")
        new = found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("link").alias("url"), F.lit(level).alias("level"), "root", "position")
        frontier = new.join(seen.select("url"), "url", "left_anti")
        seen = seen.unionByName(frontier)
    return seen.select("url", "level", "root")


def crawl(fetched: DataFrame, roots: DataFrame, held: DataFrame, limit: int = 20, depth: int = 0, topic: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages to index, and statistics, of a crawl over stored fetch results.

    fetched: (url, title, text, links, error). Pages are visited breadth-first; the budget counts pages indexed, so it
    is a running count over the visiting order, of pages that are neither errors, empty, junk nor held already.
    """
    topics = X.strings(topic or [])
    start = roots.where(~U.is_junk(F.col("url"), topics))
    order = reach(fetched.select("url", F.filter("links", lambda u: ~U.is_junk(u, topics)).alias("links")), start, depth).join(start.select(F.col("url").alias("root"), "position"), "root")
    seen = order.join(fetched, "url", "left").withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    queue = W.orderBy("level", "position", "url")
    first = F.row_number().over(W.partitionBy("content_hash").orderBy("level", "position", "url"))
    known = held.select("content_hash", F.lit(True).alias("known")).distinct()
    status = F.when(F.col("title").isNull() | F.col("error").isNotNull(), "error").when(F.trim("text") == "", "empty").when(F.col("known") | (F.col("nth") > 1), "duplicate").otherwise("indexed")
    judged = seen.withColumn("nth", first).join(known, "content_hash", "left").withColumn("status", status)
    done = F.coalesce(F.sum(F.when(F.col("status") == "indexed", 1).otherwise(0)).over(queue.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    visited = judged.withColumn("done", done).where(F.col("done") < max(1, limit))
    pages = visited.where("status = 'indexed'").select("url", "title", "text", "content_hash", "level", source_key(F.lit("web"), F.col("url")).alias("source_key"))
    return pages, crawl_stats(visited)


def crawl_stats(log: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return log.agg(F.count("*").alias("requested"), n("indexed").alias("indexed"), n("duplicate").alias("skipped_duplicates"), n("empty").alias("skipped_empty"), n("error").alias("errors"))
