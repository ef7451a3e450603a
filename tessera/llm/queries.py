"""One query for each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, editprint, langid, mixing, neardup, pii, quality, replytree, sharding, tokenids
from ._text import SQL_WORDS


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op1_decontaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step that the report leaves out: the documents themselves, spans cut and documents dropped."""
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n_chars="n_chars")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_read(spark, sf_dir, "documents"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_blocks(_read(spark, sf_dir, "documents"))


def op6_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replytree.conversations(replytree.from_turns(_read(spark, sf_dir, "conversations")))


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.groups(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op1_decontaminated_documents,
        op2_pii,
        op3_source_mixing,
        op4_minhash_near_dedup,
        op5_token_blocks,
        op6_chat_reply_trees,
        op7_extendible_sharding,
        op8_edit_fingerprints,
        op9_quality_classifier,
        op10_language_id,
    )
}

_WORDS = SQL_WORDS

SQL: dict[str, str] = {
    "op1_benchmark_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(8, len(w)) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5),
g AS (SELECT l, gram, min(item_id) AS item_id FROM (
  SELECT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i : i + l - 1], ' '))) AS gram FROM b) GROUP BY l, gram),
sizes AS (SELECT DISTINCT l FROM b),
win AS (SELECT r, doc_id, l, len(w) AS n, unnest(range(1, len(w) - l + 2)) AS i,
  unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i : i + l - 1], ' '))) AS gram FROM d, sizes WHERE len(w) >= l),
hit AS (SELECT r, doc_id, n, i, win.l AS l, item_id FROM win JOIN g ON g.l = win.l AND g.gram = win.gram),
pos AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit)),
spans AS (SELECT r, count(*) AS words_removed, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) AS n_spans
  FROM (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM pos) GROUP BY r)
SELECT doc_id, CASE WHEN words_removed >= 0.5 * n THEN 'drop' ELSE 'cut' END AS action, n AS n_words, n_windows,
  CAST(n_spans AS BIGINT) AS n_spans, words_removed, first_item
FROM (SELECT r, doc_id, n, count(DISTINCT (i, l)) AS n_windows, min(item_id) AS first_item FROM hit GROUP BY r, doc_id, n) JOIN spans USING (r)
""",
    "op3_source_mixing": r"""
WITH base AS (SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
  len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS n FROM documents),
drawn AS (SELECT * FROM base WHERE n > 0),
totals AS (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM drawn GROUP BY source),
shares AS (SELECT source, total, CAST(sum(total) OVER () AS BIGINT) // count(*) OVER ()
  + CASE WHEN row_number() OVER (ORDER BY source NULLS FIRST) <= CAST(sum(total) OVER () AS BIGINT) % count(*) OVER () THEN 1 ELSE 0 END AS budget FROM totals),
run AS (SELECT doc_id, drawn.source AS source, n, total, budget,
  CAST(sum(n) OVER (PARTITION BY drawn.source ORDER BY k, doc_id, n ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS before
  FROM drawn JOIN shares ON drawn.source IS NOT DISTINCT FROM shares.source),
epochs AS (SELECT *, unnest(range(0, budget // total + CASE WHEN before < budget % total THEN 1 ELSE 0 END)) AS epoch FROM run)
SELECT doc_id, source, epoch, before + epoch * total AS start, least(n, budget - before - epoch * total) AS take, CAST(n AS BIGINT) AS n_tokens FROM epochs
""",
    "op6_chat_reply_trees": r"""
WITH RECURSIVE one AS (SELECT conv_id AS conv, turn AS msg, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, 'user'), coalesce(text, '')) = 1),
m AS (SELECT a.*, (SELECT max(b.msg) FROM one b WHERE b.conv = a.conv AND b.msg < (SELECT coalesce(min(c.msg), a.msg) FROM one c
    WHERE c.conv = a.conv AND c.msg <= a.msg AND c.role = a.role
    AND NOT EXISTS (SELECT 1 FROM one e WHERE e.conv = a.conv AND e.msg > c.msg AND e.msg < a.msg AND e.role <> a.role))) AS parent,
  CAST(len(list_distinct(regexp_extract_all(lower(text), '[^ \t\n\r]+'))) AS DOUBLE) AS score FROM one a),
paths AS (SELECT conv, msg, score, 1 AS n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' AS chat FROM m WHERE parent IS NULL
  UNION ALL SELECT m.conv, m.msg, paths.score + m.score, n + 1, chat || chr(10) || '<|im_start|>' || role || chr(10) || text || '<|im_end|>'
  FROM paths JOIN m ON m.conv = paths.conv AND m.parent = paths.msg),
leaves AS (SELECT * FROM paths p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.conv = p.conv AND m.parent = p.msg)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY score DESC, msg) AS rank FROM leaves)
SELECT conv AS conv_id, msg AS leaf, rank, CAST(n AS BIGINT) AS n_messages, score, chat FROM ranked WHERE rank <= 3
""",
    "op7_extendible_sharding": r"""
WITH RECURSIVE base AS (SELECT doc_id, coalesce(strlen(text), 0) AS b,
  lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
nodes AS (SELECT d, substr(bits, 1, d) AS p, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS docs, count(DISTINCT bits) AS keys FROM base, range(0, 61) t(d) GROUP BY ALL),
splits AS (SELECT d, p FROM nodes WHERE bytes > 2097152 AND keys > 1),
leaves AS (SELECT d, p, bytes, docs FROM nodes n WHERE NOT (bytes > 2097152 AND keys > 1)
  AND (d = 0 OR EXISTS (SELECT 1 FROM splits s WHERE s.d = n.d - 1 AND s.p = substr(n.p, 1, CAST(n.d AS BIGINT) - 1))))
SELECT doc_id, p AS shard, CAST(d AS BIGINT) AS depth, CAST(b AS BIGINT) AS n_bytes, bytes AS shard_bytes, docs AS shard_docs
FROM base JOIN leaves ON substr(bits, 1, d) = p
""",
}
