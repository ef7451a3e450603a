"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import intent as I
from ..functions import text as X
from ..functions import urls as U
from ..functions import vocab as V
from ..operators import answer as A
from ..operators import index as N
from ..operators import search as S
from ..operators import vault as VA
from ..operators import web as WB
from ..sources import formats as FM
from ..sources.tables import from_documents, from_pages, read
from . import fixtures as T
from . import oracle as O

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return from_documents(read(spark, d, "documents"))


PHRASE = "aning heble ention"
_ONE = f"questions AS (SELECT 1 AS query_id, '{PHRASE}' AS query)"
_BATCH = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, PHRASE)], "query_id long, query string")


def batch(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_HIT = ["query_id", "rank", "id", "score", "title", "location"]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_topk(spark, d)


# index and text


@query(f"SELECT doc_id, position, term FROM (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS position FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents))")
def tokenize_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(X.tokens(F.col("text"))).alias("position", "term"))


@query(f"SELECT doc_id, position, sentence FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s))) AS position FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents))")
def sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("position", "sentence"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return N.duplicates(docs(spark, d))


@query(f"WITH {O.DOCUMENT_SOURCES}, t AS (SELECT id, unnest({O.tokens("concat_ws(' ', title, location, text)")}) AS term FROM src) SELECT term, id, count(*) AS tf FROM t GROUP BY term, id")
def term_frequency(spark, d):
    return N.postings(docs(spark, d))


@query(f"WITH {O.DOCUMENT_SOURCES}, t AS (SELECT DISTINCT id, unnest({O.tokens("concat_ws(' ', title, location, text)")}) AS term FROM src) SELECT term, count(*) AS df FROM t GROUP BY term")
def document_frequency(spark, d):
    return N.document_frequency(N.postings(docs(spark, d)))


@query(f"SELECT count(*) AS total, count(*) FILTER (k = 'file') AS files, count(*) FILTER (k = 'web') AS web FROM (SELECT 'file' AS k FROM documents UNION ALL SELECT 'web' FROM pages WHERE {O.html_text('html')} <> '')")
def source_counts(spark, d):
    keep = ["id", "source_type"]
    return N.counts(docs(spark, d).select(keep).unionByName(from_pages(read(spark, d, "pages")).select(keep)))


@query(f"WITH {T.WORDS.sql()} SELECT id, {O.stem('word')} AS stem FROM vocab")
def stem_terms(spark, d):
    return T.WORDS.df(spark).select("id", X.stem(F.col("word")).alias("stem"))


@query(f"WITH {T.PATHS.sql()}, n AS (SELECT id, lower(regexp_extract(path, '[^/]*$')) AS f FROM paths) SELECT id, list_contains({O.arr(V.TEXT_SUFFIXES + V.CONTAINER_SUFFIXES)}, regexp_extract(f, '\\.([^.]+)$', 1)) OR list_contains({O.arr(V.BARE_NAMES)}, f) AS supported FROM n")
def supported_types(spark, d):
    return T.PATHS.df(spark).select("id", FM.is_supported(F.col("path")).alias("supported"))


_CSV = r"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(raw, ''), '\r?\n'), lambda l: array_to_string(list_transform(string_split(l, ','), lambda c: trim(c)), ' | ')), lambda l: replace(replace(l, '|', ''), ' ', '') <> ''), chr(10))"


@query(f"WITH {T.FORMATS.sql()} SELECT id, {_CSV} AS text FROM formats WHERE ext = 'csv'")
def csv_text(spark, d):
    return T.FORMATS.df(spark).where("ext = 'csv'").select("id", FM.csv_text(F.col("raw")).alias("text"))


@query(f"WITH {T.FORMATS.sql()} SELECT id, replace(coalesce(raw, ''), chr(9), ' | ') AS text FROM formats WHERE ext = 'tsv'")
def tsv_text(spark, d):
    return T.FORMATS.df(spark).where("ext = 'tsv'").select("id", FM.tsv_text(F.col("raw")).alias("text"))


@query(f"""WITH {T.FORMATS.sql()} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\\\''[0-9A-Fa-f][0-9A-Fa-f]', ' ', 'g'), '\\\\[A-Za-z]+-?[0-9]* ?', ' ', 'g'), '[{{}}]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM formats WHERE ext = 'rtf'""")
def rtf_text(spark, d):
    return T.FORMATS.df(spark).where("ext = 'rtf'").select("id", FM.rtf_text(F.col("raw")).alias("text"))


@query()
def json_text(spark, d):
    return T.FORMATS.df(spark).where("ext IN ('json', 'jsonl')").select("id", F.when(F.col("ext") == "json", FM.json_text(F.col("raw"))).otherwise(FM.jsonl_text(F.col("raw"))).alias("text"))


@query("SELECT event_id, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def event_json(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


# search

_TOP = "SELECT query_id, rank, id, score, title, location FROM hits"


@query(f"WITH {O.DOCUMENT_SOURCES}, {_ONE}, {O.search(8)} {_TOP}")
def search_topk(spark, d):
    return S.search(docs(spark, d), one(spark)).select(_HIT)


@query(f"WITH {O.DOCUMENT_SOURCES}, {_BATCH}, {O.search(8)} {_TOP}")
def search_batch(spark, d):
    return S.search(docs(spark, d), batch(spark, d)).select(_HIT)


_BOTH = f"""src AS (SELECT 'web' AS source_type, page_id AS id, {O.normalize('url')} AS location, trim(regexp_replace(regexp_replace({"replace(" * 9}regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1){"".join(f", {O.lit(a)}, {O.lit(b)})" for a, b in H.ENTITIES)}, '\\s+', ' ', 'g'), 'x^', '')) AS title, {O.html_text('html')} AS text FROM pages WHERE {O.html_text('html')} <> '')"""


@query(f"WITH {_BOTH}, {_ONE}, {O.search(8)} SELECT query_id, rank, id, score FROM hits")
def search_by_type(spark, d):
    files, pages = read(spark, d, "documents"), read(spark, d, "pages")

    def of(ids):
        pooled = pages.join(ids.withColumnRenamed("id", "page_id"), "page_id", "left_semi")
        return from_documents(files.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")).unionByName(from_pages(pooled))

    both = from_documents(files).unionByName(from_pages(pages))
    return S.search(both, one(spark), source_type="web", of=of).select("query_id", "rank", "id", "score")


@query(f"WITH {O.DOCUMENT_SOURCES}, {_BATCH}, {O.search(8)} SELECT query_id, id, base, matched, total, score FROM scored")
def coverage(spark, d):
    return S.scores(docs(spark, d), batch(spark, d))


_FACTS = f"{T.SOURCES.sql()}, {T.QUESTIONS.sql()}"


def facts(spark: SparkSession) -> DataFrame:
    t = T.SOURCES.df(spark)
    return t.withColumns({"extension": F.lit(".txt"), "size_bytes": F.length("text").cast("long"), "indexed_at": F.col("id")})


@query(f"WITH {_FACTS}, {O.search(5, 'facts')} SELECT query_id, rank, id, score, intent, array_to_string(boosts, ',') AS boosts, array_to_string(penalties, ',') AS penalties FROM hits")
def intent_adjusted_search(spark, d):
    return S.search(facts(spark), T.QUESTIONS.df(spark), 5).select("query_id", "rank", "id", "score", "intent", F.array_join("boosts", ",").alias("boosts"), F.array_join("penalties", ",").alias("penalties"))


# intent


@query(f"WITH {T.QUESTIONS.sql()} SELECT query_id, {O.detect('query')} AS intent FROM questions UNION ALL SELECT 1000 + item_id, {O.detect('text')} FROM benchmark")
def detect_intent(spark, d):
    more = read(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), I.detect(F.col("text")).alias("intent"))
    return T.QUESTIONS.df(spark).select("query_id", I.detect(F.col("query")).alias("intent")).unionByName(more)


_COLS = O.score_columns("text", "intent", "query", "topic")


@query(f"WITH {T.JUDGED.sql()}, a AS (SELECT *, {O.detect('query')} AS intent, {O.hay('text')} AS h, {O.topic_terms('query')} AS topic FROM judged), b AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _COLS.items())} FROM a) SELECT id, intent, CAST({O.DELTA} AS DOUBLE) AS delta, array_to_string({O.HITS}, ',') AS boosts, array_to_string({O.FAULTS}, ',') AS penalties FROM b")
def intent_score(spark, d):
    j = T.JUDGED.df(spark).withColumn("intent", I.detect(F.col("query")))
    j = j.withColumn("s", I.score(F.col("text"), F.col("intent"), F.col("query"), X.topic_terms(F.col("query"))))
    s = F.col("s")
    return j.select("id", "intent", s["delta"].cast("double").alias("delta"), F.array_join(s["boosts"], ",").alias("boosts"), F.array_join(s["penalties"], ",").alias("penalties"))


@query(f"WITH {T.NAMES.sql()} SELECT id, {O.is_name('text')} AS plain, {O.any_name('text')} AS any_form FROM names")
def person_names(spark, d):
    return T.NAMES.df(spark).select("id", I.is_name(F.col("text")).alias("plain"), I.any_name(F.col("text")).alias("any_form"))


@query(f"WITH {T.CONCEPTS.sql()}, a AS (SELECT *, {O.topic_terms('query')} AS topic FROM concepts) SELECT id, {O.generic('text', 'topic')} AS generic FROM a")
def generic_concept(spark, d):
    return T.CONCEPTS.df(spark).select("id", I.is_generic(F.col("text"), X.topic_terms(F.col("query"))).alias("generic"))


@query(f"WITH {T.QUESTIONS.sql()} SELECT query_id, list_contains({O.query_words('query')}, 'who') AS person, {O.phrase('query', V.WHEN_PHRASES)} AS dated FROM questions")
def date_person_flags(spark, d):
    q = F.coalesce("query", F.lit(""))
    return T.QUESTIONS.df(spark).select("query_id", I.wants_person(q).alias("person"), I.wants_date(q).alias("dated"))


# answers


@query(f"WITH {T.QUESTIONS.sql()} SELECT query_id, list_has_any({O.tokens('query')}, {O.arr(V.QUANTITY_WORDS)}) AS quantity, regexp_matches(coalesce(query, ''), {O.lit(X.COMPARISON_QUERY)}) AS comparison, regexp_matches(coalesce(query, ''), {O.lit(X.REASON_QUERY)}) AS reason FROM questions")
def query_modes(spark, d):
    return T.QUESTIONS.df(spark).select("query_id", *[c.alias(k) for k, c in A.modes(F.col("query")).items()])


_OVERLAP = f"len(list_filter({O.tokens('sentence')}, lambda w: w IN ('herons', 'heron')))"


@query(f"""WITH {T.SENTENCES.sql()} SELECT id, round(CASE WHEN o = 0 THEN 0 ELSE o + o / n + CASE WHEN regexp_matches(sentence, {O.lit(X.QUANTITY)}) THEN 10 WHEN regexp_matches(sentence, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(sentence, {O.lit(X.COMPARISON)}) THEN 8 ELSE 0 END + CASE WHEN regexp_matches(sentence, {O.lit(X.REASON)}) THEN 8 ELSE 0 END END, 6) AS score, {O.display('sentence')} AS display FROM (SELECT *, {_OVERLAP} AS o, len({O.tokens('sentence')}) AS n FROM lines)""")
def sentence_scores(spark, d):
    yes = F.lit(True)
    s = A.sentence_score(F.col("sentence"), X.strings(["heron", "herons"]), yes, yes, yes)
    return T.SENTENCES.df(spark).select("id", F.round(s, 6).alias("score"), X.display_sentence(F.col("sentence")).alias("display"))


@query(f"WITH {O.DOCUMENT_SOURCES}, {_BATCH}, {O.search(8)}, {O.answer()} SELECT query_id, place, rank, id, position, sentence, score FROM best")
def answer_sentences(spark, d):
    return A.chosen(S.search(docs(spark, d), batch(spark, d))).drop("source_type", "title", "location")


@query(f"WITH {_FACTS}, {O.search(8, 'facts')}, {O.answer()} SELECT query_id, number, id, paragraph, label FROM paras")
def answer_paragraphs(spark, d):
    return A.paragraphs(S.search(facts(spark), T.QUESTIONS.df(spark)))


# web


@query("SELECT page_id, trim(regexp_replace(" + "replace(" * 9 + "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)" + "".join(f", {O.lit(a)}, {O.lit(b)})" for a, b in H.ENTITIES) + r", '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {O.html_text('html')} AS text FROM pages")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", H.text(F.col("html")).alias("text"))


@query()
def html_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.posexplode(H.links(F.col("html"), U.normalize(F.col("url")))).alias("position", "link"))


@query(f"WITH {T.URLS.sql()}, u AS (SELECT id, raw FROM urls UNION ALL SELECT 1000 + page_id, url FROM pages) SELECT id, {O.normalize('raw')} AS url FROM u")
def url_normalize(spark, d):
    both = T.URLS.df(spark).unionByName(read(spark, d, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("url").alias("raw")))
    return both.select("id", U.normalize(F.col("raw")).alias("url"))


@query(f"WITH {T.URLS.sql()}, u AS (SELECT id, coalesce(raw, '') AS raw FROM urls UNION ALL SELECT 1000 + page_id, url FROM pages) SELECT id, {O.drop_tracking('raw')} AS url FROM u")
def url_tracking(spark, d):
    both = T.URLS.df(spark).select("id", F.coalesce("raw", F.lit("")).alias("raw")).unionByName(read(spark, d, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("url").alias("raw")))
    return both.select("id", U.drop_tracking(F.col("raw")).alias("url"))


@query()
def redirect_unwrap(spark, d):
    return T.REDIRECTS.df(spark).select("id", U.unwrap_second(U.unwrap_first(F.col("href"))).alias("url"))


@query()
def result_urls(spark, d):
    return T.RESULTS_RAW.df(spark).select("id", U.result_url(F.col("href"), F.lit("https://en.wikipedia.org/w/index")).alias("url"))


@query(f"WITH {T.HOSTS.sql()}, u AS (SELECT id, url FROM hosts UNION ALL SELECT 1000 + page_id, url FROM pages) SELECT id, {O.is_blocked('url')} AS blocked FROM u")
def blocked_hosts(spark, d):
    both = T.HOSTS.df(spark).unionByName(read(spark, d, "pages").select((F.col("page_id") + 1000).alias("id"), "url"))
    return both.select("id", U.is_blocked(F.col("url")).alias("blocked"))


@query(f"WITH {T.WIKI.sql()} SELECT id, {O.offtopic('url', 'topic')} AS offtopic FROM wiki")
def offtopic_wiki(spark, d):
    return T.WIKI.df(spark).select("id", U.is_offtopic_wiki(F.col("url"), F.col("topic")).alias("offtopic"))


_PRIVATE = (
    r"h IN ('', 'localhost', 'localhost.localdomain', 'ip6-localhost', 'ip6-loopback') OR ends_with(h, '.localhost') OR ends_with(h, '.local')"
    r" OR (regexp_matches(h, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') AND (split_part(h, '.', 1) IN ('0', '10', '127') OR try_cast(split_part(h, '.', 1) AS INT) >= 224 OR starts_with(h, '169.254.') OR starts_with(h, '192.168.') OR (split_part(h, '.', 1) = '172' AND try_cast(split_part(h, '.', 2) AS INT) BETWEEN 16 AND 31)))"
    r" OR (contains(h, ':') AND (h IN ('::', '::1') OR regexp_matches(h, '^(f[cd]|fe[89ab]|ff)')))"
)


@query(f"WITH {T.HOSTS.sql()}, a AS (SELECT id, {O.hostname('url')} AS h FROM hosts) SELECT id, {_PRIVATE} AS private FROM a")
def private_hosts(spark, d):
    return T.HOSTS.df(spark).select("id", U.is_private_host(U.hostname(F.col("url"))).alias("private"))


@query(f"WITH {T.BODIES.sql()} SELECT id, body, {' OR '.join(f"contains(lower(coalesce(body, '')), {O.lit(m)})" for m in V.CHALLENGE_MARKERS)} AS challenged FROM bodies")
def challenge_pages(spark, d):
    return WB.challenged(T.BODIES.df(spark))


@query(f"""WITH {T.PROVIDED.sql()}, a AS (SELECT *, lower(url || ' ' || title) AS h, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda w: length(w) > 3 AND NOT list_contains({O.arr(V.FUNCTION_WORDS)}, w)) AS w FROM provided),
b AS (SELECT *, len(list_filter(w, lambda t: contains(h, t) OR (length(rtrim(t, 's')) >= 3 AND contains(h, rtrim(t, 's'))))) > 0 AS hit FROM a)
SELECT query_id, provider, count(*) AS n FROM b GROUP BY query_id, provider HAVING count(*) >= 3 AND max(len(w)) > 0 AND NOT bool_or(hit)""")
def unrelated_batches(spark, d):
    return WB.unrelated_batches(T.PROVIDED.df(spark))


@query(f"""WITH {T.PROVIDED.sql()}, f AS (SELECT * FROM provided QUALIFY row_number() OVER (PARTITION BY query_id, lower(rtrim(url, '/')) ORDER BY provider_order, position) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY provider_order, position) AS place, provider, url, title FROM f""")
def provider_merge(spark, d):
    return WB.merge(T.PROVIDED.df(spark))


_RANK_COLS = O.score_columns("shown", "intent", "query", "topic")
_IN = lambda side: f"list_filter(topic, lambda t: list_contains({side}, t) OR list_contains(list_transform({side}, lambda w: {O.stem('w')}), {O.stem('t')}))"


@query(f"""WITH {T.RANKED_URLS.sql()}, f AS (SELECT * FROM ranked_urls QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY position) = 1),
a AS (SELECT *, {O.hostname('url')} AS host, lower({O.part('url', 2)}) AS path, {O.topic_terms(O.clean_query('query'))} AS topic, {O.detect('query')} AS intent, replace({O.unquote('url')}, '_', ' ') AS shown FROM f),
b AS (SELECT *, regexp_extract_all(path, '[a-z0-9]+') AS pw, regexp_extract_all(host, '[a-z0-9]+') AS hw, {O.hay('shown')} AS h FROM a),
c AS (SELECT *, {_IN('pw')} AS inp, {_IN('hw')} AS inh, {', '.join(f'{v} AS {k}' for k, v in _RANK_COLS.items())} FROM b),
e AS (SELECT *, len(inp) AS np, len(list_filter(inh, lambda t: NOT list_contains(inp, t))) AS nh, {O.DELTA} AS delta FROM c),
g AS (SELECT *, np + nh AS matched, 3 * np + 2 * nh + CASE WHEN np + nh > 1 THEN 2 * (np + nh - 1) ELSE 0 END
 + CASE WHEN np + nh > 0 AND len(list_filter(string_split(path, '/'), lambda s: length(s) > 8 AND (contains(s, '-') OR contains(s, '_')))) > 0 THEN 2 ELSE 0 END
 - CASE WHEN {' OR '.join(f"starts_with(host, '{p}')" for p in V.ACCOUNT_PREFIXES)} THEN 4 ELSE 0 END - CASE WHEN len(topic) > 0 AND np + nh = 0 THEN 2 ELSE 0 END
 - CASE WHEN {O.on_hosts('host', V.LOW_VALUE_HOSTS)} THEN 4 ELSE 0 END - CASE WHEN {' OR '.join(f"contains(path, '{m}')" for m in V.LISTING_MARKERS)} THEN 3 ELSE 0 END AS base_score,
 CASE WHEN intent = 'general' THEN 0 ELSE CAST(round_even(2 * delta, 0) AS INTEGER) END AS intent_delta FROM e)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY base_score + intent_delta DESC, position) AS place, url, matched, base_score, intent_delta, base_score + intent_delta AS score, intent FROM g""")
def url_rank(spark, d):
    return WB.rank_urls(T.RANKED_URLS.df(spark))


@query(f"WITH {T.ASKED.sql()} SELECT id, {O.clean_query('query')} AS cleaned, array_to_string({O.topic_terms('query')}, ' ') AS topic FROM asked")
def topic_terms(spark, d):
    return T.ASKED.df(spark).select("id", X.clean_query(F.col("query")).alias("cleaned"), F.array_join(X.topic_terms(F.col("query")), " ").alias("topic"))


_PADDED = f"(' ' || lower({O.collapse('query')}) || ' ')"
_KEPT = rf"list_filter(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9\-'']*'), lambda x: NOT list_contains({O.arr(V.FUNCTION_WORDS)}, lower(x)))"
_HINTS = " || ".join(f"CASE WHEN contains({_PADDED}, {O.lit(f' {p} ')}) THEN {O.arr(h.split())} ELSE [] END" for p, h in V.HINTS)
_NEW = f"list_filter({_HINTS}, lambda x: NOT list_contains(list_transform({_KEPT}, lambda y: lower(y)), x))"


@query(f"WITH {T.ASKED.sql()} SELECT id, coalesce(nullif(array_to_string({_KEPT} || {O.distinct_in_order(_NEW)}, ' '), ''), {O.collapse('query')}) AS keywords FROM asked")
def query_forms(spark, d):
    return T.ASKED.df(spark).select("id", X.keyword_form(F.col("query")).alias("keywords"))


@query(f"""WITH RECURSIVE {T.WEB.sql()}, {T.ROOTS.sql()}, walk AS (SELECT url, 0 AS level, url AS root FROM roots UNION SELECT link, level + 1, root FROM (SELECT unnest(web.links) AS link, level, root FROM walk JOIN web ON web.url = walk.url WHERE level < 2) WHERE split_part(link, '/', 3) = split_part(root, '/', 3))
SELECT url, min(level) AS level, arg_min(root, level) AS root FROM walk GROUP BY url""")
def crawl_reach(spark, d):
    return WB.reach(T.WEB.df(spark).select("url", "links"), T.ROOTS.df(spark), 2)


@query("SELECT CAST(7 AS BIGINT) AS requested, CAST(4 AS BIGINT) AS indexed, CAST(1 AS BIGINT) AS skipped_duplicates, CAST(1 AS BIGINT) AS skipped_empty, CAST(1 AS BIGINT) AS errors")
def crawl_stats(spark, d):
    held = spark.createDataFrame([], "content_hash string")
    return WB.crawl(T.WEB.df(spark), T.ROOTS.df(spark), held, depth=2)[1]


@query(f"""WITH {T.TO_FETCH.sql()}, {T.ROBOTS.sql()}, a AS (SELECT url, {O.scheme('url')} AS s, {O.hostname('url')} AS h, {O.scheme('url')} || '://' || lower({O.part('url', 1)}) AS root, coalesce(nullif({O.part('url', 2)}, ''), '/') || CASE WHEN {O.part('url', 3)} <> '' THEN '?' || {O.part('url', 3)} ELSE '' END AS p FROM to_fetch)
SELECT url, s IN ('http', 'https') AND NOT ({_PRIVATE}) AND coalesce((SELECT arg_min(allow, rule_order) FROM robots WHERE site_root = root AND starts_with(p, path_prefix)), true) AS allowed FROM a""")
def robots_filter(spark, d):
    return WB.allowed(T.TO_FETCH.df(spark), T.ROBOTS.df(spark))


# writes and vault

_CLEAN = f"WITH {T.UPSERTS.sql()}, c AS (SELECT batch, position, trim(source_type) AS source_type, trim(location) AS location, trim(title) AS title, trim(text) AS text, greatest(size_bytes, 0) AS size_bytes, lower(trim(extension)) AS extension FROM upserts), l AS (SELECT *, sha256(source_type || '|' || location) AS source_key FROM c WHERE text <> '' AND source_type <> '' AND location <> '' QUALIFY row_number() OVER (PARTITION BY source_type, location ORDER BY batch DESC, position DESC) = 1)"


@query(f"{_CLEAN} SELECT batch, position, source_type, location, title, text, size_bytes, extension, source_key FROM l")
def upsert_sources(spark, d):
    return N.upsert(T.UPSERTS.df(spark))


@query(f"{_CLEAN} SELECT location, title FROM l WHERE NOT (source_type = 'web' AND {O.is_blocked('location')})")
def purge_junk(spark, d):
    return N.purge(N.upsert(T.UPSERTS.df(spark))).select("location", "title")


@query(f"""WITH {T.COLLECTIONS.sql()}, {T.SHELVED.sql()} SELECT name, description, count(source_id) AS n_sources FROM shelves LEFT JOIN shelved ON shelved.collection_id = shelves.id GROUP BY name, description""")
def collection_counts(spark, d):
    return VA.collection_counts(T.COLLECTIONS.df(spark), T.SHELVED.df(spark))


@query(f"WITH {O.DOCUMENT_SOURCES}, b AS (SELECT id, lower(concat_ws(' ', title, location, text)) AS x FROM src) SELECT id AS source_id, CAST(7 AS BIGINT) AS collection_id FROM b WHERE {' OR '.join(f"contains(x, '{w}')" for w in PHRASE.split())}")
def collection_match(spark, d):
    return VA.attach(spark.createDataFrame([], "source_id long, collection_id long"), docs(spark, d), PHRASE, 7)


def _hits(blob: str, words: list[str]) -> str:
    return " + ".join(f"(length({blob}) - length(replace({blob}, '{w}', ''))) // {len(w)}" for w in words)


@query(f"""WITH {T.NOTES.sql()}, {T.COLLECTIONS.sql()}, b AS (SELECT *, {_hits("lower(title || ' ' || body)", ['lake', 'herons', 'lake'])} AS score FROM notes)
SELECT b.id AS id, title, score, coalesce(name, 'unassigned') AS collection, substr({O.collapse('body')}, 1, 220) AS preview FROM b LEFT JOIN shelves ON shelves.id = collection_id WHERE score > 0 ORDER BY score DESC, updated_at DESC, id LIMIT 10""")
def note_search(spark, d):
    return VA.search_notes(T.NOTES.df(spark), T.COLLECTIONS.df(spark), "lake herons lake")


@query(f"""WITH {T.NOTES.sql()}, {T.COLLECTIONS.sql()} SELECT notes.id AS id, title, coalesce(name, 'unassigned') AS collection, substr({O.collapse('body')}, 1, 160) AS preview FROM notes LEFT JOIN shelves ON shelves.id = collection_id ORDER BY updated_at DESC, notes.id LIMIT 20""")
def recent_notes(spark, d):
    return VA.list_notes(T.NOTES.df(spark), T.COLLECTIONS.df(spark))


_ENT = f"""src AS (SELECT doc_id AS id, source || ' ' || doc_id || chr(10) || text AS blob FROM documents), e0 AS (SELECT id, unnest(l) AS name, unnest(range(0, len(l))) AS pos FROM (SELECT id, {O.entities('blob')} AS l FROM src)),
e1 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY pos) = 1), links AS (SELECT id AS source_id, name, 1 AS weight FROM e1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 30)"""


@query(f"WITH {_ENT} SELECT * FROM links")
def entities(spark, d):
    return VA.entity_links(docs(spark, d))


@query(f"WITH {_ENT} SELECT name, count(*) AS hits FROM links GROUP BY name ORDER BY hits DESC, name LIMIT 25")
def top_entities(spark, d):
    return VA.top_entities(VA.entity_links(docs(spark, d)))


@query(f"WITH {_ENT}, {T.COLLECTIONS.sql()}, {T.NOTES.sql()} SELECT (SELECT count(*) FROM documents) AS sources, (SELECT count(*) FROM documents) AS files, CAST(0 AS BIGINT) AS pages, (SELECT count(*) FROM shelves) AS collections, (SELECT count(*) FROM notes) AS notes, (SELECT count(DISTINCT name) FROM links) AS entities, (SELECT count(*) FROM links) AS mentions")
def vault_report(spark, d):
    s = docs(spark, d)
    return VA.report(s, T.COLLECTIONS.df(spark), T.NOTES.df(spark), VA.entity_links(s))


@query(f"""WITH {O.DOCUMENT_SOURCES}, b AS (SELECT id, source_type, location, title AS label, indexed_at, lower(concat_ws(' ', title, location, text)) AS x FROM src), s AS (SELECT id, source_type, location, label, indexed_at, {_hits('x', PHRASE.split())} AS score FROM b)
SELECT *, greatest((SELECT count(*) FROM s WHERE score > 0) - 30, 0) AS not_shown FROM s WHERE score > 0 ORDER BY indexed_at, score DESC, id LIMIT 30""")
def timeline(spark, d):
    return VA.timeline(docs(spark, d), PHRASE)


_INPUT = "CASE WHEN length({t}) >= 2 AND left({t}, 1) = right({t}, 1) AND left({t}, 1) IN ('''', '\"') THEN trim(substr({t}, 2, length({t}) - 2)) ELSE {t} END"
_T = _INPUT.format(t="trim(coalesce(text, ''))")


@query(f"""WITH a AS (SELECT conv_id, turn, {_T} AS c FROM conversations), b AS (SELECT conv_id, turn, substr(CASE WHEN len({O.tokens('c')}) > 0 THEN array_to_string(({O.tokens('c')})[1:12], ' ') ELSE substr({O.collapse('c')}, 1, 140) END, 1, 400) AS content FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM b WHERE content <> '' QUALIFY rn <= 6), f AS (SELECT conv_id, substr({O.collapse('content')}, 1, 120) AS topic, min(rn) AS rn FROM k GROUP BY ALL)
SELECT conv_id, topic, row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS place FROM f""")
def recent_topics(spark, d):
    return VA.recent_topics(read(spark, d, "conversations"))


@query(f"WITH {T.LOG.sql()} SELECT trim(line) AS line, min(pos) AS pos FROM log WHERE contains(line, 'WARN') OR contains(line, 'SKIP') OR contains(line, 'ERROR') GROUP BY 1 ORDER BY pos LIMIT 5")
def diagnostics(spark, d):
    return VA.diagnostics(T.LOG.df(spark))


@query(f"WITH {T.TYPED.sql()} SELECT id, {_INPUT.format(t="trim(coalesce(raw, ''))")} AS cleaned FROM typed")
def clean_input(spark, d):
    return T.TYPED.df(spark).select("id", X.clean_input(F.col("raw")).alias("cleaned"))
