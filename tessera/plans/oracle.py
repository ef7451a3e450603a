"""SQL for DuckDB that says the same as the columns of functions/, built from the same word lists."""

from __future__ import annotations

from ..functions import intent as I
from ..functions import text as X
from ..functions import vocab as V


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def arr(items: list[str]) -> str:
    return "CAST([" + ", ".join(map(lit, items)) + "] AS VARCHAR[])"


def collapse(t: str) -> str:
    return rf"trim(regexp_replace(coalesce({t}, ''), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def tokens(t: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(coalesce({t}, ''), '{X.TOKEN}'), lambda x: lower(x)), lambda x: NOT list_contains({arr(V.INDEX_STOPWORDS)}, x))"


def sentences(t: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({collapse(t)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 30 AND 700)"


def stem(w: str) -> str:
    cases = " ".join(f"WHEN ends_with(lower({w}), '{s}') AND length({w}) - {len(s)} >= {n} THEN left(lower({w}), length({w}) - {len(s)})" for s, n in V.STEMS)
    return f"CASE {cases} ELSE lower({w}) END"


def distinct_in_order(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def query_words(q: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({q}, '')), '[a-z0-9][a-z0-9''\-]*')"


def phrase(q: str, phrases: list[str]) -> str:
    line = f"(' ' || array_to_string({query_words(q)}, ' ') || ' ')"
    return "(" + " OR ".join(f"contains({line}, {lit(f' {p} ')})" for p in phrases) + ")"


def detect(q: str) -> str:
    w = query_words(q)
    has = lambda items: f"list_has_any({w}, {arr(items)})"
    made = has(V.CREATION_VERBS)
    return (
        f"CASE WHEN len({w}) = 0 THEN 'general' WHEN {phrase(q, V.STATISTIC_PHRASES)} OR {has(V.STATISTIC_WORDS)} THEN 'statistic'"
        f" WHEN NOT ({made} AND list_contains({w}, 'who')) AND ({phrase(q, V.EXPLANATION_PHRASES)} OR list_contains({arr(V.EXPLANATION_LEADS)}, {w}[1])) THEN 'explanation'"
        f" WHEN {made} AND {has(V.PRODUCTS)} THEN 'inventor' WHEN {made} AND {has(V.COMPANIES)} THEN 'founder' WHEN {made} THEN 'inventor' ELSE 'general' END"
    )


def hay(t: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', ' ', 'g'))"


def matches(h: str, vocabulary: list[str]) -> str:
    pairs = [(v, I._plain(v)) for v in vocabulary if I._plain(v)]
    if not pairs:
        return arr([])
    found = ", ".join(f"CASE WHEN {f'contains({h}, {lit(p)})' if ' ' in p else f'contains({chr(39)} {chr(39)} || {h} || {chr(39)} {chr(39)}, {lit(f' {p} ')})'} THEN {lit(v)} END" for v, p in pairs)
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


def unquote(t: str) -> str:
    """Percent escapes decoded where well formed, as many as the literals here need."""
    return f"CASE WHEN regexp_matches({t}, '%($|.$|[^0-9A-Fa-f]|.[^0-9A-Fa-f])') THEN {t} ELSE url_decode({t}) END"


def is_name(t: str) -> str:
    raw = rf"trim(regexp_replace(replace({t}, '_', ' '), '\s*\([^)]*\)\s*$', ''))"
    return rf"coalesce(regexp_matches({raw}, '^[A-Z][a-z]+(\s+([A-Z][a-z]+|[A-Z]\.?))?\s+[A-Z][a-z]+$') AND NOT list_has_any(regexp_split_to_array(lower({raw}), '\s+'), {arr(V.NOT_NAMES)}), false)"


def candidates(t: str) -> str:
    raw = f"trim(coalesce({t}, ''))"
    last = rf"regexp_replace({unquote(rf"regexp_extract(regexp_extract({raw}, '^[^?#]*'), '([^/]+)/*$', 1)")}, '\.(html?|php|aspx?)$', '', 'i')"
    slashes = f"(length({raw}) - length(replace({raw}, '/', '')))"
    both = f"list_filter([nullif({raw}, ''), CASE WHEN (contains({raw}, '//') OR {slashes} >= 2) AND {last} <> '' THEN {last} END], lambda x: x IS NOT NULL)"
    return distinct_in_order(both)


def any_name(t: str) -> str:
    c = candidates(t)
    return f"({is_name(f'({c})[1]')} OR {is_name(f'({c})[2]')})"


def topic_terms(q: str) -> str:
    found = rf"list_filter(list_transform(regexp_extract_all(coalesce({q}, ''), '[A-Za-z0-9][A-Za-z0-9\-'']*'), lambda x: lower(x)), lambda x: NOT list_contains({arr(V.FUNCTION_WORDS)}, x))"
    return distinct_in_order(found)


def clean_query(q: str) -> str:
    c = collapse(q)
    return f"coalesce(nullif(trim(regexp_replace({c}, '^[?!.,;:]+|[?!.,;:]+$', '', 'g')), ''), {c})"


def generic(t: str, topic: str) -> str:
    c = candidates(t)
    plain = lambda k: rf"lower(trim(regexp_replace(replace(({c})[{k}], '_', ' '), '\s*\([^)]*\)\s*$', '')))"
    gen = lambda k: f"coalesce(list_contains({arr(V.GENERIC_TITLES)}, {plain(k)}), false)"
    on = lambda k: f"coalesce(list_contains({topic}, {plain(k)}), false)"
    return f"CASE WHEN {gen(1)} THEN NOT {on(1)} WHEN {gen(2)} THEN NOT {on(2)} ELSE false END"


def score_columns(t: str, intent: str, q: str, topic: str | None) -> dict[str, str]:
    """SQL of the counted hits, signals, penalties and delta; h names the haystack column."""
    h = "h"
    dated = phrase(q, V.WHEN_PHRASES)
    plain = "CASE " + " ".join(f"WHEN {intent} = '{n}' THEN CASE WHEN {dated} THEN {matches(h, list(dict.fromkeys(V.BOOSTS[n] + V.DATE_BOOSTS)))} ELSE {matches(h, V.BOOSTS[n])} END" for n in V.INTENTS[:-1])
    plain += f" ELSE CASE WHEN {dated} THEN {matches(h, V.DATE_BOOSTS)} ELSE {arr([])} END END"
    found = "CASE " + " ".join(f"WHEN {intent} = '{n}' THEN {matches(h, V.PENALTIES[n])}" for n in V.INTENTS[:-1]) + f" ELSE {arr([])} END"
    return {
        "counted": f"({plain})[1:4]",
        "year": rf"({dated} AND regexp_matches({h}, '\b(1[5-9][0-9][0-9]|20[0-2][0-9])\b'))",
        "person": f"({intent} IN ('founder', 'inventor') AND list_contains({query_words(q)}, 'who') AND {any_name(t)})",
        "found": found,
        "work": f"regexp_matches(coalesce({t}, ''), {lit(I.WORK)})",
        "generic": generic(t, topic) if topic else "false",
    }


DELTA = "CASE WHEN h = '' THEN 0.0 ELSE len(counted) + CASE WHEN year THEN 1.5 ELSE 0 END + CASE WHEN person THEN 2 ELSE 0 END - 1.5 * (len(found) + CASE WHEN work THEN 3 ELSE 0 END + CASE WHEN generic THEN 1.5 ELSE 0 END) END"
HITS = "CASE WHEN h = '' THEN CAST([] AS VARCHAR[]) ELSE counted || CASE WHEN year THEN ['<year>'] ELSE [] END || CASE WHEN person THEN ['<person>'] ELSE [] END END"
FAULTS = "CASE WHEN h = '' THEN CAST([] AS VARCHAR[]) ELSE found || CASE WHEN work THEN ['<work-of-art>'] ELSE [] END || CASE WHEN generic THEN ['<generic-concept>'] ELSE [] END END"

DOCUMENT_SOURCES = """src AS (SELECT doc_id AS id, 'file' AS source_type, '/corpus/' || source || '/' || doc_id || '.txt' AS location, source || ' ' || doc_id AS title, text, doc_id AS indexed_at FROM documents)"""


def search(limit: int, source: str = "src") -> str:
    """Common table expressions to ranked hits (named hits) over {source}, for questions(query_id, query)."""
    light = arr(V.RANK_STOPWORDS)
    pool = 5 * limit + 10
    cols = score_columns("hay", "intent", "query", "topic")
    return f"""
tok AS (SELECT id, unnest({tokens("concat_ws(' ', title, location, text)")}) AS term FROM {source}),
qt AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS term FROM questions),
qterms AS (SELECT *, CASE WHEN list_contains({light}, term) THEN 0.15 ELSE 1.0 END AS weight, CASE WHEN list_contains({light}, term) THEN 0 ELSE 1 END AS meaningful FROM qt),
total AS (SELECT query_id, sum(meaningful) AS total FROM qterms GROUP BY query_id),
post AS (SELECT term, id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY term, id),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
nn AS (SELECT greatest(count(*), 1) AS n FROM {source}),
sums AS (SELECT query_id, id, sum(CAST(weight AS DOUBLE) * (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)) AS raw, CAST(sum(meaningful) AS BIGINT) AS matched
  FROM post JOIN qterms USING (term) JOIN dfs USING (term), nn GROUP BY query_id, id),
scored AS (SELECT query_id, id, round(raw, 6) AS base, matched, CAST(total AS BIGINT) AS total, round(raw * CASE WHEN total > 0 THEN 0.15::DOUBLE + 0.85::DOUBLE * matched / total ELSE 1 END, 6) AS score FROM sums JOIN total USING (query_id)),
pool AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {pool}),
near AS (SELECT pool.*, query, {detect('query')} AS intent, source_type, location, title, text,
  concat_ws(' ', coalesce(nullif(title, ''), nullif(location, '')), nullif(location, ''), nullif(substr(text, 1, 2000), '')) AS hay,
  list_filter({tokens('query')}, lambda x: NOT list_contains({light}, x)) AS topic FROM pool JOIN questions USING (query_id) JOIN {source} USING (id)),
plain AS (SELECT *, {hay('hay')} AS h FROM near),
signs AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in cols.items())} FROM plain),
judged AS (SELECT *, {DELTA} AS delta, {HITS} AS boosts0, {FAULTS} AS penalties0 FROM signs),
fin AS (SELECT query_id, query, id, source_type, location, title, text, intent, round(CASE WHEN intent = 'general' THEN score ELSE score * greatest(0.4::DOUBLE, least(1.9::DOUBLE, 1 + delta * 0.3::DOUBLE)) END, 6) AS score,
  CASE WHEN intent = 'general' THEN [] ELSE boosts0 END AS boosts, CASE WHEN intent = 'general' THEN [] ELSE penalties0 END AS penalties FROM judged),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fin QUALIFY rank <= {limit})"""


def answer() -> str:
    """Common table expressions from hits to best sentences (named best) and paragraphs (named paras)."""
    q = "coalesce(query, '')"
    rx = lambda p: lit(p)
    return rf"""
modes AS (SELECT *, list_has_any({tokens('query')}, {arr(V.QUANTITY_WORDS)}) AS quantity, regexp_matches({q}, {rx(X.COMPARISON_QUERY)}) AS comparison, regexp_matches({q}, {rx(X.REASON_QUERY)}) AS reason,
  list_distinct({tokens('query')}) AS terms, {sentences('text')} AS ss FROM hits WHERE rank <= 6),
sent AS (SELECT query_id, rank, id, source_type, title, location, quantity, comparison, reason, terms, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS position FROM modes),
worded AS (SELECT *, {tokens('sentence')} AS ws FROM sent),
over AS (SELECT *, len(list_filter(ws, lambda w: list_contains(terms, w))) AS o FROM worded),
signal AS (SELECT *, regexp_matches(sentence, {rx(X.QUANTITY)}) AS sq, regexp_matches(sentence, {rx(X.COMPARISON)}) AS sc, regexp_matches(sentence, {rx(X.REASON)}) AS sr FROM over WHERE o > 0),
marks AS (SELECT *, round(o + o / len(ws) + CASE WHEN quantity THEN CASE WHEN sq THEN 10 WHEN regexp_matches(sentence, '[0-9]') THEN 3 ELSE 0 END ELSE 0 END + CASE WHEN comparison AND sc THEN 8 ELSE 0 END + CASE WHEN reason AND sr THEN 8 ELSE 0 END, 6) AS score,
  substr(regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}_]+', '', 'g'), 1, 240) AS key FROM signal),
firsts AS (SELECT * FROM marks WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, rank, position) = 1),
tops AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, position) AS place0 FROM firsts QUALIFY place0 <= 10),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN CASE WHEN quantity THEN sq WHEN comparison THEN sc WHEN reason THEN sr ELSE true END THEN 0 ELSE 1 END, place0) AS place FROM tops),
num AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY fst) AS number FROM (SELECT *, min(place) OVER (PARTITION BY query_id, id) AS fst, row_number() OVER (PARTITION BY query_id, id ORDER BY place) AS nth FROM best)),
paras AS (SELECT query_id, number, id, string_agg({display('sentence')}, ' ' ORDER BY nth) AS paragraph, any_value({label('source_type', 'title', 'location')}) AS label FROM num WHERE nth <= 3 GROUP BY query_id, number, id)"""


def display(s: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({collapse(s)}, '^[.,;:|\- ]+', '')), '\s+([.,;:])', '\1', 'g')"


def label(kind: str, title: str, location: str) -> str:
    return f"(coalesce({kind}, 'source') || ': ' || coalesce(nullif({title}, ''), nullif({location}, ''), 'Untitled source') || ' :: ' || coalesce({location}, ''))"


def scheme(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"


def part(u: str, k: int) -> str:
    return rf"regexp_extract({u}, '(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', {k})"


def hostname(u: str) -> str:
    bare = rf"regexp_replace(lower({part(u, 1)}), '^[^@]*@', '')"
    return rf"CASE WHEN starts_with({bare}, '[') THEN regexp_extract({bare}, '^\[([^\]]*)\]', 1) ELSE regexp_replace({bare}, ':[0-9]*$', '') END"


def normalize(u: str) -> str:
    """For columns without characters that need quoting afresh; others go through url_encode."""
    t = f"trim(coalesce({u}, ''))"
    full = f"CASE WHEN {scheme(t)} = '' THEN 'https://' || regexp_replace({t}, '^//', '') ELSE {t} END"
    p = f"coalesce(nullif({part(full, 2)}, ''), '/')"
    quoted = f"replace(replace(replace(replace(url_encode({unquote(p)}), '%2F', '/'), '%25', '%'), '%3A', ':'), '%40', '@')"
    host = f"lower({part(full, 1)})"
    return f"CASE WHEN {t} = '' THEN '' ELSE {scheme(full)} || ':' || CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END || {quoted} || CASE WHEN {part(full, 3)} <> '' THEN '?' || {part(full, 3)} ELSE '' END END"


def drop_tracking(u: str) -> str:
    kept = f"array_to_string(list_filter(string_split({part(u, 3)}, '&'), lambda p: p <> '' AND NOT list_contains({arr(V.TRACKING)}, lower(split_part(p, '=', 1)))), '&')"
    return f"regexp_extract({u}, '^[^?#]*') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"


def on_hosts(h: str, hosts: list[str]) -> str:
    return "(" + " OR ".join(f"{h} = '{b}' OR ends_with({h}, '.{b}')" for b in hosts) + ")"


def is_blocked(u: str) -> str:
    return f"({scheme(u)} <> '' AND {hostname(u)} <> '' AND {on_hosts(hostname(u), V.BLOCKED_HOSTS)})"


def wiki_title(u: str) -> str:
    return f"lower(trim(replace({unquote(f"regexp_extract({part(u, 2)}, '/wiki/([^/#?]+)', 1)")}, '_', ' ')))"


def offtopic(u: str, topic: str) -> str:
    return f"(contains({hostname(u)}, 'wikipedia.org') AND list_contains({arr(V.FUNCTION_WORDS)}, {wiki_title(u)}) AND NOT coalesce(list_contains({topic}, {wiki_title(u)}), false))"


def html_text(h: str) -> str:
    from ..functions.html import BLOCKS, ENTITIES, SKIPPED

    t = f"regexp_replace(coalesce({h}, ''), '(?s)<!--.*?-->', '', 'g')"
    for tag in SKIPPED:
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*/>', '', 'g')"
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>', chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, value in ENTITIES:
        t = f"replace({t}, {lit(name)}, {lit(value)})"
    t = rf"regexp_replace({t}, '[ \t\r\f\x0B]+', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g')"
    return rf"regexp_replace({t}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


def entities(t: str) -> str:
    masked = rf"regexp_replace({t}, '[\p{{L}}\p{{N}}_]*[^\x00-\x7F][\p{{L}}\p{{N}}_]*', '~', 'g')"
    return rf"list_filter(regexp_extract_all({masked}, '\b[A-Z][A-Za-z0-9_]*(?:[ -][A-Z][A-Za-z0-9_]*){{0,4}}\b'), lambda x: length(x) >= 3 AND NOT list_contains({arr(V.NOT_ENTITIES)}, x))"
