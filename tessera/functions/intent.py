"""What a question asks for, and how well a text fits that."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import let, strings, words
from .urls import unquote

YEAR = r"\b(?:1[5-9][0-9]{2}|20[0-2][0-9])\b"
WORK = r"(?i)\((?:album|song|single|ep|band|soundtrack|mixtape|film|movie|tv series|television series|novel|book|magazine|comics|video game|game|play|musical|opera)\)"
CAP, STRONG = 4, {"<person>": 2.0, "<year>": 1.5}
PENALTY, WEIGHTS = 1.5, {"<work-of-art>": 3.0, "<generic-concept>": 1.5}


def query_words(query: Column) -> Column:
    return words(F.lower(query), r"[a-z0-9][a-z0-9'\-]*")


def has_phrase(w: Column, phrases: list[str]) -> Column:
    line = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return let(line, lambda x: reduce(lambda a, b: a | b, [x.contains(f" {p} ") for p in phrases]))


def detect(query: Column) -> Column:
    def of(w: Column) -> Column:
        has = lambda items: F.arrays_overlap(w, strings(items))
        made = has(V.CREATION_VERBS)
        why = has_phrase(w, V.EXPLANATION_PHRASES) | F.get(w, F.lit(0)).isin(V.EXPLANATION_LEADS)
        return (
            F.when(F.size(w) == 0, V.GENERAL)
            .when(has_phrase(w, V.STATISTIC_PHRASES) | has(V.STATISTIC_WORDS), V.STATISTIC)
            .when(~(made & F.array_contains(w, "who")) & why, V.EXPLANATION)
            .when(made & has(V.PRODUCTS), V.INVENTOR)
            .when(made & has(V.COMPANIES), V.FOUNDER)
            .when(made, V.INVENTOR)
            .otherwise(V.GENERAL)
        )

    return let(query_words(query), of)


def wants_person(query: Column) -> Column:
    return F.array_contains(query_words(query), "who")


def wants_date(query: Column) -> Column:
    return has_phrase(query_words(query), V.WHEN_PHRASES)


def haystack(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _plain(entry: str) -> str:
    return re.sub("[^a-z0-9]+", " ", entry).strip()


def matches(line: Column, vocabulary: Column, patterns: Column) -> Column:
    """Entries of vocabulary whose pattern is in line, a padded haystack; in vocabulary order."""
    return F.filter(vocabulary, lambda v, i: line.contains(F.get(patterns, i)))


def _pattern(entry: str) -> str:
    """A phrase is found anywhere, a word as a whole token."""
    p = _plain(entry)
    return p if " " in p else f" {p} "


def by_intent(intent: Column, lists: dict[str, list[str]], make=lambda x: x) -> Column:  # noqa: ANN001
    out = F
    for name in V.INTENTS:
        out = out.when(intent == name, strings([make(x) for x in lists[name]]))
    return out.otherwise(strings([]))


def is_name(text: Column) -> Column:
    """Two or three capitalised words, the middle one perhaps an initial; no digit, no word of institutions or works."""
    def shaped(raw: Column) -> Column:
        return raw.rlike(r"^[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|[A-Z]\.?))?\s+[A-Z][a-z]+$") & ~F.arrays_overlap(F.split(F.lower(raw), r"\s+"), strings(V.NOT_NAMES))

    raw = F.trim(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"\s*\([^)]*\)\s*$", ""))
    return F.coalesce(let(raw, shaped), F.lit(False))


def candidates(text: Column) -> Column:
    """The text, and its last path segment if it has the form of an address."""
    def both(raw: Column) -> Column:
        path = F.regexp_extract(raw, r"(?s)^[^?#]*", 0)
        last = F.regexp_replace(unquote(F.regexp_extract(path, r"(?s)([^/]+)/*$", 1)), r"(?i)\.(?:html?|php|aspx?)$", "")
        slashes = F.length(raw) - F.length(F.replace(raw, F.lit("/"), F.lit("")))
        second = let(last, lambda x: F.when((raw.contains("//") | (slashes >= 2)) & (x != ""), x))
        return F.array_distinct(F.array_compact(F.array(F.nullif(raw, F.lit("")), second)))

    return let(F.trim(F.coalesce(text, F.lit(""))), both)


def any_name(text: Column) -> Column:
    return F.exists(candidates(text), is_name)


def is_generic(text: Column, topic: Column) -> Column:
    """A page titled by one bare concept that the question is not about. The first such title settles it."""

    def plain(x: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), r"\s*\([^)]*\)\s*$", "")))

    titles = F.filter(F.transform(candidates(text), plain), lambda x: x.isin(V.GENERIC_TITLES))
    return let(F.get(titles, F.lit(0)), lambda x: F.coalesce(x.isNotNull() & ~F.coalesce(F.array_contains(topic, x), F.lit(False)), F.lit(False)))


def score(text: Column, intent: Column, query: Column, topic: Column | None = None) -> Column:
    """A struct (delta, boosts, penalties): how well text fits intent."""
    none = strings([])
    if_ = lambda c, x: F.when(c, strings([x])).otherwise(none)
    dated_lists = {n: list(dict.fromkeys(V.BOOSTS[n] + V.DATE_BOOSTS)) for n in V.INTENTS}
    generic = is_generic(text, topic) if topic is not None else F.lit(False)
    flags = F.struct(
        F.concat(F.lit(" "), haystack(text), F.lit(" ")).alias("line"),
        wants_date(query).alias("dated"),
        (intent.isin(V.FOUNDER, V.INVENTOR) & wants_person(query) & any_name(text)).alias("person"),
        F.coalesce(text, F.lit("")).rlike(WORK).alias("work"),
        generic.alias("generic"),
    )

    def found(f: Column) -> Column:
        line, dated = f["line"], f["dated"]
        pick = lambda make: F.when(dated, by_intent(intent, dated_lists, make)).otherwise(by_intent(intent, V.BOOSTS, make))
        return F.struct(
            F.slice(matches(line, pick(lambda x: x), pick(_pattern)), 1, CAP).alias("counted"),
            matches(line, by_intent(intent, V.PENALTIES), by_intent(intent, V.PENALTIES, _pattern)).alias("bad"),
            (dated & line.rlike(YEAR)).alias("year"),
            f["person"].alias("person"),
            f["work"].alias("work"),
            f["generic"].alias("generic"),
            (line != "  ").alias("some"),
        )

    def summed(x: Column) -> Column:
        up = F.size(x["counted"]) + F.when(x["year"], STRONG["<year>"]).otherwise(0.0) + F.when(x["person"], STRONG["<person>"]).otherwise(0.0)
        down = F.size(x["bad"]) + F.when(x["work"], WEIGHTS["<work-of-art>"]).otherwise(0.0) + F.when(x["generic"], WEIGHTS["<generic-concept>"]).otherwise(0.0)
        return F.struct(
            F.when(x["some"], up - PENALTY * down).otherwise(0.0).alias("delta"),
            F.when(x["some"], F.concat(x["counted"], if_(x["year"], "<year>"), if_(x["person"], "<person>"))).otherwise(none).alias("boosts"),
            F.when(x["some"], F.concat(x["bad"], if_(x["work"], "<work-of-art>"), if_(x["generic"], "<generic-concept>"))).otherwise(none).alias("penalties"),
        )

    return let(let(flags, found), summed)


def describe(intent: Column, query: Column) -> Column:
    dates = F.when(wants_date(query), " with dates").otherwise("")
    return F.when(intent == V.GENERAL, "general: by shared terms only").otherwise(F.concat(intent, dates))
