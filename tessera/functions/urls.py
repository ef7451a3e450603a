"""Columns over addresses. parse_url raises on bad input, so addresses are taken apart by pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import any_of, let, strings, words

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def hostname(url: Column) -> Column:
    """Authority without user and port; a bracketed address without brackets."""
    plain = lambda b: F.when(b.startswith("["), F.regexp_extract(b, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(b, r":[0-9]*$", ""))
    return let(F.regexp_replace(authority(url), r"^[^@]*@", ""), plain)


def unquote(text: Column) -> Column:
    """Percent escapes decoded, plus signs kept; the text itself if an escape is broken."""
    return let(text, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t))


_SAFE = [("+", "%20"), ("%2F", "/"), ("%25", "%"), ("%3A", ":"), ("%40", "@"), ("%7E", "~"), ("*", "%2A")]


def requote(text: Column) -> Column:
    """Percent escapes for all but letters, digits and ``_.-~/%:@``."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _SAFE, F.url_encode(unquote(text)))


def normalize(url: Column) -> Column:
    """https if no scheme, lower-case scheme and authority, a path, no fragment; '' for blank."""
    def complete(u: Column) -> Column:
        return F.when(scheme(u) == "", F.concat(F.lit("https://"), F.regexp_replace(u, "^//", ""))).otherwise(u)

    def rebuilt(full: Column) -> Column:
        p = F.coalesce(F.nullif(path(full), F.lit("")), F.lit("/"))
        tail = let(query(full), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        front = let(authority(full), lambda h: F.when(h != "", F.concat(F.lit("//"), h)).otherwise(""))
        return F.concat(scheme(full), F.lit(":"), front, requote(p), tail)

    return let(F.trim(F.coalesce(url, F.lit(""))), lambda u: F.when(u == "", "").otherwise(let(complete(u), rebuilt)))


def same_site(a: Column, b: Column) -> Column:
    return authority(a) == authority(b)


def drop_tracking(url: Column) -> Column:
    """url without tracking parameters and fragment; the others as they were written."""
    kept = F.filter(F.split(query(url), "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(V.TRACKING) & (p != ""))
    tail = let(F.array_join(kept, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), tail)


def parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]*)", 1)


def unwrap_first(url: Column) -> Column:
    """The target of a redirect that carries it, escaped up to three times, in uddg."""
    once = F.coalesce(F.try_url_decode(parameter(url, "uddg")), F.lit(""))
    thrice = let(let(let(once, unquote), unquote), unquote)
    return let(thrice, lambda t: F.when(authority(url).contains("duckduckgo.com") & t.rlike("^https?://"), t).otherwise(url))


def unwrap_second(url: Column) -> Column:
    """The target of a redirect that carries it in u: two letters, then unpadded URL-safe base64."""
    body = F.translate(F.substring(parameter(url, "u"), 3, 1 << 20), "-_", "+/")

    def decoded(b: Column) -> Column:
        padded = F.concat(b, F.repeat(F.lit("="), F.pmod(-F.length(b), F.lit(4)).cast("int")))
        return F.when(b.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))

    def chosen(good: Column) -> Column:
        wrapped = authority(url).contains("bing.com") & F.lower(path(url)).endswith("/ck/a") & good.rlike("^https?://")
        return F.when(F.coalesce(wrapped, F.lit(False)), good).otherwise(url)

    return let(let(body, decoded), chosen)


def bare_href(text: Column) -> Column:
    """The href of a stray anchor; other text trimmed."""
    pattern = r"""(?is)href=(?:"([^"]*)"|'([^']*)')"""

    def pulled(t: Column) -> Column:
        tagged = t.contains("<") & t.rlike(r"""(?is)^(?:(?!href=).)*href=(?:"[^"]*"|'[^']*')""")
        return F.when(tagged, F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2))).otherwise(t)

    return let(F.trim(F.coalesce(text, F.lit(""))), pulled)


def resolve(href: Column, base: Column) -> Column:
    """href made absolute against base: full, //host, /path, ?query, #fragment and relative forms, with . and .. folded."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))

    def fold(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, r"/\.(?=/|$)", "/"), "/")
        folded = F.aggregate(F.slice(parts, 2, 10_000), strings([]), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(folded, "/")), r"//+", "/")

    def relative(joined: Column) -> Column:
        p = let(F.regexp_extract(joined, r"^[^?#]*", 0), lambda x: F.when(x.rlike(r"(^|/)\.\.?(/|$)"), fold(x)).otherwise(x))
        return F.concat(root, p, F.regexp_extract(joined, r"[?#].*$", 0))

    folder = let(F.regexp_replace(path(base), r"[^/]*$", ""), lambda f: F.when(f == "", "/").otherwise(f))
    return let(
        href,
        lambda h: F.when(h.rlike(_SCHEME), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, path(base), h))
        .when(h.startswith("#") | (h == ""), F.concat(F.regexp_extract(base, r"^[^#]*", 0), h))
        .otherwise(let(F.concat(folder, h), relative)),
    )


def on_hosts(host: Column, hosts: list[str]) -> Column:
    """Whether host is one of hosts, or below one: an equality test for each of its suffixes."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^\.+|\.+$", ""), r"\.")
    suffixes = let(labels, lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.slice(a, i, F.size(a)), ".")))
    return F.arrays_overlap(suffixes, strings(hosts))


def is_blocked(url: Column, hosts: list[str] = V.BLOCKED_HOSTS) -> Column:
    return (scheme(url) != "") & let(hostname(url), lambda h: (h != "") & on_hosts(h, hosts))


def wiki_title(url: Column) -> Column:
    return F.lower(F.trim(F.replace(unquote(F.regexp_extract(path(url), r"/wiki/([^/#?]+)", 1)), F.lit("_"), F.lit(" "))))


def is_offtopic_wiki(url: Column, topic: Column) -> Column:
    off = let(wiki_title(url), lambda t: t.isin(V.FUNCTION_WORDS) & ~F.coalesce(F.array_contains(topic, t), F.lit(False)))
    return hostname(url).contains("wikipedia.org") & off


def is_junk(url: Column, topic: Column) -> Column:
    return is_blocked(url) | is_offtopic_wiki(url, topic)


def is_private_host(host: Column) -> Column:
    """Empty, local by name, or an address that is not of the public internet."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

    def judged(h: Column) -> Column:
        v4 = h.rlike(rf"^{octet}(\.{octet}){{3}}$")
        local4 = h.rlike(r"^(?:0|10|127|2[2-5][0-9])\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.0\.[02]\.|^198\.(?:1[89]|51)\.|^203\.0\.113\.")
        local6 = h.rlike(r"^(?:::1?|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|100::.*)$")
        named = h.isin("", "localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback") | h.endswith(".localhost") | h.endswith(".local")
        return named | (v4 & local4) | (h.contains(":") & local6)

    return let(F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"^\[+|\]+$", ""), judged)


def result_url(href: Column, base: Column) -> Column:
    """A search result's address: unwrapped, without tracking, normalised; null if it is none to visit."""
    def unescaped(t: Column) -> Column:
        for name, value in (("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(value))
        return t

    def checked(out: Column) -> Column:
        fine = let(hostname(out), lambda h: (h != "") & ~on_hosts(h, V.SEARCH_HOSTS) & ~on_hosts(h, V.BLOCKED_HOSTS))
        return F.when(scheme(out).isin("http", "https") & fine, out)

    def followed(raw: Column) -> Column:
        ignored = reduce(lambda a, b: a | b, [F.lower(raw).startswith(s) for s in V.IGNORED_SCHEMES])
        full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(resolve(raw, base))
        out = let(let(let(let(full, unwrap_first), unwrap_second), drop_tracking), normalize)
        return F.when((raw != "") & ~ignored, let(out, checked))

    return let(unescaped(bare_href(href)), followed)


def intent_text(url: Column) -> Column:
    return F.replace(unquote(url), F.lit("_"), F.lit(" "))


def url_words(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text), "[a-z0-9]+"))


def has_marker(p: Column) -> Column:
    return any_of(p, V.LISTING_MARKERS)
