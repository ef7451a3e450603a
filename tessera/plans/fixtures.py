"""Literal tables, the same rows for Spark and for SQL."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession


class Table:
    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A common table expression, to follow WITH or a comma."""
        cols = [c.strip().split(" ", 1) for c in _split(self.schema)]
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}

        def lit(v: object, kind: str) -> str:
            if v is None:
                return f"CAST(NULL AS {kinds[kind]})"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, list):
                return "CAST([" + ", ".join(lit(x, "string") for x in v) + "] AS VARCHAR[])"
            return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

        body = ", ".join("(" + ", ".join(lit(v, k) for v, (_, k) in zip(r, cols)) + ")" for r in self.rows)
        names = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in cols)
        return f"{self.name} AS (SELECT {names} FROM (VALUES {body}) v({', '.join(n for n, _ in cols)}))"


def _split(schema: str) -> list[str]:
    return schema.split(", ")


QUESTIONS = Table(
    "questions", "query_id long, query string",
    [(1, "Who founded Netflix?"), (2, "who designed the loom and when was it made"), (3, "How many herons live by the lake?"), (4, "Why do tides rise?"), (5, "lighthouse"), (6, ""), (7, "?!"), (8, "who invented microsoft excel"), (9, "explain soil erosion"), (10, "how does a kiln work"), (11, "who wrote the census"), (12, "what year did Nintendo start"), (13, "who built how do"), (14, "population of otters"), (15, None), (16, "Is a kiln hotter than an oven, compared to a forge?"), (17, "when was the compass invented")],
)
JUDGED = Table(
    "judged", "id long, query string, text string",
    [
        (1, "who founded netflix", "The company history: founders, founding year, origin, established in 1997, biography"), (2, "who founded netflix", "Sign in to your account, download the app, pricing"),
        (3, "who designed the loom and when was it made", "An early pioneer developed the first loom in 1785, a timeline"), (4, "who designed the loom", "Loom (album)"),
        (5, "who designed the loom", "https://example.org/wiki/Ada_Weaver"), (6, "who designed the loom", "https://example.org/wiki/Invention"), (7, "how many herons", "An estimated 3 million herons, says a census survey"),
        (8, "how many herons", "breeds, adoption and names"), (9, "why do tides rise", "Because of a mechanism; the reason and the cause are explained"), (10, "lighthouse", "history company founder"),
        (11, "when was the compass invented", "chronology of the year 1405 and a century"), (12, "when was the compass invented", "in 2035 or 1499"), (13, "who founded netflix", ""), (14, "who founded netflix", None), (15, "who invented history", "https://example.org/History.html"),
    ],
)
NAMES = Table(
    "names", "id long, text string",
    [(1, "Ada Weaver"), (2, "Ada M. Weaver"), (3, "Ada Mary Weaver"), (4, "Ada"), (5, "History of Looms"), (6, "Ada Weaver (engineer)"), (7, "Weaver Group"), (8, "Ada Weaver 2"), (9, "ada weaver"), (10, "https://example.org/wiki/Ada_Weaver.html"), (11, "https://example.org/a/Ada%20Weaver?x=1"), (12, ""), (13, None), (14, "Ada Mary Jane Weaver"), (15, "Ada_Weaver"), (16, "Ada mary Weaver"), (17, "Ada M Weaver")],
)
CONCEPTS = Table(
    "concepts", "id long, text string, query string",
    [(1, "Invention", "who invented the loom"), (2, "Invention", "invention history"), (3, "https://example.org/wiki/History", "who made the loom"), (4, "History of looms", "who made the loom"), (5, "Technology (concept)", "who made it"), (6, "", "x"), (7, "https://example.org/wiki/Population", "population of otters")],
)
URLS = Table(
    "urls", "id long, raw string",
    [(1, "Example.ORG"), (2, "HTTP://Example.org:8080/A/b?Q=1#frag"), (3, "https://example.org"), (4, "//example.org/x"), (5, "https://example.org/a%28b%29"), (6, "https://example.org/a+b c"), (7, "https://example.org/é?x=ü"), (8, "  "), (9, ""), (10, None), (11, "https://example.org/a?utm_source=n&b=2&UTM_Medium=x"), (12, "https://example.org/?ref=1"), (13, "https://user@example.org/%7Eme/*")],
)
_u = lambda s: "a1" + base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
REDIRECTS = Table(
    "redirects", "id long, href string",
    [
        (1, "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.org%2Fa%3Fb%3D1&rut=x"), (2, "https://duckduckgo.com/l/?uddg=https%253A%252F%252Fexample.org%252Ftwice"), (3, "https://duckduckgo.com/l/?x=1"), (4, "https://duckduckgo.com/l/?uddg=notaurl"),
        (5, f"https://www.bing.com/ck/a?p=1&u={_u('https://example.org/deep/page?x=1')}&n=2"), (6, "https://www.bing.com/ck/a?u=a1!!!!"), (7, f"https://www.bing.com/search?u={_u('https://example.org')}"), (8, f"https://www.bing.com/ck/a?u={_u('ftp://example.org')}"), (9, "https://example.org/?uddg=https%3A%2F%2Fother.org"),
    ],
)
RESULTS_RAW = Table(
    "results_raw", "id long, href string",
    [(1, '<a class="r" href="https://example.org/a?gclid=1&amp;k=2">t</a>'), (2, "javascript:void(0)"), (3, "/wiki/Loom"), (4, "https://www.dictionary.com/browse/loom"), (5, "//example.org/b#c"), (6, "https://cc.bingj.com/cache"), (7, "ftp://example.org/x"), (8, ""), (9, "mailto:a@example.org"), (10, "../up?q=1"), (11, "https://sub.wordnik.com/x")],
)
HOSTS = Table(
    "hosts", "id long, url string",
    [(1, "https://wordnik.com/w"), (2, "https://www.wordnik.com/w"), (3, "https://notwordnik.com/w"), (4, "wordnik.com"), (5, "https://localhost/x"), (6, "http://printer.local/"), (7, "http://10.1.2.3/"), (8, "http://172.20.0.1/"), (9, "http://172.32.0.1/"), (10, "http://8.8.8.8/"), (11, "http://[::1]/"), (12, "http://[fe80::1]:80/"), (13, "http://[2606:4700::1111]/"), (14, "http://192.168.1.1:8080/a"), (15, "http://224.0.0.1/"), (16, "https://example.org/"), (17, "http://a.localhost/"), (18, "http://127.0.0.1/")],
)
WIKI = Table(
    "wiki", "id long, url string, topic array<string>",
    [(1, "https://en.wikipedia.org/wiki/Many", ["herons"]), (2, "https://en.wikipedia.org/wiki/Many", ["many"]), (3, "https://en.wikipedia.org/wiki/Heron", ["herons"]), (4, "https://example.org/wiki/Many", []), (5, "https://en.wikipedia.org/wiki/The?x=1", []), (6, "https://de.wikipedia.org/wiki/How_", ["kiln"]), (7, "https://en.wikipedia.org/", [])],
)
PROVIDED = Table(
    "provided", "query_id long, query string, provider string, provider_order int, position int, url string, title string",
    [
        (1, "how many herons live here", "one", 1, 1, "https://example.org/herons", "Herons"), (1, "how many herons live here", "one", 1, 2, "https://example.org/lakes", "Lakes"), (1, "how many herons live here", "two", 2, 1, "https://EXAMPLE.org/herons/", "Herons again"), (1, "how many herons live here", "two", 2, 2, "https://example.net/heron-count", "A heron count"),
        (1, "how many herons live here", "three", 3, 1, "https://example.com/a", "Flights"), (1, "how many herons live here", "three", 3, 2, "https://example.com/b", "Hotels"), (1, "how many herons live here", "three", 3, 3, "https://example.com/c", "Cars"),
        (2, "kiln", "one", 1, 1, "https://example.com/d", "Flights"), (2, "kiln", "one", 1, 2, "https://example.com/e", "Hotels"),
    ],
)
RANKED_URLS = Table(
    "ranked_urls", "query_id long, query string, position int, url string",
    [
        (1, "who invented the transistor", 1, "https://en.wikipedia.org/wiki/Invention"), (1, "who invented the transistor", 2, "https://en.wikipedia.org/wiki/History_of_the_transistor"), (1, "who invented the transistor", 3, "https://shop.example.com/products/transistor-datasheet"), (1, "who invented the transistor", 4, "https://www.youtube.com/watch?v=1"), (1, "who invented the transistor", 2, "https://en.wikipedia.org/wiki/History_of_the_transistor"),
        (2, "how many cats are in america", 1, "https://example.org/cat-breeds"), (2, "how many cats are in america", 2, "https://example.org/pet-population-statistics-america"), (2, "how many cats are in america", 3, "https://login.cats.com/"), (2, "how many cats are in america", 4, "https://example.org/"),
        (3, "weaving", 1, "https://weaving.example.org/about"), (3, "weaving", 2, "https://example.org/weave"), (3, "weaving", 3, "https://example.org/wiki/Ada_Weaver"),
    ],
)
BODIES = Table("bodies", "id long, body string", [(1, "<div>Please solve the CAPTCHA</div>"), (2, "Too Many Requests"), (3, "<p>herons</p>"), (4, None), (5, "rate limit"), (6, "anomaly.js")])
ROBOTS = Table("robots", "site_root string, rule_order int, path_prefix string, allow boolean", [("https://example.org", 1, "/open", True), ("https://example.org", 2, "/", False), ("https://example.net", 1, "/private", False)])
TO_FETCH = Table("to_fetch", "url string", [("https://example.org/open/a",), ("https://example.org/b",), ("https://example.net/private/x",), ("https://example.net/y?z=1",), ("https://example.com/",), ("ftp://example.com/",), ("http://10.0.0.1/",), ("https://example.org",)])
WEB = Table(
    "web", "url string, title string, text string, links array<string>, error string",
    [
        ("https://a.example/", "A", "alpha text", ["https://a.example/1", "https://a.example/2", "https://b.example/"], None), ("https://a.example/1", "A1", "one text", ["https://a.example/", "https://a.example/3"], None), ("https://a.example/2", "A2", "one text", ["https://a.example/4"], None),
        ("https://a.example/3", "A3", "", [], None), ("https://a.example/4", "A4", "four", [], None), ("https://b.example/", "B", "beta", ["https://b.example/1"], None), ("https://b.example/1", "B1", "gone", [], "timeout"),
    ],
)
ROOTS = Table("roots", "url string, position int", [("https://a.example/", 1), ("https://b.example/", 2), ("https://www.wordnik.com/", 3)])
SENTENCES = Table(
    "lines", "id long, sentence string",
    [(1, "About 3 million herons live by the lakes of the north."), (2, "Herons are 40 cm taller than most other birds."), (3, "Herons fish at dawn because the water is calm."), (4, "Nothing here is on topic at all, 5 percent."), (5, "Herons, herons and herons again."), (6, ""), (7, "  .,; Herons   wade , slowly  .")],
)
SOURCES = Table(
    "facts", "id long, source_type string, location string, title string, text string",
    [
        (1, "file", "/f/herons.txt", "Herons", "About 3 million herons live by the northern lakes. Herons fish at dawn because the water is calm then. The heron is taller than most egrets are."),
        (2, "web", "https://example.org/lakes", "Lakes", "The northern lakes hold many fish for herons. about 3 million herons live by the Northern lakes! Lakes freeze in the winter months of the year."),
        (3, "file", "/f/kilns.txt", "", "A kiln is hotter than an oven because it burns wood. Kilns have been built from brick since early times."),
        (4, "file", "/f/founders.txt", "History of the company", "Two founders, Ada Weaver and Tom Loomis, founded the company Netflix in a garage. Its early history and origin are in this biography."),
        (5, "web", "https://example.org/login", "Netflix sign in", "Sign in to your Netflix account. Netflix pricing, apps, support and help are on the next page of this site."),
    ],
)
NOTES = Table(
    "notes", "id long, title string, body string, collection_id long, created_at long, updated_at long",
    [(1, "Herons", "Herons and more herons by the lake", 1, 10, 20), (2, "Kiln", "The kiln is   hot", None, 11, 20), (3, "Lake", "A lake, the lake", 2, 12, 30), (4, "Empty", "nothing", 9, 13, 5)],
)
COLLECTIONS = Table("shelves", "id long, name string, description string, created_at long", [(1, "birds", "", 1), (2, "water", "lakes and rivers", 2), (3, "unused", "", 3)])
SHELVED = Table("shelved", "source_id long, collection_id long", [(1, 1), (2, 1), (2, 2), (3, 2)])
UPSERTS = Table(
    "upserts", "batch int, position int, source_type string, location string, title string, text string, size_bytes long, extension string",
    [(1, 1, "file", "/a.txt", "A", "first", 5, ".TXT"), (1, 2, "file", "/b.txt", " B ", " body ", -4, ".txt"), (2, 1, "file", "/a.txt", "A2", "second", 6, ".txt"), (2, 2, "web", "/a.txt", "other type", "same place", 9, ""), (2, 3, "file", "/c.txt", "blank", "  ", 0, ""), (2, 4, "file", " ", "no place", "text", 1, ""), (3, 1, "file", "/b.txt", "B", "body", 4, ".txt"), (3, 2, "web", "https://www.wordnik.com/x", "junk", "a word", 6, ".html")],
)
LOG = Table("log", "pos int, line string", [(1, "OK fetched"), (2, "  WARN slow "), (3, "SKIP robots"), (4, "WARN slow"), (5, "ERROR broke"), (6, "WARN a"), (7, "WARN b"), (8, "WARN c"), (9, "")])
TYPED = Table("typed", "id long, raw string", [(1, '"quoted"'), (2, "'single'"), (3, "\"mixed'"), (4, '"'), (5, "  spaced  "), (6, '""'), (7, None), (8, "plain"), (9, '" inner "')])
ASKED = Table("asked", "id long, query string", [(1, "How many  herons are there??"), (2, "  ?!  "), (3, "population of Otters"), (4, "How long is the Nile, really?"), (5, ""), (6, "the of and"), (7, "how much number"), (8, "Who's Ada Weaver;")])
FORMATS = Table(
    "formats", "id long, ext string, raw string",
    [(1, "csv", "a, b ,c\n,,\n1,2,3\n"), (2, "tsv", "a\tb\n1\t2"), (3, "rtf", "{\\rtf1\\ansi Hello \\b bold\\b0  w\\'f6rld.\\par}"), (4, "csv", ""), (5, "tsv", None), (6, "json", '{"b": 1, "a": [2, {"d": null, "c": "x"}]}'), (7, "json", "{bad"), (8, "jsonl", '{"b":1,"a":2}\n\n{"c":3}\nbad')],
)
PATHS = Table("paths", "id long, path string", [(1, "/x/a.TXT"), (2, "/x/b.docx"), (3, "/x/c.exe"), (4, "/x/README"), (5, "/x/.gitignore"), (6, "/x/Makefile"), (7, "/x/noext"), (8, "d.tar.gz"), (9, "/x.y/z"), (10, "/x/.env")])
WORDS = Table("vocab", "id long, word string", [(i, w) for i, w in enumerate("cats inventions transistor invented creators makers bus yes Ratings ratios nations rating has glasses weavers wonders ing s".split())])
