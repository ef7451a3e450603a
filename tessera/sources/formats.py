"""Text of files by their kind. Plain formats are expressions; containers are opened in Arrow batches."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import html as H
from ..functions import vocab as V

TEXT_BYTES, PDF_BYTES = 5_000_000, 10_000_000


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]*$", 0))


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]+)$", 1)


def is_supported(path: Column) -> Column:
    return suffix(path).isin(V.TEXT_SUFFIXES + V.CONTAINER_SUFFIXES) | file_name(path).isin(V.BARE_NAMES)


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Supported files below paths, each once: (path, modificationTime, length, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.where(is_supported(F.col("path"))).dropDuplicates(["path"])


def decode(content: Column, most: int = TEXT_BYTES) -> Column:
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def csv_text(raw: Column) -> Column:
    """A line for each row with something in it, cells trimmed; for input without quoted cells."""
    rows = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r?\n"), lambda r: F.array_join(F.transform(F.split(r, ","), lambda c: F.trim(c)), " | "))
    return F.array_join(F.filter(rows, lambda r: F.translate(r, "| ", "") != ""), "\n")


def tsv_text(raw: Column) -> Column:
    return F.replace(F.coalesce(raw, F.lit("")), F.lit("\t"), F.lit(" | "))


def rtf_text(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"\\'[0-9A-Fa-f][0-9A-Fa-f]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[A-Za-z]+-?[0-9]* ?", " "), r"[{}]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def json_text(raw: Column) -> Column:
    """Keys sorted; what is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), raw)


def jsonl_text(raw: Column) -> Column:
    # try_parse_json can't take a lambda variable, so lines are parsed as one array where all are JSON, else kept
    lines = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    return F.array_join(lines, "\n")


@F.pandas_udf(StringType())
def indented_json(raw: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False)
        except ValueError:
            return x

    return raw.map(one)


@F.pandas_udf(StringType())
def indented_jsonl(raw: pd.Series) -> pd.Series:
    def line(x: str) -> str:
        try:
            return json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False)
        except ValueError:
            return x

    return raw.map(lambda t: None if t is None else "\n".join(line(x) for x in t.splitlines() if x.strip()))


@F.pandas_udf(StringType())
def quoted_csv(raw: pd.Series) -> pd.Series:
    """csv_text for input with quoted cells and line ends in them; on a broken file each raw line, commas replaced."""
    import csv

    def one(x: str | None) -> str:
        try:
            rows = list(csv.reader(io.StringIO(x or "")))
        except csv.Error:
            return "\n".join(r.replace(",", " | ") for r in (x or "").splitlines())
        return "\n".join(" | ".join(c.strip() for c in r) for r in rows if any(c.strip() for c in r))

    return raw.map(one)


def _xml(data: bytes) -> str:
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return ""
    return "\n".join(t.strip() for t in root.itertext() if t.strip())


def _members(kind: str, names: list[str]) -> list[str]:
    if kind == "docx":
        return [n for n in names if n.startswith("word/") and n.endswith(".xml")]
    if kind == "pptx":
        return sorted(n for n in names if re.match(r"ppt/(slides|notesSlides)/[^/]+\.xml$", n))
    if kind == "xlsx":
        return [n for n in names if n == "xl/sharedStrings.xml"] + sorted(n for n in names if re.match(r"xl/worksheets/[^/]+\.xml$", n))
    return [n for n in names if n == "content.xml"]


_LITERAL = re.compile(rb"\(((?:\\.|[^()\\])*)\)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)


def _pdf(data: bytes) -> str:
    def shown(part: bytes) -> Iterator[str]:
        for m in _LITERAL.finditer(part):
            yield re.sub(rb"\\([()\\])", rb"\1", m.group(1)).decode("latin-1")

    data = data[:PDF_BYTES]
    out = list(shown(data))
    for m in _STREAM.finditer(data):
        try:
            out += shown(zlib.decompress(m.group(1)))
        except zlib.error:
            continue
    return " ".join(" ".join(out).split())


def container(kind: str, data: bytes | None) -> str:
    """Text of a container's bytes; an unreadable one raises."""
    if kind == "pdf":
        return _pdf(data or b"")
    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
        return "\n".join(x for x in (_xml(z.read(n)) for n in _members(kind, z.namelist())) if x)


def extract(files: DataFrame) -> DataFrame:
    """(path, extension, text, error) of discovered files; one that can't be read gets an error and no text."""
    kinds = V.CONTAINER_SUFFIXES

    def open_containers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, data in zip(b["path"], b["extension"], b["content"]):
                try:
                    rows.append((path, kind, container(kind, data), None))
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed job
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "extension", "text", "error"])

    named = files.select("path", suffix(F.col("path")).alias("extension"), "content")
    packed = named.where(F.col("extension").isin(kinds)).mapInPandas(open_containers, "path string, extension string, text string, error string")
    raw, ext = decode(F.col("content")), F.col("extension")
    plain = named.where(~ext.isin(kinds)).select("path", "extension", raw.alias("raw"))
    r = F.col("raw")
    text = F.when(ext == "csv", quoted_csv(r)).when(ext == "tsv", tsv_text(r)).when(ext == "json", indented_json(r)).when(ext.isin("jsonl", "ndjson"), indented_jsonl(r)).when(ext == "rtf", rtf_text(r)).when(ext.isin("html", "htm", "svg"), H.text(r)).otherwise(r)
    return plain.select("path", "extension", text.alias("text"), F.lit(None).cast("string").alias("error")).unionByName(packed)


