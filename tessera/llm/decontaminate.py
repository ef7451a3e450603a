"""Benchmark decontamination by broadcast n-gram hash sets.

Words are normalised as in _text: width, case, accents and whatever stands between them don't matter, and in scripts
without spaces each character is a word. The normalised n-grams of the test items go to the executors as sorted 64-bit hashes with the words behind them. Each
document is scanned once, window by window; a hash that is found is compared word by word before it counts. The scan
is narrow: no document is shuffled. The index is broadcast in parts of at most INDEX_WORDS words, each scanned in turn
in the same stage, so that no broadcast grows with the benchmark.

Defined cases: null and empty texts, and texts without a word, have no hit and are kept as they are. Null ids are
allowed. Repeated rows are judged alike, each for itself. Items of fewer than MIN_WORDS words (null and empty among
them) are ignored; those of MIN_WORDS to n - 1 words are searched whole. An empty benchmark leaves everything as it is.
Texts of any length are scanned whole. Other columns pass through, whatever their names. A document whose hits cover
at least drop_share of its words is dropped; from others the spans are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._stage import fresh, lean

N = 8
MIN_WORDS = 5
DROP_SHARE = 0.5
INDEX_WORDS = 4_000_000


@dataclass
class Index:
    """Per window length: sorted hashes, a byte map of their leading bits, item and place of each; the items' words."""

    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    ids: list
    words: X.Words

    def item_gram(self, at: int, n: int) -> bytes:
        return self.words.text(at, at + n)


MAP_BITS = 22


def build_index(ids: list, texts: list[str | None], n: int) -> Index:
    w = X.words(pa.array(texts, pa.large_string()))
    counts, grams = w.counts, {}
    for size in sorted({min(int(c), n) for c in counts if c >= MIN_WORDS}):
        h, at, doc = X.windows(w, size)
        own = np.minimum(counts[doc], n) == size
        h, at, doc = h[own], at[own], doc[own]
        order = np.lexsort((at, doc, h))
        grams[size] = (h[order], at[order], doc[order])
    return Index(grams, ids, w)


def _hits(w: X.Words, index: Index, maps: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, words and item index of each verified hit."""
    found: list[tuple[int, int, int, int]] = []
    for size, (keys, places, items) in index.grams.items():
        h, at, doc = X.windows(w, size)
        some = np.flatnonzero(maps[size][(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        low = np.searchsorted(keys, h[some])
        real = low < len(keys)
        real[real] = keys[low[real]] == h[some][real]
        for i, k in zip(some[real], low[real]):
            gram = w.text(at[i], at[i] + size)
            while k < len(keys) and keys[k] == h[i]:
                if index.item_gram(places[k], size) == gram:
                    found.append((doc[i], at[i], size, items[k]))
                    break
                k += 1
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]
    return tuple(np.array(found, np.int64).T)  # type: ignore[return-value]


def _scan(column: str, hits: str, index_of, schema: pa.Schema):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_of.value
        maps = {}
        for size, (keys, _, _) in index.grams.items():
            maps[size] = np.zeros(1 << MAP_BITS, bool)
            maps[size][(keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
        for batch in batches:
            for b in X.chunks(batch, column):
                w = X.words(b.column(column))
                doc, at, size, item = _hits(w, index, maps)
                old = b.column(hits) if hits in b.schema.names else None
                lists: list = [None] * b.num_rows if old is None else old.to_pylist()
                for d, a, s, k in zip(doc.tolist(), at.tolist(), size.tolist(), item.tolist()):
                    lists[d] = (lists[d] or []) + [a - int(w.first[d]), s, k]
                cols = [b.column(x) for x in b.schema.names if x != hits] + [pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def scanned(docs: DataFrame, benchmark: DataFrame, hits: str, then, schema: T.StructType, n: int, text: str) -> DataFrame | None:  # noqa: ANN001
    """then, applied to batches of docs with a last column of hits; None if the benchmark has nothing to search for.

    Hits are triples (first word, words, item) in one flat list, null where there is none. An item is its item_id,
    which must be integral; a null one is given as -1. One part of the index, the usual case, is scanned and acted
    upon in one pass; of several parts each is a pass of its own, so that no worker holds two.
    """
    spark = docs.sparkSession
    lean(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("i"), F.col("text").alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = int(size // (4 * INDEX_WORDS)) + 1
    wide = T.StructType([*docs.schema.fields, T.StructField(hits, T.ArrayType(T.LongType()))])
    scans = []
    for p in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        rows = part.sort("i", "t").toPandas()
        index = build_index(rows["i"].tolist(), rows["t"].tolist(), n)
        if index.grams:
            ids = np.array(index.ids, np.int64)
            index.grams = {k: (h, at, ids[doc]) for k, (h, at, doc) in index.grams.items()}
            scans.append(_scan(text, hits, spark.sparkContext.broadcast(index), _arrow(wide)))
    if not scans:
        return None
    for scan in scans[:-1]:
        docs = docs.mapInArrow(scan, wide)
    last = scans[-1]
    return docs.mapInArrow(lambda batches: then(last(batches)), schema)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Word spans of flat triples, merged where they touch or overlap."""
    out: list[list[int]] = []
    for a, s in sorted(zip(spans[::3], spans[1::3])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + s)
        else:
            out.append([a, a + s])
    return [(a, b) for a, b in out]


REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_windows", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("words_removed", T.LongType()),
        T.StructField("first_item", T.LongType()),
    ]
)


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = DROP_SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each contaminated document: whether it is dropped or cut, and how much of it."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = _arrow(REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("hits").is_valid())
            if not b.num_rows:
                continue
            rows = []
            counts = X.words(b.column("text")).counts.tolist()
            for i, c, h in zip(b.column("doc_id").to_pylist(), counts, b.column("hits").to_pylist()):
                spans = merged(h)
                gone = sum(y - x for x, y in spans)
                rows.append((i, "drop" if gone >= drop_share * c else "cut", c, len({*zip(h[::3], h[1::3])}), len(spans), gone, min(h[2::3])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    found = scanned(slim, benchmark, "hits", run, REPORT, n, "text")
    return docs.sparkSession.createDataFrame([], REPORT) if found is None else found


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    w = X.words(pa.array([text], pa.large_string()))
    out, at = [], 0
    for a, b in spans:
        start, end = w.span(a, b)
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = DROP_SHARE, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs without the contaminated spans and documents; n_chars names a column that is to follow the text's length."""
    names, schema = docs.columns, _arrow(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index(text)
            column, lists = b.column(at), b.column(len(names))
            touched = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            cols = [b.column(k) for k in range(len(names))]
            if len(touched):
                some = pa.array(touched, pa.int64())
                texts, keep = column.to_pylist(), np.ones(b.num_rows, bool)
                counts = X.words(column.take(some)).counts.tolist()
                for i, c, h in zip(touched.tolist(), counts, lists.take(some).to_pylist()):
                    spans = merged(h)
                    left = cut_text(texts[i], spans) if sum(y - x for x, y in spans) < drop_share * c else None
                    keep[i] = left is not None
                    texts[i] = left
                cols[at] = pa.array(texts, schema.field(at).type)
                if n_chars:
                    k = names.index(n_chars)
                    fixed = cols[k].to_pylist()
                    for i in touched.tolist():
                        fixed[i] = len(texts[i]) if texts[i] is not None else None
                    cols[k] = pa.array(fixed, schema.field(k).type)
                cols = [c.filter(pa.array(keep)) for c in cols]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema)], schema=schema)

    found = scanned(docs, benchmark, fresh(docs, "hits"), run, docs.schema, n, text)
    return docs if found is None else found
