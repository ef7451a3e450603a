"""Quality classifier by a weak-label model.

1. LABELLERS, overlapping heuristics over counts of a document's characters and words, vote good, bad or abstain.
2. The number of documents with each pattern of votes is counted over all documents (at most 3 ** labellers rows).
3. Expectation-maximisation over the patterns estimates the share of good documents and what each labeller votes for
   good and for bad ones; that gives every pattern its posterior.
4. A logistic scorer over hashed features (shapes of items and of pairs of neighbours, as shares of the document) is
   trained on the posteriors of at most SAMPLE documents, those of distinct text of the least hashes, and scores every document. Its
   bias is the prior's log odds, and shares are shrunk by SHRINK items, so a document of few items is near the prior.
A document is kept if the scorer gives it at least KEEP, so it goes only at odds of three to one against it.

Defined cases: null and empty texts, and those without an item, get no vote, score 0 and are rejected. Null ids are
scored. Repeated rows get equal scores. An empty table gives an empty result, with nothing trained. If all documents
have one pattern, the posterior is the prior's and nothing is rejected. Texts are read whole. Other columns pass
through keep_good() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._stage import fresh, lean

SAMPLE = 10_000
KEEP = 0.25
BUCKETS = 1 << 13
LABELLERS = ["symbols", "repeats", "echoes", "stretch", "capitals", "bars", "shouts", "stops", "letters"]
#: Items by which a document's shares are shrunk, so that a short one is near the prior.
SHRINK = 8
GOOD, BAD, NONE = 1, 0, 2

_ITEM = np.ones(256, np.uint8)
_ITEM[[9, 10, 11, 12, 13, 32]] = 0
_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, np.uint8) for _ in range(5))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "#$%&*|^~<>{}[]\\=_@+/"]] = 1
_STOP[[ord(c) for c in ".?"]] = 1
_LAST = np.zeros(256, np.int64)
for _i, _s in enumerate((".?", ",;:", "!", "|", "#$%&*^~=_<>", "0123456789"), 1):
    _LAST[[ord(c) for c in _s]] = _i


class Items:
    """The items (runs of other than white space) of texts, with counts of their characters."""

    def __init__(self, texts: pa.Array) -> None:
        buf, offsets = X.raw(texts)
        starts, ends, self.first = X.bounds(buf, offsets, _ITEM)
        self.n = np.diff(self.first)
        hashes = X.span_hashes(buf, starts, ends)
        self.same = np.zeros(len(starts), np.int64)
        if len(starts):
            self.same[1:] = hashes[1:] == hashes[:-1]
            self.same[self.first[:-1][self.n > 0]] = 0
        self.echo = np.zeros(len(starts), np.int64)
        if len(starts) > 3:
            # the item is that of two or three places before, in the same text
            place = np.arange(len(starts)) - np.repeat(self.first[:-1], self.n)
            self.echo[2:] = (hashes[2:] == hashes[:-2]) & (place[2:] >= 2)
            self.echo[3:] |= (hashes[3:] == hashes[:-3]) & (place[3:] >= 3)

        def count(table: np.ndarray) -> np.ndarray:
            total = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(table[buf], out=total[1:])
            return (total[ends] - total[starts]).astype(np.int64)

        self.size = ends - starts
        self.upper, self.lower, self.digit, self.symbol = (count(t) for t in (_UPPER, _LOWER, _DIGIT, _SYMBOL))
        self.last = _LAST[buf[ends - 1]] if len(starts) else np.zeros(0, np.int64)
        self.bar = ((self.size == 1) & (self.last == 4)).astype(np.int64)

    def share(self, what: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        under = self.n if of is None else X.segment_sums(of, self.first)
        return X.segment_sums(what, self.first) / np.maximum(1, under)

    def votes(self) -> np.ndarray:
        """A row for each text, a column for each labeller."""

        def vote(x: np.ndarray, good: float, bad: float) -> np.ndarray:
            """good up to good and bad from bad on, for good < bad; the other way round for good > bad."""
            up = good < bad
            return np.where(x <= good if up else x >= good, GOOD, np.where(x >= bad if up else x <= bad, BAD, NONE))

        letters = self.upper + self.lower
        v = np.stack(
            [
                vote(self.share(self.symbol, self.size), 0.01, 0.06),
                vote(self.share(self.same), 0.03, 0.15),
                vote(self.share(self.echo), 0.04, 0.15),
                vote(self.share(self.same * np.concatenate([[0] * bool(len(self.same)), self.same[:-1]])), 0.005, 0.05),
                vote(self.share(self.upper, letters), 0.12, 0.25),
                vote(self.share(self.bar), 0.02, 0.15),
                vote(self.share((self.last == 3).astype(np.int64)), 0.05, 0.15),
                vote(self.share((self.last == 1).astype(np.int64)), 0.03, 0.01),
                vote(self.share(letters, self.size), 0.85, 0.75),
            ],
            1,
        )
        v[self.n == 0] = NONE
        return v

    def buckets(self) -> np.ndarray:
        """Two hashed features of each item: of its shape, and of its and the former item's."""
        size = np.minimum(np.searchsorted([2, 4, 7, 11, 20], self.size), 5)
        capitals = np.where(self.upper == 0, 0, np.where((self.lower == 0) & (self.upper > 1), 2, 1))
        shape = ((((size * 3 + capitals) * 3 + np.minimum(self.digit, 2)) * 4 + np.minimum(self.symbol, 3)) * 7 + self.last) * 2 + self.same
        before = np.concatenate([[0], shape[:-1]]) + 1 if len(shape) else shape
        if len(shape):
            before[self.first[:-1][self.n > 0]] = 0
        pair = shape * 8191 + before + (1 << 40)
        return (X.mix(np.stack([shape, pair]).astype(np.uint64)) >> np.uint64(64 - 13)).astype(np.int64)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets that each text has, their shrunk shares, and the n + 1 offsets of the texts."""
        b, d = self.buckets(), np.repeat(np.arange(len(self.n)), self.n)
        codes, counts = np.unique(np.concatenate([d * BUCKETS + row for row in b]), return_counts=True)
        row = codes // BUCKETS
        return (codes % BUCKETS).astype(np.int32), (counts / (self.n[row] + SHRINK)).astype(np.float32), np.searchsorted(row, np.arange(len(self.n) + 1))

    def score(self, weights: np.ndarray, bias: float) -> np.ndarray:
        b = self.buckets()
        z = bias + X.segment_sums(weights[b[0]] + weights[b[1]], self.first) / (self.n + SHRINK)
        return np.where(self.n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each pattern; share of good; (labeller, class, vote) probabilities."""
    m = patterns.shape[1]
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    # a start by the majority, in which one vote of bad weighs three of good
    post = np.where(good + bad == 0, 0.5, np.clip((good + 0.5) / (good + 3 * bad + 1), 0.02, 0.98))
    prior, theta = 0.5, np.zeros((m, 2, 3))
    for _ in range(rounds):
        prior = float((post * counts).sum() + 1) / (counts.sum() + 2)
        for k in range(m):
            for v in range(3):
                on = patterns[:, k] == v
                theta[k, 1, v] = (post[on] * counts[on]).sum() + 0.5
                theta[k, 0, v] = ((1 - post[on]) * counts[on]).sum() + 0.5
        theta /= theta.sum(2, keepdims=True)
        like = np.log([1 - prior, prior]) + sum(np.log(theta[k, :, patterns[:, k]]) for k in range(m))
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, prior, theta


def fit(at: np.ndarray, share: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float, rounds: int = 300) -> np.ndarray:
    """Logistic weights by Adam on the weighted log likelihood, lightly L2-regularised; the bias is given.

    The texts' features are sparse: buckets at and their shares, each text's from first[i] to first[i + 1].
    """
    row = np.repeat(np.arange(len(y)), np.diff(first))
    seen = np.bincount(at, minlength=BUCKETS) > 0
    v, m1, m2 = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(X.segment_sums(v[at] * share, first) + bias, -50, 50)))
        e = (y - p) * weight / weight.sum()
        g = np.bincount(at, share * e[row], BUCKETS) - 1e-5 * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        v += seen * 0.3 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
    return v


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n): how many documents have each pattern, one digit for each labeller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 3 ** np.arange(len(LABELLERS))
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for b in X.chunks(batch, "text"):
                items = Items(b.column("text"))
                total += np.bincount((items.votes() * powers).sum(1)[items.n > 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pattern", "n"])

    lean(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Weights and bias of the scorer; None if there is no document with an item."""
    rows = vote_patterns(docs, text).collect()  # at most 3 ** labellers rows
    if not rows:
        return None
    codes = np.array(sorted(r[0] for r in rows), np.int64)
    counts = np.array([n for _, n in sorted(map(tuple, rows))], np.float64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    post, prior, _ = em(patterns, counts)
    bias = float(np.log(prior / (1 - prior)))
    table = np.full(3 ** len(LABELLERS), 0.5)
    table[codes] = post
    total = int(counts.sum())
    # distinct texts of the least hashes: what lies below a bound is made ready, and the bound raised until it is enough
    key = F.xxhash64(text)
    some = docs.where(F.col(text).isNotNull())

    # equal texts have equal keys: a group of copies comes in whole or not, and counts once
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for b in X.chunks(batch, "text"):
                items = Items(b.column("text"))
                at, value, first = items.sparse()
                first = pa.array(first.astype(np.int32))
                code = pa.array((items.votes() * powers).sum(1))
                out = pa.RecordBatch.from_arrays([b.column("k"), code, pa.ListArray.from_arrays(first, pa.array(at)), pa.ListArray.from_arrays(first, pa.array(value))], names=["k", "code", "at", "value"])
                yield out.filter(pa.array(items.n > 0))

    share = min(1.0, 1.2 * sample / total + 1e-9)
    while True:
        below = some if share >= 1 else some.where(key < F.lit(int(-(2**63) + share * 2**64)))
        rows = below.select(key.alias("k"), F.col(text).alias("text")).mapInArrow(features, "k long, code long, at array<int>, value array<float>")
        got = rows.groupBy("k").agg(F.min(F.struct("code", "at", "value")).alias("r")).orderBy("k").limit(sample).select("r.*").toArrow()
        if share >= 1 or got.num_rows >= sample:
            break
        share = min(1.0, share * max(2.0, 1.3 * sample / max(1, got.num_rows)))  # many rows are copies
    y = table[got.column("code").to_numpy()]
    at, value = (np.concatenate([c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in got.column(n).chunks]) for n in ("at", "value"))
    first = np.concatenate([[0], np.cumsum([len(x) for x in got.column("at")])])
    bad = max(1e-9, float((1 - y).sum()))
    lift = min(10.0, max(1.0, float(y.sum()) / bad))  # the rarer class weighs as much as the other
    return fit(at, value, first, y, y + (1 - y) * lift, bias), bias


def scores(docs: DataFrame, model: tuple[np.ndarray, float] | None = None, keep: float = KEEP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, kept) of each document."""
    lean(docs.sparkSession)
    weights, bias = model or train(docs, text) or (np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in X.chunks(batch, "text"):
                s = np.round(Items(b.column("text")).score(shared.value, bias), 6)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(s >= keep)], names=["doc_id", "score", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float] | None = None, keep: float = KEEP, text: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    lean(docs.sparkSession)
    weights, bias = model or train(docs, text) or (np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at, schema = docs.columns.index(text), to_arrow_schema(docs.schema)
    name = fresh(docs, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = pa.RecordBatch.from_arrays([*batch.columns, batch.column(at)], names=[*map(str, range(batch.num_columns)), name])
            for c in X.chunks(b, name):
                on = Items(c.column(name)).score(shared.value, bias).round(6) >= keep
                cols = [c.column(k).filter(pa.array(on)) for k in range(len(schema))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(cols, schema)], schema=schema)

    return docs.mapInArrow(run, docs.schema)
