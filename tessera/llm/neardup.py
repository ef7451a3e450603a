"""MinHash near-duplicates by sequential Bayesian verification.

1. One narrow pass makes, of each document's distinct word 5-grams, BANDS x ROWS minimum hashes for banding and CHECKS
   further ones, of 8 bits each, for the estimate; and a 128-bit hash of the whole word sequence.
2. Documents of equal word sequence are one group at once; the least id of each stands for it from here on.
3. Pairs that share a band are compared in batches of BATCH check hashes. After each batch a pair is dropped if the
   posterior probability of a similarity of THRESHOLD or more (uniform prior, binomial likelihood) is under MISS.
4. Survivors are verified exactly: the Jaccard similarity of their sets of 64-bit 5-gram hashes is computed.
5. Verified pairs are joined to groups (see _cluster). No bucket, partner or candidate is capped.

Documents are never shuffled whole but for those of step 4, and only their 5-gram hashes.

Defined cases: null and empty texts and those without a word belong to no group. Texts of fewer than 5 words have one
gram, all their words. Rows of null id belong to no group. Rows of one id are one document: the union of their grams
is not taken, each is compared, and they are one group from the start. Ties go to the least id. Very long texts are
read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._cluster import clusters, copies, has_repeats, merged
from ._stage import counted, fresh, lean, staged, unstage

GRAM = 5
BANDS, ROWS = 40, 4
CHECKS, BATCH = 64, 16
THRESHOLD = 0.5
MISS = 0.005


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    n = BANDS * ROWS + CHECKS
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum hashes, a row for each function, of the texts whose grams begin at first; none may be empty."""
    a, b = _multipliers()
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out, v = np.empty((len(a), len(first)), np.uint32), np.empty(len(x), np.uint32)
    for k in range(len(a)):
        np.multiply(x, a[k], out=v)
        np.add(v, b[k], out=v)
        np.bitwise_xor(v, v >> np.uint32(15), out=v)
        np.minimum.reduceat(v, first, out=out[k])
    return out


SIGNED = "id long, k1 long, k2 long, bands array<long>, checks binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in X.chunks(batch, "text"):
            w = X.words(b.column("text"))
            grams, at, doc = w.grams(GRAM)
            has = np.flatnonzero(w.counts > 0)
            if not len(has):
                continue
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            s = signatures(grams, first)
            bands = np.zeros((BANDS, len(has)), np.uint64)
            for k in range(BANDS):
                h = np.full(len(has), k + 1, np.uint64)
                for r in s[k * ROWS : (k + 1) * ROWS]:
                    h = X.mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + r)
                bands[k] = h
            checks = np.ascontiguousarray((s[BANDS * ROWS :] * np.uint32(0x9E3779B1) >> np.uint32(24)).T.astype(np.uint8))
            # two hashes of the word sequence: sums of word hashes times a mix of their place
            place = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], w.counts)
            keys = [X.mix(np.add.reduceat(w.hashes * (X.mix(place.astype(np.uint64) + np.uint64(salt)) | np.uint64(1)), w.first[:-1][has])) for salt in (1, 1 << 40)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(has)),
                    pa.array(keys[0].view(np.int64)),
                    pa.array(keys[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64))),
                    pa.array([r.tobytes() for r in checks], pa.binary()),
                ],
                names=["id", "k1", "k2", "bands", "checks"],
            )


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in X.chunks(batch, "text"):
            grams, _, doc = X.words(b.column("text")).grams(GRAM)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sets = [np.unique(grams[cut[i] : cut[i + 1]]).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "grams"])


@cache
def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches at which the posterior of a similarity of threshold or more is at least miss.

    A check matches with probability p = s + (1 - s) / 256. Under a uniform prior p is Beta(m + 1, n - m + 1) after m
    matches of n, whose upper tail is that of a binomial sum.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def bayes_keep(a: list[bytes], b: list[bytes], threshold: float, miss: float) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, CHECKS)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, CHECKS)
    alive, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen[alive] += (x[alive, part] == y[alive, part]).sum(1)
        alive = alive[seen[alive] >= least]
    keep = np.zeros(len(x), bool)
    keep[alive] = True
    return keep


def bayes_near(threshold: float, miss: float):  # noqa: ANN201
    """bayes_keep for check hashes, a row a function, that broadcast against each other (see _cluster)."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        seen = np.zeros(np.broadcast_shapes(x.shape[1:], y.shape[1:]), np.uint8)
        keep = np.ones(seen.shape, bool)
        for k, least in enumerate(least_matches(threshold, miss)):
            for f in range(k * BATCH, (k + 1) * BATCH):
                seen += x[f] == y[f]
            keep &= seen >= least
            if not keep.any():
                break
        return keep

    return near


def _filter_pairs(test):  # noqa: ANN001, ANN202
    """mapInArrow body: of rows (a, b, x, y) the (a, b) for which test(x, y) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(test(b.column("x").to_pylist(), b.column("y").to_pylist())))

    return run


def jaccard_keep(a: list[bytes], b: list[bytes], threshold: float) -> np.ndarray:
    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b)):
        n = (len(x) + len(y)) // 8
        if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort(kind="stable")  # two sorted runs
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = shared >= threshold * (n - shared)
    return keep


def attach(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, x, y): pairs with the value of either id."""
    left = pairs.join(table.select(F.col("id").alias("a"), F.col(value).alias("x")), "a")
    return left.join(table.select(F.col("id").alias("b"), F.col(value).alias("y")), "b").select("a", "b", "x", "y")


def groups(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id, kept) for each document of a group of two or more; group_id is the least id, which is kept."""
    lean(docs.sparkSession)
    slim = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = staged(slim.mapInArrow(_sign, SIGNED), "signed")
    # rows of one id are one document of several sequences; only rows of a sequence that a lesser id has leave the search
    repeats = has_repeats(signed)
    same = staged(copies(signed, ["k1", "k2"]), "same")
    key = ["id", "k1", "k2"] if repeats else ["id"]
    alone = signed.join(counted(same.select(*key)), key, "left_anti")
    members = alone.select(F.explode("bands").alias("bucket"), "id")
    if repeats:
        members = members.distinct()

    def verify(pairs: DataFrame, near: bool = False) -> DataFrame:
        if not near:
            pairs = attach(pairs, alone.select("id", "checks"), "checks").mapInArrow(_filter_pairs(lambda x, y: bayes_keep(x, y, threshold, miss)), "a long, b long").distinct()
        near = staged(pairs, "near")
        if near.isEmpty():
            return near
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = staged(slim.join(counted(ids), "id", "left_semi").mapInArrow(_gram_sets, "id long, grams binary"), "grams")
        found = staged(attach(near, sets, "grams").mapInArrow(_filter_pairs(lambda x, y: jaccard_keep(x, y, threshold)), "a long, b long").distinct(), "found")
        unstage(sets)
        return found

    roots = clusters(members, verify, alone.select("id", F.col("checks").alias("sketch")), bayes_near(threshold, miss))
    return merged(same, roots, repeats).select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), (F.col("id") == F.col("root")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group: all rows but those of ids that groups() does not keep.

    Repeated rows of one id: the first by text stays. Rows of null id, and texts without a word, all stay.
    """
    gone_id = fresh(docs, "gone")
    gone = counted(groups(docs, threshold, miss, doc_id, text).where("NOT kept").select(F.col("doc_id").alias(gone_id)))
    left = docs.join(gone, F.col(doc_id).cast("long") == F.col(gone_id), "left_anti")
    twice = staged(left.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias(gone_id)).count().where("count > 1").select(gone_id), "twice")
    if twice.isEmpty():
        return left
    few = counted(twice)
    rank = fresh(docs, "rank")
    again = left.join(few, F.col(doc_id).cast("long") == F.col(gone_id), "left_semi").withColumn(rank, F.row_number().over(W.partitionBy(doc_id).orderBy(text))).where(F.col(rank) == 1).drop(rank)
    return left.join(few, F.col(doc_id).cast("long") == F.col(gone_id), "left_anti").unionByName(again)
