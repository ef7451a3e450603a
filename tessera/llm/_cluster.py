"""Clusters of rows that share buckets, without all pairs of a bucket.

1. Members are sorted by bucket and id over ranges of both, so a bucket of any size is spread over as many tasks as it
   fills; the least id of a bucket within a range is its pivot there. Pivots of one bucket in several ranges are linked.
2. Each id is verified against the pivot that it shares most buckets with, then against the others that it is still
   apart from. Linked ids need no further comparison, since their cluster is known.
3. In a bucket that still holds ids of several clusters, the sketches of every pair of ids apart are compared, in blocks
   of an array: small buckets many at once, large ones by parts of at most BLOCK members, each pair of parts a group of
   its own. Those that may hold are verified. No bucket, pair or partner is capped, dropped or sampled.

So a bucket of many copies costs one pair a member, and one of many unlike members some nanoseconds a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import counted, staged, unstage

#: Edges that the driver links by itself: 8 MB.
LOCAL_EDGES = 500_000
#: Members of a bucket whose pairs are listed; those of larger ones are the cells of a table of STEP rows.
SMALL, STEP = 48, (256, 2048)
#: Members of a part of a bucket: 1.5 MB of sketches.
BLOCK = 16_384
#: Members whose sketches are shuffled at once: so many an id, and this many at least.
AT_ONCE, LEAST_AT_ONCE = 4, 2_000_000
#: Whether pairs may hold, of sketches x and y, a row a byte, that broadcast against each other.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the least b of each a: combined before the exchange, so that a hub is not sorted in one task."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges and their roots: each takes the least root of its neighbours, and roots are followed to their own."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for of in (x, y, root[x], root[y]):
            np.minimum.at(new, of, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, root) for each id of the edges (a, b), root the least id that it is linked to.

    Up to local edges, a few MB, are linked on the driver; more by alternating large and small stars.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = _state(now)
    if was[0] <= local:
        table = now.toArrow()
        unstage(now)
        ids, roots = _components(*(table.column(c).to_numpy() for c in ("a", "b")))
        return edges.sparkSession.createDataFrame(pa.table({"id": ids, "root": roots}), "id long, root long")
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).withColumn("m", F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = staged(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        least = _with_least(down)
        small = least.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = staged(small, "edges")
        state = _state(new)
        unstage(now)
        unstage(down)
        now = new
        if state == was:
            break
        was = state
    root = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return root.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, id) in order: those of buckets of several, and the first and last, with the bucket's first id."""
    held = None  # the last row so far: bucket, id, pivot, whether the row before is of its bucket, whether it is the first

    def rows(buckets: np.ndarray, ids: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ids), pa.array(pivots)], names=["bucket", "id", "pivot"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, i = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "id"))
        first = held is None
        if not first:
            k, i = np.concatenate([[held[0]], k]), np.concatenate([[held[1]], i])
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        starts = np.flatnonzero(~same[:-1])
        pivots = np.repeat(i[starts], np.diff(np.append(starts, len(k))))
        keep = same[:-1] | same[1:]
        if first:
            keep[0] = True
        else:
            pivots[: starts[1] if len(starts) > 1 else len(k)] = held[2]
            keep[0] |= held[3]
        some = np.flatnonzero(keep[:-1])
        if len(some):
            yield rows(k[some], i[some], pivots[some])
        end = len(k) - 1
        held = (k[end], i[end], pivots[end], bool(keep[end]) or (held is not None and held[3] and end == 0))
    if held is not None:
        yield rows(*(np.array([x], np.int64) for x in held[:3]))


def _shared(members: DataFrame) -> DataFrame:
    """(bucket, id, pivot) of the members of buckets of several (a few of others among them)."""
    ranges = members.select("bucket", "id").repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    return staged(ranges.mapInArrow(_local, "bucket long, id long, pivot long"), "shared")


def _pivot_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, n): in how many buckets b meets the pivot a; pivots of one bucket meet the least of them."""
    spread = shared.where("id = pivot").groupBy("bucket").agg(F.min("pivot").alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", "least")
    across = shared.where("id = pivot").join(counted(spread), "bucket").where("pivot > least").select(F.col("least").alias("a"), F.col("pivot").alias("b"))
    return shared.where("id > pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).unionByName(across).groupBy("a", "b").agg(F.count("*").alias("n"))


def copies(rows: DataFrame, key: list[str]) -> DataFrame:
    """(id, key, rep) of the rows (id, key) whose key a lesser id, the least being rep, has as well."""
    least = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").drop("top")
    return rows.select("id", *key).join(counted(least), key).where("id > rep").select("id", *key, "rep").distinct()


def merged(same: DataFrame, roots: DataFrame, repeats: bool) -> DataFrame:
    """(id, root) of copies (id, rep) and of clusters (id, root) together; repeats: an id may have several texts, and each link it."""
    if repeats:
        return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    linked = roots.select("id", "root").unionByName(same.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root")))
    heads = same.select(F.col("rep").alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.col("id").alias("root"))
    return linked.unionByName(heads)


def has_repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are of two clusters."""
    ra, rb = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def _pairs(rows: pa.RecordBatch, near: Near) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs of each group, whose rows follow each other, that are of two clusters and that near keeps."""
    bucket, cell, side, ids, roots = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "cell", "side", "id", "root"))
    sketch = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1).T)
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))
    size = np.diff(np.append(first, rows.num_rows))
    ends = np.repeat(np.where(size <= SMALL, first + size, 0), size)  # 0 for the rows of large groups

    def out(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(i):
            x, y = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for d in range(1, SMALL):
        every = np.flatnonzero(ends > np.arange(rows.num_rows) + d)
        if not len(every):
            break
        every = every[(roots[every] != roots[every + d]) & ((cell[every] <= 0) | (side[every] != side[every + d]))]
        for s in range(0, len(every), STEP[0] * STEP[1]):
            i = every[s : s + STEP[0] * STEP[1]]
            i = i[near(sketch[:, i], sketch[:, i + d])]
            yield from out(i, i + d)
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        of = np.arange(at, at + n)
        two = cell[at] > 0
        xs, ys = (of[side[of] == 0], of[side[of] == 1]) if two else (of, of)
        for s in range(0, len(xs), STEP[0]):
            x = xs[s : s + STEP[0]]
            for t in range(0 if two else s, len(ys), STEP[1]):
                y = ys[t : t + STEP[1]]
                keep = near(sketch[:, x, None], sketch[:, None, y]) & (roots[x, None] != roots[y])
                if not two:
                    keep &= x[:, None] < y
                i, j = np.nonzero(keep)
                yield from out(x[i], y[j])


def _compared(near: Near):  # noqa: ANN202
    """mapInArrow body: rows (bucket, cell, side, id, root, sketch) in order of bucket and cell to pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            bucket, cell = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "cell"))
            other = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from _pairs(rows.slice(0, cut), near)
            held = rows.slice(cut)
        if held is not None:
            yield from _pairs(held, near)

    return run


def _by_sketch(apart: DataFrame, sketches: DataFrame, near: Near, at_once: int | None = None) -> DataFrame:
    """(a, b) of all pairs of a bucket that are of two clusters and that near keeps, a written table. apart: (bucket, id, root, n).

    An id is in as many buckets as it has bands, and its sketch goes to each: buckets are taken in rounds of about at_once
    members, so that what lies on disk at a time grows no faster than the ids.
    """
    if at_once is None:
        at_once = max(LEAST_AT_ONCE, AT_ONCE * sketches.count())
    # a member of a bucket of several parts goes to each of them
    rounds = -(-int(apart.agg(F.sum(F.ceil(F.col("n") / BLOCK))).first()[0] or 0) // at_once)
    if rounds <= 1:
        return staged(_close(apart, sketches, near), "close")
    some = [staged(_close(apart.where(F.pmod(F.xxhash64("bucket", F.lit(rounds)), F.lit(rounds)) == k), sketches, near), "close") for k in range(rounds)]
    every = some[0]
    for x in some[1:]:
        every = every.unionByName(x)
    close = staged(every.distinct(), "close")
    for x in some:
        unstage(x)
    return close


def _close(apart: DataFrame, sketches: DataFrame, near: Near) -> DataFrame:
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    # a part meets each part of its bucket: cells of two parts are over 0
    rows = apart.withColumn("parts", parts).withColumn("part", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cell = F.when(F.col("part") == F.col("other"), -F.col("part")).otherwise(low * F.col("parts") + high)
    cells = rows.select("bucket", cell.cast("long").alias("cell"), (F.col("part") > F.col("other")).cast("int").alias("side"), "id", "root")
    full = cells.join(sketches, "id").select("bucket", "cell", "side", "id", "root", "sketch")
    return full.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_compared(near), "a long, b long").distinct()


def clusters(members: DataFrame, verify: Callable[..., DataFrame], sketches: DataFrame | None = None, near: Near | None = None, shed: Callable[[], None] | None = None) -> DataFrame:
    """(id, root) of the ids that some verified pair links. members: (bucket, id); verify: pairs (a, b), a < b, to a written table of those
    that hold; pairs that near has kept are given with a second argument True.

    sketches: (id, sketch), as many bytes of each id, or a row for each of its texts, and near, which compares them.
    Without them what is apart in a bucket is verified pair by pair. shed is called when members have been read for the
    last time.
    """
    found: list[DataFrame] = []

    def roots() -> DataFrame:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return staged(components(every), "roots")

    shared = _shared(members)
    if shed is not None:
        shed()
    tried = staged(_pivot_pairs(shared), "met")
    best = tried.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    found.append(verify(best).select("a", "b"))
    found.append(verify(_apart(tried.join(best, ["a", "b"], "left_anti"), roots())).select("a", "b"))
    labelled = staged(shared.join(roots(), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), "labelled")
    unstage(shared)
    split = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
    apart = staged(labelled.join(counted(split), "bucket"), "apart")
    unstage(labelled)
    if sketches is None or near is None:
        x, y = apart.select("bucket", F.col("id").alias("a"), F.col("root").alias("ra")), apart.select("bucket", F.col("id").alias("b"), F.col("root").alias("rb"))
        pairs = x.join(y, "bucket").where("a < b AND ra <> rb").select("a", "b").distinct()
        found.append(verify(pairs.join(tried, ["a", "b"], "left_anti")).select("a", "b"))
        return roots()
    close = _by_sketch(apart, sketches, near)
    unstage(apart)
    found.append(verify(close.join(tried, ["a", "b"], "left_anti"), True).select("a", "b"))
    unstage(tried)
    unstage(close)
    return roots()
