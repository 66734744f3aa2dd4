"""Exact best rows on weighted axes with fewer scores: rows lie in clusters, and clusters that cannot reach a query's best are left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.axis_search import AXES, AxisSearch, _Best, normal_axes
from orrery.sources.workdir import fresh

WEIGHTS = (1.0, 0.4, 0.2)
#: Rounding that a bound must bear.
EASE = 1e-9


@dataclass
class Clusters:
    """Rows (cluster, row_id, vec) as a stored table, sorted by cluster; centres by axis, and each cluster's radius by axis and its rows."""

    rows: DataFrame
    centres: list[np.ndarray]
    radius: np.ndarray
    count: np.ndarray
    axes: tuple[int, ...]


def _nearest(x: list[np.ndarray], centres: list[np.ndarray], weights) -> np.ndarray:
    """The cluster of each row: the smallest weighted distance over the axes."""
    return sum(w * w * (-2 * (a @ c.T) + (c * c).sum(1)) for w, a, c in zip(weights, x, centres, strict=True)).argmin(1)


def build(rows: DataFrame, clusters: int = 256, sample: int = 20_000, rounds: int = 5, weights=WEIGHTS, axes: tuple[int, ...] = AXES) -> Clusters:
    """Puts every row (row_id, vec) into the cluster of its nearest centre.

    Centres are fitted on ``sample`` rows at most, those of smallest hash of the id; radii are taken over all
    rows. Rows of another width, or null ones, take no part. A cluster of many rows is split over tasks.
    """
    spark = rows.sparkSession
    rows = rows.where(F.size("vec") == sum(axes)).select(F.col("row_id").cast("long").alias("row_id"), "vec")
    some = np.array([r[0] for r in rows.orderBy(F.xxhash64("row_id"), "row_id").limit(sample).select("vec").collect()], float).reshape(-1, sum(axes))
    x = normal_axes(some, axes)
    clusters = max(1, min(clusters, len(some)))
    centres = [a[:clusters].copy() if len(some) else np.zeros((1, n)) for a, n in zip(x, axes, strict=True)]
    for _ in range(rounds if len(some) else 0):
        at = _nearest(x, centres, weights)
        size = np.bincount(at, minlength=clusters)
        for c, a in zip(centres, x, strict=True):
            total = np.zeros_like(c)
            np.add.at(total, at, a)
            c[size > 0] = total[size > 0] / size[size > 0, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = normal_axes(b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, sum(axes)), axes)
            at = _nearest(y, centres, weights) if b.num_rows else np.zeros(0, int)
            far = [np.sqrt(((a - c[at]) ** 2).sum(1)) for a, c in zip(y, centres, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("row_id"), b.column("vec"), *map(pa.array, far)], ["cluster", "row_id", "vec", *(f"r{i}" for i in range(len(axes)))])

    path = fresh(spark, "clusters")
    kind = rows.schema["vec"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"cluster int, row_id long, vec {kind}, " + ", ".join(f"r{i} double" for i in range(len(axes))))
    placed.hint("rebalance", "cluster").sortWithinPartitions("cluster").write.parquet(path)
    stored = spark.read.parquet(path)
    radius, count = np.zeros((clusters, len(axes))), np.zeros(clusters, np.int64)
    for r in stored.groupBy("cluster").agg(F.count("*").alias("n"), *[F.max(f"r{i}").alias(f"r{i}") for i in range(len(axes))]).collect():  # a row a cluster
        radius[r.cluster], count[r.cluster] = r[2:], r.n
    return Clusters(stored.select("cluster", "row_id", "vec"), centres, radius, count, axes)


def bounds(c: Clusters, queries: list[np.ndarray], weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that a row of each cluster (across) can have with each query (down)."""
    low, high = 0.0, 0.0
    for i, (w, q, m) in enumerate(zip(weights, queries, c.centres, strict=True)):
        near, r = np.abs(q @ m.T), c.radius[:, i][None]
        low = low + (w * np.maximum(near - r, 0)) ** 2
        high = high + (w * np.minimum(near + r, 1)) ** 2
    return np.sqrt(low), np.sqrt(high)


def best(c: Clusters, ids: np.ndarray, vectors: np.ndarray, k: int, weights=WEIGHTS) -> tuple[DataFrame, int]:
    """((qid, rank, row_id, score), scores taken): the best k rows of each query, as ``AxisSearch.best`` gives them.

    1. What a query's k-th best score is at least follows from the clusters' least scores and numbers of rows.
    2. The clusters that bound best, enough for k rows, are scored: their k-th score is the query's bar.
    3. Of the others those are scored whose greatest score reaches the bar. The rest cannot hold a better row.
    """
    search = AxisSearch(ids, vectors, c.axes)
    low, high = bounds(c, search.parts, weights)
    order = np.argsort(-high, 1)
    enough = np.cumsum(c.count[order], 1) - c.count[order] < k
    first = np.zeros(high.shape, bool)
    np.put_along_axis(first, order, enough, 1)
    first &= c.count > 0
    bar = np.full(len(ids), -np.inf)
    by_low = np.argsort(-low, 1)
    have = np.cumsum(c.count[by_low], 1) >= k
    full = have.any(1)
    bar[full] = np.take_along_axis(low, by_low, 1)[np.arange(len(ids)), have.argmax(1)][full]
    first &= high >= bar[:, None] - EASE
    found = _scored(c, search, first, k, weights)
    at = {int(q): i for i, q in enumerate(ids)}
    for q, score in found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("qid", "s").toLocalIterator():  # a row a query
        bar[at[q]] = max(bar[at[q]], score)
    second = (high >= bar[:, None] - EASE) & ~first & (c.count > 0)
    every = _ranked(found.unionByName(_scored(c, search, second, k, weights)), k) if second.any() else found
    return every.select("qid", "rank", "row_id", "score"), int((first * c.count).sum() + (second * c.count).sum())


def _ranked(part: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scored(c: Clusters, search: AxisSearch, asked: np.ndarray, k: int, weights) -> DataFrame:
    """The best k rows of each query over the clusters that it asks; k rows a query and task leave a task."""
    spark = c.rows.sparkSession
    wanted = {int(j): np.flatnonzero(asked[:, j]) for j in np.flatnonzero(asked.any(0))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(len(search.ids), k)
        for b in batches:
            rows, ids = search._axes(b), b.column("row_id").to_numpy()
            cluster = b.column("cluster").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1), len(cluster)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                qs = wanted.get(int(cluster[i])) if j > i else None
                for at in np.array_split(qs, -(-len(qs) // 256)) if qs is not None else ():
                    score = np.sqrt(sum((w * (x[i:j] @ q[at].T)) ** 2 for w, x, q in zip(weights, rows, search.parts, strict=True)))
                    exact = lambda r, s: (np.sqrt(sum((w * (x[i:j][r] * q[at][s]).sum(1)) ** 2 for w, x, q in zip(weights, rows, search.parts, strict=True))), np.zeros((len(r), 0)))  # noqa: E731, B023
                    top.add(at, score, ids[i:j], exact)
        top.cut()
        q, place = np.nonzero(np.isfinite(top.score))
        yield pa.RecordBatch.from_arrays([pa.array(search.ids[q]), pa.array(top.row[q, place]), pa.array(top.score[q, place])], ["qid", "row_id", "score"])

    rows = c.rows.where(F.col("cluster").isin([*wanted])) if len(wanted) < len(c.count) else c.rows
    path = fresh(spark, "clustered")
    rows.mapInArrow(run, "qid long, row_id long, score double").write.parquet(path)
    return _ranked(spark.read.parquet(path), k)
