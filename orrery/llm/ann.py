"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.scratch import Scratch


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def rotations(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """H D3 H D2 H D1 x, the signs drawn from seed and table; rows padded with zeros to a power of two."""
    width = 1 << max(1, x.shape[1] - 1).bit_length() if x.shape[1] > 1 else 2
    signs = np.random.Generator(np.random.PCG64([seed, table, width])).choice([-1.0, 1.0], (3, width))
    if width > x.shape[1]:
        x = np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], 1)
    for d in signs:
        x = hadamard(x * d) / np.sqrt(width)
    return x


def buckets(x: np.ndarray, table: int, probes: int | None, seed: int) -> np.ndarray:
    """The nearest ``probes`` signed axes (None: all) of each row, nearest first; axis i is i, its negative i + width."""
    y = rotations(x, table, seed)
    both = np.concatenate([y, -y], 1)
    if probes is None or probes >= both.shape[1]:
        return np.argsort(-both, 1, kind="stable")
    top = np.argpartition(-both, probes - 1, 1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), 1, kind="stable"), 1)


def _hasher(tables: int, probes: int | None, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vec")
            size = np.diff(np.frombuffer(vec.buffers()[1], np.int32, len(vec) + 1, vec.offset * 4))
            out = np.empty(len(vec), object)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):  # usually one width
                rows = np.flatnonzero(size == d)
                x = np.stack([flat[at[i] : at[i] + d] for i in rows])
                x = x / np.abs(x).max(1, keepdims=True)  # else tiny or huge components over- or underflow
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes = np.concatenate([buckets(x, t, probes, seed) * tables + t for t in range(tables)], 1) * 65536 + d
                for i, c in zip(rows, codes, strict=True):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(list(out), pa.list_(pa.int64()))], [*b.schema.names, "codes"])

    return run


def _searcher(k: int):
    """Rows come sorted by (key, queries first). Each run of stored rows is compared with its key's queries in blocks."""
    schema = pa.schema([("query", pa.int64()), ("found", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q_ids, q_vec, best = None, [], [], {}

        def flush():
            if not best:
                return []
            q, f, s = (np.concatenate(x) for x in zip(*best.values(), strict=True))
            return [pa.RecordBatch.from_arrays([pa.array(q), pa.array(f), pa.array(s)], schema=schema)]

        for b in batches:
            keys, ids = b.column("key").to_numpy(), b.column("id").to_numpy()
            vec = b.column("vec")
            at = np.frombuffer(vec.buffers()[1], np.int32, len(vec) + 1, vec.offset * 4)
            flat = vec.values.to_numpy()
            stored = b.column("stored").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (stored[1:] != stored[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                if keys[i] != key:
                    yield from flush()
                    key, q_ids, q_vec, best = keys[i], [], [], {}
                x = flat[at[i] : at[j]].reshape(j - i, -1)
                if not stored[i]:
                    q_ids.append(ids[i:j])
                    q_vec.append(x)
                    continue
                for n, (qi, qv) in enumerate(zip(q_ids, q_vec, strict=True)):
                    for lo in range(0, len(qi), 64):
                        for at_x in range(0, len(x), 512):
                            part, part_ids, q = x[at_x : at_x + 512], ids[i + at_x : min(j, i + at_x + 512)], qv[lo : lo + 64]
                            d = np.sqrt(((q[:, None, :] - part[None]) ** 2).sum(2))
                            row, col = np.divmod(np.arange(d.size), d.shape[1])
                            new = [qi[lo : lo + 64][row], part_ids[col], d.ravel()]
                            if (n, lo) in best:
                                new = [np.concatenate(p) for p in zip(best[n, lo], new, strict=True)]
                            best[n, lo] = _top(*new, k)
        yield from flush()

    return run


def _top(q: np.ndarray, f: np.ndarray, s: np.ndarray, k: int) -> list[np.ndarray]:
    order = np.lexsort((f, s, q))
    q, f, s = q[order], f[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return [q[keep], f[keep], s[keep]]


def valid(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 10, probes: int = 12, block: int = 4096, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows found, by Euclidean distance.

    Hashing: ``tables`` fast pseudo-rotations send the normalised vector to its
    nearest signed axis; rows are posted under one axis a table, queries look
    under their ``probes`` nearest axes. Every stored row under a probed axis is
    compared exactly, in double precision, on the original components. A query that finds
    fewer than ``k`` rows so looks under all axes of one table, and so at every row.

    Equal vectors count once in the tables: of each such class the k+1 smallest ids
    stand for it, which is all that a top-k with ties to the smaller id can name.
    An axis with more than ``block`` rows is dealt over several keys, its queries
    copied to each; many queries are dealt likewise, so no task gets a whole axis.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows without an id; vectors of unequal length are never
    compared. A repeated id counts as one row of each of its vectors. Other columns are ignored; an
    empty table or no query gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks")).where(valid(F.col("vec")) & F.col("id").isNotNull())
    # -0.0 and 0.0 are one value; the hash only brings equal vectors together, the vector itself is compared
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).distinct()
    classes = scratch.save(rows.groupBy("vec").agg(F.min("id").alias("id"), F.max("asks").alias("asks"), F.count("*").alias("n")))
    shared = classes.where("n > 1").select("vec", F.col("id").alias("class"))
    copies = rows.join(shared, "vec").select("class", "id", "asks")
    few = copies.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("at") <= k + 1).select("class", "id")
    members = scratch.save(few)
    asking = scratch.save(copies.where("asks").select("class", "id").union(classes.where("asks and n = 1").select("id", F.col("id").alias("b"))))

    near = scratch.save(_found(classes, classes.where("asks"), k, tables, probes, block, seed, scratch))
    best = scratch.save(_with_members(near, members, k))
    # an own row is always found; a query with fewer than k others looks under every axis of one table
    few = best.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") <= k).select(F.col("class").alias("id"))
    few = scratch.save(classes.where("asks").join(few, "id", "left_semi"))
    if not few.isEmpty():
        again = _with_members(_found(classes, few, k, 1, None, block, seed, scratch), members, k)
        best = best.join(few.select(F.col("id").alias("class")), "class", "left_anti").union(again)
    pairs = best.join(asking.select("class", F.col("id").alias("query_id")), "class").where("vec_id != query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(classes: DataFrame, asking: DataFrame, k: int, tables: int, probes: int | None, block: int, seed: int, scratch: Scratch) -> DataFrame:
    """(query, found, score) of the best k+1 classes that each asking class meets under its nearest ``probes`` axes (None: all) of each table."""
    schema = T.StructType([*classes.select("id", "vec").schema, T.StructField("codes", T.ArrayType(T.LongType()))])
    coded = lambda df, p: df.select("id", "vec").mapInArrow(_hasher(tables, p, seed), schema).select("id", "vec", F.explode("codes").alias("code"))
    stored = coded(classes, 1)
    queries = coded(asking, probes)
    many = lambda df, name: df.groupBy("code").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select("code", F.ceil(F.col("rows") / block).alias(name))
    split = scratch.save(many(stored, "parts").join(many(queries, "shares"), "code", "full"))

    def dealt(df: DataFrame, own: str, other: str, is_stored: bool) -> DataFrame:
        df = df.join(split, "code", "left")
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        df = df.withColumn("mine", F.pmod(F.xxhash64("id"), mine)).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)))
        part, share = ("mine", "theirs") if is_stored else ("theirs", "mine")
        return df.select(F.xxhash64("code", part, share).alias("key"), F.lit(is_stored).alias("stored"), "id", "vec")

    both = dealt(queries, "shares", "parts", False).union(dealt(stored, "parts", "shares", True))
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = both.repartition(n, "key").sortWithinPartitions("key", "stored").mapInArrow(_searcher(k + 1), "query long, found long, score double")
    # k+1 classes hold at least k rows other than the query's own
    near = hits.groupBy("query", "found").agg(F.min("score").alias("score"))
    return near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("score", "found"))).where(F.col("at") <= k + 1).drop("at")


def _with_members(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(class, vec_id, score): the best k+1 rows of the found classes."""
    full = near.join(members.select(F.col("class").alias("found"), F.col("id").alias("member")), "found", "left").select(F.col("query").alias("class"), F.coalesce("member", "found").alias("vec_id"), "score")
    return full.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("score", "vec_id"))).where(F.col("at") <= k + 1).drop("at")
