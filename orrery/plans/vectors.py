"""Vector queries. The driver's 64-wide embeddings stand for three axes: 1-24, 25-44, 45-64."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.operators import axis_search as A
from orrery.operators import clustered
from orrery.plans.registry import query, table


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda i, n: V.l2_normalise(F.slice("embedding", i, n))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", cut(1, 24).alias("re"), cut(25, 20).alias("im"), cut(45, 20).alias("z"))


def query_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: rows whose id is divisible by 100."""
    return axes(spark, sf_dir).where("row_id % 100 = 0").select(F.col("row_id").alias("qid"), F.col("re").alias("q_re"), F.col("im").alias("q_im"), F.col("z").alias("q_z"))


#: Queries whose vectors, or per-query figures, may go to every task: at most 51 MB.
MOST_QUERIES = 100_000


def per_query(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df``, of one row a query, to be broadcast if the queries are few; else a cross join runs in blocks and an equi-join by shuffle."""
    n = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").count()
    return F.broadcast(df) if n <= MOST_QUERIES else df


NORM = "list_transform({v}, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"
AXES_SQL = "axes AS (SELECT vec_id AS row_id, label, " + ", ".join(NORM.format(v=f"embedding[{i}:{j}]") + f" AS {n}" for n, i, j in (("re", 1, 24), ("im", 25, 44), ("z", 45, 64))) + " FROM embeddings)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
SCORED_SQL = f"""scored AS (SELECT q.row_id AS qid, d.row_id, d.label,
  sqrt(pow({DOT.format(a='q.re', b='d.re')}, 2) + pow(0.4 * {DOT.format(a='q.im', b='d.im')}, 2) + pow(0.2 * {DOT.format(a='q.z', b='d.z')}, 2)) AS score
  FROM axes q, axes d WHERE q.row_id % 100 = 0)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, row_id, label, dense, lexical, asf): every query row against every row on the three axes, exactly.

    Up to MOST_QUERIES the queries' vectors go to every task, which multiplies whole Arrow batches; beyond
    that a cross join runs in blocks.
    """
    t = table(spark, sf_dir, "embeddings")
    asked = t.where("vec_id % 100 = 0")
    if asked.count() > MOST_QUERIES:
        both = axes(spark, sf_dir).crossJoin(query_axes(spark, sf_dir))
        return both.select("qid", "row_id", "label", V.dot(F.col("q_re"), F.col("re")).alias("dense"), V.dot(F.col("q_im"), F.col("im")).alias("lexical"), V.dot(F.col("q_z"), F.col("z")).alias("asf"))
    got = asked.select("vec_id", "embedding").orderBy("vec_id").collect()  # bounded by the check
    search = A.AxisSearch(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float).reshape(-1, sum(A.AXES)))
    rows = t.select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("vec"))
    return search.pairs(rows, "label")


def asked_in_parts(spark: SparkSession, sf_dir: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set's ids and vectors, at most some MOST_QUERIES at a time."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")
    n = asked.count()
    parts = 1 if n <= MOST_QUERIES else -(-2 * n // MOST_QUERIES)
    for p in range(parts):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).orderBy("vec_id").collect()
        yield np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float).reshape(-1, sum(A.AXES))


def search_rows(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(qid, rank, row_id, score, mu, sd): the query set's best k rows, with the mean and deviation of all scores; a pass over the rows for each MOST_QUERIES queries."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    return reduce(DataFrame.union, [A.AxisSearch(*part).best(rows, k) for part in asked_in_parts(spark, sf_dir)])


def best_rows(spark: SparkSession, sf_dir: str, k: int, how=None, group: Column | None = None, own: bool = True, where: str | None = None) -> DataFrame:
    """(qid, rn, row_id, label, score, dense, lexical, asf, and the figures of ``AxisSearch.best``): the query set's best k rows by ``how``,
    also by the values of ``group`` (as grp); without ``own`` a query's own row is left out. Each task gives k rows a query (and group)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label", *([group.alias("grp")] if group is not None else []))
    rows = rows.where(where) if where else rows
    found = [A.AxisSearch(*part).best(rows, k, how, "grp" if group is not None else None, ("label",), own) for part in asked_in_parts(spark, sf_dir)]
    return reduce(DataFrame.union, found).withColumnRenamed("rank", "rn")


def blend(alpha: float):
    """The first two similarities, weighed."""
    return lambda parts, at: (1 - alpha) * parts[0] + alpha * parts[1]


@query(
    "ob3_three_axis_search",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, w AS (SELECT qid, row_id, score, avg(score) OVER (PARTITION BY qid) AS mu, greatest(stddev_pop(score) OVER (PARTITION BY qid), 0.05) AS sd,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM scored)
    SELECT qid, rank::INT AS rank, row_id, round(score, 6) AS score, round((score - mu) / sd, 5) AS z FROM w WHERE rank <= 10""",
)
def three_axis_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten rows of each query and how far they lie above its mean."""
    return search_rows(spark, sf_dir).select("qid", "rank", "row_id", F.round("score", 6).alias("score"), F.round((F.col("score") - F.col("mu")) / F.greatest("sd", F.lit(0.05)), 5).alias("z"))


_N = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("ob1_normalise", f"SELECT vec_id, round(embedding[1]::DOUBLE / greatest({_N('embedding')}, 1e-12), 6) AS clipped, round(embedding[1]::DOUBLE / ({_N('embedding')} + 1e-8), 6) AS added, round(embedding[1]::DOUBLE / ({_N('embedding')} + 1e-9), 6) AS added9, round({_N('list_transform(embedding, lambda x: x::DOUBLE / ' + _N('embedding') + ')')}, 6) AS length FROM embeddings")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways to divide by a length."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("embedding")
    r = lambda c: F.round(c, 6)
    return e.select("vec_id", r(V.l2_normalise(v)[0]).alias("clipped"), r(V.l2_normalise_added(v)[0]).alias("added"), r(V.l2_normalise_added(v, 1e-9)[0]).alias("added9"), r(V.norm(V.l2_normalise(v))).alias("length"))


@query("ob2_cosine", f"SELECT a.vec_id, round({DOT.format(a='a.embedding', b='b.embedding')}, 5) AS dot, round({DOT.format(a='list_transform(a.embedding, lambda x: x::DOUBLE)', b='list_transform(b.embedding, lambda x: x::DOUBLE)')} / greatest({_N('a.embedding')} * {_N('b.embedding')}, 1e-9), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("other")), 5).alias("dot"), F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("of1_exact_top_k", f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) SELECT qid, list_sort(list(row_id)) AS found FROM r WHERE rn <= 25 GROUP BY qid")
def top_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 25 of each query as a set, in order of id; clusters of rows that cannot reach them are not scored."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    c = clustered.build(rows)
    best = reduce(DataFrame.union, [clustered.best(c, *part, 25)[0] for part in asked_in_parts(spark, sf_dir)])
    return best.groupBy("qid").agg(F.array_sort(F.collect_list("row_id")).alias("found"))
