"""Fusion, normalisation, ranking and merging (families B, D, E, F, I).

Proxies: the three axes' scores are the channels, `label` groups rows to files.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scoring as S
from orrery.operators import fingerprints, fusion
from orrery.operators.axis_search import AxisSearch, channel
from orrery.plans.registry import query, table
from orrery.plans.vectors import AXES_SQL, DOT, SCORED_SQL, asked_in_parts, best_rows, pairs, per_query, search_rows

CHANNELS_SQL = f"""ch AS (SELECT q.row_id AS qid, d.row_id, d.label, {DOT.format(a='q.re', b='d.re')} AS dense, {DOT.format(a='q.im', b='d.im')} AS lexical, {DOT.format(a='q.z', b='d.z')} AS asf
  FROM axes q, axes d WHERE q.row_id % 100 = 0)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three axes' similarities as channels, of every query row and every row."""
    return pairs(spark, sf_dir).select("qid", "row_id", "label", "dense", "lexical", "asf")


def by_query():
    return Window.partitionBy("qid")


def with_stats(spark: SparkSession, sf_dir: str, df: DataFrame, *stats: F.Column) -> DataFrame:
    """Per-query aggregates beside each row: partial sums on the map side, where a window would gather a query's rows in one task."""
    return df.join(per_query(spark, sf_dir, df.groupBy("qid").agg(*stats)), "qid")


def span(*cols: str) -> list[F.Column]:
    return [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]


def top(col: str) -> F.Column:
    return F.row_number().over(by_query().orderBy(F.desc(col), "row_id"))


@query(
    "oe1_rrf_pooled",
    f"""WITH {AXES_SQL}, {CHANNELS_SQL}, r AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) AS a,
    row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, row_id) AS b FROM ch),
    u AS (SELECT qid, row_id, a AS rn FROM r WHERE a <= 50 UNION ALL SELECT qid, row_id, b FROM r WHERE b <= 50)
    SELECT qid, row_id, round(sum(1.0 / (60 + rn)), 10) AS rrf FROM u GROUP BY qid, row_id""",
)
def rrf_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel is cut to its best 50 before the sum: two group limits, no full sort."""
    lists = [best_rows(spark, sf_dir, 50, channel(axis)).select("qid", "row_id", "rn") for axis in (0, 1)]
    return lists[0].union(lists[1]).groupBy("qid", "row_id").agg(F.round(F.sum(1.0 / (60 + F.col("rn"))), 10).alias("rrf"))


@query(
    "oe2_rrf_uncut",
    f"""WITH {AXES_SQL}, {CHANNELS_SQL}, r AS (SELECT qid, row_id, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id))
    + 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, row_id)) AS s FROM ch)
    SELECT qid, row_id, round(s, 10) AS rrf FROM r""",
)
def rrf_uncut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lists, every row of each: no cut before the sum or after it."""
    return fusion.reciprocal_sums(channels(spark, sf_dir)).select("qid", "row_id", F.round("score", 10).alias("rrf"))


@query(
    "oe5_weighted_fusion",
    f"""WITH {AXES_SQL}, {CHANNELS_SQL}, m AS (SELECT qid, row_id, dense, lexical, asf,
      min(dense) OVER w AS d0, max(dense) OVER w AS d1, min(lexical) OVER w AS l0, max(lexical) OVER w AS l1, min(asf) OVER w AS a0, max(asf) OVER w AS a1 FROM ch WINDOW w AS (PARTITION BY qid)),
    f AS (SELECT qid, row_id, 0.60 * CASE WHEN d1 - d0 < 1e-6 THEN 0.5 ELSE (dense - d0) / (d1 - d0 + 1e-9) END + 0.25 * CASE WHEN l1 - l0 < 1e-6 THEN 0.5 ELSE (lexical - l0) / (l1 - l0 + 1e-9) END
      + 0.15 * CASE WHEN a1 - a0 < 1e-6 THEN 0.5 ELSE (asf - a0) / (a1 - a0 + 1e-9) END AS fused FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, row_id) AS rn FROM f)
    SELECT qid, row_id, round(fused, 6) AS fused, rn::INT AS rn FROM r WHERE rn <= 20""",
)
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels between the query's bounds, weighed and summed: the best 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    best = reduce(DataFrame.union, [fusion.min_max_best(AxisSearch(*part), rows, 20) for part in asked_in_parts(spark, sf_dir)])
    return best.select("qid", "row_id", F.round("score", 6).alias("fused"), F.col("rank").alias("rn"))


@query(
    "oe4_min_max_zero",
    f"""WITH {AXES_SQL}, {CHANNELS_SQL} SELECT qid, row_id, round((dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w + 1e-12), 6) AS scaled FROM ch WINDOW w AS (PARTITION BY qid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) <= 100""",
)
def min_max_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 100 of a channel, scaled between the bounds of all."""
    ch = best_rows(spark, sf_dir, 100, channel(0))
    return ch.select("qid", "row_id", F.round(S.min_max_zero(F.col("dense"), F.col("lo_dense"), F.col("hi_dense")), 6).alias("scaled"))


@query(
    "oi1_confidence",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, z AS (SELECT qid, row_id, (score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 0.05) AS z FROM scored WINDOW w AS (PARTITION BY qid))
    SELECT qid, row_id, round(z, 6) AS z, round({S.GAUSSIAN_SQL.replace('{z}', 'z')}, 6) AS confidence FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY z DESC, row_id) <= 100""",
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-query z-score (population deviation, at least .05) through the normal distribution: the best 100."""
    s = search_rows(spark, sf_dir, 100)
    z = (F.col("score") - F.col("mu")) / F.greatest(F.col("sd"), F.lit(0.05))
    return s.select("qid", "row_id", z.alias("z")).select("qid", "row_id", F.round("z", 6).alias("z"), F.round(S.gaussian_cdf(F.col("z")), 6).alias("confidence"))


@query(
    "ob8_threshold_then_fallback",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored WHERE row_id <> qid),
    p AS (SELECT * FROM r WHERE rn <= 30 AND score >= 0.6), s AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY rn) AS k FROM p)
    SELECT qid, row_id, round(score, 6) AS score, false AS fallback FROM s WHERE k <= 10
    UNION ALL SELECT qid, row_id, round(score, 6), true FROM r WHERE rn <= 10 AND qid NOT IN (SELECT qid FROM p)""",
)
def threshold_then_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold within the best 3k, then the best k; a query left empty gets its raw best k, flagged. A query's own row takes no part."""
    r = best_rows(spark, sf_dir, 30, own=False)
    passed = r.where("score >= 0.6")
    strict = passed.withColumn("k", F.row_number().over(by_query().orderBy("rn"))).where("k <= 10").select("qid", "row_id", F.round("score", 6).alias("score"), F.lit(False).alias("fallback"))
    rest = r.where("rn <= 10").join(passed.select("qid").distinct(), "qid", "left_anti")
    return strict.union(rest.select("qid", "row_id", F.round("score", 6), F.lit(True)))


@query(
    "od3_file_top3_mean",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, label, score, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, row_id) AS rn FROM scored)
    SELECT qid, label, round(avg(score), 6) AS score, round(max(score), 6) AS best, count(*) AS n FROM r WHERE rn <= 3 GROUP BY qid, label""",
)
def file_top3_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = best_rows(spark, sf_dir, 3, group=F.col("label"))
    return r.groupBy("qid", "label").agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.max("score"), 6).alias("best"), F.count("*").alias("n"))


@query(
    "oe8_margin",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored),
    m AS (SELECT qid, coalesce(max(CASE WHEN rn = 1 THEN score END) - max(CASE WHEN rn = 2 THEN score END), 0.5) AS margin FROM r WHERE rn <= 2 GROUP BY qid)
    SELECT qid, round(margin, 6) AS margin, CASE WHEN margin >= 0.15 THEN 'high' WHEN margin >= 0.05 THEN 'medium' ELSE 'low' END AS level FROM m""",
)
def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = best_rows(spark, sf_dir, 2)
    best = lambda n: F.max(F.when(F.col("rn") == n, F.col("score")))
    m = r.groupBy("qid").agg(F.coalesce(best(1) - best(2), F.lit(0.5)).alias("margin"))
    return m.select("qid", F.round("margin", 6).alias("margin"), S.margin_label(F.col("margin")).alias("level"))


@query(
    "oe7_segments_per_file",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, label, row_id, score, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, row_id) AS a FROM scored),
    g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS b FROM r WHERE a <= 3) SELECT qid, label, row_id, round(score, 6) AS score, b::INT AS rank FROM g WHERE b <= 12""",
)
def segments_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = best_rows(spark, sf_dir, 3, group=F.col("label"))
    return r.withColumn("rank", top("score")).where("rank <= 12").select("qid", "label", "row_id", F.round("score", 6).alias("score"), "rank")


@query(
    "of3_quota_merge",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, label % 5 AS dom, row_id, score, row_number() OVER (PARTITION BY qid, label % 5 ORDER BY score DESC, row_id) AS rn, max(score) OVER (PARTITION BY qid, label % 5) AS mx FROM scored),
    q AS (SELECT *, rn <= CASE WHEN mx >= 0.8 THEN 4 WHEN mx >= 0.5 THEN 2 WHEN mx >= 0.3 THEN 1 ELSE 1 END AS sure, score * CASE WHEN dom < 2 THEN 1.0 ELSE 0.75 END AS w FROM r WHERE rn <= 40),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN sure THEN 0 ELSE 1 END, CASE WHEN sure THEN dom END, CASE WHEN sure THEN rn END, w DESC, dom, rn) AS place FROM q)
    SELECT qid, place::INT AS place, dom::INT AS dom, row_id, sure FROM o WHERE place <= 40""",
)
def quota_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each domain's guaranteed places by its best confidence, then the rest by weighted confidence, cut to twice k = 20."""
    dom = Window.partitionBy("qid", "dom")
    r = best_rows(spark, sf_dir, 40, group=F.col("label") % 5).withColumnRenamed("grp", "dom").withColumn("mx", F.max("score").over(dom))
    quota = F.when(F.col("mx") >= 0.8, 4).when(F.col("mx") >= 0.5, 2).otherwise(1)
    q = r.withColumn("sure", F.col("rn") <= quota).withColumn("w", F.col("score") * F.when(F.col("dom") < 2, 1.0).otherwise(0.75))
    sure = F.col("sure")
    order = [F.when(sure, 0).otherwise(1), F.when(sure, F.col("dom")).asc_nulls_last(), F.when(sure, F.col("rn")).asc_nulls_last(), F.desc("w"), "dom", "rn"]
    return q.withColumn("place", F.row_number().over(by_query().orderBy(*order))).where("place <= 40").select("qid", "place", F.col("dom").cast("int").alias("dom"), "row_id", "sure")


@query(
    "oc15_outer_candidates",
    f"""WITH {AXES_SQL}, {CHANNELS_SQL}, r AS (SELECT qid, row_id, dense, lexical, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) AS a, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, row_id) AS b FROM ch),
    x AS (SELECT qid, row_id, dense FROM r WHERE a <= 30), y AS (SELECT qid, row_id, lexical FROM r WHERE b <= 30)
    SELECT qid, row_id, round(0.55 * coalesce(dense, 0) + 0.45 * coalesce(lexical, 0), 6) AS fused FROM x FULL JOIN y USING (qid, row_id)""",
)
def outer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio and text candidates side by side; what one channel lacks counts 0."""
    side = lambda axis, c: best_rows(spark, sf_dir, 30, channel(axis)).select("qid", "row_id", c)
    both = side(0, "dense").join(side(1, "lexical"), ["qid", "row_id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("qid", "row_id", F.round(0.55 * zero("dense") + 0.45 * zero("lexical"), 6).alias("fused"))


@query(
    "oi4_display_curve",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, c AS (SELECT qid, row_id, greatest(0, least(1, score)) AS x FROM scored)
    SELECT qid, row_id, round(CASE WHEN x < 0.10 THEN x * 3 WHEN x < 0.25 THEN 0.30 + (x - 0.10) * 8 / 3 WHEN x < 0.40 THEN 0.70 + (x - 0.25) * 4 / 3 WHEN x < 0.60 THEN 0.90 + (x - 0.40) * 0.4 ELSE 0.98 + (x - 0.60) * 0.025 END, 6) AS shown FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY x DESC, row_id) <= 100""",
)
def display_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of the best 100."""
    return search_rows(spark, sf_dir, 100).select("qid", "row_id", F.round(S.display_curve(F.col("score")), 6).alias("shown"))


@query(
    "ob7_mean_query_vector",
    """WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(v * v)) + 1e-8 AS s FROM e GROUP BY label)
    SELECT label, i::INT - 1 AS pos, round(v / s, 6) AS v FROM e JOIN n USING (label)""",
)
def mean_query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a group's vectors by position, then unit length; long form, so a group of any size has partial sums."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    n = e.groupBy("label").agg((F.sqrt(F.sum(F.col("v") * F.col("v"))) + 1e-8).alias("s"))
    return e.join(n, "label").select("label", "pos", F.round(F.col("v") / F.col("s"), 6).alias("v"))


@query(
    "oi13_fingerprint",
    """WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: ((x::DOUBLE + 1) * 1000000)::BIGINT) AS fp FROM embeddings)
    SELECT a.vec_id AS x, b.vec_id AS y, round(1 - list_sum(list_transform(list_zip(a.fp, b.fp), lambda p: bit_count(xor(p[1], p[2]))))::DOUBLE / (32.0 * 64), 6) AS sim FROM f a, f b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 20""",
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit agreement of 32-bit fingerprints: the likest 20 of all rows for each of the query set, which goes to every task."""
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 1000000).cast("long")).alias("fp"))
    asked = f.where("row_id % 100 = 0")
    parts = -(-asked.count() // 10_000) or 1
    found = []
    for p in range(parts):  # 2.6 MB of prints at a time
        got = asked.where(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == p).orderBy("row_id").collect()
        found.append(fingerprints.best(np.array([r[0] for r in got], np.int64), [np.array(r[1], np.int64).astype(np.uint32) for r in got], f, 20, own=False))
    return reduce(DataFrame.union, found).select(F.col("qid").alias("x"), F.col("row_id").alias("y"), F.col("score").alias("sim"))

