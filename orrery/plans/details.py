"""Chunkers, gates, boosts, caps, cascades and supporting rows of the inventory (families A to O)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scoring as S
from orrery.functions import text as X
from orrery.functions import vector as V
from orrery.operators.axis_search import channel
from orrery.operators.windows import audio_ranges
from orrery.plans.ranking import CHANNELS_SQL, by_query, span, top, with_stats
from orrery.plans.registry import query, relational, table
from orrery.plans.vectors import AXES_SQL, SCORED_SQL, best_rows, blend

_LAST = "CASE WHEN n <= 800 THEN 0 ELSE ((n - 801) // 700 + 1) * 700 END"
_PAGES = f"p AS (SELECT doc_id, n, {_LAST} AS last FROM (SELECT doc_id, length(text) AS n FROM documents) WHERE n > 0)"


@query("oa4_page_chunks", f"WITH {_PAGES} SELECT doc_id, s::INT AS start, least(s + 800, n)::INT AS stop FROM (SELECT doc_id, n, unnest(range(0, last + 1, 700)) AS s FROM p)")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    return d.select("doc_id", "n", F.explode(X.page_starts(F.col("n"))).alias("start")).select("doc_id", "start", F.least(F.col("start") + 800, "n").alias("stop"))


@query("oa4_page_chunks_compat", f"WITH {_PAGES}, s AS (SELECT doc_id, n, unnest(range(0, last + 1, 700)) AS s FROM p UNION ALL SELECT doc_id, n, unnest(range(greatest(n - 100, last + 1), n)) FROM p) SELECT doc_id, count(*)::INT AS n, sum(least(800, n - s))::BIGINT AS chars FROM s GROUP BY doc_id")
def page_chunks_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")).where("chars > 0").withColumn("s", X.page_starts_compat(F.col("chars")))
    return d.select("doc_id", F.size("s").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + F.least(F.lit(800), F.col("chars") - x)).alias("sum")).withColumnRenamed("sum", "chars")


relational(
    "oa5_two_way_chunks",
    "SELECT doc_id, i, md5(substr(text, i + 1, 400)) AS forward, md5(substr(text, greatest(n - i - 400, 0) + 1, least(400, n - i))) AS backward FROM (SELECT doc_id, text, length(text) AS n, explode(sequence(0, greatest(length(text) - 1, 0), 300)) AS i FROM {documents})",
    "SELECT doc_id, i::INT AS i, md5(substr(text, i + 1, 400)) AS forward, md5(substr(text, greatest(n - i - 400, 0) + 1, least(400, n - i))) AS backward FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text), 1), 300)) AS i FROM documents)",
)
_WIDE = lambda i: f"list_transform(embedding[{i}:{i + 19}], lambda x: x::DOUBLE)"


@query(
    "ob6_vector_blend",
    f"WITH b AS (SELECT vec_id, list_transform(list_zip({_WIDE(1)}, {_WIDE(21)}, {_WIDE(41)}), lambda p: 0.15 * p[1] + 0.25 * p[2] + 0.60 * p[3]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS s FROM b) SELECT vec_id, unnest(range(20))::INT AS pos, round(unnest(v) / s, 6) AS v FROM n",
)
def vector_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(w, F.slice("embedding", i, 20)) for w, i in ((0.15, 1), (0.25, 21), (0.60, 41))]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.blend(parts)).alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("ob10_weak_evidence_cap", f"WITH {AXES_SQL}, {CHANNELS_SQL}, c AS (SELECT *, 1 / (1 + exp(-4 * dense)) AS conf FROM ch) SELECT qid, row_id, round(CASE WHEN dense < 1.1 * 0.3 AND lexical < 0.05 THEN least(c.conf, 0.55) ELSE c.conf END, 6) AS conf FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) <= 100")
def weak_evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = best_rows(spark, sf_dir, 100, channel(0)).withColumn("conf", S.sigmoid(4 * F.col("dense")))
    weak = (F.col("dense") < 1.1 * 0.3) & (F.col("lexical") < 0.05)
    return c.select("qid", "row_id", F.round(F.when(weak, F.least("conf", F.lit(0.55))).otherwise(F.col("conf")), 6).alias("conf"))


@query("ob15_channel_gating", f"WITH {AXES_SQL}, {CHANNELS_SQL} SELECT qid, row_id, round(CASE WHEN label % 5 = 0 THEN 0.75 * dense + 0.25 * lexical ELSE 0.60 * dense + 0.25 * lexical + 0.15 * asf END, 6) AS fused FROM ch QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused DESC, row_id) <= 100")
def channel_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain without the vocabulary channel gives its weight to dense: the best of either kind of domain, then of both."""
    weighed = lambda d, x, a: lambda parts, at: np.round(d * parts[0] + x * parts[1] + a * parts[2], 6)
    without = "coalesce(label % 5 = 0, false)"
    f = best_rows(spark, sf_dir, 100, weighed(0.75, 0.25, 0.0), where=without).union(best_rows(spark, sf_dir, 100, weighed(0.60, 0.25, 0.15), where=f"NOT {without}"))
    f = f.select("qid", "row_id", F.col("score").alias("fused"))
    return f.withColumn("rn", top("fused")).where("rn <= 100").drop("rn")


@query("oc1_cross_scoring", f"WITH {AXES_SQL}, {CHANNELS_SQL} SELECT qid, row_id, round(dense, 6) AS dense FROM ch QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ch.dense DESC, row_id) <= 100")
def cross_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query against every row; the best 100 of each are given."""
    return best_rows(spark, sf_dir, 100, channel(0)).select("qid", "row_id", F.round("dense", 6).alias("dense"))


@query(
    "oc16_restricted_post_filter",
    f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, row_id, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored), f AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY rn) AS k FROM r WHERE rn <= 120 AND label % 3 = 1) SELECT qid, row_id, round(score, 6) AS score FROM f WHERE k <= 20",
)
def restricted_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best max(6k, 120) first, then the documents asked for: may give fewer than k."""
    r = best_rows(spark, sf_dir, 120).where("label % 3 = 1")
    return r.withColumn("k", F.row_number().over(by_query().orderBy("rn"))).where("k <= 20").select("qid", "row_id", F.round("score", 6).alias("score"))


@query(
    "oc16_restricted_pre_filter",
    f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored WHERE label % 3 = 1) SELECT qid, row_id, round(score, 6) AS score FROM r WHERE rn <= 20",
)
def restricted_pre_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_rows(spark, sf_dir, 20, where="label % 3 = 1").select("qid", "row_id", F.round("score", 6).alias("score"))


@query(
    "oe10_global_rank",
    f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, row_id, label % 5 AS dom, score, row_number() OVER (PARTITION BY qid, label % 5 ORDER BY score DESC, row_id) AS rn FROM scored) SELECT qid, row_id, dom::INT AS dom, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id))::INT AS rank FROM r WHERE rn <= 10",
)
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = best_rows(spark, sf_dir, 10, group=(F.col("label") % 5).cast("int")).withColumnRenamed("grp", "dom")
    return r.select("qid", "row_id", "dom", top("score").alias("rank"))


@query("of5_candidate_cap", "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= CASE WHEN (SELECT count(*) FROM documents) <= 1000 THEN 1000 ELSE 100 END")
def candidate_cap(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """All of up to 1000 candidates, else the best max(10k, 100)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.select("doc_id") if d.count() <= 1000 else d.orderBy(F.desc("n_chars"), "doc_id").limit(max(10 * k, 100)).select("doc_id")


@query(
    "oi8_rerank_fusion",
    f"WITH {AXES_SQL}, {CHANNELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) AS rn FROM ch), m AS (SELECT qid, row_id, 0.5 * (lexical - min(lexical) OVER w) / (max(lexical) OVER w - min(lexical) OVER w + 1e-12) + 0.5 * (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w + 1e-12) AS f FROM r WHERE rn <= 20 WINDOW w AS (PARTITION BY qid)) SELECT qid, row_id, round(f, 6) AS final_score FROM m",
)
def rerank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of 20 by dense; half of the reranker's and half of the fused score, each scaled within the head."""
    head = with_stats(spark, sf_dir, best_rows(spark, sf_dir, 20, channel(0)).select("qid", "row_id", "dense", "lexical"), *span("dense", "lexical"))
    part = lambda c: S.min_max_zero(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return head.select("qid", "row_id", F.round(0.5 * part("lexical") + 0.5 * part("dense"), 6).alias("final_score"))




_HIT = " + ".join(f"contains(lower(s), '{w}')::INT" for w in ("the", "with", "was"))


@query(
    "oh8_best_line",
    f"WITH l AS (SELECT doc_id, l, unnest(l) AS s, unnest(range(len(l))) + 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), r AS (SELECT *, {_HIT} AS score, row_number() OVER (PARTITION BY doc_id ORDER BY {_HIT} DESC, i) AS rn FROM l) SELECT doc_id, i::INT AS line, score, substr(array_to_string(list_filter(list_transform(l[i:i + 1], lambda x: trim(x)), lambda x: x <> ''), ' '), 1, 200) AS snippet FROM r WHERE rn = 1 AND score > 0",
)
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", X.best_line(F.col("text"), ["the", "with", "was"]).alias("b")).where("b is not null")
    return b.select("doc_id", "b.line", "b.score", "b.snippet")


@query("ok2_audio_ranges", "SELECT DISTINCT conv_id, i::DOUBLE AS start, least(i + 30, d)::DOUBLE AS stop FROM (SELECT conv_id, conv_id % 97 + 3 AS d FROM conversations), range(0, 105, 10) t(i) WHERE i = 0 OR i < d - 20")
def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_ranges(table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 97 + 3).cast("double").alias("d")).distinct(), "conv_id", "d")


@query(
    "om1_self_pair_null",
    f"WITH {AXES_SQL}, n AS (SELECT count(*) AS n FROM axes), p AS (SELECT list_sum(list_transform(list_zip(a.re, b.re), lambda p: p[1] * p[2])) AS s FROM axes a, n, axes b WHERE b.row_id = (a.row_id * 7919 + 13) % n.n AND b.row_id <> a.row_id) SELECT round(avg(s), 6) AS mu, round(stddev_pop(s), 6) AS sd, round(avg(s) + 1.6448536269514722 * stddev_pop(s), 5) AS threshold, count(*) AS n FROM p",
)
def self_pair_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with one other that its id's hash names: an equi-join, not all pairs."""
    from orrery.plans.vectors import axes

    a = axes(spark, sf_dir).select("row_id", "re")
    n = a.count()
    b = a.select(F.col("row_id").alias("other"), F.col("re").alias("re2"))
    p = a.withColumn("other", (F.col("row_id") * 7919 + 13) % n).where("row_id != other").join(b, "other").select(V.dot(F.col("re"), F.col("re2")).alias("s"))
    p = p.agg(F.avg("s").alias("mu"), F.stddev_pop("s").alias("sd"), F.count("*").alias("n"))
    return p.select(F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"), F.round(F.col("mu") + S.inverse_normal(F.lit(0.95)) * F.col("sd"), 5).alias("threshold"), "n")


@query(
    "om7_alpha_sweep",
    f"WITH {AXES_SQL}, {CHANNELS_SQL}, s AS (SELECT a.alpha, ch.qid, ch.label = q.label AS rel, row_number() OVER (PARTITION BY a.alpha, ch.qid ORDER BY (1 - a.alpha) * dense + a.alpha * lexical DESC, ch.row_id) AS rn FROM ch JOIN axes q ON q.row_id = ch.qid, (VALUES (0.0::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) a(alpha) WHERE ch.row_id <> ch.qid), f AS (SELECT alpha, qid, min(CASE WHEN rel THEN rn END) AS first FROM s WHERE rn <= 10 GROUP BY alpha, qid) SELECT alpha, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS r1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f GROUP BY alpha",
)
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out: a query's own row takes no part; R@1, R@5 and MRR within the best 10 for each blend."""
    own = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold"))
    s = reduce(DataFrame.union, [best_rows(spark, sf_dir, 10, blend(a), own=False).withColumn("alpha", F.lit(a)) for a in (0.0, 0.2, 0.5, 1.0)]).join(own, "qid")
    f = s.groupBy("alpha", "qid").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rn"))).alias("first"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return f.groupBy("alpha").agg(rate(F.col("first") == 1).alias("r1"), rate(F.col("first") <= 5).alias("r5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


relational("oi17_json_arrays", "SELECT doc_id, to_json(array(lang, source)) AS j, from_json(to_json(array(lang, source)), 'array<string>')[1] AS back FROM {documents}", "SELECT doc_id, to_json([lang, source])::VARCHAR AS j, to_json([lang, source])->>1 AS back FROM documents")
relational("oi18_iso_times", "SELECT user_id, max(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")) AS latest FROM {events} GROUP BY user_id", "SELECT user_id, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS latest FROM events GROUP BY user_id")
relational("ok5_memory", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations}) WHERE rn <= 40")
