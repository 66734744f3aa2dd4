"""Calibration and evaluation (families D, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scoring as S
from orrery.plans.registry import query, relational, table
from orrery.plans.vectors import AXES_SQL, SCORED_SQL, best_rows

RANKED_SQL = f"{AXES_SQL}, {SCORED_SQL}, g AS (SELECT s.qid, s.row_id, s.score, CASE WHEN s.label = q.label THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.row_id) AS rn FROM scored s JOIN embeddings q ON q.vec_id = s.qid WHERE s.row_id <> s.qid)"


def judged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's best ten rows of every label but itself, with whether they have its label; n: the rows of that label."""
    own = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold"))
    s = best_rows(spark, sf_dir, 10, group=F.col("label"), own=False).drop("rn").join(own, "qid")
    return s.withColumn("rel", (F.col("label") == F.col("gold")).cast("int"))


@query(
    "om6_ranking_metrics",
    f"""WITH {RANKED_SQL}, c AS (SELECT qid, sum(rel) AS pos, sum(CASE WHEN rn <= 10 THEN rel ELSE 0 END) AS got, coalesce(sum(CASE WHEN rn <= 10 THEN rel / log2(rn + 1) END), 0) AS dcg, min(CASE WHEN rel = 1 AND rn <= 10 THEN rn END) AS first FROM g GROUP BY qid),
    i AS (SELECT k, sum(1 / log2(j + 1)) AS ideal FROM range(1, 11) a(k), range(1, 11) b(j) WHERE j <= k GROUP BY k)
    SELECT qid, round(coalesce(dcg / s.ideal, 0), 6) AS ndcg_standard, round(coalesce(dcg / r.ideal, 0), 6) AS ndcg_retrieved_ideal, round(got / pos::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr
    FROM c LEFT JOIN i s ON s.k = least(pos, 10) LEFT JOIN i r ON r.k = got WHERE pos > 0""",
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG@10 in two namings: over the best order of all positives, and of the retrieved ones only."""
    s = judged_scores(spark, sf_dir)
    pos = s.where("rel = 1").groupBy("qid").agg(F.max("n").alias("pos"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row_id"))).where("rn <= 10")
    c = top.groupBy("qid").agg(F.sum("rel").alias("got"), F.sum(F.col("rel") / F.log2(F.col("rn") + 1)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rn"))).alias("first")).join(pos, "qid")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda s, j: s + 1 / F.log2(j + 1.0))
    ndcg = lambda k: F.round(F.when(k > 0, F.col("dcg") / ideal(k)).otherwise(0.0), 6)
    return c.select("qid", ndcg(F.least("pos", F.lit(10))).alias("ndcg_standard"), ndcg(F.col("got")).alias("ndcg_retrieved_ideal"), F.round(F.col("got") / F.col("pos"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


@query("om3_null_calibration", f"WITH {AXES_SQL}, {SCORED_SQL} SELECT label, round(avg(score), 6) AS mu, round(stddev_pop(score), 6) AS sd, round(avg(score) + 1.6448536269514722 * stddev_pop(score), 5) AS threshold, count(*) AS n FROM scored WHERE qid <> row_id GROUP BY label")
def null_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null distribution of each domain and the threshold at a false-accept rate of 5 %."""
    s = best_rows(spark, sf_dir, 1, group=F.col("label"), own=False)  # sums by query and label
    square = F.col("n") * (F.col("sd") * F.col("sd") + F.col("mu") * F.col("mu"))
    s = s.groupBy("label").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mu"), (F.sum(square) / F.sum("n")).alias("sq"))
    s = s.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mu") * F.col("mu"))))
    return s.select("label", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"), F.round(F.col("mu") + S.inverse_normal(F.lit(0.95)) * F.col("sd"), 5).alias("threshold"), "n")


relational(
    "od17_confusion",
    """SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, round(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fp), 0), 6) AS precision_1, round(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fn), 0), 6) AS recall_1
    FROM (SELECT CASE WHEN p = 1 AND quality = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN p = 1 AND quality = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN p = 0 AND quality = 1 THEN 1 ELSE 0 END AS fn, CASE WHEN p = 0 AND quality = 0 THEN 1 ELSE 0 END AS tn
      FROM (SELECT l.quality, CASE WHEN contains(d.text, '|') OR contains(d.text, '!!') THEN 0 ELSE 1 END AS p FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id))""",
    """SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, round(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fp), 0), 6) AS precision_1, round(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fn), 0), 6) AS recall_1
    FROM (SELECT CASE WHEN p = 1 AND quality = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN p = 1 AND quality = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN p = 0 AND quality = 1 THEN 1 ELSE 0 END AS fn, CASE WHEN p = 0 AND quality = 0 THEN 1 ELSE 0 END AS tn
      FROM (SELECT l.quality, CASE WHEN contains(d.text, '|') OR contains(d.text, '!!') THEN 0 ELSE 1 END AS p FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id))""",
)
