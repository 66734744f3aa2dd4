"""Calibration, evaluation, loops and the engine's functions as queries (families D, E, I, K, L, M, N, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery import engine
from orrery.functions import pii
from orrery.functions import scoring as S
from orrery.functions import vector as V
from orrery.operators import calibration as C
from orrery.operators import findings
from orrery.plans.privacy import FOUND_SQL, REQUESTS, _any
from orrery.operators.axis_search import channel, three_axis
from orrery.operators.ordered import numbered, quantiles
from orrery.plans.ranking import CHANNELS_SQL
from orrery.plans.recordings import by
from orrery.plans.registry import query, raw, sql, table, view
from orrery.plans.vectors import AXES_SQL, DOT, SCORED_SQL, axes, best_rows
from orrery.sources import workdir
from orrery.sources.versioned import VersionedTable

_INV95 = "1.6448536269514722"


# figures of scores


@query("od5_mean_deviation", f"WITH {AXES_SQL}, {SCORED_SQL} SELECT qid, round(avg(score), 6) AS mu, round(greatest(stddev_pop(score), 0.05), 6) AS rows_sd, round(greatest(stddev_pop(score), 0.02), 6) AS segments_sd, round(greatest(stddev_pop(score), 0.01), 6) AS files_sd FROM scored GROUP BY qid")
def mean_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of a query's scores, with the three floors."""
    s = best_rows(spark, sf_dir, 1)
    floor = lambda f: F.round(F.greatest("sd", F.lit(f)), 6)
    return s.select("qid", F.round("mu", 6).alias("mu"), floor(0.05).alias("rows_sd"), floor(0.02).alias("segments_sd"), floor(0.01).alias("files_sd"))


_TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM (SELECT *, avg(score) OVER (PARTITION BY qid) AS mu, greatest(stddev_pop(score) OVER (PARTITION BY qid), 0.05) AS sd, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM scored))"


def with_figures(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    r = best_rows(spark, sf_dir, k)
    return r.select("qid", "row_id", "score", "mu", F.greatest("sd", F.lit(0.05)).alias("sd"), F.col("lo_score").alias("lo"), F.col("hi_score").alias("hi"))


@query("oe3_min_max_half", f"WITH {AXES_SQL}, {SCORED_SQL}, {_TOP} SELECT qid, row_id, round(CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE (score - lo) / (hi - lo + 1e-9) END, 6) AS scaled FROM r WHERE rn <= 30")
def min_max_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores between a query's bounds, .5 where all are equal: the best 30."""
    return with_figures(spark, sf_dir, 30).select("qid", "row_id", F.round(S.min_max(F.col("score"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


@query("oe6_z_score", f"WITH {AXES_SQL}, {SCORED_SQL}, {_TOP} SELECT qid, row_id, round((score - mu) / sd, 5) AS z FROM r WHERE rn <= 30")
def z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_figures(spark, sf_dir, 30).select("qid", "row_id", F.round((F.col("score") - F.col("mu")) / F.col("sd"), 5).alias("z"))


@query("ob5_two_axis_search", f"WITH {AXES_SQL}, {CHANNELS_SQL}, s AS (SELECT qid, row_id, sqrt(pow(dense, 2) + pow(0.4 * lexical, 2)) AS score FROM ch), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s) SELECT qid, rank::INT AS rank, row_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def two_axis_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = best_rows(spark, sf_dir, 10, three_axis((1.0, 0.4, 0.0)))
    return s.select("qid", F.col("rn").alias("rank"), "row_id", F.round("score", 6).alias("score"))


@query("ob9_fallback", f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored WHERE qid <> row_id), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rn) AS n FROM r WHERE rn <= 30 AND score >= 0.55) SELECT qid, row_id, round(score, 6) AS score, false AS fallback FROM k WHERE n <= 10 UNION ALL SELECT qid, row_id, round(score, 6), true FROM r WHERE rn <= 10 AND qid NOT IN (SELECT qid FROM k)")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without a strict result gets its best rows, marked."""
    r = best_rows(spark, sf_dir, 30, own=False)
    k = r.where("score >= 0.55").withColumn("n", F.row_number().over(by("qid").orderBy("rn"))).where("n <= 10")
    rest = r.where("rn <= 10").join(k.select("qid").distinct(), "qid", "left_anti")
    pick = lambda df, f: df.select("qid", "row_id", F.round("score", 6).alias("score"), F.lit(f).alias("fallback"))
    return pick(k, False).union(pick(rest, True))


@query("oi2_inverse_normal", "SELECT p, CASE CAST(p * 1000 AS INT) " + " ".join(f"WHEN {k} THEN {v}" for k, v in {1: -3.09023, 25: -1.95996, 50: -1.64485, 100: -1.28155, 250: -0.67449, 500: 0.0, 750: 0.67449, 900: 1.28155, 950: 1.64485, 975: 1.95996, 999: 3.09023}.items()) + " END::DOUBLE AS z FROM (SELECT unnest([0.001, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.999])::DOUBLE AS p)")
def inverse_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the values of printed tables."""
    p = spark.createDataFrame([(x,) for x in (0.001, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.999)], "p double")
    return p.select("p", (F.round(S.inverse_normal(F.col("p")), 5) + 0.0).alias("z"))


@query("oi3_sigmoid", f"WITH {AXES_SQL}, {SCORED_SQL}, {_TOP} SELECT qid, row_id, round(1 / (1 + exp(-((score - mu) / sd) / 2)), 6) AS confidence FROM r WHERE rn <= 20")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other engine's confidence: the sigmoid of half the z-score."""
    return with_figures(spark, sf_dir, 20).select("qid", "row_id", F.round(S.sigmoid((F.col("score") - F.col("mu")) / F.col("sd") / 2), 6).alias("confidence"))


@query(
    "oe16_neighbour_budget",
    raw("WITH p AS (SELECT conv_id, turn, concat('[p.', turn + 1, ']', chr(10), trim(text)) AS piece FROM {conversations} WHERE trim(text) <> ''), w AS (SELECT a.conv_id, a.turn, b.turn AS other, b.piece, length(b.piece) AS n, row_number() OVER x AS rn, coalesce(sum(length(b.piece) + 2) OVER (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.turn - b.turn), b.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {conversations} a JOIN p b ON b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 WINDOW x AS (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.turn - b.turn), b.turn)), f AS (SELECT *, min(CASE WHEN used + n > 1200 THEN rn END) OVER (PARTITION BY conv_id, turn) AS over FROM w) SELECT conv_id, turn, other, CASE WHEN rn = over THEN md5(concat(left(piece, (1200 - used - 80)::INT), chr(10), '... [본문 일부 생략]')) ELSE md5(piece) END AS piece FROM f WHERE over IS NULL OR rn < over OR (rn = over AND 1200 - used - 80 > 200)"),
)
def neighbour_budget(spark: SparkSession, sf_dir: str, budget: int = 1200) -> DataFrame:
    """Pages around each, the nearest first, until the budget is used; the first that does not fit is cut if more than 200 characters of it remain."""
    c = table(spark, sf_dir, "conversations")
    p = c.where("trim(text) != ''").select("conv_id", F.col("turn").alias("other"), F.concat(F.lit("[p."), (F.col("turn") + 1).cast("string"), F.lit("]\n"), F.trim("text")).alias("piece"))
    near = c.select("conv_id", "turn", F.explode(F.array(*[F.col("turn") + d for d in range(-2, 3)])).alias("other"))
    w = by("conv_id", "turn").orderBy(F.abs(F.col("turn") - F.col("other")), "other")
    r = near.join(p, ["conv_id", "other"]).withColumn("rn", F.row_number().over(w)).withColumn("used", F.coalesce(F.sum(F.length("piece") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("over", F.min(F.when(F.col("used") + F.length("piece") > budget, F.col("rn"))).over(by("conv_id", "turn")))
    left = F.lit(budget) - F.col("used") - 80
    cut = F.concat(F.substring("piece", F.lit(1), left.cast("int")), F.lit("\n... [본문 일부 생략]"))
    r = r.where(F.col("over").isNull() | (F.col("rn") < F.col("over")) | ((F.col("rn") == F.col("over")) & (left > 200)))
    return r.select("conv_id", "turn", "other", F.md5(F.when(F.col("rn") == F.col("over"), cut).otherwise(F.col("piece")).cast("binary")).alias("piece"))


# calibration

_DRAWN = "(a.row_id * 7919 + 13 * i) % n.n"


@query(
    "om2_crossmodal_null",
    f"WITH {AXES_SQL}, n AS (SELECT count(*) AS n FROM axes), p AS (SELECT DISTINCT a.label % 5 AS dom, a.row_id, b.row_id AS other, sqrt(pow({DOT.format(a='a.re', b='b.re')}, 2) + pow(0.4 * {DOT.format(a='a.im', b='b.im')}, 2) + pow(0.2 * {DOT.format(a='a.z', b='b.z')}, 2)) AS s FROM axes a, n, range(1, 6) t(i), axes b WHERE a.row_id % 100 = 0 AND b.row_id = {_DRAWN} AND b.row_id <> a.row_id), m AS (SELECT dom, avg(s) AS mu, stddev_pop(s) AS sd, avg(s) + {_INV95} * stddev_pop(s) AS t FROM p GROUP BY dom), o AS (SELECT *, CASE WHEN dom = 0 THEN t / 3 WHEN dom = 1 THEN 0 ELSE t END AS pt FROM m) SELECT dom::INT AS domain, round(CASE WHEN pt > 0 AND t > 2 * pt THEN 0.1 ELSE mu END, 5) AS mu_null, round(CASE WHEN pt > 0 AND t > 2 * pt THEN pt ELSE t END, 5) AS abs_threshold, CASE WHEN pt > 0 AND t > 2 * pt THEN 'rejected' ELSE 'ok' END AS status FROM o",
)
def crossmodal_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries against five drawn rows each, by domain; a threshold over twice the previous one is refused (the first domain's is)."""
    a = axes(spark, sf_dir)
    n = a.count()
    q = a.where("row_id % 100 = 0")
    drawn = C.drawn_pairs(q, n, "row_id", 5)
    b = a.select(F.col("row_id").alias("other"), F.col("re").alias("re2"), F.col("im").alias("im2"), F.col("z").alias("z2"))
    d = lambda x: V.dot(F.col(x), F.col(x + "2"))
    p = q.join(drawn, "row_id").join(b, "other").select((F.col("label") % 5).cast("int").alias("domain"), V.three_axis(d("re"), d("im"), d("z")).alias("s"))
    m = p.groupBy("domain").agg(F.avg("s").alias("mu_null"), F.stddev_pop("s").alias("sigma_null")).withColumn("abs_threshold", C.threshold(F.col("mu_null"), F.col("sigma_null"), 0.05))
    before = F.when(F.col("domain") == 0, F.col("abs_threshold") / 3).when(F.col("domain") == 1, 0.0).otherwise(F.col("abs_threshold"))
    old = m.select("domain", F.lit(0.1).alias("mu_null"), F.lit(0.1).alias("sigma_null"), before.alias("abs_threshold"))
    return C.crossmodal(old, m).select("domain", F.round("mu_null", 5).alias("mu_null"), F.round("abs_threshold", 5).alias("abs_threshold"), "status")


@query("om4_file_null", f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, row_id) AS rn FROM scored), f AS (SELECT qid, label, avg(score) AS m FROM r WHERE rn <= 3 GROUP BY qid, label) SELECT label % 5 AS domain, round(avg(m), 6) AS mu, round(stddev_pop(m) + 1e-6, 6) AS sd, round(quantile_cont(m, 0.95), 6) AS p95, round(quantile_cont(m, 0.99), 6) AS p99, count(*) AS n FROM f GROUP BY label % 5")
def file_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null over files: the mean of each file's best three, for every query; with its percentiles."""
    f = best_rows(spark, sf_dir, 3, group=F.col("label")).groupBy("qid", "label").agg(F.avg("score").alias("m"))
    f = f.select((F.col("label") % 5).alias("domain"), "m")
    g = f.groupBy("domain").agg(F.avg("m").alias("mu"), (F.stddev_pop("m") + 1e-6).alias("sd")).join(quantiles(f, ["domain"], "m", {"p95": 0.95, "p99": 0.99}), "domain")
    return g.select("domain", *[F.round(c, 6).alias(c) for c in ("mu", "sd", "p95", "p99")], "n")


_MEASURED = "SELECT label AS domain, avg(embedding[1]::DOUBLE) + 0.2 AS mu, stddev_pop(embedding[1]::DOUBLE) AS sd, 0.2 + avg(embedding[1]::DOUBLE) + 2 * stddev_pop(embedding[1]::DOUBLE) AS t FROM embeddings GROUP BY label"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("domain")).agg((F.avg(x) + 0.2).alias("mu_null"), F.stddev_pop(x).alias("sigma_null"), (F.avg(x) + 0.2 + 2 * F.stddev_pop(x)).alias("abs_threshold"))


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations of before: other means for some domains, none for the last."""
    m = measured(spark, sf_dir)
    scale = F.when(F.col("domain") % 4 == 0, 3.0).when(F.col("domain") % 4 == 1, 1.1).when(F.col("domain") % 4 == 2, 0.3).otherwise(1.0)
    return m.where("domain != 9").select("domain", (F.col("mu_null") * scale).alias("mu_null"), "sigma_null", (F.col("abs_threshold") * scale).alias("abs_threshold"))


_PREVIOUS = f"SELECT domain, mu * k AS pm, sd, t * k AS pt FROM (SELECT *, CASE domain % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 1.1 WHEN 2 THEN 0.3 ELSE 1.0 END AS k FROM ({_MEASURED})) WHERE domain <> 9"


@query("om5_drift_guard", f"WITH m AS ({_MEASURED}), p AS ({_PREVIOUS}), j AS (SELECT m.domain, m.mu, m.t, p.pm, p.pt, coalesce((p.pm > 0 AND (m.mu > 2 * p.pm OR m.mu < 0.5 * p.pm)) OR (p.pt > 0 AND (m.t > 2 * p.pt OR m.t < 0.5 * p.pt)), false) AS off FROM m LEFT JOIN p ON p.domain = m.domain) SELECT domain, round(CASE WHEN off THEN pm ELSE mu END, 6) AS mu_null, round(CASE WHEN off THEN pt ELSE t END, 6) AS abs_threshold, CASE WHEN off THEN 'kept' ELSE 'updated' END AS status FROM j")
def drift_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.drift_guard(previous(spark, sf_dir), measured(spark, sf_dir))
    return g.select("domain", F.round("mu_null", 6).alias("mu_null"), F.round("abs_threshold", 6).alias("abs_threshold"), "status")


@query("oo9_missing_thresholds", f"WITH p AS ({_PREVIOUS}) SELECT DISTINCT label AS domain FROM embeddings WHERE label NOT IN (SELECT domain FROM p WHERE pt < 0.45)")
def missing_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains whose threshold is the default, or that have none."""
    return C.lacking(measured(spark, sf_dir), previous(spark, sf_dir))


@query("oo10_calibration_merge", f"WITH m AS ({_MEASURED}), p AS ({_PREVIOUS}), s AS (SELECT domain, mu, t FROM m WHERE domain >= 5 UNION ALL SELECT domain, pm, pt FROM p WHERE domain < 5) SELECT d.label AS domain, round(coalesce(s.mu, 0), 6) AS mu_null, round(coalesce(s.t, 0.5), 6) AS abs_threshold FROM (SELECT DISTINCT label FROM embeddings UNION SELECT 77) d LEFT JOIN s ON s.domain = d.label")
def calibration_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store takes over what was measured for the later domains; one without any has the defaults."""
    m = measured(spark, sf_dir)
    store = C.merged(previous(spark, sf_dir), m.where("domain >= 5"))
    d = C.with_defaults(m.select("domain").union(spark.sql("SELECT 77")), store)
    return d.select("domain", F.round("mu_null", 6).alias("mu_null"), F.round("abs_threshold", 6).alias("abs_threshold"))


@query("ok8_recalibration_trigger", "SELECT d.source, count(l.doc_id) AS before, count(*) AS now, count(l.doc_id) < 100 OR count(*) - count(l.doc_id) >= 500 OR count(*) - count(l.doc_id) >= 0.1 * count(*) AS due FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source UNION ALL SELECT '', (SELECT count(*) FROM labels), (SELECT count(*) FROM documents), (SELECT count(*) FROM labels) < 100 OR (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) >= 500 OR (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) >= 0.1 * (SELECT count(*) FROM documents)")
def recalibration_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered rows (labelled ones) and all rows, by source and in all."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    n = [F.count("l").alias("before"), F.count("*").alias("now")]
    g = j.groupBy("source").agg(*n).union(j.agg(*n).select(F.lit(""), "before", "now"))
    return g.withColumn("due", C.must_recalibrate(F.col("before"), F.col("now")))


# evaluation

_HITS = f"{AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, g0 AS (SELECT qid, row_id, dense, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) AS rn, count(*) FILTER (WHERE dense >= 0.35) OVER (PARTITION BY qid) AS pass FROM ch), g AS (SELECT qid, row_id FROM g0 WHERE rn <= greatest(20, least(pass, 200))), h AS (SELECT qid, row_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) WHERE rn <= 10)"


@query("om8_content_gold", f"WITH {_HITS} SELECT h.qid, round(count(g.row_id) / 10.0, 4)::DOUBLE AS precision, (SELECT count(*) FROM g x WHERE x.qid = h.qid) AS gold FROM h LEFT JOIN g ON g.qid = h.qid AND g.row_id = h.row_id GROUP BY h.qid")
def content_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows by cosine, twenty at least and 200 at most, and the precision of the best ten by three axes."""
    theta, fewest, most = C.GOLD["movie"]
    g = C.gold(best_rows(spark, sf_dir, most, channel(0)).select("qid", "row_id", "score"), theta, fewest, most)
    h = best_rows(spark, sf_dir, 10).select("qid", "row_id")
    return C.precision(h, g).join(g.groupBy("qid").agg(F.count("*").alias("gold")), "qid").select("qid", "precision", "gold")


_JUDGED = f"{AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, rn, 'File_' || (row_id % 150) AS name FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored WHERE qid <> row_id) WHERE rn <= 10), e AS (SELECT DISTINCT q.vec_id AS qid, 'file_' || (d.vec_id % 150) AS name FROM embeddings q JOIN embeddings d ON d.label = q.label AND d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), p AS (SELECT r.qid, count(*) AS found, min(rn) AS first FROM r WHERE lower(name) IN (SELECT name FROM e WHERE e.qid = r.qid) GROUP BY r.qid), d AS (SELECT qid, sum(c - 1) AS dup FROM (SELECT qid, lower(name) AS n, count(*) AS c FROM r GROUP BY ALL) GROUP BY qid), n AS (SELECT qid, count(*) AS n FROM e GROUP BY qid)"


@query("om9_hits", f"WITH {_JUDGED}, j AS (SELECT n.qid, n.n, p.found, p.first, d.dup FROM n LEFT JOIN p USING (qid) LEFT JOIN d USING (qid)) SELECT CASE WHEN qid % 200 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS queries, count(found) AS hits, round(avg(coalesce(found, 0) / least(n, 10)::DOUBLE), 6) AS coverage, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) FILTER (WHERE first = 1) AS top1, sum(coalesce(dup, 0))::BIGINT AS dup FROM j GROUP BY 1")
def judged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, coverage, MRR, top-1 and repeated names of each query, by source of the queries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    name = lambda c: F.concat(F.lit("file_"), (F.col(c) % 150).cast("string"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    expected = q.join(e, "label").where("vec_id != qid").select("qid", name("vec_id").alias("name")).distinct()
    r = best_rows(spark, sf_dir, 10, own=False).select("qid", F.col("rn").alias("rank"), F.initcap(name("row_id")).alias("name"))
    j = C.judged(r, expected, 10).withColumn("source", F.when(F.col("qid") % 200 == 0, "even").otherwise("odd"))
    return j.groupBy("source").agg(F.count("*").alias("queries"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count(F.when(F.col("top1"), 1)).alias("top1"), F.sum("n_dup").alias("dup"))


@query("om11_latency_overlap", f"WITH {AXES_SQL}, {CHANNELS_SQL}, a AS (SELECT qid, row_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) AS rn FROM ch) WHERE rn <= 10), b AS (SELECT qid, row_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, row_id) AS rn FROM ch) WHERE rn <= 10), f AS (SELECT coalesce(a.qid, b.qid) AS qid, a.qid IS NOT NULL AS x, b.qid IS NOT NULL AS y FROM a FULL JOIN b ON a.qid = b.qid AND a.row_id = b.row_id), o AS (SELECT qid, count(*) FILTER (WHERE x AND y) AS shared, count(*) FILTER (WHERE NOT y) AS only_a, count(*) FILTER (WHERE NOT x) AS only_b FROM f GROUP BY qid), t AS (SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events) SELECT qid, shared, only_a, only_b, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM o, t")
def latency_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two channels' best ten share, beside p50 and p95 of timed runs (the events' values as seconds)."""
    top = lambda axis: best_rows(spark, sf_dir, 10, channel(axis)).select("qid", "row_id")
    t = C.latencies(table(spark, sf_dir, "events").select(F.lit("all").alias("name"), F.col("value").alias("seconds"))).select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return C.overlap(top(0), top(1)).crossJoin(F.broadcast(t))


@query("om13_growth_curve", f"WITH {AXES_SQL}, {SCORED_SQL}, s AS (SELECT s.*, q.label = s.label AS rel FROM scored s JOIN embeddings q ON q.vec_id = s.qid WHERE s.qid <> s.row_id), f AS (SELECT label, dense_rank() OVER (ORDER BY label) AS ord FROM (SELECT DISTINCT label FROM embeddings)), g AS (SELECT n, s.qid, s.rel, s.score, s.row_id, row_number() OVER (PARTITION BY n, s.qid ORDER BY s.score DESC, s.row_id) AS rn FROM s JOIN f USING (label), range(1, 11) t(n) WHERE f.ord <= n), b AS (SELECT n, qid, min(CASE WHEN rel THEN rn END) AS first, avg(score) AS mu FROM g WHERE rn <= 10 GROUP BY n, qid) SELECT n::INT AS n, count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(mu), 6) AS mu FROM b GROUP BY n")
def growth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures again on the first n files, n from 1 to 10, queries' own rows left out."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    f = numbered(e.select("label").distinct(), "label").select("label", (F.col("place") + 1).alias("ord"))
    # only a file's best ten can be among the best ten of more files
    s = best_rows(spark, sf_dir, 10, group=F.col("label"), own=False).drop("rn", "n").join(f, "label").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("gold")), "qid")
    g = s.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10)))).where("ord <= n")
    g = g.withColumn("rn", F.row_number().over(by("n", "qid").orderBy(F.desc("score"), "row_id"))).where("rn <= 10")
    b = g.groupBy("n", "qid").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("rn"))).alias("first"), F.avg("score").alias("mu"))
    return b.groupBy("n").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("mu"), 6).alias("mu"))


# loops and indexing


@query("ok6_retrieval_loop", raw("WITH q AS (SELECT id, query, ((id * 7) % 50) / 10.0 AS z0, ((id * 3) % 20) / 10.0 AS step FROM {requests}), t AS (SELECT *, CASE WHEN z0 >= 1 THEN 0 WHEN z0 + step >= 1 THEN 1 ELSE 2 END AS tries FROM q) SELECT id, tries, CASE WHEN z0 + tries * step >= 3 THEN 'return_hits' ELSE 'rerank' END AS decision, concat(query, repeat('!', tries)) AS query FROM t"))
def retrieval_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests searched, evaluated and rewritten up to twice. The search here gives a z that rises with each rewriting."""
    q = view(spark, sf_dir, "requests").select(F.col("id").alias("qid"), "query")
    z = F.col("qid") * 7 % 50 / 10.0 + F.length(F.regexp_extract("query", "(!*)$", 1)) * (F.col("qid") * 3 % 20 / 10.0)
    r = engine.retrieval_loop(q, lambda df: df.select("qid", z.cast("double").alias("z")), lambda df: df.select("qid", F.concat("query", F.lit("!")).alias("query")))
    return r.select(F.col("qid").alias("id"), "tries", "decision", "query")


@query("ok7_incremental_index", raw("SELECT rel_key AS key, f.sha, length(f.text) AS n FROM {files} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id WHERE coalesce(l.toxic, 0) = 0"))
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the labelled files (the poor with other content) brought up to what is on disk."""
    f, labels = view(spark, sf_dir, "files").select("doc_id", F.col("rel_key").alias("key"), "sha", "text"), table(spark, sf_dir, "labels")
    old = f.join(labels, "doc_id").select("key", F.when(F.col("quality") == 0, "old").otherwise(F.col("sha")).alias("sha"), F.when(F.col("quality") == 0, -1).otherwise(F.length("text")).alias("n"))
    now = f.join(labels.where("toxic = 1"), "doc_id", "left_anti")
    return engine.index_changes(old, now, lambda df: df.select("key", "sha", F.length("text").alias("n")))[0]


_SEAM = "SELECT qid, row_id, (row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rn <= 50 THEN 0 ELSE 1 END, CASE WHEN rn <= 50 THEN -coalesce(length(f.stem), 0) END, rn))::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) s LEFT JOIN {files} f ON f.doc_id = s.row_id WHERE rn <= 60"


@query("ol2_scorer_seam", f"WITH {AXES_SQL}, {SCORED_SQL} " + raw(_SEAM))
def scorer_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker as a function of queries and passages, here the passage's length."""
    r = best_rows(spark, sf_dir, 60).withColumnRenamed("rn", "rank")
    f = view(spark, sf_dir, "files").select(F.col("doc_id").alias("row_id"), "stem")
    r = r.join(f, "row_id", "left").select("qid", "rank", "row_id", F.lit("q").alias("query"), F.coalesce("stem", F.lit("")).alias("passage"))
    return engine.rerank(r, lambda q, p: [float(len(x)) for x in p]).select("qid", "row_id", "place")


@query("ol3_retriever", f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) SELECT qid, rn::INT AS rank, row_id, round(score, 6) AS score FROM r WHERE rn <= 7")
def retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retriever whose encoder looks vectors up by the query's text (its id)."""
    e = table(spark, sf_dir, "embeddings")
    encode = lambda q: q.join(e.select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vec")), "query").select("qid", "vec")
    r = engine.VectorRetriever(e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec")), encode)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").cast("string").alias("query"))
    return r.search(asked, 7).select("qid", "rank", "row_id", F.round("score", 6).alias("score"))


@query("ol4_progress", "SELECT label AS step, count(*) AS done, 10 AS total FROM embeddings GROUP BY label")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by file with what was reported after each."""
    return engine.with_progress(table(spark, sf_dir, "embeddings"), "label", lambda i, n, name: None)


# the engine's functions


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    kinds = F.array(*map(F.lit, ["audio", "bgm", "doc", "image", "video"]))
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.lit("꽃").alias("query")), e.select(F.col("vec_id").alias("row_id"), kinds[F.col("label") % 5].alias("domain"), F.col("embedding").alias("vec"))


_PHI = S.GAUSSIAN_SQL.format(z="z")
_STATS = "s AS (SELECT *, avg(score) OVER (PARTITION BY qid) AS mu, greatest(stddev_pop(score) OVER (PARTITION BY qid), 0.05) AS sd FROM scored)"


@query("on1_search_all", f"WITH {AXES_SQL}, {SCORED_SQL}, s AS (SELECT qid, row_id, label % 5 AS ord, score, (score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 0.05) AS z, row_number() OVER (PARTITION BY qid, label % 5 ORDER BY score DESC, row_id) AS rank FROM scored WINDOW w AS (PARTITION BY qid, label % 5)), c AS (SELECT *, {_PHI} AS conf FROM s WHERE rank <= 40), m AS (SELECT *, max(conf) OVER (PARTITION BY qid, ord) AS mx FROM c), q AS (SELECT *, rank <= CASE WHEN mx >= 0.8 THEN 4 WHEN mx >= 0.5 THEN 2 ELSE 1 END AS sure FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN sure THEN 0 ELSE 1 END, CASE WHEN sure THEN ord END, CASE WHEN sure THEN rank END, round(conf * CASE WHEN ord IN (2, 3) THEN 1.0 ELSE 0.75 END, 12) DESC, ord, rank) AS place FROM q) SELECT qid, place::INT AS place, row_id, round(conf, 6) AS confidence, round(least(conf, 0.55), 6) AS shown FROM p WHERE place <= 40")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list over five domains; the request has one letter, so .55 is all that is shown."""
    q, rows = _vectors(spark, sf_dir)
    r = engine.search_all(q, rows)
    return r.select("qid", "place", "row_id", F.round("confidence", 6).alias("confidence"), F.round("shown", 6).alias("shown"))


@query("on2_search_rows", f"WITH {AXES_SQL}, {SCORED_SQL}, {_STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rn) AS n FROM r WHERE rn <= 60 AND score >= 0.9999) SELECT qid, n::INT AS rank, row_id, round(score, 6) AS score, false AS fallback FROM k WHERE n <= 20")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = _vectors(spark, sf_dir)
    return engine.search_rows(q, rows, 0.9999).select("qid", "rank", "row_id", F.round("score", 6).alias("score"), "fallback")


@query("on3_inspect", f"WITH {AXES_SQL}, {CHANNELS_SQL} SELECT qid, row_id, round(dense, 6) AS dense, round(sqrt(pow(dense, 2) + pow(0.4 * lexical, 2) + pow(0.2 * asf, 2)), 6) AS score, round(1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id)) + 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, row_id)), 10)::DOUBLE AS rrf FROM ch WHERE label = 3")
def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel of one file's rows."""
    q, _ = _vectors(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    return engine.inspect(q, rows).select("qid", "row_id", F.round("dense", 6).alias("dense"), F.round("score", 6).alias("score"), F.round("rrf", 10).alias("rrf"))


_FP = "list_transform(embedding[1:8], lambda x: (floor(x::DOUBLE * 1000000))::INT)"


@query("on4_identify", f"WITH {AXES_SQL}, {SCORED_SQL}, k AS (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored), f AS (SELECT min(vec_id) AS row_id, {_FP} AS fp FROM embeddings GROUP BY 2) SELECT k.vec_id AS qid, 1 AS rank, f.row_id, 1.0::DOUBLE AS score, 'fingerprint' AS method FROM embeddings k JOIN f ON f.fp = {_FP.replace('embedding', 'k.embedding')} WHERE k.vec_id % 200 = 0 UNION ALL SELECT qid, rn::INT, row_id, round(score, 6), 'vector' FROM r WHERE rn <= 5 AND qid % 200 <> 0")
def identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of which every second has a fingerprint (that of eight components)."""
    q, rows = _vectors(spark, sf_dir)
    fp = F.transform(F.slice("vec", 1, 8), lambda x: F.floor(x.cast("double") * 1000000).cast("int"))
    r = engine.identify(q.where("qid % 200 = 0").select("qid", fp.alias("fp")), rows.select("row_id", fp.alias("fp")), q, rows)
    return r.select("qid", "rank", "row_id", F.round("score", 6).alias("score"), "method")


@query("on5_stats", raw("SELECT CASE lower(regexp_extract(file_name, '([^.]*)$', 1)) WHEN 'mp4' THEN 'video' WHEN 'mp3' THEN 'audio' ELSE 'doc' END AS type, count(*) AS files, sum(greatest(1, ceil(size / 1000.0)))::BIGINT AS chunks, sum(size)::BIGINT AS bytes FROM {files} GROUP BY 1"))
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.stats(view(spark, sf_dir, "files").select("path", F.greatest(F.lit(1), F.ceil(F.col("size") / 1000.0)).alias("chunks"), "size"))


@query("on6_history_latest", raw("SELECT h.query, h.method, h.searched_at FROM {history} h JOIN (SELECT query, max(searched_at) AS m FROM {history} GROUP BY query) x ON x.query = h.query AND x.m = h.searched_at"))
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.history_latest(view(spark, sf_dir, "history"))


_UPLOADS = "SELECT concat('/up/', CAST(c_custkey AS STRING), CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN '.exe' WHEN 1 THEN '.jpg' ELSE '.pdf' END) AS path, text, CAST(length(text) AS BIGINT) AS size, c_custkey % 5 = 1 AS is_image, c_custkey FROM {profiles}"


@query(
    "on7_ingest_secure",
    raw(
        f"""WITH {FOUND_SQL}, u AS ({_UPLOADS}), k AS (SELECT c_custkey, list_sort(list_distinct(list(type))) AS types FROM f GROUP BY c_custkey) SELECT u.path, CASE WHEN c_custkey % 5 = 0 THEN 'ending' WHEN c_custkey % 7 = 0 THEN 'known' END AS error, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS total_chunks, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE (len(k.types) > 0)::INT END::BIGINT AS affected_chunks, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN '' ELSE array_to_string(k.types, ',') END AS types FROM u JOIN k USING (c_custkey)"""
    ),
)
def ingest_secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as uploads: some of a wrong ending, every seventh known."""
    u = sql(spark, sf_dir, _UPLOADS)
    known = u.where("c_custkey % 7 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    s = engine.ingest_secure(u, known)[1]
    return s.select("path", "error", "total_chunks", "affected_chunks", F.array_join("types", ",").alias("types"))


@query("oo19_upload_scan", raw(f"WITH {FOUND_SQL}, u AS ({_UPLOADS}) SELECT path, 0 AS chunk, f.type, round(max(f.score), 2)::DOUBLE AS score, count(*) AS n FROM u JOIN f USING (c_custkey) WHERE c_custkey % 5 <> 0 GROUP BY path, f.type"))
def upload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each chunk of the uploads that are taken."""
    c = engine.ingest_secure(sql(spark, sf_dir, _UPLOADS))[0]
    f = c.select("path", F.col("chunk"), F.explode("findings").alias("f")).groupBy("path", "chunk", F.col("f.type").alias("type")).agg(F.round(F.max("f.score"), 2).alias("score"), F.count("*").alias("n"))
    return f.select("path", "chunk", "type", "score", "n")


_SAYS = "CASE CAST(c_custkey % 5 AS INT) WHEN 4 THEN '전체 요약해줘' ELSE CASE CAST(c_custkey % 4 AS INT) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REQUESTS)) + " END END"


@query(
    "on8_classify_requests",
    raw(
        f"""WITH {FOUND_SQL}, k AS (SELECT p.c_custkey, coalesce(list_distinct(list(f.type) FILTER (WHERE f.type IS NOT NULL)), []) AS kinds FROM p LEFT JOIN f USING (c_custkey) GROUP BY p.c_custkey), q AS (SELECT c_custkey, kinds, {_SAYS} AS request FROM k),
        b AS (SELECT *, {_any('request', pii.BULK_WORDS)} AS asks, {_any('request', pii.RISK_WORDS)} AS risky, {_any('request', pii.RESULT_BULK_WORDS)} AND NOT contains(request, '요약') AS bulk FROM q),
        s AS (SELECT *, least(1, round(0.3 * risky::INT + 0.25 * (len(kinds) > 0)::INT + 0.3 * CASE WHEN len(kinds) > 0 THEN list_max(list_transform(kinds, lambda k: CASE k {' '.join(f"WHEN '{k}' THEN {w}" for k, w in pii.WEIGHTS.items())} END)) ELSE 0 END + 0.15 * (asks OR bulk)::INT, 4)) AS s0 FROM b), u AS (SELECT *, CASE WHEN asks THEN greatest(s0, 0.65) ELSE s0 END AS prs FROM s)
        SELECT c_custkey, prs::DOUBLE AS prs, CASE WHEN prs >= 0.65 THEN 'DANGEROUS' WHEN prs >= 0.3 THEN 'SENSITIVE' ELSE 'NORMAL' END AS label, prs < 0.65 AS allow, prs < 0.65 AND (prs >= 0.3 OR bulk) AS confirm FROM u"""
    ),
)
def classify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = findings.with_findings(view(spark, sf_dir, "profiles"))
    hits = p.select(F.col("c_custkey").alias("id"), F.array_distinct("findings.type").alias("types"))
    r = engine.classify_requests(p.select(F.col("c_custkey").alias("id"), F.expr(_SAYS).alias("query")), hits)
    return r.select(F.col("id").alias("c_custkey"), "prs", "label", "allow", "confirm")

_BOUND = f"greatest((CASE WHEN {' OR '.join(f'contains(lower(request), {chr(39)}{w}{chr(39)})' for w in S.SUMMARY_WORDS)} THEN 0.07 ELSE 0.15 END) - (CASE " + " ".join(f"WHEN {' OR '.join(f'contains(replace(lower(request), {chr(39)} {chr(39)}, {chr(39)}{chr(39)}), {chr(39)}{w.replace(' ', '')}{chr(39)})' for w in words)} THEN {by}" for words, by in S.GROUNDING_WORDS) + " ELSE 0 END), 0.05)"


@query("on8_answer_requests", raw(f"""WITH {FOUND_SQL}, k AS (SELECT p.c_custkey, coalesce(list_distinct(list(f.type) FILTER (WHERE f.type IS NOT NULL)), []) AS kinds FROM p LEFT JOIN f USING (c_custkey) GROUP BY p.c_custkey), q AS (SELECT c_custkey, kinds, {_SAYS} AS request FROM k),
        b AS (SELECT *, {_any('request', pii.BULK_WORDS)} AS asks, {_any('request', pii.RISK_WORDS)} AS risky, {_any('request', pii.RESULT_BULK_WORDS)} AND NOT contains(request, '요약') AS bulk FROM q),
        s AS (SELECT *, least(1, round(0.3 * risky::INT + 0.25 * (len(kinds) > 0)::INT + 0.3 * CASE WHEN len(kinds) > 0 THEN list_max(list_transform(kinds, lambda k: CASE k {' '.join(f"WHEN '{k}' THEN {w}" for k, w in pii.WEIGHTS.items())} END)) ELSE 0 END + 0.15 * (asks OR bulk)::INT, 4)) AS s0 FROM b), u AS (SELECT *, CASE WHEN asks THEN greatest(s0, 0.65) ELSE s0 END AS prs FROM s),
        v AS (SELECT *, request LIKE '%요약%' AS summary, request LIKE '%요약%' AND len(kinds) > 0 AS signal, c_custkey % 23 / 100.0 AS sim FROM u), l AS (SELECT *, CASE WHEN prs >= 0.65 THEN 'DANGEROUS' WHEN prs >= 0.3 OR signal THEN 'SENSITIVE' ELSE 'NORMAL' END AS label FROM v)
        SELECT c_custkey, label, CASE WHEN label = 'DANGEROUS' THEN 'blocked' WHEN sim < {_BOUND} THEN 'ungrounded' WHEN label = 'SENSITIVE' AND c_custkey % 6 <> 0 THEN 'masked' ELSE 'full' END AS action FROM l"""))
def answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each profile, which is its one hit and, where a summary is wanted, the document that it names: what is decided, and how it is shown."""
    p = findings.with_findings(view(spark, sf_dir, "profiles")).withColumn("types", F.array_distinct("findings.type"))
    name = F.concat(F.lit("d"), F.col("c_custkey").cast("string"))
    requests = p.select(F.col("c_custkey").alias("id"), F.expr(_SAYS).alias("query"), (F.col("c_custkey") % 6 == 0).alias("full_view"), name.alias("document"))
    hits = p.select(F.col("c_custkey").alias("id"), F.lit(1).alias("rank"), name.alias("chunk"), "text", "types", (F.col("c_custkey") % 23 / 100.0).alias("similarity"))
    signals = p.where(F.size("types") > 0).select(name.alias("document"), F.lit(1.0).alias("ratio"), "types")
    return engine.answer_requests(requests, hits, signals)[1].select(F.col("id").alias("c_custkey"), "label", "action")


@query("on9_search_loop_stored", "SELECT vec_id, label FROM embeddings WHERE label < 5")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that a stream of files brings up, version by version, and its latest version read back."""
    where = workdir.fresh(spark, "stream")
    e = table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").cast("string").alias("key"), F.lit("1").alias("sha"), "vec_id", "label")
    e.write.parquet(f"{where}/in")
    files = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    q = engine.index_stream(files, f"{where}/index", lambda df: df, f"{where}/checkpoint")
    q.awaitTermination()
    return engine.current_index(spark, f"{where}/index").select("vec_id", "label")


_VERSIONED = "SELECT rel_key AS key, CASE WHEN l.quality = 0 THEN concat(f.sha, '2') ELSE f.sha END AS sha, length(f.text) AS n FROM {files} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id WHERE coalesce(l.toxic, 0) = 0"


@query("oa16_index_commits", raw(_VERSIONED))
def index_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all files in three versions: all; the poor anew and the toxic gone; their buckets written anew. The last is read."""
    f = view(spark, sf_dir, "files").select("doc_id", F.col("rel_key").alias("key"), "sha", F.length("text").alias("n"))
    labels = table(spark, sf_dir, "labels")
    index = VersionedTable(spark, workdir.fresh(spark, "index"))
    index.replace(f.select("key", "sha", "n"))
    poor = f.join(labels.where("quality = 0"), "doc_id", "left_semi").select("key", F.concat("sha", F.lit("2")).alias("sha"), "n")
    toxic = f.join(labels.where("toxic = 1"), "doc_id", "left_semi").select("key")
    index.replace(poor.join(toxic, "key", "left_anti"), toxic, expect=1)
    index.compact(1)
    return index.read()
