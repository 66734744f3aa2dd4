"""Null distributions, thresholds and their guards, gold sets, and measures of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scoring as S
from orrery.operators.ordered import quantiles

#: The least cosine of a gold row, and the fewest and most gold rows of a query, by domain.
GOLD = {"image": (0.50, 10, 300), "doc_page": (0.45, 20, 2000), "movie": (0.35, 20, 200)}
#: What a domain without a calibration has.
DEFAULT = {"mu_null": 0.0, "sigma_null": 1.0, "abs_threshold": 0.5}


def threshold(mu: Column, sigma: Column, far: float) -> Column:
    """The score that a share ``far`` of a normal null exceeds."""
    return mu + S.inverse_normal(F.lit(1 - far)) * sigma


def drawn_pairs(rows: DataFrame, n: int, key: str, per_row: int = 1, prime: int = 7919) -> DataFrame:
    """(key, other): for each row ``per_row`` others, drawn by the key; rows are numbered 0 to n - 1 by ``key``. Equi-joins, no RNG."""
    i = F.explode(F.sequence(F.lit(1), F.lit(per_row)))
    return rows.select(key, i.alias("i")).select(key, F.pmod(F.col(key) * prime + 13 * F.col("i"), F.lit(n)).alias("other")).where(F.col(key) != F.col("other")).distinct()


def crossmodal(previous: DataFrame, measured: DataFrame) -> DataFrame:
    """(domain, mu_null, sigma_null, abs_threshold, status): the measured values, unless the threshold is over twice the previous one."""
    p = previous.select("domain", F.col("mu_null").alias("pm"), F.col("sigma_null").alias("ps"), F.col("abs_threshold").alias("pt"))
    j = measured.join(p, "domain", "left")
    out = (F.col("pt") > 0) & (F.col("abs_threshold") > 2 * F.col("pt"))
    pick = lambda new, old: F.when(out, F.col(old)).otherwise(F.col(new)).alias(new)
    return j.select("domain", pick("mu_null", "pm"), pick("sigma_null", "ps"), pick("abs_threshold", "pt"), F.when(out, "rejected").otherwise("ok").alias("status"))


def drift_guard(previous: DataFrame, measured: DataFrame) -> DataFrame:
    """The same for recordings: kept is the previous mean and threshold if one of them more than doubled, or fell below half."""
    p = previous.select("domain", F.col("mu_null").alias("pm"), F.col("abs_threshold").alias("pt"))
    j = measured.join(p, "domain", "left")
    off = lambda new, old: (F.col(old) > 0) & ((F.col(new) > 2 * F.col(old)) | (F.col(new) < 0.5 * F.col(old)))
    out = F.coalesce(off("mu_null", "pm") | off("abs_threshold", "pt"), F.lit(False))
    return j.select("domain", F.when(out, F.col("pm")).otherwise(F.col("mu_null")).alias("mu_null"), F.when(out, F.col("pt")).otherwise(F.col("abs_threshold")).alias("abs_threshold"), F.when(out, "kept").otherwise("updated").alias("status"))


def merged(store: DataFrame, measured: DataFrame) -> DataFrame:
    """A store's calibrations with the measured ones in the place of theirs; domains of one side only stay."""
    m = measured.select(*store.columns)
    return store.join(m.select("domain"), "domain", "left_anti").select(*store.columns).unionByName(m)


def with_defaults(domains: DataFrame, store: DataFrame) -> DataFrame:
    """(domain, mu_null, sigma_null, abs_threshold) of every domain, the defaults for those without."""
    j = domains.select("domain").distinct().join(store, "domain", "left")
    return j.select("domain", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULT.items()])


def lacking(domains: DataFrame, store: DataFrame, least: float = 0.45) -> DataFrame:
    """Domains that must be calibrated: none stored, or only the default threshold, which is ``least`` or more."""
    return domains.select("domain").distinct().join(store.where(F.col("abs_threshold") < least), "domain", "left_anti")


def must_recalibrate(then: Column, now: Column) -> Column:
    """By rows at the last calibration and now: few rows then, 500 more, or a tenth of all."""
    added = now - then
    return (then < 100) | (added >= 500) | (added >= 0.1 * now)


def gold(scores: DataFrame, theta: float, fewest: int, most: int) -> DataFrame:
    """(qid, row_id): rows of cosine ``theta`` or more, but the best ``fewest`` at least and ``most`` at most. scores: qid, row_id, score."""
    n = scores.groupBy("qid").agg(F.count(F.when(F.col("score") >= theta, 1)).alias("passing"))
    r = scores.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row_id"))).where(F.col("rn") <= most)
    return r.join(n, "qid").where(F.col("rn") <= F.greatest(F.lit(fewest), F.least("passing", F.lit(most)))).select("qid", "row_id")


def precision(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """(qid, precision) of hits (qid, row_id); null without any gold."""
    g = golden.withColumn("g", F.lit(1))
    has = golden.select("qid").distinct().withColumn("has", F.lit(True))
    p = hits.join(g, ["qid", "row_id"], "left").groupBy("qid").agg(F.round(F.count("g") / F.greatest(F.count("*"), F.lit(1)), 4).alias("p"))
    return p.join(has, "qid", "left").select("qid", F.when(F.col("has"), F.col("p")).alias("precision"))


def judged(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(qid, n_expected, hit, coverage, mrr, top1, n_dup) of results (qid, rank, name) against expected names (qid, name); names without case."""
    e = expected.select("qid", F.lower("name").alias("name")).distinct()
    n = e.groupBy("qid").agg(F.count("*").alias("n_expected"))
    r = results.where(F.col("rank") <= k).withColumn("name", F.lower("name"))
    pos = r.join(e, ["qid", "name"], "left_semi").groupBy("qid").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    dup = r.groupBy("qid", "name").agg((F.count("*") - 1).alias("d")).groupBy("qid").agg(F.sum("d").alias("n_dup"))
    j = n.join(pos, "qid", "left").join(dup, "qid", "left")
    return j.select(
        "qid",
        "n_expected",
        F.col("found").isNotNull().alias("hit"),
        (F.coalesce("found", F.lit(0)) / F.least("n_expected", F.lit(k))).alias("coverage"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("first") == 1, F.lit(False)).alias("top1"),
        F.coalesce("n_dup", F.lit(0)).alias("n_dup"),
    )


def latencies(runs: DataFrame) -> DataFrame:
    """(name, p50, p95, n) of timed runs (name, seconds)."""
    return quantiles(runs, ["name"], "seconds", {"p50": 0.5, "p95": 0.95}).select("name", "p50", "p95", "n")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, shared, only_a, only_b) of two channels' results (qid, row_id)."""
    both = a.select("qid", "row_id", F.lit(1).alias("a")).join(b.select("qid", "row_id", F.lit(1).alias("b")), ["qid", "row_id"], "full")
    return both.groupBy("qid").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
