"""Media windows and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding(media: DataFrame, key: str, duration: str, length: float, hop: float, shortest_tail: float = 0.0) -> DataFrame:
    """(key, start, stop): windows from the media's start, one at least; the last is clipped, tails under ``shortest_tail`` go."""
    last = F.greatest(F.ceil(F.col(duration) / hop) - 1, F.lit(0)).cast("int")
    w = media.select(key, duration, F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * F.lit(float(hop)))).alias("start"))
    w = w.withColumn("stop", F.least(F.col("start") + length, duration))
    return w.where((F.col("start") == 0) | (F.col("stop") - F.col("start") >= shortest_tail)).select(key, "start", "stop")


def _level(span: tuple[str, str], unit: float) -> Column:
    """The power of two, times ``unit``, that is no shorter than a span."""
    return F.greatest(F.ceil(F.log2(F.greatest((F.col(span[1]) - F.col(span[0])) / unit, F.lit(1.0)))), F.lit(0)).cast("int")


def _dealt(df: DataFrame, span: tuple[str, str], unit: float, levels: Column) -> DataFrame:
    """``df`` with __level and __bucket: the buckets that a span touches at each of the levels, two at most at those no shorter than it."""
    wide = df.withColumn("__level", F.explode(levels))
    at = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), F.col("__level")) * unit))
    return wide.withColumn("__first", at(span[0])).withColumn("__bucket", F.explode(F.sequence(F.col("__first"), at(span[1]))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], unit: float) -> DataFrame:
    """Rows of equal key whose closed spans meet.

    A span's level is the power of two of ``unit`` that is no shorter. Of two spans the shorter is dealt to
    the buckets of the longer one's level, at most two each, so a span has two keys for each level that
    the other side has and not one for every unit that it lasts. The joins are on (key, level, bucket); a
    pair that meets in two buckets counts in its first only. Spans with a null or reversed end meet nothing.
    """
    a, b = (df.where(F.col(s[0]) <= F.col(s[1])).withColumn("__own", _level(s, unit)) for df, s in ((a, a_span), (b, b_span)))
    has = lambda df: F.array(*[F.lit(r[0]) for r in sorted(df.select("__own").distinct().collect())]).cast("array<int>")  # noqa: E731 (a level a row, some 60)
    of_a, of_b = has(a), has(b)
    own = F.array("__own")
    meet = (F.col(b_span[1]) >= F.col(a_span[0])) & (F.col(b_span[0]) <= F.col(a_span[1]))
    first = F.col("__bucket") == F.greatest("__first", "__first_b")

    def join(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.drop("__own").join(y.drop("__own").withColumnRenamed("__first", "__first_b"), [key, "__level", "__bucket"]).where(meet & first).drop("__level", "__bucket", "__first", "__first_b")

    shorter_a = join(_dealt(a, a_span, unit, F.filter(of_b, lambda l: l >= F.col("__own"))), _dealt(b, b_span, unit, own))
    shorter_b = join(_dealt(a, a_span, unit, own), _dealt(b, b_span, unit, F.filter(of_a, lambda l: l > F.col("__own"))))
    return shorter_a.unionByName(shorter_b)


def audio_ranges(media: DataFrame, key: str, duration: str, window: float = 30, hop: float = 10, shortest: float = 5) -> DataFrame:
    """(key, start, stop): ranges every ``hop`` until one reaches the end; media up to ``window`` long are one range."""
    last = F.greatest(F.ceil((F.col(duration) - window) / hop), F.lit(0)).cast("int")
    w = media.select(key, duration, F.explode(F.sequence(F.lit(0), last)).alias("i"))
    w = w.select(key, (F.col("i") * F.lit(float(hop))).alias("start"), F.least(F.col("i") * F.lit(float(hop)) + window, duration).alias("stop"))
    return w.where((F.col("start") == 0) | (F.col("stop") - F.col("start") >= shortest))
