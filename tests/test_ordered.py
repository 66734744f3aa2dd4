"""Places, quantiles and meeting spans, against plain loops, and that no task holds it all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import ordered, windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randrange(40), f"n{rng.randrange(9)}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a int, b string")
    got = ordered.numbered(df, F.desc("a"), "b", "id")
    assert [r.id for r in got.orderBy("place").collect()] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]
    assert sorted(r.place for r in got.collect()) == list(range(n)) and "SinglePartition" not in plan(got)


@pytest.mark.parametrize("most", [3, 10_000])
def test_quantiles_equal_sorting(spark, monkeypatch, most):
    """Ties, outliers, one value, two values, nulls and NaN; ranges that are cut again and again."""
    monkeypatch.setattr(ordered, "SORTED", most)
    monkeypatch.setattr(ordered, "RANGES", 8)
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(700)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(300)],
        "wide": [10.0 ** rng.randrange(-9, 12) for _ in range(200)],
        "one": [4.5],
        "two": [1.0, 2.0],
        "same": [7.0] * 50,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for c, s in shares.items():
            assert got[g][c] == pytest.approx(np.quantile(vs, s), rel=1e-12), (g, c)
    every = ordered.quantiles(df, [], "v", {"p90": 0.9}).collect()
    assert every[0].p90 == pytest.approx(np.quantile([v for vs in groups.values() for v in vs], 0.9), rel=1e-12)
    assert ordered.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_spans_that_meet(spark):
    """Spans of a day beside spans of a second, points, ends that touch, reversed and null ones."""
    rng = random.Random(8)
    span = lambda: (lambda s, n: (s, s + n))(rng.uniform(-500, 90_000), rng.choice([0.0, 0.5, 1.0, 3.0, 60.0, 4_000.0, 86_400.0]))
    left = [(i, rng.randrange(3), *span()) for i in range(120)] + [(900, 0, 5.0, 1.0), (901, 0, None, 3.0), (902, 1, 10.0, 20.0)]
    right = [(i, rng.randrange(3), *span()) for i in range(120)] + [(903, 1, 20.0, 30.0), (904, 1, 9.0, 10.0)]
    a, b = spark.createDataFrame(left, "x long, k int, s double, e double"), spark.createDataFrame(right, "y long, k int, u double, v double")
    want = sorted((i, j) for i, k, s, e in left for j, m, u, v in right if k == m and None not in (s, e) and s <= e and v >= s and u <= e)
    got = windows.overlap_join(a, b, "k", ("s", "e"), ("u", "v"), 1.0)
    assert sorted(map(tuple, got.select("x", "y").collect())) == want and {(902, 903), (902, 904)} <= set(want)
    assert got.columns == ["k", "x", "s", "e", "y", "u", "v"]


def test_a_long_span_has_few_keys(spark):
    day = spark.createDataFrame([(0, 0.0, 86_400.0)], "k int, s double, e double").withColumn("__own", windows._level(("s", "e"), 1.0))
    levels = F.filter(F.array(*map(F.lit, range(18))), lambda l: l >= F.col("__own"))
    assert windows._dealt(day, ("s", "e"), 1.0, levels).count() <= 4
    second = spark.createDataFrame([(0, 7.2, 8.1)], "k int, s double, e double").withColumn("__own", windows._level(("s", "e"), 1.0))
    assert windows._dealt(second, ("s", "e"), 1.0, F.filter(F.array(*map(F.lit, range(18))), lambda l: l >= F.col("__own"))).count() <= 2 * 18
