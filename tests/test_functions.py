import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import pii, scoring, text
from orrery.functions import vector as V
from orrery.operators.windows import sliding


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("z", [-4.0, -1.3, -0.2, 0.0, 0.7, 2.5, 5.0])
def test_gaussian_cdf(spark, z):
    assert abs(one(spark, scoring.gaussian_cdf(F.col("z")), z=z) - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-7


@pytest.mark.parametrize("p", [0.001, 0.01, 0.3, 0.5, 0.95, 0.999])
def test_inverse_normal(spark, p):
    z = one(spark, scoring.inverse_normal(F.col("p")), p=p)
    assert abs(0.5 * (1 + math.erf(z / math.sqrt(2))) - p) < 1e-8


@pytest.mark.parametrize(("x", "y"), [(0.1, 0.3), (0.25, 0.7), (0.3, 0.7 + 0.05 * 4 / 3), (0.4, 0.9), (0.6, 0.98), (1.0, 0.99)])
def test_display_curve(spark, x, y):
    assert abs(one(spark, scoring.display_curve(F.col("x")), x=x) - y) < 1e-9


@pytest.mark.parametrize(("n", "ok"), [("900101-1123456", False), ("900101-1123459", True), ("850202-2345678", False), ("850202-2345677", True)])
def test_resident_number(spark, n, ok):
    assert one(spark, pii.resident_valid(F.col("n")), n=n) is ok


@pytest.mark.parametrize(("n", "ok"), [("123-45-67890", False), ("123-45-67891", True)])
def test_business_number(spark, n, ok):
    assert one(spark, pii.business_valid(F.col("n")), n=n) is ok


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="취업 통계 the AI-x7 a") == ["취업", "통계", "ai-x7"]


def test_snippet(spark):
    words = F.array(F.lit("cat"))
    assert one(spark, text.best_snippet(F.col("t"), words), t="A dog. A cat sat! Another cat.") == "A cat sat!"
    assert one(spark, text.best_snippet(F.col("t"), words), t="No such beast here") == "No such beast here"


def test_windows(spark):
    media = spark.createDataFrame([(1, 3.0), (2, 30.0), (3, 31.0), (4, 65.0)], "f long, d double")
    got = {(r[0], r[1], r[2]) for r in sliding(media, "f", "d", 30, 15).collect()}
    assert {(1, 0.0, 3.0), (2, 0.0, 30.0), (3, 30.0, 31.0), (4, 60.0, 65.0)} <= got


def test_normalise_zero(spark):
    assert one(spark, V.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
