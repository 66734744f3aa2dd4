"""Exact vector search: few rows leave a task, all domains are asked, clusters that cannot matter are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import engine
from orrery.operators import axis_search, clustered, fusion, ordered
from orrery.operators.axis_search import AxisSearch
from orrery.plans import registry

WEIGHTS = (1.0, 0.4, 0.2)


def vectors(n, kind, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(12, 64))[rng.integers(0, 12, n)] + 0.05 * x
    x[n // 2] = x[n // 3]  # equal vectors
    return x.astype(np.float32)


def frame(spark, x, **more):
    return spark.createDataFrame([(i, v.tolist(), *[m(i) for m in more.values()]) for i, v in enumerate(x)], "row_id long, vec array<float>" + "".join(f", {c} string" for c in more)).repartition(3)


def plain(x, ids, k, rows=None):
    parts = axis_search.normal_axes(x.astype(float))
    out = {}
    for q in ids:
        s = np.sqrt(sum((w * (p * p[q]).sum(1)) ** 2 for w, p in zip(WEIGHTS, parts, strict=True)))
        some = range(len(x)) if rows is None else rows
        out[q] = [(i, round(float(s[i]), 9)) for i in sorted(some, key=lambda i: (-s[i], i))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.row_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_best_of_blocks_equals_plain_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(axis_search, "CELLS", 500)
    monkeypatch.setattr(axis_search, "BLOCK", 7)
    x = vectors(300, kind)
    ids = np.arange(0, 300, 15)
    got = AxisSearch(ids, x[ids]).best(frame(spark, x), 6)
    assert found(got) == plain(x, ids, 6)
    s = np.array([[v for _, v in r] for r in plain(x, ids, 300).values()])
    for r in got.where("rank = 1").collect():
        assert (r.mu, r.sd) == pytest.approx((s[list(ids).index(r.qid)].mean(), s[list(ids).index(r.qid)].std()), abs=1e-8)


def test_few_rows_leave_a_task(spark, monkeypatch):
    """2,000 queries: k rows a query and task are written, whatever the steps are."""
    written = []
    monkeypatch.setattr(axis_search, "fresh", lambda s, n, f=axis_search.fresh: written.append(f(s, n)) or written[-1])
    x = vectors(2_000, "uniform")
    rows = frame(spark, x)
    AxisSearch(np.arange(2_000), x).best(rows, 5)
    tasks = rows.rdd.getNumPartitions()
    assert spark.read.parquet(written[0]).count() == 2_000 * 5 * tasks < 2_000 * 2_000 / 50


def test_every_domain_is_asked(spark):
    """Seventy domains and rows without one, in one pass."""
    x = vectors(210, "uniform")
    rows = frame(spark, x, domain=lambda i: None if i % 71 == 70 else f"d{i % 71:02d}")
    q = spark.createDataFrame([(0, x[0].tolist())], "qid long, vec array<float>")
    got = engine.search_all(q, rows, 200).collect()
    assert len(got) == 210 and {r.domain for r in got} == {None, *(f"d{i:02d}" for i in range(70))}
    one = engine.search_all(q, rows, 2, domain="d03").collect()
    assert {r.domain for r in one} == {"d03"}
    per = AxisSearch(np.array([0]), x[:1]).best(rows, 2, group="domain")
    for d in (None, "d05"):
        some = [i for i in range(210) if (i % 71 == 70) == (d is None) and (d is None or i % 71 == 5)]
        assert found(per.where(F.col("domain").eqNullSafe(d))) == plain(x, [0], 2, some)


@pytest.mark.parametrize(("kind", "share"), [("clustered", 0.5), ("uniform", 1.0)])
def test_clusters_that_cannot_matter_are_left_out(spark, kind, share):
    x = vectors(1_500, kind, 4)
    ids = np.arange(0, 1_500, 50)
    c = clustered.build(frame(spark, x), clusters=24, sample=400)
    got, scores = clustered.best(c, ids, x[ids], 8)
    assert found(got) == plain(x, ids, 8)
    assert 0 < scores <= share * len(ids) * len(x) and c.count.sum() == len(x)


def test_clusters_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0] * 64), (2, None), (3, [1.0] * 3), (4, [1.0] * 64), (4, [1.0] * 64)], "row_id long, vec array<float>")
    c = clustered.build(rows, clusters=4)
    got, _ = clustered.best(c, np.array([9]), np.ones((1, 64)), 5)
    assert [r[0] for r in found(got)[9]] == [4, 4, 1]
    empty, scores = clustered.best(clustered.build(rows.limit(0)), np.array([9]), np.ones((1, 64)), 5)
    assert empty.count() == 0 and scores == 0


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_sums_over_whole_lists(spark, monkeypatch, kind):
    """Reciprocal ranks and scaled channels, against sorting everything; small heads make the threshold algorithm go on."""
    from orrery.operators import fusion

    monkeypatch.setattr(axis_search, "CELLS", 700)
    x = vectors(260, kind, 9)
    ids, parts = np.arange(0, 260, 20), axis_search.normal_axes(x.astype(float))
    rows = frame(spark, x)
    search = AxisSearch(ids, x[ids])
    rrf, scaled = {}, {}
    for q in ids:
        ch = [(p * p[q]).sum(1) for p in parts]
        rank = [np.empty(260, int) for _ in range(2)]
        for r, c in zip(rank, ch, strict=False):
            r[np.lexsort((np.arange(260), -c))] = np.arange(1, 261)
        s = 1 / (60 + rank[0]) + 1 / (60 + rank[1])
        rrf[q] = [(i, round(float(s[i]), 9)) for i in sorted(range(260), key=lambda i: (-s[i], i))[:5]]
        f = sum(w * (c - c.min()) / (c.max() - c.min() + 1e-9) for w, c in zip(fusion.WEIGHTS, ch, strict=True))
        scaled[q] = [(i, round(float(f[i]), 9)) for i in sorted(range(260), key=lambda i: (-f[i], i))[:5]]
    for first in (0, 5):
        assert found(fusion.reciprocal_best(search, rows, 5, first=first)) == rrf
    assert found(fusion.min_max_best(search, rows, 5)) == scaled


def test_own_rows_and_groups(spark):
    """Without a query's own row, by groups: figures and kept numbers are those of the rows that count."""
    x = vectors(120, "uniform", 3)
    rows = frame(spark, x).withColumn("label", (F.col("row_id") % 4).cast("int"))
    ids = np.array([0, 7])
    got = AxisSearch(ids, x[ids]).best(rows, 3, group="label", keep=("label",), own=False)
    for q in ids:
        for g in range(4):
            some = [i for i in range(120) if i % 4 == g and i != q]
            mine = [r for r in got.collect() if r[0] == q and r[1] == g]
            assert [(r.row_id, round(r.score, 9)) for r in sorted(mine, key=lambda r: r["rank"])] == plain(x, [q], 3, some)[q] and {r.n for r in mine} == {len(some)}


@pytest.mark.parametrize("held", [10_000, 5, 0])
def test_quantile_of_scores_by_counts(spark, monkeypatch, held):
    """Equal to the quantile of all pairs, with ties, whether many, few or no scores may be put in order."""
    monkeypatch.setattr(axis_search, "SORTED", held)
    monkeypatch.setattr(axis_search, "CELLS", 700)
    x = vectors(200, "uniform")
    x[50:90] = x[50]  # equal scores
    ids = np.arange(0, 200, 9)
    rows = frame(spark, x)
    searches = [AxisSearch(ids[:10], x[ids[:10]]), AxisSearch(ids[10:], x[ids[10:]])]
    part = axis_search.normal_axes(x.astype(float))[0]
    every = (part @ part[ids].T).ravel()
    for share in (0.0, 0.33, 0.95, 1.0):
        assert axis_search.quantile(searches, rows, share, axis_search.channel(0)) == pytest.approx(np.quantile(every, share), abs=1e-9)


def test_quantile_without_scores(spark):
    x = vectors(5, "uniform")
    none = AxisSearch(np.zeros(0, np.int64), np.zeros((0, 64)))
    assert axis_search.quantile([none], frame(spark, x), 0.5, axis_search.channel(0)) is None
    assert axis_search.quantile([], frame(spark, x), 0.5, axis_search.channel(0)) is None


def test_calibration_and_gating_make_no_row_a_pair(spark, monkeypatch):
    from orrery.plans import registry

    def refused(*_):
        raise AssertionError("a row a pair")

    monkeypatch.setattr(AxisSearch, "pairs", refused)
    for name in ("om12_music_calibration", "ob15_channel_gating"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize(("parts", "sent"), [(8, 200_000), (1, 0)])
def test_reciprocal_sums_of_every_pair(spark, monkeypatch, parts, sent):
    """Ties to the smaller id; a query's list reaches over partitions; no pair is left out."""
    monkeypatch.setattr(ordered, "SENT", sent)
    rng = np.random.default_rng(8)
    pairs = [(q, r, float(rng.integers(0, 9)), float(rng.integers(0, 99))) for q, n in ((0, 700), (100, 3), (200, 1), (-5, 90)) for r in range(n)]
    want = {}
    for axis in (2, 3):
        for q in {p[0] for p in pairs}:
            for rank, p in enumerate(sorted((p for p in pairs if p[0] == q), key=lambda p: (-p[axis], p[1])), 1):
                want[q, p[1]] = want.get((q, p[1]), 0) + 1 / (fusion.RANK + rank)
    df = spark.createDataFrame(pairs, "qid long, row_id long, dense double, lexical double").repartition(parts)
    got = fusion.reciprocal_sums(df).collect()
    assert len(got) == len(pairs) and {(r.qid, r.row_id): round(r.score, 12) for r in got} == {k: round(v, 12) for k, v in want.items()}


def test_uncut_reciprocal_ranks_give_every_pair(spark, data):
    """Each query of the set with each row, not a number of best ones."""
    ids = [r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()]
    got = [(r.qid, r.row_id) for r in registry.queries()["oe2_rrf_uncut"](spark, data).collect()]
    assert sorted(got) == sorted((q, r) for q in ids if q % 100 == 0 for r in ids)


def test_inspection_takes_any_number_of_queries(spark, monkeypatch):
    x = vectors(1_400, "even")
    queries = frame(spark, x).withColumnRenamed("row_id", "qid")
    rows = frame(spark, x[:15])

    def of(q):
        return {(r.qid, r.row_id): (r.dense, r.lexical, r.asf, r.rrf) for r in engine.inspect(q, rows).collect()}

    whole = of(queries)
    parts = axis_search.normal_axes(x.astype(float))
    for q in range(0, 1_400, 77):
        dense, lexical, asf = [(p[:15] * p[q]).sum(1) for p in parts]
        place = lambda s: {i: n for n, i in enumerate(sorted(range(15), key=lambda i: (-s[i], i)), 1)}  # noqa: E731, B023
        first, second = place(dense), place(lexical)
        for i in range(15):
            assert np.allclose(whole[q, i], (dense[i], lexical[i], asf[i], 1 / (60 + first[i]) + 1 / (60 + second[i])), atol=1e-12)
    assert len(whole) == 1_400 * 15
    monkeypatch.setattr(engine, "PART", 500)
    assert len(list(engine._in_parts(queries, axis_search.AXES))) == 6
    assert of(queries) == whole
