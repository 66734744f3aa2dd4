"""Exact search on three axes: a bounded set of queries against rows of any number, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.workdir import fresh

#: Widths of the three axes within a vector.
AXES = (24, 20, 20)
#: Products that are held at once.
CELLS = 1 << 21
#: Queries that are scored together; more go block by block.
BLOCK = 1 << 12
#: Rows that stay for each query of a task beyond the wanted ones, before they are cut.
SLACK = 64
#: How far a matrix product may be from the sum along the axis.
NEAR = 1e-9


def normal_axes(x: np.ndarray, axes: tuple[int, ...] = AXES) -> list[np.ndarray]:
    """Each axis of each row over its length."""
    out, at = [], 0
    for n in axes:
        part = x[:, at : at + n]
        out.append(part / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-12))
        at += n
    return out


class _Best:
    """The best k (score, then smaller id) of each query over a task's rows; sums of all scores, and the bounds of each axis and of scores."""

    def __init__(self, queries: int, k: int, extra: int = 0, axes: int = 0):
        self.k, self.queries, self._every = k, queries, np.arange(queries)
        self.score = np.full((queries, k), -np.inf)
        self.row = np.full((queries, k), np.iinfo(np.int64).max)
        self.more = np.zeros((queries, k, extra))
        self.n = np.zeros(queries, np.int64)
        self.s, self.ss = np.zeros(queries), np.zeros(queries)
        self.lo, self.hi = np.full((queries, axes + 1), np.inf), np.full((queries, axes + 1), -np.inf)  # the last: of scores
        self._held: list[tuple[np.ndarray, ...]] = []
        self._count = 0

    def add(self, at: slice | np.ndarray, score: np.ndarray, ids: np.ndarray, exact) -> None:
        """Scores of rows (down) with the queries ``at`` (across), -inf for those left out. Only what reaches a query's
        k-th best is kept, by its ``exact`` score and what else goes with it."""
        there = np.isfinite(score)
        whole = np.where(there, score, 0)
        self.n[at] += there.sum(0)
        self.s[at] += whole.sum(0)
        self.ss[at] += (whole * whole).sum(0)
        self.lo[at, -1] = np.minimum(self.lo[at, -1], np.where(there, score, np.inf).min(0, initial=np.inf))
        self.hi[at, -1] = np.maximum(self.hi[at, -1], score.max(0, initial=-np.inf))
        if len(ids) > self.k:
            low = np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k]  # of these rows' best k the least
        else:
            low = np.full(score.shape[1], -np.inf)
        r, q = np.nonzero(there & (score >= np.maximum(low, self.score[at, -1]) - NEAR))
        if len(r):
            value, more = exact(r, q)
            self._held.append((self._every[at][q], value, ids[r], more))
            self._count += len(r)
            if self._count > self.queries * (self.k + SLACK):
                self.cut()

    def bound(self, at: slice, axis: int, x: np.ndarray) -> None:
        self.lo[at, axis] = np.minimum(self.lo[at, axis], x.min(0))
        self.hi[at, axis] = np.maximum(self.hi[at, axis], x.max(0))

    def cut(self) -> None:
        if not self._held:
            return
        old = np.isfinite(self.score)
        q = np.concatenate([np.nonzero(old)[0], *(h[0] for h in self._held)])
        score = np.concatenate([self.score[old], *(h[1] for h in self._held)])
        row = np.concatenate([self.row[old], *(h[2] for h in self._held)])
        more = np.concatenate([self.more[old], *(h[3] for h in self._held)])
        order = np.lexsort((row, -score, q))
        q, score, row, more = q[order], score[order], row[order], more[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[:], self.row[:] = -np.inf, np.iinfo(np.int64).max
        self.score[q[top], place[top]], self.row[q[top], place[top]], self.more[q[top], place[top]] = score[top], row[top], more[top]
        self._held, self._count = [], 0


def three_axis(weights: tuple[float, float, float] = (1.0, 0.4, 0.2)):
    """The length of the weighted similarities."""
    return lambda parts, at: np.sqrt(sum((w * x) ** 2 for w, x in zip(weights, parts, strict=True)))


def channel(axis: int):
    """One axis' similarity."""
    return lambda parts, at: parts[axis]


#: What the similarities on the axes are called.
NAMES = ("dense", "lexical", "asf")


class AxisSearch:
    """Queries whose similarities with rows are wanted; rows of another width, or null ones, take no part."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: tuple[int, ...] = AXES):
        self.ids, self.axes, self.parts = ids, axes, normal_axes(np.asarray(vectors, float), axes)

    def _axes(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, sum(self.axes))
        return normal_axes(flat, self.axes)

    def _scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(from, to, similarities of those rows with all queries by axis)."""
        n, rows = batch.num_rows, self._axes(batch)
        # products are summed along the axis, so equal vectors have equal scores wherever they stand
        step = max(1, CELLS // max(1, len(self.ids) * max(self.axes)))
        for i in range(0, n, step):
            yield i, min(n, i + step), [(r[i : i + step, None, :] * q[None]).sum(2) for r, q in zip(rows, self.parts, strict=True)]

    def pairs(self, rows: DataFrame, *keep: str) -> DataFrame:
        """(qid, row_id, kept columns, dense, lexical, asf) of ``rows`` (row_id, vec, kept columns)."""
        rows = rows.where(F.size("vec") == sum(self.axes)).select("row_id", *keep, "vec")
        schema = "qid long, row_id long, " + "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep) + "dense double, lexical double, asf double"
        names = ["qid", "row_id", *keep, "dense", "lexical", "asf"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, s in self._scores(b) if len(self.ids) else ():
                    at = pa.array(np.repeat(np.arange(i, j), len(self.ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(self.ids, j - i)), b.column("row_id").take(at), *(b.column(c).take(at) for c in keep), *(pa.array(x.ravel()) for x in s)], names)

        return rows.mapInArrow(run, schema)

    def _blocks(self, rows: list[np.ndarray], i: int, j: int) -> Iterator[tuple[slice, slice, list[np.ndarray]]]:
        """(rows, queries, their similarities by axis) in pieces of CELLS products; the last digits depend on the piece."""
        for lo in range(0, len(self.ids), BLOCK):
            at = slice(lo, min(lo + BLOCK, len(self.ids)))
            step = max(1, CELLS // (at.stop - lo))
            for r in range(i, j, step):
                some = slice(r, min(r + step, j))
                yield some, at, [x[some] @ q[at].T for x, q in zip(rows, self.parts, strict=True)]

    def _exact(self, rows: list[np.ndarray], some: slice, at: slice, r: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """The similarities of single pairs by axis, summed along it: equal vectors have equal ones."""
        return [(x[some][r] * y[at][q]).sum(1) for x, y in zip(rows, self.parts, strict=True)]

    def _each(self, batches: Iterator[pa.RecordBatch], k: int, how, group: str | None, keep: tuple[str, ...], own: bool) -> Iterator[tuple[object, _Best]]:
        """(group, best of it) of a task's rows; the rows of a group come together, or all are one."""
        best, name = None, None
        for b in batches:
            if not b.num_rows or not len(self.ids):
                continue
            ids, rows = b.column("row_id").to_numpy(), self._axes(b)
            kept = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in keep], 1) if keep else np.zeros((b.num_rows, 0))
            names = b.column(group).to_pylist() if group else None
            cuts = [0, *(i for i in range(1, b.num_rows) if names[i] != names[i - 1]), b.num_rows] if group else [0, b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if best is None or (group and names[i] != name):
                    if best is not None:
                        best.cut()
                        yield name, best
                    best, name = _Best(len(self.ids), k, len(self.axes) + len(keep), len(self.axes)), names[i] if group else None
                for some, at, parts in self._blocks(rows, i, j):
                    score = how(parts, at)
                    if not own:
                        score = np.where(ids[some, None] == self.ids[None, at], -np.inf, score)
                    for axis, x in enumerate(parts):
                        best.bound(at, axis, x)

                    def exact(r, q, some=some, at=at, rows=rows, kept=kept):
                        each = self._exact(rows, some, at, r, q)
                        return how(each, np.arange(at.start, at.stop)[q]), np.concatenate([np.stack(each, 1), kept[some][r]], 1)

                    best.add(at, score, ids[some], exact)
        if best is not None:
            best.cut()
            yield name, best

    def best(self, rows: DataFrame, k: int, how=None, group: str | None = None, keep: tuple[str, ...] = (), own: bool = True) -> DataFrame:
        """(qid, rank, row_id, score, the similarities by axis, kept columns, n, mu, sd, lo_ and hi_ of each axis and of score) of the best k rows a query.

        ``how`` (parts, queries) makes a score of the similarities, ``three_axis()`` by default; by the values of
        a column ``group``, a null one too, if given. n, mu and sd are the number, mean and deviation of all
        scores of the query (and group), lo and hi the bounds of its similarities and scores. ``keep`` names
        numbers of the rows to carry; without ``own`` a row of the query's id takes no part in scores.

        A task keeps each query's best k of all its rows, and the sums of its scores, and gives them once:
        k rows a query, task and group, whatever the number of rows or queries. These few rows are
        written out, ranked and added up. Queries are taken in blocks of BLOCK, rows in steps that
        hold CELLS products. The last digits of a product depend on its place in a step, so rows that come
        near a query's k-th best are scored once more, along the axis: equal vectors have equal scores.
        With ``group`` rows are sorted within their task first, so one group is held at a time.
        """
        how, keep = how or three_axis(), tuple(c for c in keep if c != group)  # the group is there already
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ([group] if group else []) + list(keep)}
        rows = rows.where(F.size("vec") == sum(self.axes)).select("row_id", *kinds, "vec")
        if group:
            rows = rows.sortWithinPartitions(group)
        axes = [NAMES[i] if i < len(NAMES) else f"axis{i}" for i in range(len(self.axes))]
        ends = [f"{e}_{c}" for e in ("lo", "hi") for c in (*axes, "score")]
        figures = ["score", *axes, *keep, "s", "ss", *ends]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, best in self._each(batches, k, how, group, keep, own):
                full = np.isfinite(best.score)
                full[:, 0] |= best.n == 0  # the bounds of queries without a row count as well
                q, place = np.nonzero(full)
                first = place == 0
                put = lambda x: np.where(first, x[q], 0)  # noqa: E731, B023
                columns = [np.where(np.isfinite(best.score), best.score, np.nan)[q, place], *best.more[q, place].T, put(best.s), put(best.ss), *best.lo[q].T, *best.hi[q].T]
                out = [pa.array(self.ids[q]), pa.array(best.row[q, place]), pa.array(put(best.n)), *map(pa.array, columns)]
                if group:
                    out.append(pa.array([name] * len(q)).cast(_arrow(kinds[group])))
                yield pa.RecordBatch.from_arrays(out, ["qid", "row_id", "n", *figures, *([group] if group else [])])

        spark, path = rows.sparkSession, fresh(rows.sparkSession, "best")
        rows.mapInArrow(run, "qid long, row_id long, n long, " + ", ".join(f"`{c}` double" for c in figures) + (f", `{group}` {kinds[group]}" if group else "")).write.parquet(path)
        part = spark.read.parquet(path)
        by = ["qid", group] if group else ["qid"]
        sums = part.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), *[(F.min if e.startswith("lo") else F.max)(e).alias(e) for e in ends])
        mu = F.col("s") / F.col("n")
        stats = sums.select(*by, "n", mu.alias("mu"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mu * mu, F.lit(0.0))).alias("sd"), *ends)
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "row_id")
        top = part.where(~F.isnan("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        on = top["qid"] == stats["qid"]
        if group:
            on = on & top[group].eqNullSafe(stats[group])
        return top.join(stats, on).select(*[top[c] for c in (*by, "rank", "row_id", "score", *axes)], *[top[c].cast(kinds[c]).alias(c) for c in keep], *[stats[c] for c in ("n", "mu", "sd", *ends)])

    def ranks(self, rows: DataFrame, asked: DataFrame, how) -> DataFrame:
        """(qid, row_id, rank): the place of asked pairs (qid, row_id, score) among all rows by ``how``, ties to the smaller id.

        Scores are those that ``best`` gives with the same ``how``. A task counts, for each asked pair, its rows that
        come before it: one number a pair and task. The pairs go to every task, a bounded number a query.
        """
        got = asked.select("qid", "row_id", "score").toPandas()
        at = {int(q): i for i, q in enumerate(self.ids)}
        got["q"] = got["qid"].map(at)
        got = got.sort_values(["q", "score", "row_id"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
        q, score, row = got["q"].to_numpy(int), got["score"].to_numpy(), got["row_id"].to_numpy(np.int64)
        bounds = np.searchsorted(q, np.arange(len(self.ids) + 1))
        rows = rows.where(F.size("vec") == sum(self.axes)).select("row_id", "vec")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = np.zeros(len(q) + 1, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                ids, parts_of = b.column("row_id").to_numpy(), self._axes(b)
                for some, at_, parts in self._blocks(parts_of, 0, b.num_rows):
                    value = how(parts, at_)
                    for c in range(at_.stop - at_.start):
                        lo, hi = bounds[at_.start + c], bounds[at_.start + c + 1]
                        if lo == hi:
                            continue
                        up = score[lo:hi][::-1]
                        after = np.searchsorted(up, value[:, c])
                        near = np.flatnonzero((value[:, c] - up[np.maximum(after - 1, 0)] < NEAR) & (after > 0) | (up[np.minimum(after, hi - lo - 1)] - value[:, c] < NEAR) & (after < hi - lo))
                        value[near, c] = how(self._exact(parts_of, some, at_, near, np.full(len(near), c)), np.full(len(near), at_.start + c))
                        # a row stands before every pair of a lower score, and of the same and a greater id
                        place = np.searchsorted(-score[lo:hi], -value[:, c], "left")
                        for r in np.flatnonzero((place < hi - lo) & (score[np.minimum(lo + place, hi - 1)] == value[:, c])):
                            same = np.searchsorted(-score[lo:hi], -value[r, c], "right")
                            place[r] += np.searchsorted(row[lo + place[r] : lo + same], ids[some][r], "right")
                        np.add.at(before, lo + place[place < hi - lo], 1)
                        # counts run on to all later pairs of the query
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(before[:-1])], ["pair", "before"])

        spark, path = rows.sparkSession, fresh(rows.sparkSession, "ranks")
        rows.mapInArrow(run, "pair long, before long").write.parquet(path)
        counted = spark.read.parquet(path).groupBy("pair").agg(F.sum("before").alias("n")).toPandas()  # a number a pair
        first = np.zeros(len(q), np.int64)
        first[counted["pair"].to_numpy(int)] = counted["n"].to_numpy()
        total = np.cumsum(first)
        start = np.where(bounds[:-1] > 0, total[np.maximum(bounds[:-1] - 1, 0)], 0) if len(q) else np.zeros(len(self.ids), np.int64)
        place = total - start[q] + 1
        return spark.createDataFrame(list(zip(got["qid"].tolist(), row.tolist(), place.tolist(), strict=True)), "qid long, row_id long, rank long")


#: A quantile's scores are numbered by KEY_BITS bits between the bounds, KEY_STEP of them counted in a pass; so many scores are put in order in the end.
KEY_BITS, KEY_STEP, SORTED = 40, 10, 10_000


def quantile(searches: list[AxisSearch], rows: DataFrame, share: float, how, lo: float = -1.0, hi: float = 1.0) -> float | None:
    """The quantile of the scores of all queries of ``searches`` with all ``rows`` (row_id, vec), between neighbours by line; None without a score.

    No score of a pair leaves a task: each pass counts them by the next KEY_STEP bits of their place between
    ``lo`` and ``hi``, which bound them, and only those in the range that holds the wanted place are counted
    in the next one. A range of at most SORTED scores is put in order; one that is still fuller after all bits
    holds scores that differ by less than (hi - lo) / 2 ** KEY_BITS and stands for each of them.
    """
    rows = rows.where(F.size("vec") == sum(searches[0].axes)).select("row_id", "vec") if searches else rows

    def chosen(search: AxisSearch, batches: Iterator[pa.RecordBatch], ranges: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the range, its scores, their keys) piece by piece; a range is its leading bits and their number."""
        for b in batches:
            if b.num_rows and len(search.ids):
                for _, at, parts in search._blocks(search._axes(b), 0, b.num_rows):
                    v = how(parts, np.arange(at.start, at.stop)).ravel()
                    v = v[~np.isnan(v)]
                    key = np.clip((v - lo) / (hi - lo) * 2**KEY_BITS, 0, 2**KEY_BITS - 1).astype(np.int64)
                    for i, (lead, bits) in enumerate(ranges):
                        inside = key >> (KEY_BITS - bits) == lead
                        yield i, v[inside], key[inside]

    def counts(ranges: list[tuple[int, int]]) -> np.ndarray:
        def counter(search: AxisSearch):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n = np.zeros((len(ranges), 1 << KEY_STEP), np.int64)
                for i, _, key in chosen(search, batches, ranges):
                    n[i] += np.bincount(key >> (KEY_BITS - ranges[i][1] - KEY_STEP) & ((1 << KEY_STEP) - 1), minlength=1 << KEY_STEP)
                i, r = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(r), pa.array(n[i, r])], ["i", "r", "n"])

            return run

        out = np.zeros((len(ranges), 1 << KEY_STEP), np.int64)
        one = reduce(DataFrame.union, [rows.mapInArrow(counter(s), "i long, r long, n long") for s in searches])
        for i, r, n in one.groupBy("i", "r").agg(F.sum("n")).collect():  # at most 2 x 1,024 numbers
            out[i, r] = n
        return out

    def values(ranges: list[tuple[int, int]]) -> list[np.ndarray]:
        def giver(search: AxisSearch):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for i, v, _ in chosen(search, batches, ranges):
                    if len(v):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(v)], ["i", "v"])

            return run

        got = reduce(DataFrame.union, [rows.mapInArrow(giver(s), "i long, v double") for s in searches]).toPandas()  # at most 2 x SORTED
        return [np.sort(got["v"].to_numpy()[got["i"].to_numpy() == i]) for i in range(len(ranges))]

    if not searches:
        return None
    first = counts([(0, 0)])[0]
    total = int(first.sum())
    if not total:
        return None
    at = (total - 1) * share
    wanted = [[0, 0, k, first] for k in sorted({int(np.floor(at)), int(np.ceil(at))})]  # leading bits, their number, place in the range, counts below
    full = wanted
    while full:
        for w in full:
            run = np.cumsum(w[3])
            r = int(np.searchsorted(run, w[2], "right"))
            w[:] = [w[0] << KEY_STEP | r, w[1] + KEY_STEP, w[2] - int(run[r] - w[3][r]), w[3][r]]
        full = [w for w in full if w[3] > SORTED and w[1] < KEY_BITS]
        if full:
            for w, n in zip(full, counts([(w[0], w[1]) for w in full]), strict=True):
                w[3] = n
    few = [w for w in wanted if w[3] <= SORTED]
    held = dict(zip(map(id, few), values([(w[0], w[1]) for w in few]), strict=True)) if few else {}
    ends = [float(held[id(w)][w[2]]) if id(w) in held else lo + (w[0] + 0.5) / 2**KEY_BITS * (hi - lo) for w in wanted]
    return ends[0] + (at - np.floor(at)) * (ends[-1] - ends[0])


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
