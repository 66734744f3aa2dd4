"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import queries, repeats

NO_RUN = [None] * 4


def brute(w, least=24, times=3):
    """Every period's maximal stretches, those kept whose smallest period it is."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, times * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def row_of(doc_id, text):
    """What the contract says of one document."""
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs, gone = brute(w), set()
    for s, m, q in runs:
        gone |= set(range(s + q, s + m))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = NO_RUN
    if runs:
        s, m, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = [s, m, q, 1000 * m // q]
    return [doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 12)), max_size=8), st.sampled_from([(24, 3), (6, 3), (5, 2)]))
def test_runs_equal_all_stretches(parts, sizes):
    words = [x for part, n in parts for x in part * n][:400]
    cut = len(words) // 3
    got = repeats.find(np.array(words, int), np.array([0, cut, cut, len(words)]), *sizes)
    assert got == [brute(w, *sizes) for w in (words[:cut], [], words[cut:])]


def test_long_periods_stay_near_linear():
    """A period far above the dense lengths, a hundred thousand equal words, and a text of Fibonacci words, all runs at once."""
    assert repeats.find(np.arange(30_000) % 4_000, np.array([0, 30_000])) == [[(0, 30_000, 4_000)]]
    assert repeats.find(np.zeros(100_000, int), np.array([0, 100_000])) == [[(0, 100_000, 1)]]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert repeats.find(np.array(b), np.array([0, len(b)])) == [brute(b)]


def test_query_equals_plain_loops(spark, data):
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(list, queries.op12_periodic_runs(spark, data).select(cols).collect()))
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert got == sorted(row_of(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)


def test_odd_rows(spark):
    """Nulls, blanks, repeats, equal exponents, long texts, names that clash in any case, an empty table."""
    again = "a b c " * 9
    rows = [(1, None, 0.0, "x"), (1, "", 0.0, "x"), (None, " \t\n", None, None), (2, again + "x y", 1.0, "x"), (2, again + "x y", 1.0, "x"), (3, again + "| " + "d e f " * 9, 1.0, None), (4, "z " * 200_000, 1.0, None), (5, "é E " * 12 + "é e", 1.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS double, `__text` string")
    got = repeats.collapse(docs)
    assert got.columns == ["doc_id", "text", "__text", "n_words", "runs", "best", "collapsed"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert [(by[k].n_words, by[k].runs, by[k].best, by[k].collapsed) for k in [(1, None), (1, ""), (None, " \t\n")]] == [(0, [], None, "")] * 3
    assert by[2, again + "x y"].collapsed == "a b c x y" and got.where("doc_id = 2").count() == 2
    two = by[3, rows[5][1]]
    assert [tuple(r) for r in two.runs] == [(0, 27, 3), (28, 27, 3)] and tuple(two.best) == (0, 27, 3)
    assert tuple(by[4, "z " * 200_000].best) == (0, 200_000, 1) and by[4, "z " * 200_000].collapsed == "z"
    assert [tuple(r) for r in by[5, rows[7][1]].runs] == [(0, 25, 2)]
    assert repeats.collapse(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        repeats.find(np.zeros(3, int), np.array([0, 3]), 24, 1)
