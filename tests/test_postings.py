"""Best documents by term impacts: equal to summing all, with far fewer postings read where lists are long."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.operators import postings


def zipf(n, words, seed):
    rng = random.Random(seed)
    return [{f"t{min(words - 1, int(words ** rng.random()) - 1)}" for _ in range(rng.randrange(1, 60))} for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = zipf(6_000, 4_000, 1)
    rng = random.Random(2)
    rows = [(t, d, (1 + int(t[1:]) ** 0.5) * rng.choice([0.5, 0.75, 1.0])) for d, ts in enumerate(docs) for t in sorted(ts)]
    df = spark.createDataFrame(rows, "t string, doc long, impact double")
    return rows, df


@pytest.mark.parametrize("block", [64, 100_000])
def test_equal_to_summing_all(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "FIRST", 200)
    rows, df = corpus
    p = postings.build(df, 6_000)
    held = defaultdict(dict)
    for t, d, x in rows:
        held[t][d] = x
    rng = random.Random(3)
    queries = {i: {rng.choice(["t0", "t1", "t2", "t5", "t9"]), f"t{rng.randrange(3_000)}", f"t{rng.randrange(3_000)}", "unknown"} for i in range(25)} | {25: {"unknown"}, 26: {"t0"}, 27: {f"t{i}" for i in range(40)}}
    q = spark.createDataFrame([(i, t) for i, ts in queries.items() for t in ts for _ in range(2)], "item long, t string")
    want, full = set(), 0
    for i, ts in queries.items():
        s = defaultdict(float)
        for t in sorted(ts):
            full += len(held[t])
            for d, x in held[t].items():
                s[d] += x
        want |= {(i, n + 1, d, round(s[d], 6)) for n, d in enumerate(sorted(s, key=lambda d: (-round(s[d], 8), d))[:7])}
    for most in (0, 10**9):
        got, read = postings.best(p, q, 7, full=most)
        assert {(r.item, r["rank"], r.doc, round(r.s, 6)) for r in got.collect()} == want
        opened = read.agg(F.sum("postings")).first()[0]
        assert opened == full if most or block > 64 else opened < full
    if block == 64:  # queries of a rare and a common word
        short = q.where("item < 25")
        mine = sum(len(held[t]) for i in range(25) for t in queries[i])
        assert postings.best(p, short, 7, full=0)[1].agg(F.sum("postings")).first()[0] < mine / 2


def test_empty(spark, corpus):
    p = postings.build(corpus[1].limit(0), 0)
    assert postings.best(p, spark.createDataFrame([(1, "t0")], "item long, t string"), 3)[0].count() == 0
