"""Fingerprints against comparing all pairs."""

import numpy as np
import pytest

from orrery.operators import fingerprints


def similarity(a, b):
    n = min(len(a), len(b))
    return 1 - sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a[:n], b[:n], strict=True)) / (32.0 * n) if n else 0.0


def prints(seed=1):
    """Tracks, and copies with few bits turned, cut off, or with one word in common by chance."""
    rng = np.random.default_rng(seed)
    tracks = [rng.integers(0, 1 << 32, rng.integers(4, 40), dtype=np.uint32) for _ in range(60)]
    asked = []
    for i in range(0, 60, 3):
        q = tracks[i].copy()
        for _ in range(int(len(q) * 32 * [0.0, 0.02, 0.029, 0.031, 0.05][i // 3 % 5])):
            q[rng.integers(len(q))] ^= np.uint32(1 << int(rng.integers(32)))
        asked.append(q[: len(q) - i % 4])
    asked.append(np.concatenate([tracks[0][:1], tracks[1][1:]]))
    return tracks, [*asked, np.zeros(0, np.uint32)]


def frame(spark, some, key):
    signed = lambda x: [int(v) - (1 << 32 if v >= 1 << 31 else 0) for v in x]
    return spark.createDataFrame([(i, signed(x)) for i, x in enumerate(some)] + [(999, None)], f"{key} long, fp array<int>").repartition(3)


def test_near_equals_all_pairs(spark):
    tracks, asked = prints()
    got = fingerprints.near(frame(spark, asked, "qid"), frame(spark, tracks, "row_id"))
    want = {(q, t) for q, x in enumerate(asked) for t, y in enumerate(tracks) if similarity(x, y) >= 0.97}
    assert {(r.qid, r.row_id) for r in got.collect()} == want and len(want) > 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="above"):
        fingerprints.near(got, got, 0.9)


def test_best_equals_sorting(spark):
    tracks, asked = prints(3)
    got = fingerprints.best(np.arange(len(asked)), asked, frame(spark, tracks, "row_id"), 4, own=False)
    found = {}
    for r in got.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append((r.row_id, r.score))
    for q, x in enumerate(asked):
        s = {t: int(similarity(x, y) * 1e6 + 0.5) / 1e6 for t, y in [*enumerate(tracks), (999, [])] if t != q}
        assert found[q] == [(t, pytest.approx(s[t], abs=1e-9)) for t in sorted(s, key=lambda t: (-s[t], t))[:4]]
