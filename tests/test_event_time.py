"""Sessions over streams whose events come late, shuffled and again."""

import random
from pathlib import Path

import duckdb

from orrery.operators import sessions
from orrery.plans import recordings, registry
from orrery.sources import workdir

SCHEMA = "session string, event_id long, ts timestamp, event_type string, pii_types array<string>, user_query string"
TYPES = [*sessions.EVENTS, "view"]


def events(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        second = 5 * i + rng.randrange(5)
        out.append((f"s{rng.randrange(6)}", i, second, rng.choice(["view"] * 6 + TYPES), rng.choice([None, [], ["KR_RRN"], ["KR_RRN", "PASSPORT"]]), rng.choice(["", "신한 계좌", "국민 계좌", None])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, i, t, e, p, q) for s, i, t, e, p, q in rows], SCHEMA.replace("ts timestamp", "t long")).selectExpr("session", "event_id", "timestamp_seconds(1700000000 + t) AS ts", "event_type", "pii_types", "user_query")


def run(spark, tmp_path, batches, make):
    """What the stream gives for files that come one after the other, and its progress."""
    for n, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        got = []
        q = make(source).writeStream.outputMode("update" if make is risk else "append").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).trigger(availableNow=True).start()
        q.awaitTermination()
        yield q.recentProgress, got


def risk(source):
    return sessions.session_risk_stream(source, "session", "60 seconds")


def dropped(progress):
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def test_shuffled_and_repeated_events_give_the_batch_result(spark, tmp_path):
    rows, rng = events(), random.Random(1)
    want = {tuple(r) for r in sessions.session_risk(frame(spark, rows), "session").collect()}
    # within 60 seconds events change places: batches of eight, each with the last of the one before
    batches = [rows[i : i + 8] + rows[max(0, i - 4) : i] for i in range(0, len(rows), 8)]
    for b in batches:
        rng.shuffle(b)
    batches.append([("end", 10**6, 100_000, "view", None, "")])
    seen = [dropped(p) for p, _ in run(spark, tmp_path, batches, risk)]
    out = spark.read.parquet(f"{tmp_path}/out").where("session <> 'end'")
    last = {}
    for r in out.orderBy("batch").collect():
        last[r.session] = (r.session, r.score, r.warned, r.blocked)
    assert set(last.values()) == want and sum(seen) == 0
    assert {r[3] for r in want} == {True, False} or len(want) > 3


def test_events_beyond_the_delay_are_counted(spark, tmp_path):
    early = [("a", 1, 0, "full_view_click", None, ""), ("a", 2, 300, "full_view_click", None, "")]
    late = [("a", 3, 10, "dangerous_request", None, ""), ("a", 4, 290, "sensitive_request", None, ""), ("end", 9, 9_000, "view", None, "")]
    seen = [dropped(p) for p, _ in run(spark, tmp_path, [early, late], risk)]
    last = spark.read.parquet(f"{tmp_path}/out").where("session = 'a'").orderBy("batch").collect()[-1]
    assert last.score == 3 + 3 + 2 and sum(seen) >= 1


def test_session_windows_in_batch_and_stream(spark, tmp_path):
    rows = events(60, 7)
    want = {}
    for s in {r[0] for r in rows}:
        t = sorted(r[2] for r in rows if r[0] == s)
        start = t[0]
        for x, y in zip(t, [*t[1:], 10**9], strict=True):
            if y - x > 20:
                want[s, start] = (x, sum(start <= z <= x for z in t))
                start = y
    second = lambda c: int(c.timestamp()) - 1_700_000_000
    as_dict = lambda df: {(r.session, second(r.start)): (second(r.last), r.n_events) for r in df.collect()}
    assert as_dict(sessions.session_windows(frame(spark, rows), "session", "20 seconds")) == want
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    windows = lambda source: sessions.session_windows(source, "session", "20 seconds", "1 hour")
    list(run(spark, tmp_path, [shuffled[:30], shuffled[20:], [("end", 10**6, 100_000, "view", None, "")]], windows))
    assert as_dict(spark.read.parquet(f"{tmp_path}/out").where("session <> 'end'")) == want


def test_many_sessions_share_states(spark, tmp_path):
    """A call costs milliseconds, so calls are by groups of sessions: 6,000 sessions have no more states than groups."""
    rows = [(f"s{s}", 10 * s + i, 7 * i, "dangerous_request" if s % 3 == 0 else "sensitive_request", ["KR_RRN"] if i else None, "") for s in range(6_000) for i in range(1 + s % 4)]
    want = {tuple(r) for r in sessions.session_risk(frame(spark, rows), "session").collect()}
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    half = len(rows) // 2
    progress = [p for p, _ in run(spark, tmp_path, [shuffled[:half], shuffled[half - 100 :], [("end", 10**6, 100_000, "view", None, "")]], risk)]
    out = spark.read.parquet(f"{tmp_path}/out").where("session <> 'end'").selectExpr("session", "struct(score, warned, blocked) AS r", "batch").groupBy("session").agg({"batch": "count", "r": "max"})
    assert {(r.session, *r["max(r)"]) for r in out.collect()} == want
    assert {r[3] for r in want} == {True, False}
    states = [s["numRowsTotal"] for p in progress for x in p for s in x["stateOperators"] if s["operatorName"] == "applyInPandasWithState"]
    assert max(states) <= 1 << 12


def test_triggers_of_the_event_time_query_do_not_grow_with_files(spark, data, tmp_path, monkeypatch):
    for name in registry.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    (tmp_path / "events.parquet").unlink()
    spark.read.parquet(f"{data}/events.parquet").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(workdir, "fresh", lambda spark, name: f"{tmp_path}/{name}")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        got = {tuple(r) for r in recordings.session_risk_event_time(spark, str(tmp_path)).select("user_id", "score", "warned", "blocked").collect()}
    finally:
        spark.conf.set(key, before)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    assert got == set(con.sql(registry.oracle_sql()["ok4_session_risk_event_time"]).fetchall())
    assert len(list(Path(f"{tmp_path}/sessions/in").glob("n=*/*.parquet"))) > 12
    assert len(list(Path(f"{tmp_path}/sessions/out").glob("batch=*"))) <= 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None
