"""Session risk: points of each event, and the sum that stops once the session is blocked; in a batch and over a stream."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of events, of repeats, and the bounds.
EVENTS = {"sensitive_request": 2, "full_view_click": 3, "policy_bypass_attempt": 5, "dangerous_request": 6, "pii_in_output_detected": 4, "regenerate_triggered": 2, "bulk_request": 5}
SAME_TYPE, INSTITUTIONS, RAPID = 2, 4, 3
WARN, BLOCK = 8, 15
SECONDS, REQUESTS = 30, 3
#: Names of institutions in requests.
NAMES = ["신한", "kb", "국민", "하나", "우리", "농협", "기업", "산업", "카카오뱅크", "토스뱅크", "케이뱅크", "씨티", "sc제일"]


def points(events: DataFrame, session: str) -> DataFrame:
    """``events`` (event_id, ts, event_type, pii_types, user_query) with n (place in the session), before (earlier events within
    SECONDS), repeats (types that the session has had), institutions (seen so far) and points.

    Events are ordered by time, then id. All by windows and counts over the session's key; no group is collected.
    """
    order = Window.partitionBy(session).orderBy("ts", "event_id")
    e = events.withColumn("n", F.row_number().over(order))
    near = Window.partitionBy(session).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-SECONDS * 1_000_000, 0)
    e = e.withColumn("before", (F.col("n") - F.min("n").over(near)).cast("int"))
    kinds = e.select(session, "n", F.posexplode("pii_types").alias("at", "kind"))
    again = F.row_number().over(Window.partitionBy(session, "kind").orderBy("n", "at")) > 1
    repeats = kinds.withColumn("again", again.cast("int")).groupBy(session, "n").agg(F.sum("again").cast("int").alias("repeats"))
    named = e.select(session, "n", F.explode(F.filter(F.array(*map(F.lit, NAMES)), lambda k: F.contains("user_query", k))).alias("name"))
    first = named.groupBy(session, "name").agg(F.min("n").alias("n")).groupBy(session, "n").agg(F.count("*").alias("new"))
    e = e.join(repeats, [session, "n"], "left").join(first, [session, "n"], "left")
    e = e.withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    e = e.withColumn("institutions", F.coalesce(F.sum("new").over(Window.partitionBy(session).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int")).drop("new")
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])[F.col("event_type")], F.lit(0))
    many = (F.col("institutions") >= 2) & (F.coalesce("user_query", F.lit("")) != "")
    total = base + F.when(F.col("before") >= REQUESTS, RAPID).otherwise(0) + SAME_TYPE * F.col("repeats") + F.when(many, INSTITUTIONS).otherwise(0)
    return e.withColumn("points", total)


def session_risk(events: DataFrame, session: str) -> DataFrame:
    """(session, score, warned, blocked). The score is the running sum at the first event that reaches BLOCK, else the whole sum:
    later points do not count. Warned is a session that was between the bounds after some event."""
    run = points(events, session).withColumn("sum", F.sum("points").over(Window.partitionBy(session).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    s = F.col("sum")
    total = F.coalesce(F.min(F.when(s >= BLOCK, s)), F.max("sum"))
    warned = F.coalesce(F.max((s >= WARN) & (s < BLOCK)), F.lit(False))
    return run.groupBy(session).agg(total.cast("long").alias("score"), warned.alias("warned")).select(session, "score", "warned", (F.col("score") >= BLOCK).alias("blocked"))


#: A session's state before its first event: score, warned, times of the last SECONDS, types, institutions as bits.
EMPTY = [0, False, [], [], 0]
NONE = (1 << 63) - 1  # no event waits


def _packed(events: DataFrame, session: str, groups: int) -> DataFrame:
    """(group, session, ts, us, event): an event's microseconds, and as JSON what its points need: session, time, id, points of its type,
    institutions as bits, whether there is a request, and types."""
    name, us = F.col(session).cast("string"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 63)))
    named = [F.when(F.contains("user_query", F.lit(n)), 1 << i).otherwise(0) for i, n in enumerate(NAMES)]
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])[F.col("event_type")], F.lit(0))
    parts = [name.alias("s"), us.alias("t"), F.col("event_id").alias("i"), base.alias("p"), reduce(Column.bitwiseOR, named).alias("n"), (F.coalesce("user_query", F.lit("")) != "").alias("q"), F.array_compact("pii_types").alias("k")]
    return events.select(F.pmod(F.xxhash64(name), F.lit(groups)).alias("group"), name.alias("session"), "ts", us.alias("us"), F.to_json(F.struct(*parts)).alias("event"))


def _sorted(events: list[str]) -> list[dict]:
    """Packed events in order of time, then id, null ones first as in a batch."""
    return sorted(json.loads(f"[{','.join(events)}]"), key=lambda e: (e["t"], "i" in e, e.get("i", 0)))


def _advance(held: list, events: list[dict]) -> list:
    """A session's state after some events, sorted. Sessions are many and mostly short: microseconds an event, and no frame a session."""
    score, warned, times, types, names = held
    if score >= BLOCK:
        return held
    near, kinds = deque(times), set(types)
    for e in events:
        while near and near[0] < e["t"] - SECONDS * 1_000_000:
            near.popleft()
        score += e["p"] + (RAPID if len(near) >= REQUESTS else 0)
        near.append(e["t"])
        for k in e.get("k", ()):
            score += SAME_TYPE if k in kinds else 0
            kinds.add(k)
        names |= e["n"]
        score += INSTITUTIONS if e["q"] and names.bit_count() >= 2 else 0
        if score >= BLOCK:
            return [score, warned, [], [], 0]  # later points do not count
        warned = warned or score >= WARN
    return [score, warned, list(near), sorted(kinds), names]


def _add(held: dict[str | None, list], events: list[dict]) -> set[str | None]:
    """Brings the states of sessions up to sorted events; the sessions that these changed or began."""
    per, changed = defaultdict(list), set()
    for e in events:
        per[e.get("s")].append(e)
    for name, own in per.items():
        before = held.get(name)
        held[name] = _advance(before or EMPTY, own)
        if held[name] != before:
            changed.add(name)
    return changed


_RISK = "session string, score long, warned boolean, blocked boolean"


def _risk(held: dict[str | None, list], names) -> pd.DataFrame:
    rows = [(n, held[n][0], held[n][1], held[n][0] >= BLOCK) for n in names]
    return pd.DataFrame(rows, columns=["session", "score", "warned", "blocked"])


def _loaded(held: str) -> dict[str | None, list]:
    return dict(json.loads(held))


def _dumped(held: dict[str | None, list]) -> str:
    return json.dumps(list(held.items()), ensure_ascii=False)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Adds a trigger's events, in order, to their sessions' states."""
    held = _loaded(state.get[0]) if state.exists else {}
    events = _sorted([x for f in frames for x in f["event"]])
    _add(held, events)
    state.update((_dumped(held),))
    yield _risk(held, dict.fromkeys(e.get("s") for e in events))


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keeps sessions' events until the watermark has passed them, then adds them in order of time.

    The state's timer stands at the earliest event that waits, so a session without new events is
    settled too. While all only wait, new ones are joined to the others unread. Of a blocked session
    nothing waits any more.
    """
    stored, first, waits = state.get if state.exists else ("[]", NONE, "")
    held, now = _loaded(stored), state.getCurrentWatermarkMs()
    over = {name for name, h in held.items() if h[0] >= BLOCK}
    events = [waits] if waits else []
    for f in () if state.hasTimedOut else frames:
        f = f[~f["session"].isin(over)]
        events += f["event"].tolist()
        first = min(first, int(f["us"].min())) if len(f) else first
    changed = set()
    if first <= now * 1000:
        every = _sorted(events)
        cut = bisect_right(every, now * 1000, key=lambda e: e["t"])
        changed = _add(held, every[:cut])
        rest = [e for e in every[cut:] if held.get(e.get("s"), EMPTY)[0] < BLOCK]
        stored, events = _dumped(held), [json.dumps(e, ensure_ascii=False) for e in rest]
        first = rest[0]["t"] if rest else NONE
    state.update((stored, first, ",".join(events)))
    if events:
        state.setTimeoutTimestamp(max(first // 1000 + 1, now + 1))
    if changed:
        yield _risk(held, changed)


def session_risk_stream(events: DataFrame, session: str, delay: str | None = None, groups: int = 1 << 12) -> DataFrame:
    """(session, score, warned, blocked) over a stream: each trigger gives the sessions that it changed.

    Without ``delay`` a session's events must come in order from trigger to trigger. With it
    (``10 minutes``) they may come in any order and again: an event id counts once within the delay, and
    events wait until the watermark, the latest time seen less the delay, has passed them, so the last
    row of a session is what ``session_risk`` gives for the events in order. Those that come later
    than the delay are left out; the query's progress counts them (numRowsDroppedByWatermark). A
    session's state is its score, the times of the last SECONDS, the types and institutions seen, and
    the events that wait. Sessions share ``groups`` states by a hash, because a call costs milliseconds whatever
    it does: more of them for many millions of sessions. The number is part of a checkpoint.
    """
    if delay is None:
        return _packed(events, session, groups).groupBy("group").applyInPandasWithState(_fold, _RISK, "held string", "update", "NoTimeout")
    named = events.withColumns({"event_id": F.col("event_id").cast("long"), "ts": F.col("ts").cast("timestamp")}).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return _packed(named, session, groups).groupBy("group").applyInPandasWithState(_settle, _RISK, "held string, first long, waits string", "update", "EventTimeTimeout")


def session_windows(events: DataFrame, session: str, gap: str, delay: str | None = None) -> DataFrame:
    """(session, start, last, n_events): stretches of a session's events with ``gap`` or less between neighbours.

    The same in a batch and over a stream; there a stretch is given once the watermark (``delay``)
    has passed its end, and an event that comes later than the delay is left out.
    """
    if delay is not None:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    w = events.groupBy(F.col(session).alias("session"), F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("n_events"))
    return w.select("session", F.col("w.start").alias("start"), "last", "n_events")
