"""Tool-call linking in chat logs."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import Scratch

_BLOCK = re.compile(r"<(tool_call|tool_result)>(.*?)</\1>", re.S)
#: Levels of lists and objects that a block may nest; the library that reads and writes JSON bears some more.
MOST_NESTED = 5_000
#: References of one conversation that one task may order; those of a longer one are ordered level by level over the cluster.
MOST_EDGES = 50_000


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(number: str) -> float:
    if not math.isfinite(value := float(number)):
        raise ValueError("number out of range")
    return value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parsed(raw: str):
    """A JSON value; ValueError for what is not JSON, cannot be written as UTF-8 again, has numbers beyond double or nests too deeply."""
    try:
        value = json.loads(raw, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    work = [(value, 1)]
    while work:
        x, depth = work.pop()
        if isinstance(x, dict | list):
            if depth > MOST_NESTED:
                raise ValueError("nested too deeply")
            work += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x)]
            for k in x if isinstance(x, dict) else ():
                k.encode()
        elif isinstance(x, str):
            x.encode()  # UnicodeEncodeError, a ValueError, for half a surrogate pair
    return value


_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength."""
    kind = schema.get("type")
    if kind is not None:
        number = isinstance(value, int | float) and not isinstance(value, bool)
        ok = number and (kind == "number" or isinstance(value, int) or value.is_integer()) if kind in ("number", "integer") else isinstance(value, _TYPES.get(kind, object))
        if not ok:
            return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [x for k, v in sorted(value.items()) if k in known for x in faults(v, known[k], f"{at}.{k}")]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
    return out


def _references(value) -> set[str]:
    """Ids that arguments refer to: strings of the form ``$ref:<id>``."""
    out, work = set(), [value]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out |= {x[5:]} if x.startswith("$ref:") else set()
        elif isinstance(x, dict | list):
            work += x.values() if isinstance(x, dict) else x
    return out


BLOCKS = "conv_id long, turn long, part int, kind string, id string, name string, arguments string, valid boolean, fault string, needs array<string>"


def _parser(schemas: dict[str, dict]):
    def one(kind: str, raw: str):
        try:
            d = parsed(raw)
        except ValueError as e:
            return None, None, None, False, "not JSON" if isinstance(e, json.JSONDecodeError) else str(e)[:80] if not isinstance(e, UnicodeError) else "not Unicode", []
        if not isinstance(d, dict):
            return None, None, None, False, "not an object", []
        name = d.get("name") if isinstance(d.get("name"), str) else None
        if kind == "tool_result":
            ref = d.get("tool_call_id", d.get("id"))
            ref = ref if isinstance(ref, str) else None
            return ref, name, canonical(d.get("content")), ref is not None, None if ref is not None else "no id", []
        ref = d.get("id") if isinstance(d.get("id"), str) else None
        args = d.get("arguments", {})
        if isinstance(args, str):  # arguments as a string of JSON
            try:
                args = parsed(args)
            except ValueError:
                return ref, name, canonical(args), False, "arguments: not JSON", []
        if ref is None or name is None:
            wrong = ["no id" if ref is None else "no name"]
        else:
            wrong = ["unknown tool"] if schemas and name not in schemas else faults(args, schemas.get(name, {}))
        return ref, name, canonical(args), not wrong, "; ".join(wrong) or None, sorted(_references(args))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, turn, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "text")), strict=True):
                for part, m in enumerate(_BLOCK.finditer(text)):
                    ref, name, args, valid, fault, needs = one(m[1], m[2])
                    out.append({"conv_id": conv, "turn": turn, "part": part, "kind": m[1], "id": ref, "name": name, "arguments": args, "valid": valid, "fault": fault, "needs": needs})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("valid", pa.bool_()), ("fault", pa.string()), ("needs", pa.list_(pa.string()))]))

    return run


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = []
        for r in b.to_pylist():
            d = {"role": r["role"], "content": _BLOCK.sub("", r["text"] or "").strip(" \t\n\r") if r["calls"] or r["results"] else r["text"] or ""}
            if r["calls"]:
                d["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]) if c["arguments"] else None, "depth": c["depth"], "status": c["status"]} for c in sorted(r["calls"], key=lambda c: (c["depth"] is None, c["depth"] or 0, c["part"]))]
            if r["results"]:
                d["tool_results"] = [{"tool_call_id": c["id"], "content": json.loads(c["arguments"]) if c["arguments"] else None, "status": c["status"]} for c in sorted(r["results"], key=lambda c: c["part"])]
            lines.append(canonical(d))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "n_calls", "n_linked", "n_faults", "depth")), pa.array(lines, pa.string())], ["conv_id", "turn", "n_calls", "n_linked", "n_faults", "depth", "message"])


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth of each call of whole conversations, sorted by conversation: calls come off as all they need has come off."""
    held: list[tuple[str, str]] = []
    last = None

    def levels(conv: int) -> pa.RecordBatch:
        needs: dict[str, set] = {}
        users: dict[str, list] = {}
        for x, y in held:
            needs.setdefault(x, set()).add(y)
            users.setdefault(y, []).append(x)
        depth = dict.fromkeys((y for y in users if y not in needs), 0)
        work = list(depth)
        for y in work:  # grows while it is read
            for x in users.get(y, ()):
                needs[x].discard(y)
                if not needs[x]:
                    depth[x] = depth[y] + 1  # the call that comes off last is among the deepest
                    work.append(x)
        names = [x for x in depth if x in needs]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), conv)), pa.array(names, pa.string()), pa.array([depth[x] for x in names], pa.int32())], ["conv_id", "id", "depth"])

    for b in batches:
        for conv, x, y in zip(*(b.column(c).to_pylist() for c in ("conv_id", "id", "need")), strict=True):
            if conv != last and held:
                yield levels(last)
                held = []
            last = conv
            held.append((x, y))
    if held:
        yield levels(last)


def _levels(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, id, depth) of every call that is on no cycle and behind none.

    Conversations of up to MOST_EDGES references are ordered in one task each, so a chain of any
    length takes one step. For longer ones a step over the cluster settles one level.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    free = calls.join(edges, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("depth"))
    long = scratch.save(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).select("conv_id"))
    short = edges.join(long, "conv_id", "left_anti").repartition(parts, "conv_id").sortWithinPartitions("conv_id")
    done = free.union(short.mapInArrow(_order, "conv_id long, id string, depth int"))
    if long.isEmpty():
        return done
    edges = scratch.save(edges.join(long, "conv_id", "left_semi"))
    own = scratch.save(free.join(long, "conv_id", "left_semi"))
    have = own.count()
    while True:
        ready = edges.join(own.select("conv_id", F.col("id").alias("need"), "depth"), ["conv_id", "need"], "left").groupBy("conv_id", "id").agg(F.max("depth").alias("d"), F.count("*").alias("n"), F.count("depth").alias("m")).where("n = m")
        following = scratch.save(own.where("depth = 0").union(ready.select("conv_id", "id", (F.col("d") + 1).alias("depth"))))
        scratch.drop(own)
        now, own = following.count(), following
        if now == have:
            return done.union(own.where("depth > 0"))
        have = now


def link(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, n_calls, n_linked, n_faults, depth, message (canonical JSON).

    Turns hold ``<tool_call>{id, name, arguments}</tool_call>`` and
    ``<tool_result>{tool_call_id, content}</tool_result>`` blocks. Calls and results of
    one conversation are hash-joined by id. Of calls with one id the first (turn, then
    place) is the call, later ones have the status `repeated`; so for results. Arguments
    are checked against ``schemas`` by tool name (an empty or missing dict checks only the form).

    depth is the topological level: 0 for a call that refers to no other
    (``"$ref:<id>"`` in its arguments), else one more than the deepest it refers to.
    Calls on a cycle, or behind one, have no depth and the status `cycle`; a reference
    to no call has the status `dangling`. A turn's depth is its deepest call's. Sorting
    calls by (depth, turn, place) gives an order in which each comes after what it
    needs; turns stay rows, so no conversation is gathered in one task.

    Statuses: linked, pending (a call without result), orphan (a result without call),
    repeated, invalid (see n_faults), dangling, cycle. Null text is an empty message;
    null ids of conversation or turn are kept and never linked; repeated turns come out
    as often as they stand, their blocks counted once. Other columns are ignored.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = rows.where(F.col("text").rlike("<tool_(call|result)>") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "text").distinct()
    blocks = scratch.save(some.mapInArrow(_parser(schemas or {}), BLOCKS).distinct())
    place = F.struct("turn", "part")
    firsts = blocks.where("id is not null").groupBy("conv_id", "kind", "id").agg(F.min(place).alias("first"))
    calls = scratch.save(firsts.where("kind = 'tool_call'").select("conv_id", "id", F.col("first").alias("call_at")))
    results = firsts.where("kind = 'tool_result'").select("conv_id", "id", F.col("first").alias("result_at"))
    linked = scratch.save(calls.join(results, ["conv_id", "id"], "full"))

    needs = blocks.where("kind = 'tool_call' and size(needs) > 0").join(calls, ["conv_id", "id"]).where(F.struct("turn", "part") == F.col("call_at")).select("conv_id", "id", F.explode("needs").alias("need"))
    needs = scratch.save(needs.distinct())
    known = needs.join(calls.select("conv_id", F.col("id").alias("need"), F.lit(True).alias("there")), ["conv_id", "need"], "left")
    dangling = known.where("there is null").select("conv_id", "id").distinct().withColumn("dangling", F.lit(True))
    edges = scratch.save(known.where("there").select("conv_id", "id", "need"))
    depth = scratch.save(_levels(calls.select("conv_id", "id"), edges, scratch))

    at = F.struct("turn", "part")
    detail = blocks.join(linked, ["conv_id", "id"], "left").join(depth, ["conv_id", "id"], "left").join(dangling, ["conv_id", "id"], "left")
    call = F.col("kind") == "tool_call"
    status = (
        F.when(F.col("id").isNull() | ~F.col("valid"), "invalid")
        .when(call & (at != F.col("call_at")) | ~call & (at != F.col("result_at")), "repeated")
        .when(call & F.col("depth").isNull(), "cycle")
        .when(call & F.col("dangling"), "dangling")
        .when(call & F.col("result_at").isNull(), "pending")
        .when(~call & F.col("call_at").isNull(), "orphan")
        .otherwise("linked")
    )
    detail = detail.withColumn("status", status).withColumn("depth", F.when(call & (at == F.col("call_at")), F.col("depth")))
    item = F.struct("part", "id", "name", "arguments", "depth", "status")
    per_turn = scratch.save(
        detail.groupBy("conv_id", "turn").agg(
            F.collect_list(F.when(call, item)).alias("calls"),
            F.collect_list(F.when(~call, item)).alias("results"),
            F.count(F.when(F.col("status") == "linked", 1)).cast("int").alias("n_linked"),
            F.count(F.when(~F.col("status").isin("linked", "pending"), 1)).cast("int").alias("n_faults"),
            F.max("depth").alias("depth"),
        )
    )
    out = rows.join(per_turn, ["conv_id", "turn"], "left").withColumns({"n_calls": F.coalesce(F.size("calls"), F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0)), "n_faults": F.coalesce("n_faults", F.lit(0))})
    out = out.withColumn("n_calls", F.greatest("n_calls", F.lit(0)))
    return out.mapInArrow(_serialise, "conv_id long, turn long, n_calls int, n_linked int, n_faults int, depth int, message string")
