"""A table that is replaced key by key: rows in key buckets, a batch's changes as deltas, one manifest a version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.sources.files import Store

_MARK = "__mark"


class Conflict(RuntimeError):
    """Another writer came first."""


class VersionedTable:
    """Rows of any number for each key below ``path``; readers see one version, writers add the next.

    A version is a file of the folder manifests. It lists, for each bucket of keys, the parts that
    hold its rows, the oldest first. A change writes the rows of the keys it touches, with one mark for
    each such key, into the buckets of these keys, then creates the next manifest; that file appears
    whole or not at all and never replaces another, so of two writers of one version one is told and
    takes the next. A row counts if its key has no mark in a later part. A bucket of more than
    ``most_parts`` parts is written anew, without marks and what they hide; other buckets stay.
    What a crash leaves is in no manifest, and goes with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key", buckets: int = 64, most_parts: int = 8):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.store = Store(spark, self.path)
        self._new = {"buckets": buckets, "most_parts": most_parts}

    # versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self.store.list(f"{self.path}/manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The given or latest version, null before the first."""
        if version is None:
            every = self.versions()
            if not every:
                return None
            version = every[-1]
        return json.loads(self.store.read(self._name(version)))

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:012d}.json"

    def _commit(self, change, expect: int | None = None) -> dict:
        """Adds the version that ``change`` makes of the latest one, as often as others come first. ``expect``: the only version to follow."""
        while True:
            now = self.manifest()
            at = 0 if now is None else now["version"]
            if expect is not None and expect != at:
                raise Conflict(f"version {at} follows {expect} already")
            new = change(now)
            if new is None:
                return now
            new["version"] = at + 1
            if self.store.create(self._name(at + 1), json.dumps(new)):
                return new

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version; later changes do not show."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"no version of {self.path}")
        return self._rows(m, range(m["buckets"]))

    def _rows(self, m: dict, buckets) -> DataFrame:
        """The rows of some buckets. Marks are read from parts that have them, and meet the rows by key."""
        schema = T.StructType.fromJson(m["schema"])
        paths = {b: m["parts"][str(b)] for b in buckets if m["parts"].get(str(b))}
        if not paths:
            return self.spark.createDataFrame([], schema)
        order = {c: i for i, c in enumerate(m["order"])}
        stored = T.StructType([*schema, T.StructField(_MARK, T.BooleanType()), T.StructField("__part", T.StringType()), T.StructField("__bucket", T.IntegerType())])

        def load(parts) -> DataFrame:
            df = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/__part={c}/__bucket={b}" for b, c in parts])
            used = sorted({order[c] for _, c in parts})
            at = F.create_map(*[x for i in used for x in (F.lit(m["order"][i]), F.lit(i))])
            return df.withColumn("__at", at[F.col("__part")])

        rows = load([(b, c) for b, held in paths.items() for c in held]).where(~F.col(_MARK))
        later = [(b, c) for b, held in paths.items() for c in held[1:] if c not in m["whole"]]
        if later:
            marks = load(later).where(_MARK).groupBy(F.col(self.key).alias("__key")).agg(F.max("__at").alias("__last"))
            rows = rows.join(marks, rows[self.key].eqNullSafe(F.col("__key")), "left").where("__last IS NULL OR __at >= __last")
        return rows.select(*[f.name for f in schema])

    # writing

    def _write(self, df: DataFrame, buckets: int) -> tuple[str, list[int]]:
        """Writes one part, and says which buckets it has. A bucket of a hot key is split over tasks."""
        part = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")
        df.withColumn("__bucket", bucket).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/__part={part}")
        return part, [int(n.split("=")[1]) for n, _ in self.store.list(f"{self.path}/data/__part={part}") if n.startswith("__bucket=")]

    def replace(self, rows: DataFrame, touched: DataFrame | None = None, expect: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """The version in which the keys of ``rows`` and ``touched`` have the given rows and no others.

        ``expect``: the version that the rows were made from; a Conflict if another follows it already.
        Without it a change goes on top of whatever came meanwhile: of two changes of one key the later
        stays, changes of other keys both do. ``batch``: (source, number); a number that its source has
        reached is not applied again.
        """
        now = self.manifest()
        if now is not None and batch is not None and now["batches"].get(batch[0], -1) >= batch[1]:
            return now["version"]
        settings = self._new if now is None else now
        schema = rows.schema if now is None else T.StructType.fromJson(now["schema"])
        own = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        keys = own.select(self.key) if touched is None else own.select(self.key).union(touched.select(F.col(self.key).cast(schema[self.key].dataType)))
        marks = keys.distinct().select(*[(F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema], F.lit(True).alias(_MARK))
        part, buckets = self._write(own.withColumn(_MARK, F.lit(False)).union(marks), settings["buckets"])

        def change(m: dict | None) -> dict | None:
            if m is None:
                m = {**self._new, "schema": json.loads(schema.json()), "parts": {}, "order": [], "whole": [], "batches": {}}
            if batch is not None:
                if m["batches"].get(batch[0], -1) >= batch[1]:
                    return None
                m["batches"][batch[0]] = batch[1]
            m["order"].append(part)
            for b in buckets:
                m["parts"].setdefault(str(b), []).append(part)
            return m

        made = self._commit(change, expect)
        if any(len(p) > made["most_parts"] for p in made["parts"].values()):
            self.compact()
        return made["version"]

    def delete(self, keys: DataFrame, **how) -> int:
        """The version without the keys' rows."""
        schema = T.StructType.fromJson(self.manifest()["schema"])
        return self.replace(self.spark.createDataFrame([], schema), keys, **how)

    def compact(self, least: int | None = None) -> dict:
        """Writes buckets of more than ``least`` parts anew; ``most_parts`` by default. Parts that come meanwhile stay on top."""
        m = self.manifest()
        least = m["most_parts"] if least is None else least
        long = {b: held for b, held in m["parts"].items() if len(held) > least}
        if not long:
            return m
        part, _ = self._write(self._rows(m, map(int, long)).withColumn(_MARK, F.lit(False)), m["buckets"])

        def change(now: dict) -> dict | None:
            if any(now["parts"].get(b, [])[: len(held)] != held for b, held in long.items()):
                return None  # another writer did it
            for b, held in long.items():
                now["parts"][b] = [part, *now["parts"][b][len(held) :]] if self.store.exists(f"{self.path}/data/__part={part}/__bucket={b}") else now["parts"][b][len(held) :]
            # older than all that came after what it holds
            now["order"].insert(min(now["order"].index(c) for held in long.values() for c in held), part)
            now["whole"].append(part)
            used = {c for held in now["parts"].values() for c in held}
            now["order"], now["whole"] = [c for c in now["order"] if c in used], [c for c in now["whole"] if c in used]
            return now

        return self._commit(change)

    def vacuum(self, keep: int = 2, older: float = 86_400.0, now: float | None = None) -> list[str]:
        """Takes away versions before the last ``keep``, and parts that none of these lists and that are older than ``older`` seconds, so no part of a change under way."""
        import time

        every, now = self.versions(), time.time() if now is None else now
        used = {c for v in every[-keep:] for held in self.manifest(v)["parts"].values() for c in held}
        for v in every[:-keep]:
            self.store.delete(self._name(v))
        gone = [n for n, t in self.store.list(f"{self.path}/data") if n.startswith("__part=") and n[7:] not in used and now - t > older]
        for n in gone:
            self.store.delete(f"{self.path}/data/{n}")
        return gone
