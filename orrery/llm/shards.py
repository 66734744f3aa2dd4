"""Sharding over fixed virtual slots."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.scratch import Scratch

#: Virtual slots of a table; fixed for its life.
SLOTS = 4096
_KEY = ["__id", "text_crc32", "size"]


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) with virtual_slot, size (UTF-8 bytes of the text plus 8; null has none) and text_crc32.

    The slot hashes the id with the text's checksum, so rows of one id, or without one, are dealt
    out by their texts. Rows equal in id, checksum and size that together outweigh half a mean slot,
    at most two such groups a slot, are dealt over all slots by their place in the table; then the
    rows are written out, so that later steps see the same slots. Null text has the checksum of no
    bytes. Columns of the three names are replaced.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    new = {"size": F.length(raw).cast("long") + 8, "text_crc32": F.crc32(raw).cast("long"), "__id": F.col(id_col)}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("virtual_slot", "size", "text_crc32")]
    rows = docs.withColumns(new).select(*keep, *new)
    plain = F.pmod(F.xxhash64("__id", "text_crc32"), F.lit(slots)).cast("int")
    total = docs.select(F.sum(new["size"])).first()[0] or 0
    heavy = rows.groupBy(*_KEY).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) & (F.col("__n") * F.col("size") > F.lit(total / slots / 2))).drop("__n")
    scratch = Scratch(docs.sparkSession, "shards")
    heavy = scratch.save(heavy)
    if heavy.isEmpty():
        return rows.withColumn("virtual_slot", plain).drop("__id")
    same = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in _KEY]
    heavy = heavy.select(*[F.col(c).alias(f"__{c}") for c in _KEY], F.lit(True).alias("__heavy"))
    rows = rows.withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(heavy), same[0] & same[1] & same[2], "left")
    dealt = F.pmod(F.xxhash64("__id", "text_crc32", "__place"), F.lit(slots)).cast("int")
    return scratch.save(rows.select(*keep, "size", "text_crc32", F.when(F.col("__heavy"), dealt).otherwise(plain).alias("virtual_slot")))


def weights(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each filled slot: as many rows as there are slots at most."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def plan(bytes_of: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: the heaviest slot first, each to the shard with the fewest bytes."""
    out, heap = [0] * slots, [(0, 0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda s: (-bytes_of.get(s, (0, 0))[0], s)):
        load, held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + bytes_of.get(slot, (0, 0))[0], held + 1, shard))
    return out


def rebalance(shard_of: list[int], bytes_of: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map for ``shards`` shards: slots leave shards that are gone, and shards above the mean
    by more than ``tolerance`` (never below it by more), for the lightest shard. The others stay."""
    load, held = [0] * shards, [[] for _ in range(shards)]
    size = lambda s: bytes_of.get(s, (0, 0))[0]
    out, loose = list(shard_of), []
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            load[shard] += size(slot)
            held[shard].append(slot)
        else:
            loose.append(slot)
    mean = sum(map(size, range(len(shard_of)))) / shards
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-size(s), s)):
            if load[shard] > mean * (1 + tolerance) and load[shard] - size(slot) >= mean * (1 - tolerance):
                load[shard] -= size(slot)
                loose.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-size(s), s)):
        have, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (have + size(slot), shard))
    return out


def save_map(spark: SparkSession, shard_of: list[int], version: int, path: str) -> None:
    """Adds a version to the stored map: one row a slot, partitioned by version; older versions stay."""
    spark.createDataFrame([(s, h) for s, h in enumerate(shard_of)], "slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={int(version)}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """The given version of a stored map, else its latest."""
    rows = spark.read.option("basePath", path).parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    return version, [r[0] for r in rows.where(F.col("version") == version).orderBy("slot").select("shard").collect()]


def current_map(spark: SparkSession, bytes_of: dict[int, tuple[int, int]], shards: int, slots: int, path: str) -> list[int]:
    """The stored map at ``path``, read back: planned and stored as version 1 where there is none, else its
    latest version, edited and stored as the next one if the slots' bytes or the shards no longer fit it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        save_map(spark, plan(bytes_of, shards, slots), 1, path)
    version, shard_of = load_map(spark, path)
    if len(shard_of) != slots:
        raise ValueError(f"the stored map has {len(shard_of)} slots, not {slots}: a table's slots are fixed")
    edited = rebalance(shard_of, bytes_of, shards)
    if edited != shard_of:
        save_map(spark, edited, version + 1, path)
        version, shard_of = load_map(spark, path)
    return shard_of


def assign(rows: DataFrame, shard_of: list[int], counts: dict[int, tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """``slotted`` rows with shard int and slot long, the row's place in its shard, gapless from 0.

    A place is the rows of the shard's earlier virtual slots plus the rank within the
    own one, so ranks are taken in thousands of groups, never over a whole shard. The
    map is a broadcast table of one entry a virtual slot. Ties in id are ordered by checksum
    and size; rows equal in all three are alike.
    """
    base, filled = [0] * len(shard_of), {}
    for slot, shard in enumerate(shard_of):
        base[slot] = filled.get(shard, 0)
        filled[shard] = base[slot] + counts.get(slot, (0, 0))[1]
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(v, s, b) for v, (s, b) in enumerate(zip(shard_of, base, strict=True))], "virtual_slot int, shard int, __base long"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size"))
    return rows.drop("shard", "slot", "__base").withColumn("__rank", rank - 1).join(table, "virtual_slot").withColumn("slot", F.col("__base") + F.col("__rank")).drop("__base", "__rank")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (its ``keep`` columns, the id among them) with size, text_crc32, virtual_slot, shard, slot.

    Every row, also one with null id or text, gets exactly one place. Shards are near equal in
    bytes (law `bytes`), down to the largest single text. The slot-to-shard map is stored in
    versions at ``map_path`` (below spark.checkpoint.dir by default, for this run alone): a later
    call with more rows or another count of shards edits it and moves only the slots it must. An
    empty table gives no rows. Columns of the five names are replaced.
    """
    rows = slotted(docs, slots, id_col, text_col, keep)
    counts = weights(rows)
    path = map_path or f"{Scratch(docs.sparkSession, 'shard-map').root}/map"
    return assign(rows, current_map(docs.sparkSession, counts, shards, slots, path), counts, id_col)
