"""Near-duplicate documents: a MinHash signature-coordinate inverted join, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textvec as tv
from orrery.llm.components import connected_components
from orrery.llm.scratch import Scratch, extended, small_batches

#: Signature coordinates, and the least number that a pair must share. The value of a
#: coordinate is two minima, so sets of similarity s share it with probability s * s:
#: by chance alone values seldom meet. At a similarity of 0.8 a pair shares fewer than
#: 8 of 32 with probability 1.4e-6.
COORDINATES, LEAST = 32, 8
#: Rows of a posting list that are compared at once; longer lists are dealt in blocks.
BLOCK = 1024

_rng = np.random.Generator(np.random.PCG64(99))
_A = _rng.integers(1, 1 << 64, (COORDINATES, 2), dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 64, (COORDINATES, 2), dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """32 bits for the two minima of each coordinate over each non-empty set."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        low = [np.minimum.reduceat(every * _A[c, i] + _B[c, i], starts) for i in range(2)]
        out[:, c] = tv.mix(low[0] + tv.mix(low[1])) >> np.uint64(32)
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, off = tv.buffers(batch.column("text"))
    for i, j in tv.groups(off):
        own = off[i : j + 1] - off[i]
        _, h, first = tv.words(data[off[i] : off[j]], own)
        yield i, j, [tv.shingle_set(h[first[r] : first[r + 1]], k) for r in range(j - i)]


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in _sets(b, k):
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                sums, sig = np.zeros((j - i, 2), np.int64), np.full(j - i, None, object)
                if full:
                    starts, every = np.cumsum([0, *map(len, full[:-1])]), np.concatenate(full)
                    for c, key in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        sums[n > 0, c] = np.add.reduceat(tv.mix(every ^ np.uint64(key)), starts).view(np.int64)
                    sig[n > 0] = [x.tobytes() for x in signatures(full)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(list(sig), pa.binary())], ["id", "n", "h1", "h2", "sig"])

    return run


#: Bytes of sets that leave a task at once.
OUT = 4 << 20


def _setter(k: int, names: list[str]):
    """One row, with the set of the text, for every entry of the column rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in _sets(b, k):
                lists = b.column("rows").slice(i, j - i)
                entries, count = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(j - i), count)
                at = np.cumsum([0, *(8 * len(sets[r]) for r in owner)])
                lo = 0
                while lo < len(owner):
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + OUT, "right")) - 1)
                    some = owner[lo:hi]
                    raw = [sets[r].tobytes() for r in some]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(some + i)), *(entries.field(n).slice(lo, hi - lo) for n in names), pa.array(raw, pa.binary())], ["id", *names, "shingles"])
                    lo = hi

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One token a coordinate: a hash of (coordinate, value)."""
    place = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[None]
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        token = tv.mix(sig.astype(np.uint64) | place).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(np.arange(0, token.size + 1, COORDINATES, dtype=np.int32), token.ravel())], ["id", "tokens"])


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each run of equal keys; a run may reach over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(b.num_rows - 1, bool)
        for x in at:
            changed |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(x[i] for x in at)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sized(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9


def _stars(similarity: float):
    """Each row of a posting list with the first row that is very like it: pairs, a star a cluster."""
    likely = round(COORDINATES * similarity**2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for t in _runs(batches, "token", "part"):
            ids, n = t["id"].to_numpy(), t["n"].to_numpy()
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            rest = np.argsort(ids, kind="stable")
            while len(rest) > 1:
                lead, others = rest[0], rest[1:]
                alike = ((sketch[others] == sketch[lead]).sum(1) >= likely) & _sized(n[others], n[lead], similarity)
                if alike.any():
                    out.append(np.stack([np.full(alike.sum(), ids[lead]), ids[others[alike]]], 1))
                rest = others[~alike]
            if sum(map(len, out)) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return run


def _labels(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric adjacency matrix, as its first row."""
    label, big = np.arange(len(near)), len(near)
    while True:
        low = np.minimum(label, np.where(near, label[None], big).min(1, initial=big))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _gathered(similarity: float):
    """Pairs (row, first row) of the groups of a posting list: rows of unequal component that
    collide often enough to be linked are neighbours. A dealt list compares the sides of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for t in _runs(batches, "token", "part"):
            if t.num_rows < 2:
                continue
            ids, n, comp, side = (t[c].to_numpy() for c in ("id", "n", "comp", "side"))
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            near = np.zeros((len(ids), len(ids)), bool)
            for lo in range(0, len(ids), 64):
                x = slice(lo, lo + 64)
                may = (comp[x, None] != comp) & _sized(n[x, None], n, similarity) & ((side[x, None] == 2) | (side[x, None] != side))
                i, j = np.nonzero(may)
                near[lo + i, j] = (sketch[lo + i] == sketch[j]).sum(1) >= LEAST
            held = np.flatnonzero(near.any(1))
            if len(held):
                first = _labels(near[np.ix_(held, held)])
                out.append(np.stack([ids[held], ids[held[first]]], 1))
            if sum(map(len, out)) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Frequent shingles by a matrix product, the others by pairs of their holders."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 48
    place = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 2048):
        at = often[code] & (place[code] >= lo) & (place[code] < lo + 2048)
        part = np.zeros((m, min(2048, int(often.sum()) - lo)), np.float32)
        part[row[at], place[code[at]] - lo] = 1
        out += (part @ part.T).astype(np.int32)
    order = np.argsort(code, kind="stable")
    order = order[(times[code[order]] > 1) & ~often[code[order]]]
    for f in np.unique(times[(times > 1) & ~often]):
        holders = row[order[times[code[order]] == f]].reshape(-1, f)
        for lo in range(0, len(holders), max(1, 400_000 // (f * f))):
            h = holders[lo : lo + max(1, 400_000 // (f * f))]
            out += np.bincount((h[:, :, None] * m + h[:, None, :]).ravel(), minlength=m * m).reshape(m, m).astype(np.int32)
    return out


def _linked(similarity: float):
    """Links between components within a group, or between two blocks of it, on full sets: as few as join what is linked."""
    hundredths = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for t in _runs(batches, "grp", "part"):
            comp, side = t["comp"].to_numpy(), t["side"].to_numpy()
            if len(comp) < 2 or (comp == comp[0]).all():
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t["shingles"].chunks for x in c]
            both = _common(sets)
            n = np.array([len(s) for s in sets], np.int32)
            link = (100 * both >= hundredths * (n[:, None] + n[None] - both)) & (both > 0) & (comp[:, None] != comp[None]) & ((side[:, None] == 2) | (side[:, None] != side[None]))
            i, j = np.nonzero(np.triu(link))
            if len(i):
                names, at = np.unique(comp, return_inverse=True)
                e = np.unique(np.sort(np.stack([at[i], at[j]], 1), 1), axis=0)
                joined = np.zeros((len(names), len(names)), bool)
                joined[e[:, 0], e[:, 1]] = joined[e[:, 1], e[:, 0]] = True
                first = _labels(joined)
                moved = np.flatnonzero(first != np.arange(len(names)))
                out.append(np.stack([names[first[moved]], names[moved]], 1))
        if out:
            yield _pairs(out)

    return run


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(out), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], schema=PAIR)


def _confirmer(similarity: float):
    hundredths = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_sets, key, found = [], None, []
        for b in batches:
            heads, shares, ids, lead = (b.column(c).to_pylist() for c in ("head", "share", "id", "lead"))
            sets = b.column("shingles")
            for r in range(b.num_rows):
                own = np.frombuffer(sets[r].as_buffer(), np.uint64)
                if key != (heads[r], shares[r]):
                    lead_sets, key = [], (heads[r], shares[r])
                if lead[r]:
                    lead_sets.append(own.copy())
                    continue
                for head in lead_sets:  # more than one only where an id has several texts
                    both = int((head[np.minimum(np.searchsorted(head, own), len(head) - 1)] == own).sum()) if len(head) else 0
                    if both and 100 * both >= hundredths * (len(head) + len(own) - both):
                        found.append((heads[r], ids[r]))
            if len(found) > 50_000:
                yield _pairs([np.array(found, np.int64)])
                found = []
        if found:
            yield _pairs([np.array(found, np.int64)])

    return run


def _with_sets(rows: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``rows`` with the shingle set of their id's texts. A text meets all rows of its id at once, its set is made once and goes to each."""
    names = [c for c in rows.columns if c != "id"]
    per = rows.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("rows")).hint("merge")
    own = texts.join(per.select("id").hint("merge"), "id", "left_semi").distinct().join(per, "id")
    return own.mapInArrow(_setter(k, names), extended(rows, ["id", *names], "shingles binary"))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. A document's set is made once; a lead's goes to each share of its pairs."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(64)))
    asked = scratch.save(pairs.select("a", "share").distinct().select(F.col("a").alias("head"), "share", F.col("a").alias("id"), F.lit(True).alias("lead")).union(pairs.select(F.col("a"), "share", "b", F.lit(False))))
    rows = _with_sets(asked, texts, k).repartition(parts, "head", "share").sortWithinPartitions("head", "share", F.col("lead").desc())
    return scratch.save(rows.mapInArrow(_confirmer(similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 2, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    A document's set is its distinct ``k``-word shingles, words being runs without
    ASCII white space, A-Z lower-cased; fewer words make one shingle; no word makes
    an empty set, linked with nothing. Two documents are linked if the Jaccard
    similarity of their sets is ``similarity`` or more; component_id is the
    smallest document reachable, kept whether the document is that one.

    1. Documents with equal sets become one class, the smallest id standing for it.
    2. Every class is posted under each (coordinate, value) of its signature. Values
       held once cannot collide and go. Pairs that share LEAST of the coordinates
       share one of the COORDINATES - LEAST + 1 rarest, so only these are kept: the
       common values are skipped, the hottest lists first.
    3. Lists are merged in blocks; collisions are counted on one-byte coordinates,
       which never counts too few. First each row only meets the first row of its
       list that is nearly certain to be linked; these stars are confirmed on full
       sets and joined to components. Rows of different components that still collide
       LEAST times or more are then gathered into groups, and a group's full sets
       compared with each other, in blocks: every retained pair is confirmed, but
       only links that join two components are given out, never pairs.

    A class needs LEAST shared values to have a partner at all, so most documents
    leave after step 2. Equal ids are one node, whatever the rows hold: links of
    each row's text count for it. Rows whose id is null are returned unlinked, with null
    component and kept true. Null text is empty text. Ids are whole numbers, or text that
    spells them. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = small_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    signed = scratch.save(texts.mapInArrow(_signer(k), "id long, n long, h1 long, h2 long, sig binary"))
    usable = signed.where("id is not null and n > 0")
    classes = scratch.save(usable.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.min("sig").alias("sig")))

    tokens = scratch.save(classes.select("id", "sig").mapInArrow(_tokens, "id long, tokens array<long>"))
    posted = tokens.select("id", F.explode("tokens").alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = posted.join(counts, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("p"))
    prefix = shared.where(F.size("p") >= LEAST).select("id", F.explode(F.slice("p", 1, F.size("p") - (LEAST - 1))).alias("p"))
    lists = scratch.save(prefix.select("id", "p.token", "p.c").join(classes.select("id", "n", "sig"), "id").mapInArrow(_sketches, "id long, token long, c long, n long, sketch binary"))
    scratch.drop(tokens)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("c") / BLOCK)
    within = lists.withColumn("part", F.pmod(F.xxhash64("id", "token"), blocks)).repartition(parts, "token", "part").sortWithinPartitions("token", "part")
    stars = scratch.save(within.mapInArrow(_stars(similarity), "a long, b long").distinct())
    texts = texts.where("id is not null")
    first = scratch.save(connected_components(_confirmed(stars, texts, k, similarity, scratch), scratch))

    placed = scratch.save(_mixed(lists, first))
    short = placed.where(F.col("c") <= BLOCK).withColumns({"part": F.lit(0).cast("long"), "side": F.lit(2)})
    # a dealt list: block i meets block j for i <= j; a row of block i goes to each pair with i in it
    long = placed.where(F.col("c") > BLOCK).withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("id", "token"), "nb"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    long = long.withColumn("part", 1 + F.least("own", "other") * F.col("nb") + F.greatest("own", "other")).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    rest = short.unionByName(long.drop("nb", "own", "other")).repartition(parts, "token", "part").sortWithinPartitions("token", "part")
    near = scratch.save(rest.mapInArrow(_gathered(similarity), "a long, b long").distinct())
    group = connected_components(near, scratch).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    group = scratch.save(group.join(first.withColumnRenamed("node", "id"), "id", "left").select("id", "grp", F.coalesce("component", "id").alias("comp")))
    dealt = scratch.save(_dealt(group, scratch))  # met twice below: unsaved, both plans hold all its joins
    rows = _with_sets(dealt, texts, k).repartition(parts, "grp", "part").sortWithinPartitions("grp", "part")
    second = scratch.save(rows.mapInArrow(_linked(similarity), "a long, b long").distinct())
    last = scratch.save(connected_components(second, scratch))

    rep = classes.select("n", "h1", "h2", F.col("id").alias("rep"))
    mapped = first.select(F.col("node").alias("rep"), F.col("component").alias("c1"))
    final = rep.join(mapped, "rep", "left").withColumn("c1", F.coalesce("c1", "rep")).join(last.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left").select("n", "h1", "h2", F.coalesce("c2", "c1").alias("comp"))
    rows = signed.drop("sig").join(final, ["n", "h1", "h2"], "left").withColumn("comp", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")))
    return _one_node(rows, scratch).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def _mixed(lists: DataFrame, components: DataFrame) -> DataFrame:
    """The rows, with their component, of lists that hold more than one; c becomes the rows of the list."""
    placed = lists.drop("c").join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    several = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo != hi").select("token", "c")
    return placed.join(several, "token")


def _dealt(group: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp, grp, part, side): every two rows of a group that differ in component meet in a part.

    A group is cut into blocks: a component of more than BLOCK rows has blocks of its
    own, which need not meet each other, the other rows share blocks. So next to a
    component of any size, the cost is that of the rows outside it.
    """
    sizes = group.groupBy("grp", "comp").agg(F.count("*").alias("cs"))
    owner = F.when(F.col("cs") > BLOCK, F.col("comp"))
    rows = group.join(sizes, ["grp", "comp"]).withColumn("owner", owner)
    counts = rows.groupBy("grp", "owner").agg(F.count("*").alias("c")).withColumn("nb", F.ceil(F.col("c") / BLOCK)).drop("c")
    counts = scratch.save(counts.withColumn("owner", F.coalesce("owner", F.lit(-(1 << 62)))))
    rows = rows.withColumn("owner", F.coalesce("owner", F.lit(-(1 << 62)))).join(counts, ["grp", "owner"]).withColumn("at", F.pmod(F.xxhash64("id"), "nb"))
    blocks = scratch.save(counts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("grp", "owner", "at"))
    pair = lambda o, a: F.struct(F.col(o).alias("o"), F.col(a).alias("a"))
    mine, theirs = pair("owner", "at"), pair("o2", "a2")
    meet = blocks.join(blocks.select("grp", F.col("owner").alias("o2"), F.col("at").alias("a2")), "grp")
    meet = meet.where((F.col("owner") != F.col("o2")) | (F.col("owner") == -(1 << 62)))
    meet = meet.withColumn("part", F.xxhash64(F.least(mine, theirs), F.greatest(mine, theirs))).withColumn("side", F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1))
    return rows.join(meet, ["grp", "owner", "at"]).select("id", "comp", "grp", "part", "side")


def _one_node(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows that share an id share a component: the components that such ids touch are joined once more."""
    rows = scratch.save(rows)
    twice = rows.where("id is not null").groupBy("id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    bridges = scratch.save(rows.join(twice.select("id"), "id").select("id", "comp"))
    if bridges.isEmpty():
        return rows
    merged = scratch.save(connected_components(bridges, scratch))
    return rows.join(merged.select(F.col("node").alias("comp"), F.col("component").alias("c")), "comp", "left").withColumn("comp", F.coalesce("c", "comp"))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each coordinate."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        short = np.ascontiguousarray((sig ^ (sig >> np.uint32(16)) ^ (sig >> np.uint32(8))).astype(np.uint8))
        off = np.arange(0, short.size + 1, COORDINATES, dtype=np.int32)
        sketch = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(off), pa.py_buffer(short)])
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("token"), b.column("c"), b.column("n"), sketch], ["id", "token", "c", "n", "sketch"])
