"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textvec as tv
from orrery.llm.scratch import Scratch, aside, extended, others, small_batches

#: Bits of a fingerprint, in 64-bit words. Sets of weighted similarity 0.8 have a cosine of 8 / 9, so
#: each bit differs with a chance of 0.151: 19.3 of 128 bits, with a deviation of 4.1.
LANES = 2
#: Hamming radius that the blocks guarantee: 2.9 deviations above the mean at a similarity of 0.8 exactly.
RADIUS = 31
#: Blocks of 16 bits: of two prints within the radius one block differs in RADIUS // BLOCKS = 3 bits at
#: most. Stored values are turned in up to one bit, asked ones in up to two.
BLOCKS, STORED_FLIPS = 8, 1
#: Benchmark text whose index goes to every task; a larger benchmark takes more passes over the documents.
MOST_BYTES = 16 << 20
#: Words whose running bit sums are held at once.
SPAN = 1 << 15


def _bits(sh: np.ndarray) -> np.ndarray:
    """+1 and -1 for each fingerprint bit of each shingle."""
    lanes = np.stack([tv.mix(sh ^ np.uint64(0xD1B54A32D192ED03 * (i + 1) & (1 << 64) - 1)) for i in range(LANES)], 1)
    return np.unpackbits(lanes.view(np.uint8).reshape(len(sh), -1), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def whole_weights(w: np.ndarray) -> np.ndarray:
    """Weights as integers, so that sums do not depend on their order."""
    return np.maximum(1, np.rint(w * 16)).astype(np.int64)


def simhash(sh: np.ndarray, weight: np.ndarray, at: np.ndarray, per: int) -> np.ndarray:
    """Fingerprints (LANES columns) of the runs of ``per`` shingles from each place: the signs of the weighted bit sums."""
    out = np.empty((len(at), LANES), np.uint64)
    lo = 0
    while lo < len(at):  # places are in order; running sums over a bounded span at a time
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max(1, SPAN - per), "left")))
        a, b = int(at[lo]), int(at[hi - 1]) + per
        total = np.zeros((b - a + 1, 64 * LANES), np.int64)
        np.cumsum(_bits(sh[a:b]) * weight[a:b, None], axis=0, out=total[1:])
        here = at[lo:hi] - a
        out[lo:hi] = np.packbits(total[here + per] > total[here], axis=1).view(np.uint64)
        lo = hi
    return out


def _turns(most: int) -> np.ndarray:
    """All 16-bit masks of up to ``most`` bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


class Blocks:
    """Fingerprints by the values of their 16-bit blocks and what one turned bit makes of them."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.asked = _turns(RADIUS // BLOCKS - STORED_FLIPS)
        turned = _turns(STORED_FLIPS)
        self.index = []
        for part in prints.view(np.uint16).reshape(len(prints), BLOCKS).T:
            value = (part[:, None] ^ turned).ravel()
            order = np.argsort(value, kind="stable")
            self.index.append((value[order], (order // len(turned)).astype(np.int32)))

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row of ``asked``, row of the indexed) that share a block but for its allowed bits."""
        found = []
        for b, (value, item) in enumerate(self.index):
            v = (asked.view(np.uint16).reshape(len(asked), BLOCKS)[:, b, None] ^ self.asked).ravel()
            lo, hi = np.searchsorted(value, v, "left"), np.searchsorted(value, v, "right")
            n = hi - lo
            row = np.repeat(np.repeat(np.arange(len(asked)), len(self.asked)), n)
            j = item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            found.append(np.unique(row * len(self.prints) + j))
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row of ``asked``, row of the indexed) within RADIUS."""
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(asked), 256):
            i, j = self.candidates(asked[at : at + 256])
            near = np.bitwise_count(asked[at + i] ^ self.prints[j]).sum(1) <= RADIUS
            rows.append(i[near] + at)
            items.append(j[near])
        return np.concatenate(rows), np.concatenate(items)


class Benchmark:
    """Items of one pass with their shingles' weights, and fingerprints in blocks by item length.

    A shingle weighs log(1 + items / items that hold it), one that no item holds
    log(1 + items): what many items share says little. The counts are those of the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, int, bytes, bytes]], count: int, k: int = 5, similarity: float = 0.8):
        """items: (id, words, shingles in order, the weight of each)."""
        self.k, self.similarity, self.count = k, similarity, count
        self.ids = [i[0] for i in items]
        sizes = np.array([i[1] for i in items], int)
        runs = [np.frombuffer(i[2], np.uint64) for i in items]
        self.known, first = np.unique(np.concatenate([*runs, np.zeros(0, np.uint64)]), return_index=True)
        self.weight = np.concatenate([*(np.frombuffer(i[3]) for i in items), np.zeros(0)])[first]
        self.other = float(np.log1p(count))
        self.sets = [np.unique(r) for r in runs]
        self.totals = np.array([self.weigh(s) for s in self.sets])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True
        self.by_size: dict[int, tuple[np.ndarray, Blocks, float]] = {}
        short = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size < k:
                short += own.tolist()
                continue
            per = size - k + 1
            prints = np.concatenate([simhash(runs[r], whole_weights(self._all_weights(runs[r])), np.array([0]), per) for r in own])
            self.by_size[size] = (own, Blocks(prints))
        # for every known shingle the lengths, as places in the list of lengths, of the items that hold it
        self.sizes = sorted(self.by_size)
        self.least = np.array([self.totals[self.by_size[s][0]].min() * similarity - 1e-9 for s in self.sizes])
        pairs = [(np.searchsorted(self.known, self.sets[r]), np.full(len(self.sets[r]), n)) for n, s in enumerate(self.sizes) for r in self.by_size[s][0]]
        at, size = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        at, self.held_by = np.divmod(np.unique(at * max(1, len(self.sizes)) + size), max(1, len(self.sizes)))
        self.held_from = np.searchsorted(at, np.arange(len(self.known) + 1))
        # items of fewer words than a shingle: their one hash, by length
        self.short = {s: (values[o := np.argsort(values)], np.array(rows)[o]) for s in sorted({int(sizes[r]) for r in short}) if len(rows := [r for r in short if sizes[r] == s]) and len(values := np.array([runs[r][0] for r in rows]))}

    def _all_weights(self, sh: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(sh), self.other)
        at = np.minimum(np.searchsorted(self.known, sh), len(self.known) - 1)
        return np.where(self.known[at] == sh, self.weight[at], self.other)

    def weigh(self, s: np.ndarray) -> float:
        return float(self._all_weights(s).sum())

    def places(self, sh: np.ndarray) -> np.ndarray:
        """Each shingle's place among the known ones, -1 for one that no item holds."""
        out = np.full(len(sh), -1)
        maybe = np.flatnonzero(self.filter[sh >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, sh[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == sh[maybe], at, -1)
        return out

    def hits(self, sh: np.ndarray, place: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of each item's best window in a text of k words or more.

        sh: the text's shingles; place: those of the known ones. Windows are as long as the item, or
        the whole text if that is shorter, one from each word. What a window has in common with an
        item is at most what its shingles weigh that items of that length hold, so a window in which
        they weigh less than ``similarity`` of the lightest such item cannot pass and gets no fingerprint.
        """
        best: dict[int, tuple[float, int, int]] = {}
        known = np.flatnonzero(place >= 0)
        n = self.held_from[place[known] + 1] - self.held_from[place[known]]
        at_known = np.repeat(known, n)
        size_of = self.held_by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.held_from[place[known]], n)]
        total = np.bincount(size_of, self.weight[place[at_known]], len(self.sizes))
        weight = None
        for g in np.flatnonzero(total >= self.least).tolist():
            size = self.sizes[g]
            items, blocks = self.by_size[size]
            per = min(size - self.k + 1, len(sh))
            own = np.zeros(len(sh) + 1)
            mine = at_known[size_of == g]
            own[mine + 1] = self.weight[place[mine]]
            held = np.cumsum(own)
            at = np.flatnonzero(held[per:] - held[:-per] >= self.least[g])
            if not len(at):
                continue
            weight = whole_weights(np.where(place >= 0, self.weight[place], self.other)) if weight is None else weight
            w, found = blocks.within(simhash(sh, weight, at, per))
            for i, j in zip(at[w].tolist(), items[found].tolist(), strict=True):
                window = np.unique(sh[i : i + per])
                common = self.weigh(np.intersect1d(window, self.sets[j], assume_unique=True))
                s = common / (self.totals[j] + self.weigh(window) - common)
                if s >= self.similarity - 1e-12 and (j not in best or (s, -i) > (best[j][0], -best[j][1])):
                    best[j] = (float(s), i, per + self.k - 1)
        return [(self.ids[j], *b) for j, b in sorted(best.items())]

    def short_hits(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Items of fewer than k words: their single shingle is the whole window."""
        found = []
        for size, (values, rows) in self.short.items():
            if size > len(h):
                continue
            runs = np.zeros(len(h) - size + 1, np.uint64)
            for p in range(size):
                runs += h[p : p + len(runs)] * tv.PLACE[p]
            runs = tv.mix(runs + np.uint64(size))
            lo = np.searchsorted(values, runs, "left")
            at = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == runs)
            first: dict[int, int] = {}
            for i in at.tolist():
                for n in range(int(lo[i]), int(np.searchsorted(values, runs[i], "right"))):
                    first.setdefault(int(rows[n]), i)
            found += [(self.ids[j], 1.0, i, size) for j, i in sorted(first.items())]
        return found

    def scan(self, column: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        """The hits of each text of an Arrow column."""
        data, off = tv.buffers(column)
        out: list[list] = [[] for _ in range(len(off) - 1)]
        if not self.ids:
            return out
        lightest = self.least.min(initial=np.inf)
        for i, j in tv.groups(off):
            _, h, first = tv.words(data[off[i] : off[j]], off[i : j + 1] - off[i], tv.NON_WORD)
            sh = tv.shingles(h, self.k)
            place = self.places(sh)
            known = np.flatnonzero(place >= 0)
            row = np.searchsorted(first, known, "right") - 1
            over = known + self.k > first[row + 1]  # over a text's end
            place[known[over]] = -1
            known, row = known[~over], row[~over]
            held = np.bincount(row, self.weight[place[known]], j - i)
            for r in np.flatnonzero(held >= lightest).tolist():
                a, b = int(first[r]), int(first[r + 1]) - self.k + 1
                if b > a:
                    out[i + r] = self.hits(sh[a:b], place[a:b])
            if self.short:
                for r in range(j - i):
                    out[i + r] += self.short_hits(h[first[r] : first[r + 1]])
        return out


HITS = "array<struct<item_id:long,similarity:double,start:int,n_words:int>>"
_NAMES = ("item_id", "similarity", "start", "n_words")
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("n_words", pa.int32())]))
#: The index that this process made last, by the pass's name.
_built: dict[str, Benchmark] = {}


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tv.buffers(b.column("text"))
            for i, j in tv.groups(off):
                _, h, first = tv.words(data[off[i] : off[j]], off[i : j + 1] - off[i], tv.NON_WORD)
                words = [h[first[r] : first[r + 1]] for r in range(j - i)]
                runs = [tv.shingles(w, k) if len(w) >= k else tv.shingle_set(w, k) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("key").slice(i, j - i), pa.array([len(w) for w in words], pa.int32()), pa.array([r.view(np.int64) for r in runs], pa.list_(pa.int64()))],
                    ["id", "key", "words", "run"],
                )

    return run


def _weighted(items: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, key, words, run, weight) of every item with words, its shingles in order with their weights, and the number of such items."""
    items = scratch.save(items.mapInArrow(_shingled(k), "id long, key long, words int, run array<long>").where("words > 0"))
    count = items.count()
    each = items.select("id", "key", F.posexplode("run").alias("at", "shingle"))
    held = each.select("id", "key", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("n"))
    weighed = each.join(held, "shingle").withColumn("w", F.log1p(F.lit(count) / F.col("n")))
    rows = weighed.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "shingle", "w"))).alias("s"))
    return scratch.save(rows.join(items.select("id", "key", "words"), ["id", "key"]).select("id", "key", "words", "s.shingle", "s.w")), count


def scan(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8, keep: list[str] | None = None, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` (its ``keep`` columns) with hits: the benchmark items that each whole text contains.

    Words are runs of letters and digits (every non-ASCII byte counts as a letter),
    A-Z lower-cased. A hit is a window of the item's length whose ``k``-word shingles
    have a weighted Jaccard similarity of ``similarity`` or more with the item's; the
    best window of an item is given, the earliest of equal ones. Items of fewer than k words
    must occur word by word.

    1. Shingles of all items are counted and weighed over the cluster.
    2. Windows that hold enough known shingles get a fingerprint, which is looked up in the
       blocks of the items of that length: all within RADIUS are found.
    3. These are confirmed on the full weighted sets.

    Null and empty texts have no hits; null, empty or unidentified items are left out;
    an item id given twice counts for each of its texts. Rows are taken one by one. The
    index of at most MOST_BYTES of benchmark text is broadcast; a larger benchmark goes
    in several passes over the documents, one after the other, whose hits are joined, so the
    driver holds one part at a time. A column named hits, in any case, is replaced.
    """
    spark = docs.sparkSession
    keep, text, row = others(docs.columns if keep is None else keep, ("hits",)), aside(docs, "text"), aside(docs, "row")
    scratch = Scratch(spark, "decontam")
    items = items.where(F.col(id_col).isNotNull() & (F.length(item_text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).distinct().withColumn("key", F.xxhash64("text"))
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = -(-held // MOST_BYTES) or 1
    weighed, count = _weighted(items, k, scratch)
    texts = small_batches(docs.select(*keep, F.col(text_col).cast("string").alias(text)))
    if passes == 1:
        return _passed(texts, keep, text, weighed, count, k, similarity)[0]
    numbered = scratch.save(texts.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for p in range(passes):
        hits, sent = _passed(numbered.select(row, text), [row], text, weighed.where(F.pmod(F.xxhash64("id", "key"), F.lit(passes)) == p), count, k, similarity)
        hits = scratch.save(hits.where("size(hits) > 0"))
        sent.unpersist()
        found = hits if found is None else found.union(hits)
    found = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return numbered.drop(text).join(found, row, "left").select(*keep, F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def _passed(texts: DataFrame, keep: list[str], text: str, weighed: DataFrame, count: int, k: int, similarity: float):
    """``texts`` with hits of the given items, of bounded size, and the broadcast that the result reads."""
    rows = [(r[0], r[1], np.array(r[2], np.int64).tobytes(), np.array(r[3]).tobytes()) for r in weighed.orderBy("id", "key").select("id", "words", "shingle", "w").toLocalIterator()]
    sent, name = texts.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Benchmark(sent.value, count, k, similarity)
        bench = _built[name]
        for b in batches:
            found = bench.scan(b.column(text))
            hits = pa.array([[dict(zip(_NAMES, x, strict=True)) for x in h] for h in found], _HITS)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), hits], [*keep, "hits"])

    return texts.mapInArrow(run, extended(texts, keep, f"hits {HITS}")), sent
