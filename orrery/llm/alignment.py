"""Alignment of two tokenizers by byte-owner arrays, and how often their tokens meet over a corpus."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import Scratch, aside, extended, others, small_batches
from orrery.llm.textvec import buffers, groups

#: How a byte-level model cuts a text before it merges (fixed value of the format).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank between two other characters: no token of either tokenizer spans it but at its front.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
#: Link counts that may go to every task; 500,000 of them take some 50 MB.
MOST_PAIRS = 500_000


class ByteLevel:
    """A byte-level BPE model of a tokenizer's JSON file; special tokens are plain text."""

    def __init__(self, file: bytes):
        self.file, made = file, json.loads(file)
        model, cut = made["model"], made["pre_tokenizer"]
        if model["type"] != "BPE" or made["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("a byte-level BPE model without a normaliser is needed")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, the others follow from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.spelt = {i: bytes(map(byte.__getitem__, t)) for t, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if [model["vocab"][x + y] for x, y in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("tokens must be numbered in the order of their merges")
        self.size = max(self.spelt) + 1

    @cached_property
    def _library(self):
        import tiktoken

        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={b: i for i, b in self.spelt.items()}, special_tokens={})

    @cached_property
    def _slower(self):
        import tokenizers

        slow = tokenizers.Tokenizer.from_str(self.file.decode())
        slow.encode_special_tokens = True
        return slow

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self._library.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # its pattern gives up on some 100,000 blanks in a row
            return np.array(self._slower.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentencepiece model."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self._library = SentencePieceProcessor(model_proto=model)
        self.spelt = {i: bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces)}
        self.size = len(proto.pieces)
        rules = proto.normalizer_spec
        #: whether a text's parts between single blanks may be encoded apart
        self.parts = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text), np.int64)


def owners(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, of each B token, overlaps) of two ways to cut the same bytes into tokens of these lengths.

    Each byte has an owner in A and one in B. Where the pair of owners changes, another overlap
    begins; where both change at once, a cut lies. overlaps: (A token, B token) in order.
    """
    a, b = np.repeat(np.arange(len(a_len)), a_len), np.repeat(np.arange(len(b_len)), b_len)
    a_new, b_new = a[1:] != a[:-1], b[1:] != b[:-1]
    group = np.zeros(len(a), np.int64)
    np.cumsum(a_new & b_new, out=group[1:])
    at = np.flatnonzero(np.r_[len(a) > 0, a_new | b_new][: len(a)])
    first = lambda n: group[np.cumsum(n) - n]
    return first(a_len), first(b_len), np.stack([a[at], b[at]], 1)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, then those of the next."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


_DIGITS = 10


def _listed(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all groups, a ``;`` behind each, and where each group starts in it."""
    ids = np.r_[a, b]
    order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
    ids, part = ids[order], np.r_[2 * a_group, 2 * b_group + 1][order]
    width = np.ones(len(ids), np.int64)
    for k in range(1, _DIGITS):
        width += ids >= 10**k
    most = int(width.max(initial=1))
    cells = np.zeros((len(ids), most + 1), np.uint8)
    for k in range(most):  # digits from the right
        at = width - 1 - k
        has = at >= 0
        cells[has, at[has]] = 48 + ids[has] // 10**k % 10
    last = np.r_[part[1:] != part[:-1], [True]][: len(ids)]
    cells[np.arange(len(ids)), width] = np.where(last, np.where(part % 2, 59, 124), 44)
    end = np.cumsum(width + 1)
    return cells[np.arange(most + 1) <= width[:, None]].tobytes(), np.r_[0, end[last & (part % 2 == 1)]]


class Aligner:
    """Two tokenizers over texts, part by part between single blanks; what each part gives is kept for the next time.

    Up to twice MOST parts of up to 64 characters are kept, in some 60 MB.
    """

    MOST = 100_000
    HEAD = 5  # n_a, n_b, n_groups, n_links, distinct links

    def __init__(self, a_file: bytes, b_model: bytes):
        self.a, self.b = ByteLevel(a_file), Pieces(b_model)
        self.a_len, self.b_len = (np.array([len(t.spelt.get(i, b"")) for i in range(t.size)]) for t in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        #: by part: the text of its groups, and its figures and links; None for a part without tokens
        self.listed: dict[str, bytes | None] = {}
        self.figures: dict[str, bytes] = {}
        self._old: tuple[dict[str, bytes | None], dict[str, bytes]] = {}, {}

    def parts(self, text: str) -> list[str]:
        return BETWEEN.split(text) if self.b.parts else [text]

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids in A and B, or nothing if their bytes are not the text's."""
        a, b, raw = self.a(" " + text), self.b(text), (" " + text).encode()
        spelt = lambda t, ids: b"".join(map(t.spelt.__getitem__, ids.tolist()))
        return (a, b) if spelt(self.a, a) == raw == spelt(self.b, b) and self.a_len[a].all() and self.b_len[b].all() else None

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids, B's ids, their groups, and overlaps as places in both; all empty if the text has no tokens."""
        none = np.zeros(0, np.int64)
        got = self._encoded(text) if text else None
        if got is None:
            return none, none, none, none, none.reshape(0, 2)
        return *got, *owners(self.a_len[got[0]], self.b_len[got[1]])

    def _measure(self, parts: list[str]) -> Iterator[tuple[bytes | None, bytes]]:
        """What each part gives: the text of its groups, and its figures with its distinct links and how often each occurs."""
        got = self._encoded(" ".join(parts))
        if got is None:
            if len(parts) == 1:
                yield None, b""
            else:
                half = len(parts) // 2
                yield from self._measure(parts[:half])
                yield from self._measure(parts[half:])
            return
        a, b = got
        a_len, b_len = self.a_len[a], self.b_len[b]
        a_group, b_group, _ = owners(a_len, b_len)
        n_groups = int(a_group[-1]) + 1
        text, at = _listed(a, b, a_group, b_group)
        # a part starts where its bytes do; both tokenizers have a token there
        start = np.cumsum([0, *(1 + len(p.encode()) for p in parts)])
        a_from = np.searchsorted(np.r_[0, np.cumsum(a_len)], start)
        b_from = np.searchsorted(np.r_[0, np.cumsum(b_len)], start)
        g_from = np.r_[a_group, n_groups][a_from]
        part = np.repeat(np.arange(len(parts)), np.diff(g_from))
        n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        key, times = self._links(a, b, a_group, b_group, n_a, n_b, part)
        n_links = np.bincount(part, n_a * n_b, len(parts)).astype(np.int64)
        pair_from = np.searchsorted(key[:, 0], np.arange(len(parts) + 1))
        head = np.stack([np.diff(a_from), np.diff(b_from), np.diff(g_from), n_links, np.diff(pair_from)], 1)
        # a part's figures, then its links
        flat = np.zeros(head.size + 2 * len(times), np.int64)
        start = 2 * pair_from + self.HEAD * np.arange(len(parts) + 1)
        flat[(start[:-1, None] + np.arange(self.HEAD)).ravel()] = head.ravel()
        at_pair = 2 * np.arange(len(times)) + self.HEAD * (key[:, 0] + 1)
        flat[at_pair], flat[at_pair + 1] = key[:, 1], times
        raw, bounds, cuts = flat.tobytes(), (8 * start).tolist(), at[g_from].tolist()
        for i in range(len(parts)):
            yield text[cuts[i] : cuts[i + 1]], raw[bounds[i] : bounds[i + 1]]

    def _links(self, a, b, a_group, b_group, n_a, n_b, part) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (part, link) in order, a link being A id * size of B + B id, and how often each occurs.

        A token of A is repeated for the distinct ids of B in its group, some at a time.
        """
        size = self.b.size
        key, times = np.unique(b_group * size + b, return_counts=True)
        first = np.searchsorted(key, np.arange(len(n_b) + 1) * size)
        count = np.diff(first)
        own, own_times = np.unique(a_group * self.a.size + a, return_counts=True)
        own_group, own = own // self.a.size, own % self.a.size
        out = []
        ends = np.cumsum(count[own_group])
        step = np.searchsorted(ends, np.arange(0, int(ends[-1]) + 1, 1 << 22), "left") if len(ends) else []
        for i, j in zip(step, [*step[1:], len(own)], strict=True):
            reps = count[own_group[i:j]]
            other = _ranges(first[own_group[i:j]], reps)
            link = np.repeat(own[i:j], reps) * size + key[other] % size
            out.append(_summed(np.repeat(part[own_group[i:j]], reps), link, np.repeat(own_times[i:j], reps) * times[other]))
        keys, sums = np.concatenate([k for k, _ in out]), np.concatenate([s for _, s in out])
        return (keys, sums) if len(out) == 1 else _summed(keys[:, 0], keys[:, 1], sums)

    def learn(self, parts: set[str]) -> set[str]:
        """Makes ``listed`` and ``figures`` hold all the parts, and returns those without tokens."""
        if len(self.listed) > self.MOST:
            self._old, self.listed, self.figures = (self.listed, self.figures), {}, {}
        new = parts - self.listed.keys()
        for p in new & self._old[0].keys():
            self.listed[p], self.figures[p] = self._old[0][p], self._old[1][p]
        new -= self._old[0].keys()
        # parts with white space or the blank's mark at an end do not stand beside others
        plain = [p for p in new if p and SPACE not in p and not p[0].isspace() and not p[-1].isspace()]
        for some in ([plain] if plain else []) + [[p] for p in new.difference(plain)]:
            for p, (self.listed[p], self.figures[p]) in zip(some, self._measure(some), strict=True):
                pass
        return {p for p in new if self.listed[p] is None} | {p for p in parts - new if self.listed[p] is None}

    def drop_long(self, parts: set[str]) -> None:
        """Long parts are not kept."""
        for p in parts:
            if len(p) > 64:
                self.listed.pop(p, None)
                self.figures.pop(p, None)


def _summed(part: np.ndarray, link: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (part, link) in order, and the sums of ``times``."""
    key = part << 40 | link if int(link.max(initial=0)) < 1 << 40 and int(part.max(initial=0)) < 1 << 22 else None
    order = np.lexsort((link, part)) if key is None else np.argsort(key, kind="stable")
    part, link, times = part[order], link[order], times[order]
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (link[1:] != link[:-1])][: len(part)])
    return np.stack([part[new], link[new]], 1), np.add.reduceat(times, new) if len(new) else times


_made: dict[bytes, Aligner] = {}


def aligner(a_file: bytes, b_model: bytes) -> Aligner:
    """Compiled once a process."""
    key = hashlib.sha256(a_file + b_model).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Aligner(a_file, b_model)
    return _made[key]


def align(docs: DataFrame, a_file: bytes, b_model: bytes, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (its ``keep`` columns) with a_ids, b_ids, a_groups, b_groups array<int> and overlaps array<struct<a, b>>.

    A encodes a blank and the text, B the text. Byte offsets where tokens of both end cut them into
    groups, numbered from 0; overlaps are the places of tokens that share bytes, in order. A text that
    is null, empty, or not spelt by both has empty arrays. Rows are taken one by one and whole; columns
    of the new names, in any case, are replaced. No shuffle.
    """
    new = ("a_ids", "b_ids", "a_groups", "b_groups", "overlaps")
    keep, text = others(docs.columns if keep is None else keep, new), aside(docs, "text")
    schema = extended(docs, keep, "a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, overlaps array<struct<a: int, b: int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_file, b_model)
        for b in batches:
            _, at = buffers(b.column(text))
            for i, j in groups(at):
                got = [both.whole(t.as_py() or "") for t in b.column(text).slice(i, j - i)]
                off = lambda k: pa.array(np.cumsum([0, *(len(g[k]) for g in got)]), pa.int32())  # noqa: E731, B023
                flat = lambda k: np.concatenate([g[k] for g in got]).astype(np.int32)  # noqa: E731, B023
                over = flat(4)
                last = pa.ListArray.from_arrays(off(4), pa.StructArray.from_arrays([pa.array(over[:, 0]), pa.array(over[:, 1])], ["a", "b"]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), *(pa.ListArray.from_arrays(off(k), pa.array(flat(k))) for k in range(4)), last], [*keep, *new])

    return small_batches(docs.select(*keep, F.col(text_col).cast("string").alias(text))).mapInArrow(run, schema)


_LINKS = "array<struct<a: int, b: int, times: long>>"


def measure(docs: DataFrame, a_file: bytes, b_model: bytes, keep: list[str] | None = None, text_col: str = "text", row: str = "row") -> DataFrame:
    """``docs`` (its ``keep`` columns) with ``row`` long, another for each row, n_a, n_b, n_groups, n_links long, groups_sha256 string and links array<a, b, times>.

    Tokens and groups are those of ``align``. A link is a token of A and one of B in one group;
    links are summed up by their ids. groups_sha256 is the hash of the groups' ids,
    ``a1,a2|b1;a3|b2,b3``; '' for a text without tokens.
    """
    new = (row, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    keep, text = others(docs.columns if keep is None else keep, new), aside(docs, "text")
    schema = extended(docs, keep, f"`{row}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {_LINKS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = aligner(a_file, b_model), TaskContext.get().partitionId() << 40
        try:
            for b in batches:
                _, at = buffers(b.column(text))
                for i, j in groups(at):
                    columns = _measured(both, [t.as_py() or "" for t in b.column(text).slice(i, j - i)])
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), pa.array(np.arange(number, number + j - i)), *columns], [*keep, *new])
                    number += j - i
        finally:
            both.forget()

    return small_batches(docs.select(*keep, F.col(text_col).cast("string").alias(text))).mapInArrow(run, schema)


def _measured(both: Aligner, texts: list[str]) -> list[pa.Array]:
    """The columns of ``measure`` for some texts."""
    lists = [both.parts(t) if t else [] for t in texts]
    parts = set(chain.from_iterable(lists))
    bad = both.learn(parts)
    if bad:
        lists = [x if bad.isdisjoint(x) else [] for x in lists]
    counts = [Counter(x) for x in lists]
    row, times = np.repeat(np.arange(len(texts)), [len(c) for c in counts]), np.array([n for c in counts for n in c.values()], np.int64)
    raw = list(map(both.figures.__getitem__, chain.from_iterable(counts)))
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
    flat, start = np.frombuffer(b"".join(raw), np.int64), np.cumsum(size) - size
    head = flat[start[:, None] + np.arange(Aligner.HEAD)].reshape(-1, Aligner.HEAD)
    at = _ranges(start + Aligner.HEAD, size - Aligner.HEAD)
    total = lambda k: pa.array(np.bincount(row, head[:, k] * times, len(texts)).astype(np.int64))
    key, sums = _summed(np.repeat(row, head[:, 4]), flat[at[::2]], flat[at[1::2]] * np.repeat(times, head[:, 4]))
    links = pa.StructArray.from_arrays([pa.array((key[:, 1] // both.b.size).astype(np.int32)), pa.array((key[:, 1] % both.b.size).astype(np.int32)), pa.array(sums)], ["a", "b", "times"])
    off = pa.array(np.searchsorted(key[:, 0], np.arange(len(texts) + 1)), pa.int32())
    # every group's text ends with a semicolon, the last one's does not count
    sha = [hashlib.sha256(b"".join(map(both.listed.__getitem__, x))[:-1]).hexdigest() if x else "" for x in lists]
    both.drop_long(parts)
    return [*map(total, range(4)), pa.array(sha), pa.ListArray.from_arrays(off, links)]


def count_links(docs: DataFrame, a_file: bytes, b_model: bytes, keep: list[str] | None = None, text_col: str = "text", most: int = MOST_PAIRS) -> DataFrame:
    """``docs`` (its ``keep`` columns) with the figures of ``measure``, n_best and count_sum long.

    A pair of ids counts the rows that hold it linked. count_sum adds up the counts of a row's links,
    n_best is how many of them have the highest count that a link of their A id has, ties included;
    0 for rows without tokens.

    Figures are written once; links are then counted over the cluster. The commonest pairs, ``most``
    at most, meet the links by broadcast, others by a join, in which no pair is hot.
    """
    new = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    keep, row = others(docs.columns if keep is None else keep, (*new, "links")), aside(docs, "row")
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.save(measure(docs.select(*keep, F.col(text_col).alias(aside(docs, "t"))), a_file, b_model, keep, aside(docs, "t"), row), compression="zstd")
    links = rows.select(F.col(row).alias("row"), F.explode("links").alias("l")).select("row", "l.*")
    counts = scratch.save(links.groupBy("a", "b").agg(F.count("*").alias("n")))
    top = counts.groupBy("a").agg(F.max("n").alias("best"))  # a row an id of A at most
    counts = scratch.save(counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("best")).alias("best")))
    least = 0
    while counts.where(F.col("n") > least).limit(most + 1).count() > most:
        least = max(1, 2 * least)
    met = links.join(F.broadcast(counts.where(F.col("n") > least)), ["a", "b"], "left" if least else "inner")
    if least:
        met = met.where("n is not null").unionByName(met.where("n is null").drop("n", "best").join(counts.where(F.col("n") <= least), ["a", "b"]))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("links").join(sums.withColumnRenamed("row", row), row, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*keep, *new[:5], zero("n_best"), zero("count_sum"))
