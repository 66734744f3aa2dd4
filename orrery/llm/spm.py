"""SentencePiece encoding and decoding as a shortest path through a weighted transducer."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import aside, extended, others, small_batches

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE, _UNIGRAM, _BPE = 1, 2, 3, 6, 1, 2
#: Pairs of pieces are kept as first * _PAIR + second.
_PAIR = 1 << 20
#: Rows of an Arrow batch that become Python strings at a time, and segments of a text that are joined at a time.
ROWS, SEGMENTS = 256, 1 << 16


class Normaliser:
    """The model's normaliser, compiled from its specification: character rules, white space rules, the added blank.

    The rules are a double-array trie over UTF-8 bytes: the longest rule that fits at a place is
    rewritten, a character without a rule copies itself.
    """

    def __init__(self, spec, space_behind: bool):
        if space_behind:
            raise ValueError("a model that puts blanks behind words is not supported")
        blob = spec.precompiled_charsmap
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if blob else []
        self.written = blob[4 + size :] if blob else b""
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "
        self.identity = not self.units and not self.squeeze
        self._known: dict[str, bool] = {}

    def _rule(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and rewriting of the longest rule at a place."""
        units, found = self.units, None
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = jump(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.written[start : self.written.index(b"\0", start)]
        return found

    def rewritten(self, text: str) -> str:
        """The text after the character rules."""
        if not self.units:
            return text
        raw, out, at = text.encode("utf-8", "replace"), bytearray(), 0
        while at < len(raw):
            if (got := self._rule(raw, at)) is not None:
                out += got[1]
                at += got[0]
                continue
            end = at + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            out += raw[at:end]
            at = end
        return out.decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        if not self.identity:
            text = self.rewritten(text)
            if self.squeeze:
                text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        return ((" " if self.prefix else "") + text).replace(" ", self.space)


class Pieces:
    """The pieces as a transducer from characters to ids: a trie, whose final states carry an id and a weight.

    A unigram model's arc weighs minus its score. A BPE model is an acceptor over neighbouring
    pieces: an arc behind another weighs 0 if merging leaves the boundary between the two alone,
    else it is missing (infinite). ``follows`` tells it from the pieces' last merges, which are
    found once, when the model is compiled.
    """

    def __init__(self, proto):
        odd = {p.type for p in proto.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE) or odd:
            raise ValueError("a unigram or BPE model without user-defined pieces is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.spelt = [b"" if p.type == _CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else " ⁇ ".encode() if p.type == _UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        # a unigram model's unknown characters cost 10 more than its least likely piece
        self.penalty = 10 - min((p.score for p in proto.pieces if p.type == _NORMAL), default=0.0)
        if self.kind == _BPE:
            self._order()
        self.trie: dict[str, tuple[dict, int]] = {}  # by character: the next node and the piece that ends here, or -1
        for piece, t in self.ids.items():
            if self.kind == _BPE and self.order[t] < 0:
                continue
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, -1))[0]
            node[piece[-1]] = (node.get(piece[-1], ({}, -1))[0], t)

    def _order(self) -> None:
        """Merge order of each piece (0: a character, -1: never made) and the two pieces of its last merge."""
        long = [t for p, t in self.ids.items() if len(p) > 1]
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a BPE model needs a piece for each character of its pieces")
        self.order, self.left, self.right, self.level = [0] * len(self.pieces), [-1] * len(self.pieces), [-1] * len(self.pieces), set()
        rank = {s: n + 1 for n, s in enumerate(sorted({self.scores[t] for t in long}, reverse=True))}
        self.place = {self.pieces[t]: rank[self.scores[t]] for t in long}
        for t in long:
            last = self._merged(self.pieces[t], 2)
            if len(last) > 2 or self._merged(self.pieces[t]) != [self.pieces[t]]:
                self.order[t] = -1
                continue
            self.left[t], self.right[t] = (self.ids[x] for x in last)
            self.order[t] = self.place[self.pieces[t]]
            if any(self.place.get(x, 0) >= self.order[t] for x in last):
                self.level.add(t)  # as good as its parts: runs of blanks

    def _merged(self, text: str, least: int = 1) -> list[str]:
        """Merging of known characters, best pieces first, of equal ones the leftmost, down to ``least`` parts."""
        parts, none = list(text), 1 << 60
        while len(parts) > least:
            best, i = min((self.place.get(x + y, none), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand behind piece a: no merge over their boundary comes before the merges that made them.

        The later of the two pieces' last merges is undone in turn; of equal ones the left goes
        first. A piece no later than its parts does not tell when it was made, so it is merged.
        """
        if a in self.level or b in self.level:
            return self._merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        limit = 1 << 60
        get, pieces, order = self.place.get, self.pieces, self.order
        while True:
            if get(pieces[a] + pieces[b], limit) < limit:
                return False
            if order[a] > order[b]:
                limit, a = order[a], self.right[a]
            elif order[b]:
                limit, b = order[b] + 1, self.left[b]
            else:
                return True

    def cuts(self) -> re.Pattern:
        """Segments of normalised text that no piece spans: a run of characters that pieces hold side by side, with the blanks before it."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):  # pieces over several words
            breaks = "" if any("\n" in p for p in self.ids) else "\n"
            return re.compile(f"[^{breaks}]+|\n" if breaks else r"(?s).+")
        above: dict[str, str] = {}

        def root(c: str) -> str:
            while above.setdefault(c, c) != c:
                above[c] = c = above[above[c]]
            return c

        for p in self.ids:
            body = p.lstrip(SPACE)
            for x, y in zip(body, body[1:], strict=False):
                above[root(x)] = root(y)
        classes: dict[str, list[str]] = {}
        for c in above:
            classes.setdefault(root(c), []).append(c)
        runs = ["[" + "".join(map(re.escape, sorted(v))) + "]+" for v in sorted(classes.values(), key=lambda v: (-len(v), v)) if len(v) > 1]
        return re.compile(f"(?s){SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+")


class _Segments(dict):
    """Ids of segments as int32 bytes, kept for the next time; when full, those not used since the last time go.

    Segments of up to 64 characters, so two times MOST of them hold some 60 MB at most.
    """

    MOST = 120_000

    def __init__(self, fst: Transducer):
        self.fst, self.old = fst, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            got = array("i", self.fst.path(text)).tobytes()
        if len(text) <= 64:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[text] = got
        return got


class Transducer:
    """normaliser o pieces o byte fallback of one model, composed with a text segment by segment.

    States of the composition are the ends of characters. From each, arcs run along the trie: one
    for every piece that spells the characters in between, or one for a character without a piece,
    which gives its bytes, or the unknown piece. Paths add weights and the least weight wins
    (tropical semiring); of equal paths the one found first stays. In a BPE model every state has
    one finite path at most, as no two ways of merging the same characters have all boundaries in
    order, so states can be visited depth first.
    """

    MOST_PAIRS = 400_000

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.pieces = Pieces(proto)
        self._cut = self.pieces.cuts()
        self.forget()

    def forget(self) -> None:
        """Drops what is kept of earlier texts."""
        self._segments = _Segments(self)
        self._pairs: dict[int, bool] = {}

    def path(self, text: str) -> list[int]:
        """The ids on the shortest path of one segment."""
        p = self.pieces
        if p.kind == _BPE:
            return self._merging(text)
        back = self._cheapest(text)
        out: list[int] = []
        i = len(text)
        while i:
            j, t = back[i]
            out += [t] if t >= 0 else self._spelt(text[j:i])[::-1]
            i = j
        return out[::-1]

    def _spelt(self, c: str) -> list[int]:
        """The output of a character without a piece."""
        p = self.pieces
        return [p.bytes.get(b, p.unknown) for b in c.encode("utf-8", "replace")] if p.bytes else [p.unknown]

    def _merging(self, text: str) -> list[int]:
        """The shortest path for weights that are 0 or infinite: depth first, longest arcs first, so the first that ends is it.

        A state that no finite arc leaves is not entered again: whatever way leads to it is the same.
        """
        n, root, pairs = len(text), self.pieces.trie, self._pairs
        arcs: list[list[tuple[int, int]] | None] = [None] * n
        dead = bytearray(n + 1)
        trail: list[tuple[int, int]] = []
        j, before = 0, -1
        while j < n:
            found = arcs[j]
            if found is None:
                node, i, found = root, j, []
                for c in text[j:] if j else text:
                    arc = node.get(c)
                    if arc is None:
                        break
                    i += 1
                    node, t = arc
                    if t >= 0:
                        found.append((i, t))
                if i == j:  # no piece starts with this character
                    found.append((j + 1, -1))
                found.reverse()
                arcs[j] = found
            for i, t in found:
                if dead[i]:
                    continue
                if before >= 0 <= t:
                    key = before * _PAIR + t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= self.MOST_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.pieces.follows(before, t)
                    if not ok:
                        continue
                trail.append((j, before))
                j, before = i, t
                break
            else:
                dead[j] = 1
                if not trail:
                    raise ValueError(f"no path through {text!r}")
                j, before = trail.pop()
        last = [t for _, t in trail[1:]]
        if n:
            last.append(before)
        if min(last, default=0) >= 0:
            return last
        out: list[int] = []
        for (at, _), t in zip(trail, last, strict=True):
            out += [t] if t >= 0 else self._spelt(text[at])
        return out

    def _cheapest(self, text: str) -> list[tuple[int, int]]:
        n, none, scores = len(text), float("inf"), self.pieces.scores
        cost, back = [0.0] + [none] * n, [(0, -1)] * (n + 1)
        for j in range(n):
            node = self.pieces.trie
            for i in range(j + 1, n + 1):
                node, t = node.get(text[i - 1], (None, -1))
                weight = -scores[t] if t >= 0 else self.pieces.penalty if i == j + 1 else none
                if cost[j] + weight < cost[i]:
                    cost[i], back[i] = cost[j] + weight, (j, t)
                if node is None:
                    break
        return back

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32 bytes. Without byte pieces a run of unknown characters is one unknown piece."""
        if not text:
            return b""
        text, kept = self.normalise(text), self._segments.__getitem__
        if len(text) < SEGMENTS:
            out = b"".join(map(kept, self._cut.findall(text)))
        else:
            out = b"".join(b"".join(map(kept, some)) for some in batched((m[0] for m in self._cut.finditer(text)), SEGMENTS))
        if self.pieces.bytes:
            return out
        ids = np.frombuffer(out, np.int32)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.pieces.unknown) & (ids[:-1] == self.pieces.unknown)
        return ids[~again].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces spelt out, bytes put together (invalid ones become U+FFFD), the added blank taken off."""
        text = b"".join(map(self.pieces.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if (self.normalise.prefix or self.normalise.squeeze) and text.startswith(" ") else text


_made: dict[bytes, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """Compiled once a process."""
    key = hashlib.sha256(model).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(model)
    return _made[key]


def encode(docs: DataFrame, model: bytes, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (its ``keep`` columns) with token_ids array<int>, n_tokens int and exact boolean.

    exact: whether decoding the ids gives the text back; a text with U+2581, or one that the
    normaliser changes, does not. Null and empty texts have no tokens and are exact. The model's
    bytes (a file of some 500 kB) travel with the task. Rows are taken one by one, whole, so ties,
    repeats and null ids need no rule; columns of the new names, in any case, are replaced. What a worker keeps
    of earlier segments is bounded and goes when its task ends. No shuffle.
    """
    new = ("token_ids", "n_tokens", "exact")
    keep, col = others(docs.columns if keep is None else keep, new), aside(docs, "text")
    rows = small_batches(docs.select(*keep, F.col(text_col).cast("string").alias(col)))
    schema = extended(docs, keep, "token_ids array<int>, n_tokens int, exact boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    ids, exact = [], []
                    for text in b.column(col):
                        text = text.as_py() or ""
                        ids.append(fst.encode(text))
                        exact.append(fst.decode(memoryview(ids[-1]).cast("i")) == text)
                    count = np.array([len(x) // 4 for x in ids], np.int32)
                    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    tokens = pa.ListArray.from_arrays(off, pa.array(np.frombuffer(b"".join(ids), np.int32)))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), tokens, pa.array(count), pa.array(exact)], [*keep, *new])
        finally:
            fst.forget()

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``rows`` with ``text_col`` decoded from ``ids_col``; null ids give null, an id outside the model fails."""
    keep = [c for c in rows.columns if c != text_col]
    schema = extended(rows, keep, f"`{text_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for b in batches:
            texts = [None if x is None else fst.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, text_col])

    return rows.select(*keep).mapInArrow(run, schema)
