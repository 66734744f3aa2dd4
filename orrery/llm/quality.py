"""Document quality by Bradley-Terry pairwise ranking.

A text is seen as figures on its bytes and words and as hashed words, word pairs and byte triples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textvec as tv
from orrery.llm.scratch import aside, extended, others, small_batches

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".?",
    "pause": b",;:'-",
    "shout": b"!",
    "bar": b"|",
    "sign": b"%&$#*@~^_=+<>/\\{}[]()\"`",
    "high": range(128, 256),
}
_MEMBER = np.zeros((len(_CLASSES), 256), np.uint8)
for _row, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[_row, list(_bytes)] = 1

FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "distinct", "repeats", "top_word", "words_per_line", "distinct_shape"]
#: Buckets of hashed words and word pairs, and as many of hashed byte triples.
BUCKETS = 512
WIDTH = len(FEATURES) + 2 * BUCKETS
#: Texts whose figures, of 8 KB a text and some copies of them, are held at once.
ROWS = 256
_TRIPLE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd factors, one a place


def _counted(out: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> None:
    """Adds the occurrences of (row, bucket), rows ascending, to ``out``."""
    if len(row):
        lo, hi = int(row[0]), int(row[-1]) + 1
        out[lo:hi] += np.bincount((row - lo) * BUCKETS + bucket, minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS)


def grams(data: np.ndarray, off: np.ndarray, words: tuple | None = None) -> np.ndarray:
    """Two rows of BUCKETS a text side by side: lower-cased words and pairs of neighbours, and triples of lower-cased bytes, of the whole text.

    A bucket holds the square root of its share of the text's occurrences, so both rows
    have length 1, or 0 where a text has none.
    """
    n = len(off) - 1
    out = np.zeros((2, n, BUCKETS))
    _, h, first = tv.words(data, off) if words is None else words
    pair = tv.shingles(h, 2)
    for lo in range(0, len(h), tv.PIECE):
        at = np.arange(lo, min(lo + tv.PIECE, len(h)))
        row = np.searchsorted(first, at, "right") - 1
        _counted(out[0], row, (h[at] >> np.uint64(55)).astype(np.int64))
        inside = at + 1 < first[row + 1]
        _counted(out[0], row[inside], (pair[at[inside]] >> np.uint64(55)).astype(np.int64))
    for lo in range(0, max(len(data) - 2, 0), tv.PIECE):
        hi = min(lo + tv.PIECE, len(data) - 2)
        low = tv.LOWER[data[lo : hi + 2]].astype(np.uint32)
        hashed = low[:-2] * _TRIPLE[0] + low[1:-1] * _TRIPLE[1] + low[2:] * _TRIPLE[2]
        hashed ^= hashed >> np.uint32(15)
        at = np.arange(lo, hi)
        row = np.searchsorted(off, at, "right") - 1
        inside = at + 2 < off[row + 1]
        _counted(out[1], row[inside], ((hashed * _TRIPLE[1]) >> np.uint32(23))[inside].astype(np.int64))
    out /= np.maximum(out.sum(2, keepdims=True), 1)
    return np.sqrt(out).transpose(1, 0, 2).reshape(n, -1)


def inputs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``features`` and ``grams`` side by side, WIDTH figures a text."""
    words = tv.words(data, off)
    return np.concatenate([features(data, off, words), grams(data, off, words)], 1)


def features(data: np.ndarray, off: np.ndarray, words: tuple | None = None) -> np.ndarray:
    """One row of FEATURES a text, from its whole bytes."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, len(FEATURES)))
    total = np.zeros(len(data) + 1, np.int64)
    for c in range(len(_CLASSES)):
        np.cumsum(_MEMBER[c][data], out=total[1:])
        out[:, c] = total[off[1:]] - total[off[:-1]]
    lines = out[:, list(_CLASSES).index("line")].copy()
    out[:, : len(_CLASSES)] /= np.maximum(size, 1)[:, None]
    _, h, first = tv.words(data, off) if words is None else words
    count = np.diff(first)
    at = len(_CLASSES)
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(count)
    out[:, at + 2] = np.minimum(size / np.maximum(count, 1), 60) / 10
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    for r in range(n):
        w = h[first[r] : first[r + 1]]
        if len(w):
            _, times = np.unique(w, return_counts=True)
            out[r, at + 3] = len(times) / len(w)
            out[r, at + 5] = times.max() / len(w)
            out[r, at + 7] = np.log(len(times)) / np.log(len(w) + 1)
    out[:, at + 4] = np.where(count > 1, (same[first[1:]] - same[np.minimum(first[:-1] + 1, len(h))]) / np.maximum(count - 1, 1), 0)
    out[:, at + 6] = np.log1p(count / (lines + 1))
    return out


def _input_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tv.buffers(b.column("text"))
        for i, j in tv.groups(off, rows=ROWS):
            x = inputs(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([b.column("label").slice(i, j - i), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], ["label", "x"])


class Ranker:
    """score = 1 / (1 + exp(-(w . z(x) - cut))): w from pairs, cut a quantile of the fitted scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.cut, -30, 30)))


def _columns(width: int) -> list[slice]:
    """Columns of a table that are copied at a time."""
    return [slice(c, c + 64) for c in range(0, width, 64)]


def fit_pairs(x: np.ndarray, label: np.ndarray, per_row: int = 24, penalty: float = 1e-3, steps: int = 25) -> Ranker:
    """Bradley-Terry: of a pair (label 1, label 0) the first wins with probability sigmoid(w . (x1 - x0)).

    Newton's method on the mean logistic loss over ``per_row`` drawn partners a row,
    with an L2 penalty; each step is solved by conjugate gradients on the rows, so no
    difference of a pair is ever stored. FEATURES are scaled one by one; what follows them
    shares one scale, which leaves rare grams small. The cut is the score quantile at the
    share of label 0, so as many fitted rows are rejected as were marked 0. With one label
    only, w is 0 and every score 0.5.
    """
    return _fitted(np.array(x, float), label, per_row, penalty, steps)


def _fitted(z: np.ndarray, label: np.ndarray, per_row: int = 24, penalty: float = 1e-3, steps: int = 25) -> Ranker:
    """``fit_pairs``, which scales ``z`` in place: the driver holds the figures once."""
    width = z.shape[1]
    if not len(z) or label.min() == label.max():
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = z.mean(0), np.empty(width)
    for c in _columns(width):
        scale[c] = np.maximum(z[:, c].std(0), 1e-9)
    if width > len(FEATURES):
        scale[len(FEATURES) :] = np.sqrt((scale[len(FEATURES) :] ** 2).mean())
    z -= mean
    z /= scale
    np.clip(z, -8, 8, out=z)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.Generator(np.random.PCG64(5))
    loser = np.concatenate([bad[rng.integers(0, len(bad), len(good) * per_row)], np.repeat(bad, per_row)])
    winner = np.concatenate([np.repeat(good, per_row), good[rng.integers(0, len(good), len(bad) * per_row)]])

    def spread(v: np.ndarray) -> np.ndarray:
        """The mean over pairs of v times the pair's difference."""
        return (np.bincount(winner, v, len(z)) - np.bincount(loser, v, len(z))) @ z / len(winner)

    w = np.zeros(width)
    for _ in range(steps):
        s = z @ w
        p = 1 / (1 + np.exp(np.clip(s[winner] - s[loser], -30, 30)))  # chance of the wrong order
        curve = p * (1 - p)

        def bent(v: np.ndarray, curve: np.ndarray = curve) -> np.ndarray:
            m = z @ v
            return spread(curve * (m[winner] - m[loser])) + penalty * v

        step = _solved(bent, spread(p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return Ranker(mean, scale, w, _cut(s, label))


def _solved(times, b: np.ndarray, most: int = 200) -> np.ndarray:
    """x with times(x) = b, by conjugate gradients."""
    x, r = np.zeros_like(b), b.copy()
    d, rr = r.copy(), r @ r
    stop = 1e-20 + 1e-16 * rr
    for _ in range(most):
        if rr <= stop:
            break
        q = times(d)
        a = rr / (d @ q)
        x, r = x + a * d, r - a * q
        last, rr = rr, r @ r
        d = r + rr / last * d
    return x


def _cut(s: np.ndarray, label: np.ndarray) -> float:
    """The quantile at the share of label 0, in the middle of its gap."""
    s, zeros = np.sort(s), int((label == 0).sum())
    return float((s[zeros - 1] + s[zeros]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", penalty: float = 1e-4) -> Ranker:
    """Fits on at most ``most`` labelled rows, those of smallest hash of the id among ``usable`` ones.

    ``usable`` is a condition on the labels' columns. Rows with a null id, a label
    other than 0 and 1, or an id of several labels are not used. Of a repeated id one text
    is used, the smallest; null text counts as empty. Ids are whole numbers.
    """
    marked = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("hi")).where("label = hi")
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.col("label").cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # `most` rows bound the broadcast; of an id's texts the smallest counts, so as many rows as labels come back at most
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
    x, label = _ordered(small_batches(rows).mapInArrow(_input_rows, "label int, x binary").toArrow().to_batches())  # 4.2 KB a row
    return _fitted(x, label, penalty=penalty)


def _ordered(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels of all rows, in an order of their own: rows come in any order, and the fit must not depend on it. ``batches`` is emptied on the way."""
    n = sum(b.num_rows for b in batches)
    x, label = np.empty((n, WIDTH)), np.empty(n, np.int32)
    lo = 0
    while batches:
        b = batches.pop()
        hi = lo + b.num_rows
        if hi > lo:
            raw = b.column("x")
            x[lo:hi] = np.frombuffer(raw.buffers()[2], np.float32, (hi - lo) * WIDTH, 4 * WIDTH * raw.offset).reshape(-1, WIDTH)
            label[lo:hi] = b.column("label").to_numpy()
        lo = hi
    order = np.lexsort((*x.T, label)) if n else np.zeros(0, int)
    for c in _columns(WIDTH):
        x[:, c] = x[order, c]
    return x, label[order]


def score(docs: DataFrame, ranker: Ranker, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with score double (0 to 1) and predicted int; ``keep`` names the columns to carry (all by default).

    Only the text decides. Null text counts as empty; an empty text has a score like
    any other. Columns of these two names in ``docs``, in any case, are replaced. No shuffle.
    """
    keep, text = others(docs.columns if keep is None else keep, ("score", "predicted")), aside(docs, "text")
    rows = small_batches(docs.select(*keep, F.col(text_col).cast("string").alias(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tv.buffers(b.column(text))
            s = [ranker(inputs(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in tv.groups(off, rows=ROWS)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    schema = extended(docs, keep, "score double, predicted int")
    return rows.mapInArrow(run, schema)
