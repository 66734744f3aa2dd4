"""Personal data in texts with offsets, one Arrow batch at a time: Spark's functions find all matches, but not where they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import pii

_PATTERNS = {k: [(re.compile(p), s) for p, s in v] for k, v in pii.RECOGNISERS.items()}
_CARD, _GROUPS, _ROW = (re.compile(p) for p in (pii.CARD, pii.CARD_GROUPS, pii.CARD_ROW))
_NEAR = [w.lower() for w in [*pii.BANKS, *pii.ACCOUNT_WORDS]]
_OUTPUT = [(k, re.compile(p)) for k, p, _ in pii.OUTPUT] + [("CREDIT_CARD", re.compile(p)) for p in pii.OUTPUT_CARDS]


def _sum_holds(kind: str, digits: str) -> bool:
    d = [int(c) for c in digits]
    if kind == "KR_RRN":
        return (11 - sum(a * w for a, w in zip(d[:12], [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], strict=True)) % 11) % 10 == d[12]
    if kind == "KR_BRN":
        return (10 - (sum(a * w for a, w in zip(d[:9], [1, 3, 7, 1, 3, 7, 1, 3, 5], strict=True)) + d[8] * 5 // 10) % 10) % 10 == d[9]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def _card_like(text: str) -> bool:
    s = re.sub(r"\s+", " ", text.strip())
    digits = re.sub(r"\D", "", s)
    return bool(_GROUPS.fullmatch(s)) or 13 <= len(digits) <= 19 and bool(_ROW.fullmatch(digits))


def _repeated(text: str, value: str) -> bool:
    return len(value.strip()) >= 4 and text.count(value.strip()) > pii.MOST_REPEATS


def near_account(text: str, start: int, end: int) -> bool:
    """Whether a bank or a word of accounts stands near a span."""
    window = text[max(0, start - pii.NEAR) : end + pii.NEAR].lower()
    return any(w in window for w in _NEAR)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) of a text's personal data, by place.

    Numbers with a checksum count only if it holds. Bank accounts need a bank or a word of accounts
    nearby, and neither they nor business numbers may repeat more than MOST_REPEATS times; a span in
    the layout of a card is no account. Card numbers that fail the Luhn check count by their layout.
    Of findings of one type one that lies within another of no lower score goes.
    """
    out = []
    for kind, patterns in _PATTERNS.items():
        own = []
        for pattern, score in patterns:
            for m in pattern.finditer(text):
                if kind in ("KR_RRN", "KR_BRN"):
                    if not _sum_holds(kind, re.sub(r"\D", "", m[0])):
                        continue
                    score = 1.0
                if kind == "KR_BANK_ACCOUNT" and (_card_like(m[0]) or not near_account(text, *m.span())):
                    continue
                if kind in ("KR_BANK_ACCOUNT", "KR_BRN") and _repeated(text, m[0]):
                    continue
                own.append((m.start(), m.end(), kind, score))
        out += [x for i, x in enumerate(own) if not any(j != i and y[0] <= x[0] and x[1] <= y[1] and (y[3], -j) > (x[3], -i) for j, y in enumerate(own))]
    cards = [(m.start(), m.end(), "CREDIT_CARD", 1.0) for m in _CARD.finditer(text) if _sum_holds("CREDIT_CARD", re.sub(r"\D", "", m[0]))]
    for pattern, score in ((_GROUPS, 0.88), (_ROW, 0.78)):
        for m in pattern.finditer(text):
            if not any(m.start() < e and m.end() > s for s, e, _, _ in cards) and not _repeated(text, m[0]):
                cards.append((m.start(), m.end(), "CREDIT_CARD", score))
    return sorted(out + cards)


def in_output(text: str) -> list[str]:
    """Types in a generated answer, in order; accounts only near a bank or a word of accounts."""
    found = [k for k, p in _OUTPUT if any(k != "KR_BANK_ACCOUNT" or near_account(text, *m.span()) for m in p.finditer(text))]
    return list(dict.fromkeys(found))


def merged(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Spans without overlaps: those that overlap become one, with the type of the greatest weight, the first of equal ones."""
    out: list[list] = []
    for s, e, kind, _ in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
            if pii.WEIGHTS[kind] > pii.WEIGHTS[out[-1][2]]:
                out[-1][2] = kind
        else:
            out.append([s, e, kind])
    return [tuple(x) for x in out]


def masked(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with each finding as its type in brackets."""
    for s, e, kind in reversed(merged(spans)):
        text = f"{text[:s]}[{kind}]{text[e:]}"
    return text


FINDINGS = "array<struct<start:int,end:int,type:string,score:double>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64())]))


def with_findings(rows: DataFrame, text_col: str = "text", mask: bool = False, output: bool = False) -> DataFrame:
    """``rows`` with findings; with the column masked, and with output_types, if asked for. Null text has none and stays null. No shuffle."""
    more = [("findings", FINDINGS), *[("masked", "string")] * mask, *[("output_types", "array<string>")] * output]
    keep = [c for c in rows.columns if c not in dict(more)]
    schema = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL(", ".join(" ".join(x) for x in more))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            found = [find(t or "") for t in texts]
            columns = [pa.array([[{"start": s, "end": e, "type": k, "score": x} for s, e, k, x in f] for f in found], _ARROW)]
            if mask:
                columns.append(pa.array([None if t is None else masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            if output:
                columns.append(pa.array([in_output(t or "") for t in texts], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], [*keep, *dict(more)])

    return rows.select(*keep).mapInArrow(run, schema)


def image_regions(blocks: DataFrame, key: str = "image", order: str = "block", text: str = "text", box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """(image, x0, y0, x1, y1, types) of text blocks of images with personal data in their text, or in it and the next block's.

    A pair's region is the box around both. Equal regions count once, with the types found first (a block before a pair).
    """
    found = lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in pii.IMAGE.items()]))
    w = Window.partitionBy(key).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    rows = blocks.withColumns({"__text": nxt(text), **{f"__{c}": nxt(c) for c in box}})
    alone = rows.select(key, F.lit(0).alias("pair"), order, *box, found(F.col(text)).alias("types"))
    sides = [F.least(box[0], "__" + box[0]), F.least(box[1], "__" + box[1]), F.greatest(box[2], "__" + box[2]), F.greatest(box[3], "__" + box[3])]
    pair = rows.where(F.col("__text").isNotNull()).select(key, F.lit(1).alias("pair"), order, *[s.alias(c) for s, c in zip(sides, box, strict=True)], found(F.concat_ws(" ", text, "__text")).alias("types"))
    both = alone.union(pair).where(F.size("types") > 0)
    return both.groupBy(key, *box).agg(F.min_by("types", F.struct("pair", order)).alias("types"))
