"""Scores, confidences and caps as column arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that lower the bound of grounding, by how much, and those of a summary.
GROUNDING_WORDS = [(["여권", "passport", "여권번호", "여권사진", "여권 사진", "여권 번호"], 0.10), (["주민번호", "주민등록", "rrn", "신분증", "민증"], 0.08), (["계좌번호", "사업자번호", "사업자등록"], 0.06)]
SUMMARY_WORDS = ["요약", "줄거리", "핵심", "정리", "간단히", "스토리", "내용", "plot", "summary", "synopsis"]


def gaussian_cdf(z: Column) -> Column:
    """Phi(z) by Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8. Spark has no erf."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


GAUSSIAN_SQL = "(CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END)".replace(
    "{t}",
    "(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * (1 / (1 + 0.2316419 * abs({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * abs({z}))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs({z}))) * (1.781477937 + (1 / (1 + 0.2316419 * abs({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs({z}))) * 1.330274429)))))",
)


def inverse_normal(p: Column) -> Column:
    """Inverse of Phi by Acklam's rational approximation (relative error about 1e-9).

    Fixed values: the published coefficients.
    """
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def horner(coefficients: list[float], x: Column) -> Column:
        total = F.lit(coefficients[0])
        for k in coefficients[1:]:
            total = total * x + k
        return total

    q = p - 0.5
    middle = horner(a, q * q) * q / horner([*b, 1.0], q * q)
    tail = lambda x: horner(c, x) / horner([*d, 1.0], x)
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p <= 1 - 0.02425, middle).otherwise(-tail(F.sqrt(-2 * F.log(1 - p))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def display_curve(x: Column) -> Column:
    """Piecewise linear: (0,0) (.10,.30) (.25,.70) (.40,.90) (.60,.98) (1,.99), flat beyond."""
    points = [(0.0, 0.0), (0.10, 0.30), (0.25, 0.70), (0.40, 0.90), (0.60, 0.98), (1.0, 0.99)]
    out = F.when(x <= 0, F.lit(0.0))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(0.99))


def min_max(x: Column, lo: Column, hi: Column, flat: float = 0.5) -> Column:
    """To 0..1 between a query's bounds; a constant channel becomes ``flat``."""
    return F.when(hi - lo < 1e-6, F.lit(flat)).otherwise((x - lo) / (hi - lo + 1e-9))


def min_max_zero(x: Column, lo: Column, hi: Column) -> Column:
    """The other variant: a constant channel becomes 0."""
    return F.when(hi - lo < 1e-12, F.lit(0.0)).otherwise((x - lo) / (hi - lo + 1e-12))


def fused(dense: Column, lexical: Column, asf: Column, has_lexical: Column, has_asf: Column) -> Column:
    """.60 / .25 / .15; the weight of a missing channel goes to dense."""
    wl, wa = F.when(has_lexical, 0.25).otherwise(0.0), F.when(has_asf, 0.15).otherwise(0.0)
    return dense * (1 - wl - wa) + F.when(has_lexical, lexical * 0.25).otherwise(0.0) + F.when(has_asf, asf * 0.15).otherwise(0.0)


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """1 - Hamming / (32 n) of two arrays of 32-bit words, signed or not, over their common length."""
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, 1 - bits / (32.0 * n)).otherwise(0.0)


def rerank_discount(score: Column, logit: Column, exempt: Column) -> Column:
    return F.when(~exempt & (logit < -3), score * 0.5).otherwise(score)


def margin_label(margin: Column) -> Column:
    return F.when(margin >= 0.15, "high").when(margin >= 0.05, "medium").otherwise("low")


def title_boost(final: Column, hits: Column) -> Column:
    """1.5 for each of the request's own words in a file's name."""
    return final + 1.5 * hits


def title_floor(confidence: Column, hits: Column) -> Column:
    """.60 at least where the name holds any."""
    return F.when(hits > 0, F.greatest(confidence, F.lit(0.60))).otherwise(confidence)


def token_boost(hits: Column, asked: Column, each: float, whole: float) -> Column:
    """``each`` for a token that an item holds, and ``whole`` more once as many match as the request itself has (words that expansion added count)."""
    return F.when(hits > 0, each * hits + F.when(hits >= asked, whole).otherwise(0.0)).otherwise(0.0)


def music_fusion(audio: Column, text: Column, has_text: Column) -> Column:
    """.55 audio and .45 text, audio alone without a text index; what a channel lacks counts 0."""
    a, t = F.coalesce(audio, F.lit(0.0)), F.coalesce(text, F.lit(0.0))
    return F.when(has_text, 0.55 * a + 0.45 * t).otherwise(a)


def null_confidence(score: Column, mu: Column, sigma: Column) -> Column:
    """Phi of a score over the null's mean and deviation, 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), gaussian_cdf((score - mu) / F.greatest(sigma, F.lit(1e-6)))))


def meaningful(query: Column) -> Column:
    """struct(alpha, digit, hangul, cjk, other, meaningful) of a request's characters, blanks around it left out.

    Single jamo count as other: they say nothing.
    """
    q = F.trim(query)
    count = lambda p: F.length(F.regexp_replace(q, f"[^{p}]", ""))
    hangul, cjk, digit = count(r"\x{AC00}-\x{D7AF}"), count(r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}"), count(r"\p{Nd}")
    letters = F.regexp_replace(F.regexp_replace(q, r"[\x{AC00}-\x{D7AF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{3130}-\x{318F}]", ""), r"[^\p{L}]", "")
    alpha = F.length(letters)
    return F.struct(alpha.alias("alpha"), digit.alias("digit"), hangul.alias("hangul"), cjk.alias("cjk"), (F.length(q) - alpha - digit - hangul - cjk).alias("other"), (alpha + hangul + cjk).alias("meaningful"))


def query_cap(query: Column) -> Column:
    """What a confidence may be at most: .30 for a request without letters or digits, .40 for digits only, .55 for one letter."""
    q = meaningful(query)
    return F.when(q["meaningful"] == 0, F.when(q["digit"] > 0, 0.40).otherwise(0.30)).when(q["meaningful"] == 1, 0.55).otherwise(1.0)


def adjusted(raw: Column, query: Column) -> Column:
    """A cosine on the display curve, and at most the request's cap; 0 if there is none."""
    return F.coalesce(F.least(display_curve(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))), query_cap(query)), F.lit(0.0))


def loud_share(samples: Column, window: int, least: float) -> Column:
    """The share of windows whose root mean square is above ``least``; a last, shorter one is left out."""
    n = F.floor(F.size(samples) / window).cast("int")
    rms = lambda i: F.sqrt(F.aggregate(F.slice(samples, i * window + 1, F.lit(window)), F.lit(0.0), lambda s, x: s + x * x) / window)
    loud = F.filter(F.sequence(F.lit(0), n - 1), lambda i: rms(i) > least)
    return F.when(n > 0, F.size(loud) / n).otherwise(0.0)


def wants_summary(query: Column) -> Column:
    return reduce(or_, [F.contains(F.lower(query), F.lit(w)) for w in SUMMARY_WORDS])


def grounding_threshold(query: Column) -> Column:
    """.15, for a summary .07, less what words of identity take off; .05 at least."""
    q = F.replace(F.lower(query), F.lit(" "), F.lit(""))
    off = F.lit(0.0)
    for words, by in reversed(GROUNDING_WORDS):
        off = F.when(reduce(or_, [F.contains(q, F.lit(w.replace(" ", ""))) for w in words]), by).otherwise(off)
    return F.greatest(F.when(wants_summary(query), 0.07).otherwise(0.15) - off, F.lit(0.05))
