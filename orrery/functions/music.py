"""Tracks and recordings: tags, parameters, boosts, weights."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of captions and speech by the share of frames, in nine buckets.
BUCKETS = [(0.10, 0.90), (0.20, 0.80), (0.30, 0.70), (0.40, 0.60), (0.50, 0.50), (0.60, 0.40), (0.70, 0.30), (0.80, 0.20), (0.90, 0.10)]
#: Words of a description that say nothing.
DESCRIPTION_STOP = ["music", "background", "with", "and", "for", "the", "very", "tempo", "clip", "that", "this", "from"]


def bucket_weights(frames: Column, speech: Column) -> Column:
    """struct(caption, speech) weights of a recording with so many frames and pieces of speech."""
    total = frames + speech
    share = F.when(total > 0, frames / total).otherwise(0.5)
    at = F.least(F.floor(share * 9).cast("int"), F.lit(8))
    return F.struct(F.array(*[F.lit(b) for b, _ in BUCKETS])[at].alias("caption"), F.array(*[F.lit(s) for _, s in BUCKETS])[at].alias("speech"))


#: Labels of a feature below each bound, and from the last one on; no label where there is none.
TAGS = {
    "tempo": [(75, "slow"), (110, "medium-tempo"), (None, "fast")],
    "centroid": [(1500, "dark-timbre"), (3500, "warm-timbre"), (None, "bright-timbre")],
    "zcr": [(0.12, None), (None, "noisy")],
}
#: Labels outside two bounds: below the first, above the second.
EDGES = {"ratio": (0.5, "rhythmic", 5, "melodic"), "loud": (0.02, "quiet", 0.15, "loud"), "seconds": (30, "short-clip", 240, "long-track")}
#: Phrases of a description, by the same scheme.
PHRASES = {
    "tempo": [(95, "slow tempo calm 느린 잔잔한 조용한"), (125, "moderate tempo mid 중간 템포"), (None, "fast tempo upbeat 빠른 활기찬 신나는")],
    "centroid": [(1800, "dark warm low spectral 어두운 낮은 저음"), (3500, "balanced neutral 중성 균형"), (None, "bright airy high spectral 밝은 화사한 고음")],
    "loud": [(0.03, "quiet soft 조용 작은 볼륨"), (0.1, "medium loudness 중간 볼륨"), (None, "loud energetic 강한 에너지 큰 볼륨")],
    "vocal": [(2000, "vocal warm chesty 따뜻한 보컬 낮은 목소리"), (3800, "vocal balanced natural 중성 보컬 자연스러운"), (None, "vocal bright airy 밝은 고음 보컬")],
}
#: Phrases with one bound or two that are compared strictly.
NOISY, SMOOTH = (0.12, "noisy percussive 타격감 드럼"), "smooth harmonic 부드러운 하모닉"
MELODIC, RHYTHMIC, MIXED = (2.0, "harmonic melodic 선율 위주 멜로디"), (0.8, "rhythmic percussive 리듬 위주 비트"), "mixed harmonic percussive 혼합 밸런스"
ALWAYS, BREATHY, NO_VOICE = "music audio track 음악", (0.35, " breathy airy 쉰 목소리 공기감"), "instrumental 반주 보컬 없음"
#: What scales features to about 0 to 1.
MOOD = {"energy": 12.0, "brightness": 6000.0, "slowest": 60.0, "tempo": 120.0, "harmonic": 3.0}
VOICE = {"presence": 20.0, "air": 4.0, "prominence": 3.0}
PACKED = {"tempo": 200.0, "centroid": 8000.0, "centroid_sd": 4000.0, "rolloff": 20000.0, "ratio": 5.0, "loud": 10.0, "mfcc": 100.0}


def _by_bound(x: Column, table: list[tuple[float | None, str | None]]) -> Column:
    """The entry of the first bound that x is below, else the last one."""
    *below, (_, last) = table
    return reduce(lambda out, e: F.when(x < e[0], F.lit(e[1])).otherwise(out), reversed(below), F.lit(last))


def tags(tempo: Column, centroid: Column, ratio: Column, loud: Column, zcr: Column, seconds: Column) -> Column:
    """Rule-based labels of a track's features."""
    edge = lambda x, e: F.when(x > e[2], e[3]).when(x < e[0], e[1])
    noisy = F.when(zcr > TAGS["zcr"][0][0], TAGS["zcr"][1][1])
    return F.array_compact(F.array(_by_bound(tempo, TAGS["tempo"]), _by_bound(centroid, TAGS["centroid"]), edge(ratio, EDGES["ratio"]), edge(loud, EDGES["loud"]), noisy, edge(seconds, EDGES["seconds"])))


def description(tempo: Column, centroid: Column, zcr: Column, ratio: Column, loud: Column, vocal: Column, vocal_centroid: Column, vocal_high: Column) -> Column:
    """A track in words, for a text encoder; other bounds than those of ``tags``."""
    sung = F.concat(_by_bound(vocal_centroid, PHRASES["vocal"]), F.when(vocal_high > BREATHY[0], BREATHY[1]).otherwise(""))
    return F.concat_ws(
        " ",
        _by_bound(tempo, PHRASES["tempo"]),
        _by_bound(centroid, PHRASES["centroid"]),
        F.when(zcr > NOISY[0], NOISY[1]).otherwise(SMOOTH),
        F.when(ratio > MELODIC[0], MELODIC[1]).when(ratio < RHYTHMIC[0], RHYTHMIC[1]).otherwise(MIXED),
        _by_bound(loud, PHRASES["loud"]),
        F.lit(ALWAYS),
        F.when(vocal > 1e-6, sung).otherwise(NO_VOICE),
    )


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def mood(tempo: Column, centroid: Column, loud: Column, ratio: Column) -> Column:
    """struct(energy, brightness, tempo_norm, harmonic) of 0 to 1."""
    return F.struct(unit(loud * MOOD["energy"]).alias("energy"), unit(centroid / MOOD["brightness"]).alias("brightness"), unit((tempo - MOOD["slowest"]) / MOOD["tempo"]).alias("tempo_norm"), unit(F.log1p(ratio) / MOOD["harmonic"]).alias("harmonic"))


def voice(centroid: Column, loud: Column, high: Column, mix_loud: Column) -> Column:
    """struct(brightness, presence, air, prominence) of a track's voice, 0 to 1."""
    return F.struct(F.when(centroid > 0, unit(centroid / MOOD["brightness"])).otherwise(0.0).alias("brightness"), unit(loud * VOICE["presence"]).alias("presence"), unit(F.log1p(high) / VOICE["air"]).alias("air"), unit(loud / (mix_loud + 1e-9) / VOICE["prominence"]).alias("prominence"))


def packed(tempo: Column, centroid: Column, centroid_sd: Column, rolloff: Column, zcr: Column, ratio: Column, loud: Column, loud_sd: Column, mfcc: Column, mfcc_sd: Column, chroma: Column) -> Column:
    """One vector of a track's features, each scaled to about 0 to 1."""
    head = F.array(tempo / PACKED["tempo"], centroid / PACKED["centroid"], centroid_sd / PACKED["centroid_sd"], rolloff / PACKED["rolloff"], zcr, F.log1p(ratio) / PACKED["ratio"], loud * PACKED["loud"], loud_sd * PACKED["loud"])
    down = lambda v: F.transform(v, lambda x: x.cast("double") / PACKED["mfcc"])
    return F.concat(head, down(mfcc), down(mfcc_sd), F.transform(chroma, lambda x: x.cast("double")))


def artist_title(name: Column) -> Column:
    """struct(artist, title) of a file's name: parted at the first underscore, ``_audio`` at the end left out; no artist without one."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""), "_audio$", "")
    at = F.instr(base, "_")
    return F.when(at > 0, F.struct(F.trim(F.substring(base, F.lit(1), at - 1)).alias("artist"), F.trim(F.substring(base, at + 1, F.length(base))).alias("title"))).otherwise(F.struct(F.lit("").alias("artist"), F.trim(base).alias("title")))


def boosts(artist_hint: Column, title_hint: Column, broad: Column, hinted_moods: Column, filename: Column, artist: Column, title: Column, track_tags: Column, moods: dict[str, list[str]]) -> Column:
    """What a request's hints add to a track: .20 for its artist (.30 without a title), .25 for its title, .05 for each mood among its tags."""
    blob = lambda *c: F.lower(F.concat_ws(" ", *c))
    a = F.when(F.contains(blob(filename, artist), F.lower(artist_hint)), F.when(broad, 0.30).otherwise(0.20))
    t = F.when(F.contains(blob(filename, title), F.lower(title_hint)), 0.25)
    fits = lambda words: F.exists(track_tags, lambda tag: reduce(or_, [F.contains(F.lower(tag), F.lit(w.lower())) for w in words]))
    m = sum((F.when(F.array_contains(hinted_moods, k) & fits(v), 0.05).otherwise(0.0) for k, v in moods.items()), F.lit(0.0))
    return F.coalesce(a, F.lit(0.0)) + F.coalesce(t, F.lit(0.0)) + m


def description_boost(request: Column, text: Column) -> Column:
    """.025 for each of the request's words of four letters or more that a description holds, .10 at most."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(request), F.lit("[a-z]{4,}"), 0), lambda w: ~w.isin(*DESCRIPTION_STOP)))
    return F.least(F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) * 0.025, F.lit(0.10))
