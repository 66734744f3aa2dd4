"""Recordings, tracks and sessions (families B, C, D, E, F, I, K, M, O)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import music as M
from orrery.functions import scoring as S
from orrery.operators import requests as Q
from orrery.operators import sessions
from orrery.operators.axis_search import AxisSearch, channel, quantile
from orrery.operators.windows import overlap_join, sliding
from orrery.plans.ranking import CHANNELS_SQL
from orrery.plans.registry import query, raw, table, view
from orrery.plans.vectors import AXES_SQL, SCORED_SQL, asked_in_parts, best_rows
from orrery.sources import workdir


def by(*keys: str) -> Window:
    return Window.partitionBy(*keys)


# speech and frames


@query(
    "oc8_interval_overlap",
    raw("WITH s AS {segments}, f AS (SELECT conv_id, unnest(range(0, (floor(max(end_sec) / 12) + 1)::BIGINT)) * 12.0 AS f0 FROM s GROUP BY conv_id) SELECT f.conv_id, f.f0::DOUBLE AS start, string_agg(s.turn::VARCHAR, ' ' ORDER BY s.start_sec, s.turn) AS turns, md5(trim(string_agg(s.stt_text, ' ' ORDER BY s.start_sec, s.turn))) AS text FROM f JOIN s ON s.conv_id = f.conv_id AND s.end_sec >= f.f0 AND s.start_sec <= f.f0 + 12 GROUP BY f.conv_id, f.f0"),
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech against the frames of 12 s up to each recording's end, both ends closed; texts in order."""
    s = view(spark, sf_dir, "segments").select("conv_id", "turn", "start_sec", "end_sec", "stt_text")
    f = s.groupBy("conv_id").agg(F.floor(F.max("end_sec") / 12).cast("int").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).select("conv_id", (F.col("i") * 12.0).cast("double").alias("start")).withColumn("stop", F.col("start") + 12)
    hit = overlap_join(f, s, "conv_id", ("start", "stop"), ("start_sec", "end_sec"), unit=1.0)
    rows = hit.groupBy("conv_id", "start").agg(F.array_sort(F.collect_list(F.struct("start_sec", "turn", "stt_text"))).alias("a"))
    return rows.select("conv_id", "start", F.array_join(F.transform("a", lambda x: x["turn"].cast("string")), " ").alias("turns"), F.md5(F.trim(F.array_join("a.stt_text", " ")).cast("binary")).alias("text"))


@query(
    "oc9_window_speech",
    raw("WITH s AS {segments}, d AS (SELECT conv_id, max(end_sec) AS d FROM s GROUP BY conv_id), w AS (SELECT conv_id, d, unnest(range(0, greatest(ceil(d / 15)::BIGINT, 1))) * 15.0 AS w0 FROM d) SELECT w.conv_id, w.w0::DOUBLE AS start, round(least(w.w0 + 30, w.d), 2) AS stop, count(s.turn) AS turns, md5(coalesce(nullif(trim(string_agg(s.stt_text, ' ' ORDER BY s.start_sec, s.turn)), ''), ' ')) AS text FROM w LEFT JOIN s ON s.conv_id = w.conv_id AND s.end_sec >= w.w0 AND s.start_sec <= w.w0 + 30 GROUP BY w.conv_id, w.w0, w.d"),
)
def window_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech within windows of 30 s every 15 s up to each recording's end; a window without any has one blank."""
    s = view(spark, sf_dir, "segments").select("conv_id", "turn", "start_sec", "end_sec", "stt_text")
    w = sliding(s.groupBy("conv_id").agg(F.max("end_sec").alias("d")), "conv_id", "d", 30, 15).withColumn("reach", F.col("start") + 30)
    hit = overlap_join(w, s, "conv_id", ("start", "reach"), ("start_sec", "end_sec"), unit=1.0)
    rows = hit.groupBy("conv_id", "start").agg(F.array_sort(F.collect_list(F.struct("start_sec", "turn", "stt_text"))).alias("a"))
    text = F.coalesce(F.nullif(F.trim(F.array_join("a.stt_text", " ")), F.lit("")), F.lit(" "))
    return w.join(rows, ["conv_id", "start"], "left").select("conv_id", "start", F.round("stop", 2).alias("stop"), F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("turns"), F.md5(text.cast("binary")).alias("text"))


# scores of files

_KIND = "CASE WHEN element_at(embedding, 1) >= 0 THEN 'blip' ELSE 'stt' END"


@query("od1_best_per_file", f"WITH {AXES_SQL}, {SCORED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored), b AS (SELECT qid, label, round(max(score), 4) AS best, arg_min(row_id, rn) AS row_id FROM p WHERE rn <= 50 GROUP BY qid, label), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best DESC, label) AS place FROM b) SELECT qid, label, row_id, best FROM r WHERE place <= 10")
def best_per_file(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The best 5k chunks, the best of each file among them, the best k files."""
    p = best_rows(spark, sf_dir, 5 * k)
    b = p.groupBy("qid", "label").agg(F.round(F.max("score"), 4).alias("best"), F.min_by("row_id", "rn").alias("row_id"))
    return b.withColumn("place", F.row_number().over(by("qid").orderBy(F.desc("best"), "label"))).where(F.col("place") <= k).select("qid", "label", "row_id", "best")


_WEIGHTED = f"""t AS (SELECT vec_id, label, {_KIND} AS kind FROM embeddings), g AS (SELECT label, count(*) FILTER (WHERE kind = 'blip') AS frames, count(*) FILTER (WHERE kind = 'stt') AS speech FROM t GROUP BY label),
    w AS (SELECT label, ([{', '.join(str(b) for b, _ in M.BUCKETS)}])[least(floor(frames::DOUBLE / (frames + speech) * 9)::INT, 8) + 1] AS bw, ([{', '.join(str(s) for _, s in M.BUCKETS)}])[least(floor(frames::DOUBLE / (frames + speech) * 9)::INT, 8) + 1] AS sw FROM g)"""


def weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their source, and each file's weights."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(_KIND).alias("kind"))
    g = t.groupBy("label").agg(F.count(F.when(F.col("kind") == "blip", 1)).alias("frames"), F.count(F.when(F.col("kind") == "stt", 1)).alias("speech"))
    return t, g.withColumn("w", M.bucket_weights(F.col("frames"), F.col("speech"))).select("label", "frames", "speech", "w.caption", "w.speech")


@query("oi11_modality_weights", raw(f"WITH {_WEIGHTED} SELECT label, bw::DOUBLE AS caption, sw::DOUBLE AS speech FROM w"))
def modality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("label", F.expr(_KIND).alias("kind"))
    g = t.groupBy("label").agg(F.count(F.when(F.col("kind") == "blip", 1)).alias("frames"), F.count(F.when(F.col("kind") == "stt", 1)).alias("speech"))
    return g.select("label", M.bucket_weights(F.col("frames"), F.col("speech")).alias("w")).select("label", "w.caption", "w.speech")


@query(
    "od2_two_source_score",
    raw(
        f"""WITH {AXES_SQL}, {SCORED_SQL}, {_WEIGHTED}, p AS (SELECT s.qid, s.row_id, s.label, greatest(0, round(s.score, 6)) AS sim, t.kind, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.row_id) AS rn FROM scored s JOIN t ON t.vec_id = s.row_id),
        f AS (SELECT qid, label, coalesce(max(sim) FILTER (WHERE kind = 'blip'), 0) AS b, coalesce(max(sim) FILTER (WHERE kind = 'stt'), 0) AS s, arg_min(row_id, rn) FILTER (WHERE kind = 'blip') AS br, arg_min(row_id, rn) FILTER (WHERE kind = 'stt') AS sr FROM p WHERE rn <= 300 GROUP BY qid, label),
        r AS (SELECT f.qid, f.label, round(bw * b + sw * s, 4) AS similarity, CASE WHEN b >= s THEN br ELSE sr END AS snippet_row, row_number() OVER (PARTITION BY f.qid ORDER BY round(bw * b + sw * s, 4) DESC, f.label) AS place FROM f JOIN w USING (label)) SELECT qid, label, similarity::DOUBLE AS similarity, snippet_row FROM r WHERE place <= 10"""
    ),
)
def two_source(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Captions' and speech's best similarity of each file among the best max(30k, 200) chunks, by the file's weights; the snippet is the better one's."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.expr(_KIND).alias("kind"))
    p = best_rows(spark, sf_dir, max(30 * k, 200)).join(t, "row_id").withColumn("sim", F.greatest(F.lit(0.0), F.round("score", 6)))
    own = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    best = lambda kind: F.coalesce(F.max(own(kind, "sim")), F.lit(0.0))
    f = p.groupBy("qid", "label").agg(best("blip").alias("b"), best("stt").alias("s"), F.min_by("row_id", own("blip", "rn")).alias("br"), F.min_by("row_id", own("stt", "rn")).alias("sr"))
    f = f.join(modality_weights(spark, sf_dir), "label").withColumn("similarity", F.round(F.col("caption") * F.col("b") + F.col("speech") * F.col("s"), 4))
    return f.withColumn("place", F.row_number().over(by("qid").orderBy(F.desc("similarity"), "label"))).where(F.col("place") <= k).select("qid", "label", "similarity", F.when(F.col("b") >= F.col("s"), F.col("br")).otherwise(F.col("sr")).alias("snippet_row"))


@query("od4_best_lexical_per_file", f"WITH {AXES_SQL}, {CHANNELS_SQL} SELECT qid, label, round(max(asf), 6) AS asf, round(max(lexical), 6) AS sparse FROM ch GROUP BY qid, label")
def best_lexical_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = best_rows(spark, sf_dir, 1, group=F.col("label"))
    return r.select("qid", "label", F.round("hi_asf", 6).alias("asf"), F.round("hi_lexical", 6).alias("sparse"))


TITLE = ["talk", "_3", "nothing"]
_PHI_SQL = S.GAUSSIAN_SQL.format(z="z")


@query(
    "ob11_av_cap",
    raw(
        f"""WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, row_id) AS rn FROM scored), f AS (SELECT qid, label, avg(score) AS d FROM r WHERE rn <= 3 GROUP BY qid, label), t AS (SELECT conv_id AS label, max(length(trim(stt_text)) + length(trim(caption))) > 0 AS has_text FROM {{segments}} GROUP BY conv_id),
        g AS (SELECT *, avg(d) OVER (PARTITION BY qid) AS mu, greatest(stddev_pop(d) OVER (PARTITION BY qid), 0.01) AS sd FROM f), z AS (SELECT g.qid, g.label, (d - mu) / sd AS z, coalesce(has_text, false) AS has_text FROM g LEFT JOIN t USING (label)), c AS (SELECT *, {_PHI_SQL} AS conf FROM z),
        h AS (SELECT *, (contains('talk_' || label || '.mp4', 'talk')::INT + contains('talk_' || label || '.mp4', '_3')::INT) AS hits FROM c)
        SELECT qid, label, round(z * 0.60 + 1.5 * hits, 5) AS final, round(CASE WHEN z < 0.3 AND NOT has_text THEN least(greatest(conf, 0.60), 0.40) ELSE greatest(conf, 0.60) END, 5) AS confidence, z < 0.3 AND NOT has_text AS low FROM h"""
    ),
)
def av_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording's confidence over the query's files: names that hold the request's words give 1.5 each and .60 at least, weak ones without any text .40 at most."""
    r = best_rows(spark, sf_dir, 3, group=F.col("label")).groupBy("qid", "label").agg(F.avg("score").alias("d"))
    stats = r.groupBy("qid").agg(F.avg("d").alias("mu"), F.greatest(F.stddev_pop("d"), F.lit(0.01)).alias("sd"))
    text = view(spark, sf_dir, "segments").groupBy(F.col("conv_id").alias("label")).agg((F.max(F.length(F.trim("stt_text")) + F.length(F.trim("caption"))) > 0).alias("has_text"))
    z = r.join(stats, "qid").join(text, "label", "left").withColumn("z", (F.col("d") - F.col("mu")) / F.col("sd"))
    name = F.concat(F.lit("talk_"), F.col("label").cast("string"), F.lit(".mp4"))
    hits = sum((F.contains(name, F.lit(t)).cast("int") for t in TITLE), F.lit(0))
    conf = S.title_floor(S.gaussian_cdf(F.col("z")), hits)
    weak = (F.col("z") < 0.3) & ~F.coalesce("has_text", F.lit(False))
    return z.select("qid", "label", F.round(S.title_boost(F.col("z") * 0.60, hits), 5).alias("final"), F.round(F.when(weak, F.least(conf, F.lit(0.40))).otherwise(conf), 5).alias("confidence"), weak.alias("low"))


_RESULTS = "r AS (SELECT qid, row_id, (ARRAY['image', 'doc', 'video', 'audio', 'bgm'])[label % 5 + 1] AS type, greatest(0, least(1, score * 2)) AS conf, rn, lex * 12 - 3 AS logit FROM (SELECT s.qid, s.row_id, s.label, s.score, c.lexical AS lex, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.row_id) AS rn FROM scored s JOIN ch c ON c.qid = s.qid AND c.row_id = s.row_id) WHERE rn <= 80)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's best 80 rows with a type, a confidence and the reranker's logit (the second axis stands for the model's)."""
    c = best_rows(spark, sf_dir, 80)
    kinds = F.array(*map(F.lit, ["image", "doc", "video", "audio", "bgm"]))
    return c.select("qid", "row_id", kinds[F.col("label") % 5].alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * 2)).alias("conf"), "rn", (F.col("lexical") * 12 - 3).alias("logit"))


@query("ob14_rerank_floor", f"WITH {AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, {_RESULTS} SELECT qid, row_id, type FROM r WHERE type IN ('video', 'audio', 'bgm') OR logit >= -5")
def rerank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).where("type IN ('video', 'audio', 'bgm') OR logit >= -5").select("qid", "row_id", "type")


@query("oi7_rerank_discount", f"WITH {AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, {_RESULTS} SELECT qid, row_id, round(CASE WHEN rn <= 50 AND type NOT IN ('video', 'audio', 'bgm') AND logit < -3 THEN conf * 0.5 ELSE conf END, 5) AS conf FROM r")
def rerank_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the confidence where the reranker says no, within the head that it saw; recordings are exempt."""
    r = results(spark, sf_dir)
    return r.select("qid", "row_id", F.round(S.rerank_discount(F.col("conf"), F.col("logit"), F.col("type").isin("video", "audio", "bgm") | (F.col("rn") > 50)), 5).alias("conf"))


@query("oi6_domain_caps", f"WITH {AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, {_RESULTS} SELECT qid, row_id, round(CASE WHEN type = 'bgm' THEN least(conf, 0.75) ELSE conf END, 5) AS mixed, round(CASE WHEN type = 'bgm' THEN least(conf, 0.85) ELSE conf END, 5) AS own FROM r")
def domain_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Music's confidence at most .75 among other domains, .85 in its own search."""
    r, music = results(spark, sf_dir), F.col("type") == "bgm"
    cap = lambda c: F.round(F.when(music, F.least("conf", F.lit(c))).otherwise(F.col("conf")), 5)
    return r.select("qid", "row_id", cap(0.75).alias("mixed"), cap(0.85).alias("own"))


@query("of6_rerank_head", f"WITH {AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, {_RESULTS} SELECT qid, row_id, (row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rn <= 50 THEN 0 ELSE 1 END, CASE WHEN rn <= 50 THEN round(-logit, 9) END, rn))::INT AS place FROM r")
def rerank_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 by logit, equal ones as they were; the tail keeps its order."""
    head = F.col("rn") <= 50
    return results(spark, sf_dir).select("qid", "row_id", F.row_number().over(by("qid").orderBy(F.when(head, 0).otherwise(1), F.when(head, F.round(-F.col("logit"), 9)).asc_nulls_last(), "rn")).alias("place"))


@query("oo15_rerank_sort", f"WITH {AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, {_RESULTS} SELECT qid, row_id, (row_number() OVER (PARTITION BY qid ORDER BY round(-logit, 9), rn))::INT AS place FROM r")
def rerank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("qid", "row_id", F.row_number().over(by("qid").orderBy(F.round(-F.col("logit"), 9), "rn")).alias("place"))


@query("of4_flat_quota", f"WITH {AXES_SQL}, {CHANNELS_SQL}, {SCORED_SQL}, {_RESULTS}, o AS (SELECT *, list_position(['doc', 'image', 'video', 'audio', 'bgm'], type) AS g, list_position(['image', 'doc', 'video', 'audio', 'bgm'], type) AS x, row_number() OVER (PARTITION BY qid, type ORDER BY conf DESC, rn) AS t FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN t <= 5 THEN 0 ELSE 1 END, CASE WHEN t <= 5 THEN g END, CASE WHEN t <= 5 THEN t END, round(conf * CASE WHEN type IN ('image', 'doc') THEN 1.0 ELSE 0.75 END, 12) DESC, x, t) AS place FROM o) SELECT qid, row_id, place::INT AS place FROM q WHERE place <= 40")
def flat_quota(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The best k // 4 of each type, type by type, then the rest by weighted confidence; 2k in all."""
    at = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("type"))
    r = results(spark, sf_dir).withColumn("t", F.row_number().over(by("qid", "type").orderBy(F.desc("conf"), "rn")))
    sure = F.col("t") <= max(1, k // 4)
    w = F.round(F.col("conf") * F.when(F.col("type").isin("image", "doc"), 1.0).otherwise(0.75), 12)
    order = [F.when(sure, 0).otherwise(1), F.when(sure, at(["doc", "image", "video", "audio", "bgm"])).asc_nulls_last(), F.when(sure, F.col("t")).asc_nulls_last(), w.desc(), at(["image", "doc", "video", "audio", "bgm"]), "t"]
    return r.withColumn("place", F.row_number().over(by("qid").orderBy(*order))).where(F.col("place") <= 2 * k).select("qid", "row_id", "place")


@query("oe9_top_gap", f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) SELECT qid, round(max(score) - avg(score), 6) AS gap FROM r WHERE rn <= 3 GROUP BY qid")
def top_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best lies above the mean of the best three."""
    r = best_rows(spark, sf_dir, 3)
    return r.groupBy("qid").agg(F.round(F.max("score") - F.avg("score"), 6).alias("gap"))


@query("oo1_merge_types", f"WITH {AXES_SQL}, {SCORED_SQL}, u AS (SELECT qid, label % 7 AS path, label % 3 AS type, max(score) AS s FROM scored GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid, type ORDER BY s DESC, path) AS rn FROM u), m AS (SELECT qid, path, max(s) AS s FROM k WHERE rn <= 5 GROUP BY qid, path) SELECT qid, path, round(s, 6) AS similarity, (row_number() OVER (PARTITION BY qid ORDER BY s DESC, path))::INT AS place FROM m")
def merge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five paths of each type; a path in several counts once, with its best similarity."""
    u = best_rows(spark, sf_dir, 1, group=F.col("label")).groupBy("qid", (F.col("label") % 7).alias("path"), (F.col("label") % 3).alias("type")).agg(F.max("score").alias("s"))
    k = u.withColumn("rn", F.row_number().over(by("qid", "type").orderBy(F.desc("s"), "path"))).where("rn <= 5").groupBy("qid", "path").agg(F.max("s").alias("s"))
    return k.select("qid", "path", F.round("s", 6).alias("similarity"), F.row_number().over(by("qid").orderBy(F.desc("s"), "path")).alias("place"))


# tracks

MOODS = {"calm": ["slow", "calm"], "upbeat": ["fast", "upbeat"], "melodic": ["melodic"], "loud": ["loud"]}
REQUEST = "CASE CAST(qid % 500 AS INT) WHEN 0 THEN 'artist: artist3' WHEN 100 THEN 'calm slow melodic harmonic' WHEN 200 THEN 'upbeat energetic loud' WHEN 300 THEN '''artist7'' 노래' ELSE 'artist5' END"
_TAGS = "list_filter([CASE WHEN tempo < 75 THEN 'slow' WHEN tempo < 110 THEN 'medium-tempo' ELSE 'fast' END, CASE WHEN centroid < 1500 THEN 'dark-timbre' WHEN centroid < 3500 THEN 'warm-timbre' ELSE 'bright-timbre' END, CASE WHEN ratio > 5 THEN 'melodic' WHEN ratio < 0.5 THEN 'rhythmic' END, CASE WHEN loud < 0.02 THEN 'quiet' WHEN loud > 0.15 THEN 'loud' END, CASE WHEN zcr > 0.12 THEN 'noisy' END, CASE WHEN seconds < 30 THEN 'short-clip' WHEN seconds > 240 THEN 'long-track' END], lambda x: x IS NOT NULL)"
_TEXT = "concat_ws(' ', CASE WHEN tempo < 95 THEN 'slow tempo calm 느린 잔잔한 조용한' WHEN tempo < 125 THEN 'moderate tempo mid 중간 템포' ELSE 'fast tempo upbeat 빠른 활기찬 신나는' END, CASE WHEN centroid < 1800 THEN 'dark warm low spectral 어두운 낮은 저음' WHEN centroid < 3500 THEN 'balanced neutral 중성 균형' ELSE 'bright airy high spectral 밝은 화사한 고음' END, CASE WHEN zcr > 0.12 THEN 'noisy percussive 타격감 드럼' ELSE 'smooth harmonic 부드러운 하모닉' END, CASE WHEN ratio > 2 THEN 'harmonic melodic 선율 위주 멜로디' WHEN ratio < 0.8 THEN 'rhythmic percussive 리듬 위주 비트' ELSE 'mixed harmonic percussive 혼합 밸런스' END, CASE WHEN loud < 0.03 THEN 'quiet soft 조용 작은 볼륨' WHEN loud < 0.1 THEN 'medium loudness 중간 볼륨' ELSE 'loud energetic 강한 에너지 큰 볼륨' END, 'music audio track 음악', CASE WHEN vocal > 1e-6 THEN concat(CASE WHEN vocal_centroid < 2000 THEN 'vocal warm chesty 따뜻한 보컬 낮은 목소리' WHEN vocal_centroid < 3800 THEN 'vocal balanced natural 중성 보컬 자연스러운' ELSE 'vocal bright airy 밝은 고음 보컬' END, CASE WHEN vocal_high > 0.35 THEN ' breathy airy 쉰 목소리 공기감' ELSE '' END) ELSE 'instrumental 반주 보컬 없음' END)"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tracks")


def _c(*names: str) -> list[F.Column]:
    return [F.col(n) for n in names]


@query("oi12_feature_tags", raw(f"WITH t AS {{tracks}}, u AS (SELECT *, lambda_free FROM (SELECT *, 1 AS lambda_free FROM t)) SELECT vec_id, array_to_string({_TAGS}, ',') AS tags, round(least(1, greatest(0, loud * 12)), 6) AS energy, round(least(1, greatest(0, centroid / 6000)), 6) AS brightness, round(least(1, greatest(0, (tempo - 60) / 120)), 6) AS tempo_norm, round(least(1, greatest(0, ln(1 + ratio) / 3)), 6) AS harmonic, round(least(1, greatest(0, vocal / (loud + 1e-9) / 3)), 6) AS prominence FROM u"))
def feature_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("mood", M.mood(*_c("tempo", "centroid", "loud", "ratio"))).withColumn("voice", M.voice(*_c("vocal_centroid", "vocal", "vocal_high", "loud")))
    r = lambda c: F.round(c, 6).alias(c.split(".")[1])
    return t.select("vec_id", F.array_join(M.tags(*_c("tempo", "centroid", "ratio", "loud", "zcr", "seconds")), ",").alias("tags"), r("mood.energy"), r("mood.brightness"), r("mood.tempo_norm"), r("mood.harmonic"), r("voice.prominence"))


@query("oo16_track_text", raw(f"SELECT vec_id, {_TEXT} AS text FROM {{tracks}}"))
def track_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("vec_id", M.description(*_c("tempo", "centroid", "zcr", "ratio", "loud", "vocal", "vocal_centroid", "vocal_high")).alias("text"))


@query("oo17_feature_vector", raw("WITH t AS {tracks}, p AS (SELECT vec_id, list_concat([tempo / 200, centroid / 8000, centroid_sd / 4000, rolloff / 20000, zcr, ln(1 + ratio) / 5, loud * 10, loud_sd * 10], list_concat(list_transform(embedding[9:28], lambda x: x::DOUBLE / 100), list_concat(list_transform(embedding[29:48], lambda x: x::DOUBLE / 100), list_transform(embedding[49:60], lambda x: x::DOUBLE)))) AS v FROM t) SELECT vec_id, unnest(range(60))::INT AS pos, round(unnest(v), 6) + 0.0 AS v FROM p"))
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.packed(*_c("tempo", "centroid", "centroid_sd", "rolloff", "zcr", "ratio", "loud", "loud_sd"), F.slice("embedding", 9, 20), F.slice("embedding", 29, 20), F.slice("embedding", 49, 12))
    return tracks(spark, sf_dir).select("vec_id", F.posexplode(v).alias("pos", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query("oo18_track_vectors", raw("SELECT t.vec_id, CASE WHEN n.doc_id IS NOT NULL THEN 'new' WHEN o.doc_id IS NOT NULL THEN 'kept' ELSE 'missing' END AS source, round(CASE WHEN n.doc_id IS NOT NULL THEN -element_at(t.embedding, 1)::DOUBLE WHEN o.doc_id IS NOT NULL THEN element_at(t.embedding, 1)::DOUBLE ELSE 0 END, 6) AS first FROM {embeddings} t LEFT JOIN (SELECT doc_id FROM {labels} WHERE toxic = 1) n ON n.doc_id = t.vec_id LEFT JOIN {documents} o ON o.doc_id = t.vec_id"))
def track_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector a track by its name: a new one, else the stored one, else zeros."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    new = t.join(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", F.transform("embedding", lambda x: -x).alias("n"))
    old = t.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", F.col("embedding").alias("o"))
    m = t.select("vec_id", F.size("embedding").alias("d")).join(new, "vec_id", "left").join(old, "vec_id", "left")
    source = F.when(F.col("n").isNotNull(), "new").when(F.col("o").isNotNull(), "kept").otherwise("missing")
    return m.select("vec_id", source.alias("source"), F.round(F.coalesce("n", "o", F.array_repeat(F.lit(0.0).cast("float"), F.col("d")))[0].cast("double"), 6).alias("first"))


_FUSED_SQL = f"""ch2 AS (SELECT qid, row_id, dense, lexical, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, row_id) AS a, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, row_id) AS b FROM ch), x AS (SELECT qid, row_id, dense FROM ch2 WHERE a <= 40), y AS (SELECT qid, row_id, lexical FROM ch2 WHERE b <= 40),
  j AS (SELECT qid, row_id, 0.55 * coalesce(dense, 0) + 0.45 * coalesce(lexical, 0) AS base FROM x FULL JOIN y USING (qid, row_id)), k AS (SELECT j.*, {REQUEST} AS request, t.label, t.filename, {_TAGS} AS tags, lower({_TEXT}) AS text FROM j JOIN {{tracks}} t ON t.vec_id = j.row_id),
  h AS (SELECT *, CASE CAST(qid % 500 AS INT) WHEN 0 THEN 'artist3' WHEN 100 THEN 'calm slow melodic harmonic' WHEN 200 THEN 'upbeat energetic loud' WHEN 300 THEN '7' ELSE '5' END AS artist FROM k),
  s AS (SELECT *, CASE WHEN contains(lower(filename), artist) THEN 0.30 ELSE 0 END + CASE WHEN qid % 500 = 100 THEN 0.05 * (len(list_filter(tags, lambda t: contains(t, 'slow') OR contains(t, 'calm'))) > 0)::INT + 0.05 * list_contains(tags, 'melodic')::INT WHEN qid % 500 = 200 THEN 0.05 * list_contains(tags, 'fast')::INT + 0.05 * list_contains(tags, 'loud')::INT ELSE 0 END
    + least(0.10, 0.025 * CASE CAST(qid % 500 AS INT) WHEN 100 THEN contains(text, 'calm')::INT + contains(text, 'slow')::INT + contains(text, 'melodic')::INT + contains(text, 'harmonic')::INT WHEN 200 THEN contains(text, 'upbeat')::INT + contains(text, 'energetic')::INT + contains(text, 'loud')::INT ELSE 0 END) AS boost FROM h),
  r AS (SELECT *, base + boost AS fused, row_number() OVER (PARTITION BY qid ORDER BY round(base + boost, 9) DESC, row_id) AS rank FROM s)"""


def fused_tracks(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Candidates of both channels with their boosts, ranked: (qid, row_id, fused, rank)."""
    side = lambda axis, c: best_rows(spark, sf_dir, max(4 * k, 40), channel(axis)).select("qid", "row_id", c)
    both = side(0, "dense").join(side(1, "lexical"), ["qid", "row_id"], "full").withColumn("base", S.music_fusion(F.col("dense"), F.col("lexical"), F.lit(True)))
    t = tracks(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "filename", M.artist_title(F.col("filename")).alias("at"), M.tags(*_c("tempo", "centroid", "ratio", "loud", "zcr", "seconds")).alias("tags"), M.description(*_c("tempo", "centroid", "zcr", "ratio", "loud", "vocal", "vocal_centroid", "vocal_high")).alias("text"))
    j = both.join(t, "row_id").withColumn("request", F.expr(REQUEST)).withColumn("h", Q.music_hints(F.col("request"), MOODS))
    boost = M.boosts(F.col("h.artist"), F.col("h.title"), F.col("h.broad"), F.col("h.moods"), F.col("filename"), F.col("at.artist"), F.col("at.title"), F.col("tags"), MOODS) + M.description_boost(F.col("request"), F.col("text"))
    return j.withColumn("boost", boost).withColumn("fused", F.col("base") + F.col("boost")).withColumn("rank", F.row_number().over(by("qid").orderBy(F.round("fused", 9).desc(), "row_id")))


@query("oi10_music_fusion", raw(f"WITH {AXES_SQL}, {CHANNELS_SQL}, {_FUSED_SQL} SELECT qid, row_id, round(fused, 6)::DOUBLE AS fused, round(boost, 6)::DOUBLE AS boost, rank::INT AS rank FROM r WHERE rank <= 10"))
def music_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """.55 audio and .45 text, hints and words of the description added, the best ten."""
    return fused_tracks(spark, sf_dir).where("rank <= 10").select("qid", "row_id", F.round("fused", 6).alias("fused"), F.round("boost", 6).alias("boost"), "rank")


@query("oh14_clean_name", raw("SELECT vec_id, filename, concat('artist', label) AS artist, concat('song ', vec_id) AS title, regexp_replace(filename, '[.]mp3$', '') AS clean FROM {tracks}"))
def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.functions import text as X

    return tracks(spark, sf_dir).select("vec_id", "filename", M.artist_title(F.col("filename")).alias("a"), X.title_of(F.col("filename")).alias("clean")).select("vec_id", "filename", "a.artist", "a.title", "clean")


@query("om12_music_calibration", f"WITH {AXES_SQL}, {CHANNELS_SQL}, n AS (SELECT avg(dense) AS mu, stddev_pop(dense) AS sd, quantile_cont(dense, 0.95) AS p95, count(*) AS n FROM ch WHERE qid % 200 = 0), p AS (SELECT avg(m) AS mu_pos, stddev_pop(m) AS sd_pos FROM (SELECT qid, max(dense) AS m FROM ch WHERE qid % 200 <> 0 GROUP BY qid)) SELECT round(mu, 6) AS mu, round(sd, 6) AS sd, round(p95, 6) AS threshold, round(mu_pos, 6) AS mu_pos, round(sd_pos, 6) AS sd_pos, round((mu_pos - mu) / greatest(sd, 1e-6), 5) AS separation, n FROM n, p")
def music_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null requests (every second of the query set) over all tracks; how far the others' best lies above them. Sums and counts leave a task, no pairs."""
    each = best_rows(spark, sf_dir, 1, channel(0)).select("qid", "score", "n", "mu", "sd")
    null, square = each.where("qid % 200 = 0"), F.col("n") * (F.col("sd") * F.col("sd") + F.col("mu") * F.col("mu"))
    null = null.agg((F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mu"), (F.sum(square) / F.sum("n")).alias("sq"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    null = null.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mu") * F.col("mu"))))
    pos = each.where("qid % 200 != 0").agg(F.avg("score").alias("mu_pos"), F.stddev_pop("score").alias("sd_pos"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    asked = [AxisSearch(ids[ids % 200 == 0], vectors[ids % 200 == 0]) for ids, vectors in asked_in_parts(spark, sf_dir)]
    p95 = quantile(asked, rows, 0.95, channel(0))
    r = lambda c: F.round(c, 6).alias(c)
    return null.crossJoin(pos).select(r("mu"), r("sd"), F.round(F.lit(p95).cast("double"), 6).alias("threshold"), r("mu_pos"), r("sd_pos"), F.round((F.col("mu_pos") - F.col("mu")) / F.greatest("sd", F.lit(1e-6)), 5).alias("separation"), "n")


# samples, grounding, rounding


@query("oi15_voice_activity", "WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE * 0.02 AS x, unnest(range(64)) AS i FROM embeddings), w AS (SELECT vec_id, i // 8 AS w, sqrt(avg(x * x)) AS rms FROM s GROUP BY vec_id, i // 8) SELECT vec_id, round(avg(CASE WHEN rms > 0.0025 THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN rms > 0.0025 THEN 1.0 ELSE 0.0 END) >= 0.5 AS voice FROM w GROUP BY vec_id")
def voice_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of loud windows of eight samples each (a vector's components as samples), and whether that is voice."""
    samples = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 0.02).alias("x"))
    r = samples.select("vec_id", S.loud_share(F.col("x"), 8, 0.0025).alias("ratio"))
    return r.select("vec_id", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= 0.5).alias("voice"))


_ASKS = "CASE CAST(qid % 400 AS INT) WHEN 0 THEN '여권 사본' WHEN 100 THEN '주민번호 요약' WHEN 200 THEN '문서 요약' ELSE 'hello' END"


@query(
    "oi16_grounding",
    f"WITH {AXES_SQL}, {SCORED_SQL}, r AS (SELECT qid, max(score) AS sim FROM scored WHERE qid <> row_id GROUP BY qid), a AS (SELECT *, {_ASKS} AS q FROM r) SELECT qid, round(sim, 6) AS sim, CASE q WHEN '여권 사본' THEN 0.05 WHEN '주민번호 요약' THEN 0.05 WHEN '문서 요약' THEN 0.07 ELSE 0.15 END::DOUBLE AS threshold, sim >= CASE q WHEN '여권 사본' THEN 0.05 WHEN '주민번호 요약' THEN 0.05 WHEN '문서 요약' THEN 0.07 ELSE 0.15 END AS grounded FROM a",
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best context is near enough to the request: the bound is lower for summaries and for words of documents of identity, .05 at least."""
    r = best_rows(spark, sf_dir, 1, own=False).select("qid", F.col("score").alias("sim")).withColumn("q", F.expr(_ASKS))
    t = S.grounding_threshold(F.col("q"))
    return r.select("qid", F.round("sim", 6).alias("sim"), F.round(t, 6).alias("threshold"), (F.col("sim") >= t).alias("grounded"))


@query("oi19_rounding", "SELECT o_orderkey, round_even(o_orderkey::DOUBLE / 8, 2) AS rounded FROM orders")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to the even neighbour, as everywhere in the engine's figures."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bround(F.col("o_orderkey").cast("double") / 8, 2).alias("rounded"))


# sessions

_POINTS = raw(
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {{session_events}}), k AS (SELECT unnest([{', '.join(f"'{x}'" for x in sessions.NAMES)}]) AS name), f AS (SELECT user_id, name, min(n) AS n FROM e, k WHERE contains(user_query, name) GROUP BY user_id, name),
    p AS (SELECT e.*, (SELECT count(*) FROM e x WHERE x.user_id = e.user_id AND x.n < e.n AND x.ts >= e.ts - INTERVAL 30 SECOND)::INT AS before, CASE WHEN pii_type IS NOT NULL AND row_number() OVER (PARTITION BY user_id, pii_type ORDER BY n) > 1 THEN 1 ELSE 0 END AS repeats, (SELECT count(*) FROM f WHERE f.user_id = e.user_id AND f.n <= e.n)::INT AS institutions FROM e),
    q AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in sessions.EVENTS.items())} ELSE 0 END + CASE WHEN before >= 3 THEN 3 ELSE 0 END + 2 * repeats + CASE WHEN institutions >= 2 AND user_query <> '' THEN 4 ELSE 0 END AS points FROM p)"""
)


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "session_events")
    return e.withColumn("pii_types", F.array_compact(F.array("pii_type")))


@query("oe12_rapid_repeat", f"{_POINTS} SELECT event_id, before, before >= 3 AS rapid FROM q")
def rapid_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.points(session_events(spark, sf_dir), "user_id").select("event_id", "before", (F.col("before") >= sessions.REQUESTS).alias("rapid"))


@query("oe13_repeat_type", f"{_POINTS} SELECT event_id, repeats FROM q")
def repeat_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.points(session_events(spark, sf_dir), "user_id").select("event_id", "repeats")


@query("oe14_running_distinct", f"{_POINTS} SELECT event_id, institutions, institutions >= 2 AND user_query <> '' AS many FROM q")
def running_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions that a session has named so far: counted where each comes first, so no event carries a set."""
    return sessions.points(session_events(spark, sf_dir), "user_id").select("event_id", "institutions", ((F.col("institutions") >= 2) & (F.col("user_query") != "")).alias("many"))


_RISK_SQL = f"{_POINTS}, s AS (SELECT user_id, n, sum(points) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM q) SELECT user_id, coalesce(min(s) FILTER (WHERE s >= 15), max(s))::BIGINT AS score, coalesce(max(s >= 8 AND s < 15), false) AS warned, max(s) >= 15 AS blocked FROM s GROUP BY user_id"


@query("ok4_session_risk", _RISK_SQL)
def session_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_risk(session_events(spark, sf_dir), "user_id")


@contextmanager
def on_disk_state(spark: SparkSession) -> Iterator[None]:
    """A stream that starts within keeps its state in RocksDB, with bounded memory, unless a store has been chosen: all ids wait at once here."""
    store = "spark.sql.streaming.stateStore"
    chosen = {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.boundedMemoryUsage": "true"}
    before = {k: spark.conf.get(k, None) for k in chosen}
    mine = {} if before[f"{store}.providerClass"] else {k: v for k, v in chosen.items() if before[k] is None}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


@query("ok4_session_risk_event_time", _RISK_SQL)
def session_risk_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session risk of a stream of all events, which come out of order and again, by the watermark; the last row of each session.

    The events are dealt over files by a hash of their id, some twice, so every trigger has all times; the
    delay covers them. One event behind all others settles what waits.
    """
    where = workdir.fresh(spark, "sessions")
    e = session_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "pii_types", "user_query")
    deal = F.pmod(F.xxhash64("event_id"), F.lit(3))
    e.withColumn("n", deal).union(e.where("event_id % 10 = 0").withColumn("n", (deal + 1) % 3)).write.partitionBy("n").parquet(f"{where}/in")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    span = 60 + (int((last - first).total_seconds()) if last else 0)
    end = e.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(2 * span))).alias("ts"))
    end = end.select(F.lit(-1).alias("user_id"), F.lit(-1).alias("event_id"), "ts", F.lit("view").alias("event_type"), F.array().alias("pii_types"), F.lit("").alias("user_query"))
    end.select(*[F.col(f.name).cast(f.dataType) for f in e.schema], F.lit(3).alias("n")).write.mode("append").partitionBy("n").parquet(f"{where}/in")
    third = -(-len(spark.read.schema(e.schema).parquet(f"{where}/in").inputFiles()) // 3)
    files = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", third).parquet(f"{where}/in")
    risk = sessions.session_risk_stream(files, "user_id", f"{span} seconds").writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint")
    risk = risk.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{where}/out/batch={i}")).trigger(availableNow=True)
    with on_disk_state(spark):
        stream = risk.start()
    stream.awaitTermination()
    every = spark.read.parquet(f"{where}/out").where("session <> '-1'")
    return every.groupBy("session").agg(F.max_by(F.struct("score", "warned", "blocked"), "batch").alias("r")).select(F.col("session").cast("long").alias("user_id"), "r.*")


_GAP = "SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events"


@query("ok4_session_windows", f"WITH g AS ({_GAP}), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n_events FROM s GROUP BY user_id, n")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each user's events with six hours or less between neighbours."""
    return sessions.session_windows(table(spark, sf_dir, "events"), "user_id", "6 hours").withColumnRenamed("session", "user_id")
