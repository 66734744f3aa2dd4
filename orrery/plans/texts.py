"""Text cleaning, captions, names, n-grams, lexical assets, summaries (families A, B, D, H, I, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scoring as S
from orrery.functions import text as X
from orrery.operators import registers as R
from orrery.operators import requests as Q
from orrery.operators.ordered import numbered
from orrery.plans.lexical import _STOP
from orrery.plans.registry import query, raw, table, view
from orrery.sources import workdir

_TOKENS = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, '[가-힣]{{2,}}|[A-Za-z][A-Za-z0-9\\-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))"


@query("oa2_term_table", f"SELECT doc_id, t AS term, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest({_TOKENS('text')}) AS t FROM documents) GROUP BY doc_id, t")
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' terms in long form, written once and read back: what lexical channels start from."""
    path = workdir.fresh(spark, "terms")
    X.term_counts(table(spark, sf_dir, "documents")).write.parquet(path)
    return spark.read.parquet(path)


#: Most tokens and greatest share of documents of each domain's vocabulary.
ASSETS = {"image": (8_000, 0.5), "Doc": (25_000, 0.4), "Movie": (25_000, 0.5), "Rec": (15_000, 0.5)}
_ASSET_ROWS = ", ".join(f"('{d}', {k}, {r})" for d, (k, r) in ASSETS.items())


@query(
    "oo2_lexical_assets",
    raw(
        f"""WITH a(domain, most, share) AS (VALUES {_ASSET_ROWS}), f AS {{files}}, n AS (SELECT domain, count(*) AS n FROM f GROUP BY domain), t AS (SELECT domain, doc_id, unnest(list_distinct({_TOKENS('text')})) AS token FROM f), d AS (SELECT domain, token, count(*) AS df FROM t GROUP BY domain, token),
        v AS (SELECT d.domain, token, df, ln((n.n + 1.0) / (df + 1)) + 1 AS idf, a.most FROM d JOIN n USING (domain) JOIN a USING (domain) WHERE df >= 2 AND df <= floor(n.n * a.share)) SELECT domain, token, df, round(idf, 4) AS idf FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY df, token) AS rn FROM v) WHERE rn <= most"""
    ),
)
def lexical_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each domain's vocabulary: tokens of two documents or more, not of too many, the rarest first."""
    f = view(spark, sf_dir, "files").select("domain", "doc_id", "text")
    a = spark.createDataFrame([(d, k, r) for d, (k, r) in ASSETS.items()], "domain string, most int, share double")
    n = f.groupBy("domain").agg(F.count("*").alias("n")).join(F.broadcast(a), "domain")
    df = f.select("domain", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("domain", "token").agg(F.count("*").alias("df"))
    v = df.join(F.broadcast(n), "domain").where("df >= 2 AND df <= floor(n * share)")
    v = v.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("df", "token"))).where("rn <= most")
    return v.select("domain", "token", "df", F.round(F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1, 4).alias("idf"))


@query(
    "oo5_recording_assets",
    raw(
        f"""WITH s AS (SELECT file_path, unnest(list_distinct({_TOKENS("concat(stt_text, ' ', caption)")})) AS token FROM {{segments}}), n AS (SELECT count(*) AS n FROM {{segments}}), d AS (SELECT token, count(*) AS df FROM s GROUP BY token), v AS (SELECT token, df, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM d, n WHERE df >= 2 AND df <= greatest(floor(n * 0.5), 1)) SELECT token, df, round(idf, 4) AS idf FROM (SELECT *, row_number() OVER (ORDER BY df, token) AS rn FROM v) WHERE rn <= 20000"""
    ),
)
def recording_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings' vocabulary over segments, 20,000 tokens at most."""
    s = view(spark, sf_dir, "segments").select(F.concat_ws(" ", "stt_text", "caption").alias("t"))
    n = s.agg(F.count("*").alias("n"))
    df = s.select(F.explode(F.array_distinct(X.tokens(F.col("t")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    v = df.crossJoin(F.broadcast(n)).where("df >= 2 AND df <= greatest(floor(n * 0.5D), 1)")
    return v.orderBy("df", "token").limit(20_000).select("token", "df", F.round(F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1, 4).alias("idf"))


@query("oo3_recording_text", raw("SELECT file_path, turn, md5(trim(concat_ws(' ', nullif(concat('Movie', ' ', regexp_replace(file_name, '[.]mp4$', '')), ''), CASE WHEN conv_id % 2 = 0 THEN 'synopsis of it' END, nullif(trim(stt_text), '')))) AS text FROM {segments}"))
def recording_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for a segment: folder, title, metadata where there is some (even recordings), speech."""
    s = view(spark, sf_dir, "segments")
    text = X.recording_text(F.col("file_path"), F.col("file_name"), F.when(F.col("conv_id") % 2 == 0, "synopsis of it"), F.col("stt_text"))
    return s.select("file_path", "turn", F.md5(text.cast("binary")).alias("text"))


_CAPTION = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_BODY = "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '%s), '[ \\n\\t\\r]+', ' '%s))"


@query("oo4_page_text", f"SELECT page_id, md5(CASE WHEN c = '' THEN b WHEN b = '' THEN c ELSE c || chr(10) || b END) AS text FROM (SELECT page_id, trim({_CAPTION}) AS c, {_BODY % (', ' + chr(39) + 'g' + chr(39), ', ' + chr(39) + 'g' + chr(39))} AS b FROM pages)")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's caption (its title) and, on the next line, its body without markup."""
    p = table(spark, sf_dir, "pages").select("page_id", F.trim(F.expr("regexp_extract(html, '<title>([^<]*)</title>', 1)")).alias("c"), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\n\\t\\r]+", " ")).alias("b"))
    return p.select("page_id", F.md5(F.concat_ws("\n", F.nullif("c", F.lit("")), F.nullif("b", F.lit(""))).cast("binary")).alias("text"))


_MESSY = "SELECT doc_id, concat(text, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN concat(chr(10), '中文内容中文') WHEN 1 THEN concat(chr(10), 'x.toObject( return <b>a</b>', chr(10), 'plain line') WHEN 2 THEN concat(chr(10), '한글 中文字') WHEN 3 THEN concat(chr(10), '12 . 3', chr(10), '4 · 5') WHEN 4 THEN concat(chr(10), '한a한a한a한글') ELSE '' END) AS text FROM {documents}"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each with a line that one of the filters is made for."""
    from orrery.plans.registry import sql

    return sql(spark, sf_dir, _MESSY)


_NOISE_SQL = ["\\.[a-zA-Z_$][a-zA-Z0-9_$]*\\s*\\(", "\\b(?:function|var|let|const|return|typeof)\\b", "[a-zA-Z_$][a-zA-Z0-9_$]*\\.[a-zA-Z_$][a-zA-Z0-9_$]*\\.[a-zA-Z_$]", "<[a-zA-Z][^>]{0,80}>", "\\\\u[0-9a-fA-F]{4}"]
_CN, _KO = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]", "[가-힣]"
_SWITCH = "(?:[가-힣]+[A-Za-z\\x{4E00}-\\x{9FFF}]+|[A-Za-z\\x{4E00}-\\x{9FFF}]+[가-힣]+)(?:[A-Za-z\\x{4E00}-\\x{9FFF}]+[가-힣]+|[가-힣]+[A-Za-z\\x{4E00}-\\x{9FFF}]+){2,}"


@query(
    "ob17_line_filter",
    raw(
        f"""WITH m AS ({_MESSY}), k AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda l: trim(l) = '' OR NOT (len(regexp_extract_all(l, '{_KO}')) = 0 AND len(regexp_extract_all(l, '{_CN}')) >= 3)) AS korean, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines FROM m)
        SELECT doc_id, md5(trim(array_to_string(korean, chr(10)), ' ' || chr(10))) AS kept, len(lines) = 0 OR (len(lines) <= 5 AND list_avg(list_transform(lines, lambda l: length(l))) < 30) OR len(list_filter(lines, lambda l: regexp_matches(l, '^[\\d\\s.\\-·…]+$')))::DOUBLE / len(lines) > 0.5 AS toc FROM k"""
    ),
)
def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of Chinese characters only go; whether a chunk looks like a table of contents."""
    return messy(spark, sf_dir).select("doc_id", F.md5(X.without_foreign_lines(F.col("text")).cast("binary")).alias("kept"), X.looks_like_contents(F.col("text")).alias("toc"))


@query(
    "oi14_clean_text",
    raw(
        f"""WITH m AS ({_MESSY}), l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: CASE WHEN trim(l) = '' THEN '' ELSE l END) AS ls FROM m),
        k AS (SELECT doc_id, list_filter(ls, lambda l: l = '' OR NOT ({' + '.join(f"regexp_matches(l, '{p}')::INT" for p in _NOISE_SQL)} >= 2 OR (len(regexp_extract_all(l, '{_CN}')) >= 3 AND len(regexp_extract_all(l, '{_CN}')) > len(regexp_extract_all(l, '{_KO}'))) OR regexp_matches(l, '{_SWITCH}'))) AS kept FROM l)
        SELECT doc_id, md5(trim(regexp_replace(array_to_string(kept, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS clean, len(kept)::INT AS lines FROM k"""
    ),
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted text without lines of script or markup and without garbled ones."""
    m = messy(spark, sf_dir)
    return m.select("doc_id", F.md5(X.cleaned(F.col("text")).cast("binary")).alias("clean"), F.size(X.clean_lines(F.col("text"))).alias("lines"))


_CAPTIONS = "SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('漢字', left(text, 20)) WHEN 1 THEN concat(left(text, 200), '漢') WHEN 2 THEN concat(left(text, 20), chr(1), chr(2)) ELSE left(text, 50) END AS caption FROM {documents}"
_CJK_SHARE = "len(regexp_extract_all(caption, '[\\x{4E00}-\\x{9FFF}]'))::DOUBLE / length(caption) > 0.05"
_CTRL_SHARE = "len(regexp_extract_all(caption, '[\\x{FFFD}\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}]'))::DOUBLE / length(caption) > 0.05"


@query("oo13_caption_gate", raw(f"SELECT doc_id, CASE WHEN {_CJK_SHARE} OR {_CTRL_SHARE} THEN '' ELSE caption END AS caption FROM ({_CAPTIONS})"))
def caption_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.plans.registry import sql

    return sql(spark, sf_dir, _CAPTIONS).select("doc_id", X.clean_caption(F.col("caption")).alias("caption"))


@query("ob13_corrupt_captions", raw(f"SELECT doc_id FROM ({_CAPTIONS}) WHERE caption <> '' AND NOT ({_CJK_SHARE})"))
def corrupt_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that are not full of Chinese characters."""
    from orrery.plans.registry import sql

    return sql(spark, sf_dir, _CAPTIONS).where(X.cjk_share(F.col("caption")) <= 0.05).select("doc_id")


_STUBS = "SELECT vec_id, CASE CAST(vec_id % 5 AS INT) WHEN 0 THEN concat(lpad(CAST(vec_id AS STRING), 3, '0'), '.mp4') WHEN 1 THEN concat('x-2026-4-27-wpu-', CAST(vec_id AS STRING), '-d.wav') WHEN 2 THEN '코스모스 E01.mp4' WHEN 3 THEN filename ELSE '가-1.mp3' END AS name FROM {tracks}"


@query("ob12_content_stub", raw(f"SELECT vec_id FROM ({_STUBS}) WHERE NOT regexp_full_match(regexp_replace(name, '[.][^.]*$', ''), '[0-9]+') AND regexp_matches(regexp_replace(name, '[.][^.]*$', ''), '[가-힣]{{2,}}|[a-zA-Z]{{4,}}')"))
def content_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names say something: not digits only, a Korean word of two or a Latin one of four characters."""
    from orrery.plans.registry import sql

    return sql(spark, sf_dir, _STUBS).where(X.says_something(R.stem(F.col("name")))).select("vec_id")


@query(
    "oh13_character_classes",
    raw("WITH q AS (SELECT id, concat('  ', query, CASE CAST(id % 3 AS INT) WHEN 0 THEN ' ㅋㅋ漢字 カナ!' WHEN 1 THEN ' été 9' ELSE '' END) AS s FROM {requests}), c AS (SELECT id, trim(s) AS s FROM q) SELECT id, len(regexp_extract_all(s, '\\p{Nd}'))::INT AS digit, len(regexp_extract_all(s, '[\\x{AC00}-\\x{D7AF}]'))::INT AS hangul, len(regexp_extract_all(s, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}]'))::INT AS cjk, len(regexp_extract_all(regexp_replace(s, '[\\x{AC00}-\\x{D7AF}\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{3130}-\\x{318F}]', '', 'g'), '\\p{L}'))::INT AS alpha, length(s)::INT - (digit + hangul + cjk + alpha) AS other FROM c"),
)
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = view(spark, sf_dir, "requests").select("id", F.expr("concat('  ', query, CASE CAST(id % 3 AS INT) WHEN 0 THEN ' ㅋㅋ漢字 カナ!' WHEN 1 THEN ' été 9' ELSE '' END)").alias("s"))
    return q.select("id", S.meaningful(F.col("s")).alias("c")).select("id", "c.digit", "c.hangul", "c.cjk", "c.alpha", "c.other")


_SHORT = "CASE CAST(id % 6 AS INT) WHEN 0 THEN 'ㅋㅋ!!' WHEN 1 THEN '1234' WHEN 2 THEN '꽃' WHEN 3 THEN 'a 1' WHEN 4 THEN '' ELSE query END"


@query(
    "oi5_query_caps",
    raw(f"WITH q AS (SELECT id, {_SHORT} AS q, ((id * 37) % 100) / 100.0::DOUBLE AS x FROM {{requests}}), c AS (SELECT id, x, CASE CAST(id % 6 AS INT) WHEN 0 THEN 0.30 WHEN 1 THEN 0.40 WHEN 2 THEN 0.55 WHEN 3 THEN 0.55 WHEN 4 THEN 0.30 ELSE 1.0 END AS cap, CASE WHEN x < 0.10 THEN x * 3 WHEN x < 0.25 THEN 0.30 + (x - 0.10) * 8 / 3 WHEN x < 0.40 THEN 0.70 + (x - 0.25) * 4 / 3 WHEN x < 0.60 THEN 0.90 + (x - 0.40) * 0.4 ELSE 0.98 + (x - 0.60) * 0.025 END AS y FROM q) SELECT id, round(least(cap, y), 6)::DOUBLE AS with_curve, round(least(cap, x), 6)::DOUBLE AS without FROM c"),
)
def query_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence under what its request allows, on the display curve and as it is."""
    q = view(spark, sf_dir, "requests").select("id", F.expr(_SHORT).alias("q"), (F.col("id") * 37 % 100 / 100.0).cast("double").alias("x"))
    return q.select("id", F.round(S.adjusted(F.col("x"), F.col("q")), 6).alias("with_curve"), F.round(F.least("x", S.query_cap(F.col("q"))), 6).alias("without"))


_ASK = ["report", "src1", "en"]


def _boost_sql(hay: str, each: float, whole: float) -> str:
    hits = " + ".join(f"contains(lower({hay}), '{t}')::INT" for t in _ASK)
    return f"(CASE WHEN ({hits}) > 0 THEN {each} * ({hits}) + CASE WHEN ({hits}) >= 2 THEN {whole} ELSE 0 END ELSE 0 END)::DOUBLE"


@query("oh10_token_boost", raw(f"SELECT doc_id, round({_boost_sql('rel_key', 0.05, 0.10)}, 6) AS boost FROM {{files}}"))
def token_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """.05 for each of a request's words (two of its own, one that expansion added) in a row's id, .10 more for as many as it has itself."""
    hits = sum((F.contains(F.lower("rel_key"), F.lit(t)).cast("int") for t in _ASK), F.lit(0))
    return view(spark, sf_dir, "files").select("doc_id", F.round(S.token_boost(hits, F.lit(2), 0.05, 0.10), 6).alias("boost"))


@query("oh11_av_boost", raw("SELECT conv_id, turn, round(" + _boost_sql("concat(coalesce(nullif(stt_text, ''), ''), ' ', file_name)", 0.10, 0.20).replace("'report'", "'talk'").replace("'src1'", "'_1'") + ", 6) AS boost FROM {segments}"))
def av_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a segment's speech and its file's name: .10, and .20."""
    hay = F.lower(F.concat_ws(" ", "stt_text", "file_name"))
    hits = sum((F.contains(hay, F.lit(t)).cast("int") for t in ("talk", "_1", "en")), F.lit(0))
    return view(spark, sf_dir, "segments").select("conv_id", "turn", F.round(S.token_boost(hits, F.lit(2), 0.10, 0.20), 6).alias("boost"))


@query("oh12_title_boost", raw("WITH f AS (SELECT doc_id, lower(file_name) AS n, (size % 100) / 100.0::DOUBLE AS conf FROM {files}), h AS (SELECT *, contains(n, 'report')::INT + contains(n, 'src1')::INT AS hits FROM f) SELECT doc_id, round(conf + 1.5 * hits, 6)::DOUBLE AS final, CASE WHEN hits > 0 THEN greatest(conf, 0.60) ELSE conf END::DOUBLE AS confidence FROM h"))
def title_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.5 for each of the request's own words in a file's name, and .60 confidence at least."""
    n = F.lower("file_name")
    hits = F.contains(n, F.lit("report")).cast("int") + F.contains(n, F.lit("src1")).cast("int")
    f = view(spark, sf_dir, "files").select("doc_id", (F.col("size") % 100 / 100.0).cast("double").alias("conf"), hits.alias("hits"))
    return f.select("doc_id", F.round(S.title_boost(F.col("conf"), F.col("hits")), 6).alias("final"), S.title_floor(F.col("conf"), F.col("hits")).alias("confidence"))


_NGRAM_SQL = """w AS (SELECT file_name, regexp_extract_all(stem, '[가-힣]{2,}') || regexp_extract_all(stem, '[A-Za-z]{2,}') AS w FROM (SELECT file_name, concat(stem, ' ', left(text, 40)) AS stem FROM {files})), e AS (SELECT file_name, w, unnest(range(1, len(w) + 1)) AS i FROM w),
  g AS (SELECT lower(w[i]) AS g, file_name FROM e UNION SELECT lower(w[i] || ' ' || w[i + 1]), file_name FROM e WHERE i < len(w) AND length(w[i] || ' ' || w[i + 1]) BETWEEN 4 AND 25 UNION SELECT lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), file_name FROM e WHERE i + 1 < len(w) AND length(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) BETWEEN 6 AND 35),
  c AS (SELECT g, count(*) AS files FROM g GROUP BY g HAVING count(*) BETWEEN 2 AND 50)"""


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of names that go on with the start of the document."""
    return X.name_ngrams(view(spark, sf_dir, "files").select("file_name", F.concat_ws(" ", "stem", F.substring("text", 1, 40)).alias("stem")))


@query("oh20_ngrams", raw(f"WITH {_NGRAM_SQL} SELECT g, files FROM c"))
def name_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three words of files' names that 2 to 50 files share."""
    return ngrams(spark, sf_dir)


@query("oh20_title_phrases", raw("WITH t AS (SELECT id, concat(word, ' 의장 과 ', word, ' 교수') AS t FROM {requests}), p AS (SELECT id, unnest(regexp_extract_all(t, '[가-힣]{2,4}\\s*(?:의장|대표|대통령|박사|감독|교수|장관|위원|의원|소장|회장|기자|작가)')) AS m FROM t) SELECT regexp_replace(m, '^([가-힣]{2,4}?)\\s*(의장|대표|대통령|박사|감독|교수|장관|위원|의원|소장|회장|기자|작가)$', '\\1 \\2') AS phrase, count(DISTINCT id) AS files FROM p GROUP BY 1 HAVING count(DISTINCT id) BETWEEN 2 AND 30"))
def title_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their office in speech that 2 to 30 files share."""
    t = view(spark, sf_dir, "requests").select("id", F.concat("word", F.lit(" 의장 과 "), "word", F.lit(" 교수")).alias("t"))
    return X.office_phrases(t, "id", "t")


@query("of7_systematic_sample", raw(f"WITH {_NGRAM_SQL}, n AS (SELECT greatest(1, count(*) // 20) AS step, count(*) AS n FROM c), r AS (SELECT g, files, row_number() OVER (ORDER BY files, g) - 1 AS i FROM c) SELECT g, files FROM r, n WHERE CASE WHEN n.n > 20 THEN i % step = 0 AND i // step < 20 ELSE true END"))
def systematic_sample(spark: SparkSession, sf_dir: str, target: int = 20) -> DataFrame:
    """Of the candidates, ordered by their files, every so many-th, ``target`` in all."""
    g = ngrams(spark, sf_dir)
    n = g.count()
    if n <= target:
        return g
    step = max(1, n // target)
    r = numbered(g, "files", "g", name="i")
    return r.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < target)).select("g", "files")


@query("oh24_snippet_backfill", raw("SELECT d.doc_id, md5(coalesce(nullif(trim(b.text), ''), CASE WHEN d.lang = 'en' THEN nullif(left(trim(d.text), 800), '') END, nullif(left(array_to_string(list_filter([d.source, d.lang, ''], lambda x: x <> ''), ' | '), 600), ''))) AS snippet FROM {documents} d LEFT JOIN {benchmark} b ON b.item_id = d.doc_id"))
def snippet_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit's own snippet, else its page's text (documents in English), else its caption's parts."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("own"))
    d = table(spark, sf_dir, "documents").join(b, "doc_id", "left")
    s = X.snippet_of(F.col("own"), F.when(F.col("lang") == "en", F.col("text")), F.array("source", "lang", F.lit("")))
    return d.select("doc_id", F.md5(s.cast("binary")).alias("snippet"))


FORCED = ["report", "fiscal rule", "CBAM", "통계", "und"]


@query("od9_forced_keywords", raw(f"WITH d AS (SELECT unnest(list_distinct({_TOKENS('text')})) AS token, doc_id FROM {{documents}}), v AS (SELECT token, count(*) AS df FROM d GROUP BY token HAVING count(*) >= 2 AND count(*) <= floor((SELECT count(*) FROM {{documents}}) * 0.4)) SELECT token, df, round(ln(((SELECT count(*) FROM {{documents}}) + 1.0) / (df + 1)) + 1, 4) AS idf FROM v UNION ALL SELECT k, 0, 3.5 FROM (SELECT unnest([{', '.join(repr(k.lower()) for k in FORCED)}]) AS k) WHERE k NOT IN (SELECT token FROM v)"))
def forced_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with a domain's own words: those that the bounds left out come in with no document and a middle weight."""
    from orrery.plans.lexical import vocabulary

    v = vocabulary(spark, sf_dir).withColumn("idf", F.round("idf", 4))
    k = spark.createDataFrame([(x.lower(),) for x in FORCED], "token string").join(v, "token", "left_anti")
    return v.unionByName(k.select("token", F.lit(0).cast("long").alias("df"), F.lit(3.5).alias("idf")))


@query("oh2_bounded_tokens", "SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[가-힣]{2,8}|[A-Za-z]{3,12}|[0-9]+'), lambda x: lower(x)), ' ')) AS tokens FROM documents")
def bounded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(X.bounded_tokens(F.col("text")), " ").cast("binary")).alias("tokens"))


_CTX = "SELECT c_mktsegment AS segment, c_custkey AS page, concat(CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN c_name ELSE concat('This page of the document says the following in a rather long line about ', c_name, CASE WHEN c_custkey % 4 = 0 THEN ' and more' ELSE ' 1234567890 1234567890 1234567890' END) END) AS text FROM {customer}"
_TOC = "len(l) = 0 OR (len(l) <= 5 AND list_avg(list_transform(l, lambda x: length(x))) < 30)"


@query(
    "oo22_summary_context",
    raw(
        f"""WITH c AS ({_CTX}), n AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY page) AS i, list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '') AS l FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY segment, trim(left(trim(text), 60)) ORDER BY i) AS again FROM n WHERE NOT ({_TOC}))
        SELECT segment, md5(CASE WHEN length(t) > 1200 THEN concat(left(t, 1200), chr(10), '...(이하 생략)') ELSE t END) AS context FROM (SELECT segment, string_agg(concat('[문서 ', i, '] ', segment, ':', chr(10), trim(text)), chr(10) || chr(10) ORDER BY i) AS t FROM k WHERE again = 1 GROUP BY segment)"""
    ),
)
def summary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in page order, without tables of contents and those that start alike, cut to the budget."""
    from orrery.plans.registry import sql

    return X.summary_context(sql(spark, sf_dir, _CTX), "segment", "page", "text").select("segment", F.md5(F.col("context").cast("binary")).alias("context"))


@query("oo23_extractive_fallback", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), u AS (SELECT doc_id, trim(left(trim(l), 120)) AS s, i FROM l WHERE length(trim(l)) >= 10 AND NOT (ends_with(trim(l), ':') AND length(trim(l)) < 60)), d AS (SELECT doc_id, s, min(i) AS i FROM u GROUP BY doc_id, s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM d) SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY i)) AS summary FROM k WHERE rn <= 5 GROUP BY doc_id")
def extractive_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines of a context that has a numbered block for each of a document's lines."""
    context = F.concat(F.lit("[문서 1] 가:\n"), F.replace("text", F.lit("\n"), F.lit("\n[문서 2] 나:\n")))
    return table(spark, sf_dir, "documents").select("doc_id", X.extract(context).alias("s")).where("size(s) > 0").select("doc_id", F.md5(F.array_join("s", "\n").cast("binary")).alias("summary"))


@query("oo24_summary_intent", raw("SELECT id, (contains(query, '요약') OR contains(query, '정리') OR contains(query, '줄거리') OR contains(query, '핵심') OR contains(query, '3줄') OR contains(query, '세줄') OR contains(query, '한줄') OR contains(lower(query), 'summary') OR contains(lower(query), 'plot')) AND NOT (contains(query, '출력') OR contains(query, '보여줘') OR contains(query, '전부') OR contains(query, '모두') OR contains(lower(query), 'dump')) AS wants, ((length(query) - length(replace(query, '1', ''))) / 1)::INT AS ones FROM {requests}"))
def summary_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request only wants a summary, and how often a piece stands in it without overlaps."""
    return view(spark, sf_dir, "requests").select("id", X.only_summary(F.col("query")).alias("wants"), X.occurrences(F.col("query"), "1").alias("ones"))


@query("oo14_rerank_passage", raw("WITH s AS (SELECT conv_id, file_name, min_by(stt_text, turn) AS t, min_by(caption, turn) AS c FROM {segments} GROUP BY conv_id, file_name) SELECT s.conv_id, md5(left(coalesce(nullif(trim(CASE WHEN d.lang = 'en' THEN d.text END), ''), nullif(s.t, ''), nullif(s.c, ''), s.file_name), 800)) AS passage FROM s LEFT JOIN {documents} d ON d.doc_id = s.conv_id"))
def rerank_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit's snippet (some recordings have none), else its first segment's speech or caption, else its name; 800 characters."""
    s = view(spark, sf_dir, "segments").groupBy("conv_id", "file_name").agg(F.min_by("stt_text", "turn").alias("t"), F.min_by("caption", "turn").alias("c"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.when(F.col("lang") == "en", F.col("text")).alias("snippet"))
    return s.join(d, "conv_id", "left").select("conv_id", F.md5(X.passage(F.col("snippet"), F.col("t"), F.col("c"), F.col("file_name")).cast("binary")).alias("passage"))
