"""Requests, texts in two languages, snippets and sentences (families B, H, O). Korean requests come from the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import requests as Q
from orrery.plans.registry import query, raw, table, view


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "requests")


def _case(word: str, endings: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({word}, '{e}') AND length({word}) > {len(e) + 1} THEN left({word}, length({word}) - {len(e)})" for e in endings) + f" ELSE {word} END"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _map(table_of: dict[str, list[str]], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in table_of.items()) + " ELSE [] END"


_WORDS = raw("(SELECT DISTINCT word FROM {requests})")


@query("oh4_strip_particle", f"SELECT word, {_case('word', Q.PARTICLES)} AS expansion, {_case('word', Q.PLACE_ENDINGS)} AS place, {_case('word', Q.ANSWER_ENDINGS)} AS answer FROM {_WORDS}")
def strip_particle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lists of endings over every word of the requests."""
    w = asked(spark, sf_dir).select("word").distinct()
    cut = lambda e: Q.without_ending(F.col("word"), e)
    return w.select("word", cut(Q.PARTICLES).alias("expansion"), cut(Q.PLACE_ENDINGS).alias("place"), cut(Q.ANSWER_ENDINGS).alias("answer"))


VOCAB = ["취업", "교육", "경제", "농구", "데이터", "데이터센터", "인공지능", "음악", "research", "budg"]


@query("oh3_suffix_backoff", f"SELECT DISTINCT word, v AS token FROM {_WORDS}, (SELECT unnest({_list(VOCAB)}) AS v), range(0, 4) t(k) WHERE v = left(lower(word), length(word) - k) AND (k = 0 OR length(word) - k >= 2)")
def suffix_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words against the vocabulary, whole and without their last one to three syllables, two at least remaining."""
    w = asked(spark, sf_dir).select("word").distinct().select("word", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where("k = 0 OR length(word) - k >= 2")
    w = w.select("word", F.substring(F.lower("word"), F.lit(1), F.length("word") - F.col("k")).alias("token"))
    return w.join(spark.createDataFrame([(v,) for v in VOCAB], "token string"), "token").select("word", "token").distinct()


DICTIONARY = [(i, k, e) for i, (k, e) in enumerate((k, e) for k, v in Q.PLACE_WORDS.items() for e in v)]
_EXPANDED_SQL = f"""WITH RECURSIVE d(ord, ko, en) AS (VALUES {', '.join(f"({o}, '{k}', '{e}')" for o, k, e in DICTIONARY)}),
  q AS (SELECT id, query, regexp_extract_all(query, '[가-힣]+|[A-Za-z][A-Za-z0-9&/]*|[0-9]+') AS toks FROM requests),
  t AS (SELECT id, query, len(toks) AS n, list_transform(toks, lambda x: lower(x)) AS low, unnest(toks) AS t, unnest(range(len(toks))) AS nth FROM q),
  r AS (SELECT *, CASE WHEN t IN (SELECT ko FROM d) THEN t WHEN lower(t) IN (SELECT ko FROM d) THEN lower(t) ELSE {_case('t', Q.PARTICLES)} END AS root FROM t),
  c AS (SELECT id, low, n, nth, 2 * nth AS side, d.ord, d.en AS w FROM r JOIN d ON d.ko = r.root UNION ALL SELECT id, low, n, nth, 2 * nth + 1, min(d.ord), d.ko FROM r JOIN d ON lower(d.en) = lower(r.t) GROUP BY id, low, n, nth, d.ko),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, ord) AS i FROM c),
  f(id, i, side, cnt, stop, seen, out) AS (SELECT DISTINCT id, 0::BIGINT, -1::BIGINT, 0, false, low, []::VARCHAR[] FROM k
    UNION ALL SELECT f.id, k.i, k.side, CASE WHEN list_contains(f.seen, lower(k.w)) OR (f.side = k.side AND f.stop) THEN (CASE WHEN f.side // 2 = k.side // 2 AND f.side >= 0 THEN f.cnt ELSE 0 END) ELSE 1 + (CASE WHEN f.side // 2 = k.side // 2 AND f.side >= 0 THEN f.cnt ELSE 0 END) END,
      (f.side = k.side AND f.stop) OR (NOT list_contains(f.seen, lower(k.w)) AND 1 + (CASE WHEN f.side // 2 = k.side // 2 AND f.side >= 0 THEN f.cnt ELSE 0 END) >= greatest(2, 10 // greatest(k.n, 1))),
      CASE WHEN list_contains(f.seen, lower(k.w)) OR (f.side = k.side AND f.stop) THEN f.seen ELSE list_append(f.seen, lower(k.w)) END, CASE WHEN list_contains(f.seen, lower(k.w)) OR (f.side = k.side AND f.stop) THEN f.out ELSE list_append(f.out, k.w) END
    FROM f JOIN k ON k.id = f.id AND k.i = f.i + 1),
  l AS (SELECT id, arg_max(out, i) AS out FROM f GROUP BY id)
  SELECT q.id, CASE WHEN len(l.out) > 0 THEN q.query || ' ' || array_to_string(l.out[1:10], ' ') ELSE q.query END AS expanded FROM q LEFT JOIN l ON l.id = q.id"""


@query("oh5_bilingual_expansion", raw(_EXPANDED_SQL.replace("FROM requests", "FROM {requests}")))
def bilingual_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with what a dictionary (a table, here that of places) adds."""
    return Q.expanded(asked(spark, sf_dir), spark.createDataFrame(DICTIONARY, "ord int, ko string, en string"))


def _stripped(q: str) -> str:
    for f in sorted(Q.FILLERS, key=len, reverse=True):
        q = f"replace({q}, '{f}', ' ')"
    return f"trim(regexp_replace({q}, '\\s+', ' ', 'g'))"


_TO_EN = "list_filter([" + ", ".join(f"CASE WHEN contains(query, '{k}') THEN '{e}' END" for k, e in Q.REWRITE_WORDS.items()) + "], lambda x: x IS NOT NULL)"
_TO_KO = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(lower(query), '(^|[^a-z0-9_]){e.lower()}($|[^a-z0-9_])') THEN '{k}' END" for k, e in Q.REWRITE_WORDS.items()) + "], lambda x: x IS NOT NULL)"


@query("oh6_query_rewrite", raw(f"SELECT id, trim(concat({_stripped('query')}, ' ', array_to_string(CASE WHEN regexp_matches(query, '[가-힣]') AND NOT regexp_matches(query, '[A-Za-z]') THEN {_TO_EN} WHEN regexp_matches(query, '[A-Za-z]') AND NOT regexp_matches(query, '[가-힣]') THEN {_TO_KO} ELSE [] END, ' '))) AS rewritten FROM {{requests}}"))
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", Q.rewritten(F.col("query")).alias("rewritten"))


_REV: dict[str, list[str]] = {}
for _k, _v in Q.PLACE_WORDS.items():
    for _e in _v:
        _REV.setdefault(_e, []).append(_k)
_FIRSTS = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_PLACE_TOKENS = "list_filter(list_transform(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+'), lambda w: CASE WHEN regexp_matches(w, '[가-힣]') THEN " + _case("w", Q.PLACE_ENDINGS) + " ELSE w END), lambda w: length(w) >= 2)"


@query("oo12_place_tokens", raw(f"WITH a AS (SELECT id, {_PLACE_TOKENS} AS l FROM {{requests}}), b AS (SELECT id, {_FIRSTS.format(l='l')} AS t FROM a), c AS (SELECT id, t, flatten(list_transform(t, lambda x: list_concat([x], list_concat({_map(Q.PLACE_WORDS, 'x')}, {_map(_REV, 'x')})))) AS e FROM b) SELECT id, array_to_string(t, ',') AS tokens, array_to_string({_FIRSTS.format(l='e')}, ',') AS expanded FROM c"))
def place_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = asked(spark, sf_dir).select("id", Q.place_tokens(F.col("query")).alias("t"))
    return t.select("id", F.array_join("t", ",").alias("tokens"), F.array_join(Q.place_expanded(F.col("t")), ",").alias("expanded"))


SEEK = "dann the und"


@query(
    "oo11_location",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS s, unnest(range(len(ls))) AS i FROM l), c AS (SELECT *, list_transform(['dann', 'the', 'und'], lambda t: contains(lower(s), t)::INT) AS h, list_transform(['dann', 'the', 'und'], lambda t: list_contains(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), t)::INT) AS w FROM e),
    r AS (SELECT *, CASE WHEN list_sum(h) >= 3 THEN list_sum(h) ELSE greatest(list_sum(h), list_sum(w)) END AS score FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rn FROM r WHERE score > 0)
    SELECT b.doc_id, (b.doc_id % 30 + 1)::INT AS page, (b.i + 1)::INT AS line, b.score::INT AS score, md5(substr(array_to_string(list_filter(list_transform(l.ls[b.i + 1:b.i + 2], lambda x: trim(x)), lambda x: x <> ''), ' '), 1, 200)) AS snippet FROM b JOIN l ON l.doc_id = b.doc_id WHERE b.rn = 1""",
)
def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, line and snippet of each document for one request."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("page_images/x__1/p"), F.lpad((F.col("doc_id") % 30).cast("string"), 4, "0"), F.lit(".jpg")).alias("id"), Q.best_place(F.col("text"), F.lit(SEEK)).alias("b")).where("b is not null")
    return d.select("doc_id", (F.regexp_extract("id", "p([0-9]+)[.]", 1).cast("int") + 1).alias("page"), "b.line", "b.score", F.md5(F.col("b.snippet").cast("binary")).alias("snippet"))


@query("oo11_media_location", raw("WITH s AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY length(stt_text) DESC, turn) AS rn, round(start_sec)::BIGINT AS t FROM {segments}) SELECT file_path, round(start_sec, 2) AS timestamp, round(end_sec, 2) AS timestamp_end, CASE WHEN t >= 3600 THEN concat(t // 3600, ':', lpad((t % 3600 // 60)::VARCHAR, 2, '0'), ':', lpad((t % 60)::VARCHAR, 2, '0')) ELSE concat(t // 60, ':', lpad((t % 60)::VARCHAR, 2, '0')) END AS label, md5(substr(trim(coalesce(nullif(stt_text, ''), caption)), 1, 200)) AS snippet FROM s WHERE rn = 1"))
def media_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time range, label and text of each recording's best segment (the one with most speech)."""
    s = view(spark, sf_dir, "segments").withColumn("rn", F.row_number().over(Window.partitionBy("file_path").orderBy(F.length("stt_text").desc(), "turn"))).where("rn = 1")
    text = F.substring(F.trim(F.coalesce(F.nullif("stt_text", F.lit("")), "caption")), 1, 200)
    return s.select("file_path", F.round("start_sec", 2).alias("timestamp"), F.round("end_sec", 2).alias("timestamp_end"), X.clock(F.col("start_sec")).alias("label"), F.md5(text.cast("binary")).alias("snippet"))


@query("oh9_hms", raw("SELECT conv_id, turn, CASE WHEN r >= 3600 THEN concat(r // 3600, ':', lpad((r % 3600 // 60)::VARCHAR, 2, '0'), ':', lpad((r % 60)::VARCHAR, 2, '0')) ELSE concat(r // 60, ':', lpad((r % 60)::VARCHAR, 2, '0')) END AS rounded, concat(f // 60, ':', lpad((f % 60)::VARCHAR, 2, '0')) AS floored FROM (SELECT conv_id, turn, round(start_sec * 9)::BIGINT AS r, floor(start_sec * 9)::BIGINT AS f FROM {segments})"))
def hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as H:MM:SS, rounded, and as minutes and seconds, cut."""
    s = view(spark, sf_dir, "segments")
    return s.select("conv_id", "turn", X.clock(F.col("start_sec") * 9).alias("rounded"), X.minutes(F.col("start_sec") * 9).alias("floored"))


_HINT = lambda d: "(" + " OR ".join(f"contains(lower(query), '{h}')" for h in Q.DOMAIN_HINTS[d]) + ")"
_GUESS = "CASE " + " ".join(f"WHEN {_HINT(d)} THEN '{d}'" for d in Q.DOMAIN_HINTS) + " END"
_RESULTS = "SELECT c_custkey AS id, r AS rank, CASE WHEN (c_custkey + r) % 3 = 0 THEN 'movie' WHEN (c_custkey + r) % 3 = 1 THEN 'image' ELSE 'music' END AS domain, ((c_custkey * 31 + r * 17) % 100) / 100.0 AS confidence FROM "


@query("oh19_intent", raw(f"WITH r AS ({_RESULTS} {{customer}}, range(1, 13) t(r) WHERE c_custkey % 2 = 0), m AS (SELECT id, domain, avg(confidence) AS m, min(rank) AS f FROM r WHERE rank <= 10 GROUP BY id, domain), b AS (SELECT id, domain, row_number() OVER (PARTITION BY id ORDER BY round(m, 12) DESC, f) AS rn FROM m) SELECT q.id, coalesce({_GUESS}, b.domain, 'image') AS domain FROM {{requests}} q LEFT JOIN b ON b.id = q.id AND b.rn = 1"))
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's domain: by its words, by the first results (even ids have some), by default."""
    r = spark.sql(_RESULTS.replace("c_custkey AS id", "c_custkey AS id") + " {c}, (SELECT explode(sequence(1, 12)) AS r) WHERE c_custkey % 2 = 0", c=table(spark, sf_dir, "customer"))
    return Q.chosen_domain(asked(spark, sf_dir), r.withColumn("confidence", F.col("confidence").cast("double")))


MOODS = {"jazz": ["재즈", "jazz", "swing"], "news": ["뉴스", "news", "방송"], "sports": ["스포츠", "sports", "농구"], "calm": ["잔잔", "calm"]}
_SONGS = "CASE CAST(id % 8 AS INT) WHEN 0 THEN concat('가수 ', word, ' 들려줘') WHEN 1 THEN concat('''', word, ''' 노래') WHEN 2 THEN concat(word, ' 음악이 배경') WHEN 3 THEN concat(word, ' 노래 찾아줘') WHEN 4 THEN concat(word, '의 밤편지가 배경') WHEN 5 THEN '잔잔한 노래' WHEN 6 THEN word ELSE concat(word, ' jazz 추천') END"


@query(
    "oh18_music_request",
    raw(
        f"""SELECT id, CASE k WHEN 0 THEN split_part(word, ' ', 1) WHEN 1 THEN word WHEN 2 THEN word WHEN 3 THEN word WHEN 4 THEN word WHEN 6 THEN CASE WHEN contains(word, '음악') THEN NULL ELSE word END END AS artist, CASE WHEN k = 4 THEN '밤편지' WHEN k = 2 AND ends_with(word, '의') THEN '음악' END AS title,
        array_to_string(list_filter([CASE WHEN k = 7 THEN 'jazz' END, CASE WHEN contains(word, '농구') AND k <> 5 THEN 'sports' END, CASE WHEN k = 5 THEN 'calm' END], lambda x: x IS NOT NULL), ',') AS moods FROM (SELECT id, CAST(id % 8 AS INT) AS k, word FROM {{requests}} WHERE NOT (CAST(id % 8 AS INT) = 0 AND (contains(word, '로') OR contains(word, '을'))))"""
    ),
)
def music_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist, title and moods of requests for music, made from each request's word."""
    q = asked(spark, sf_dir).where("NOT (id % 8 = 0 AND (contains(word, '로') OR contains(word, '을')))").select("id", F.expr(_SONGS).alias("song"))
    return q.select("id", Q.music_hints(F.col("song"), MOODS).alias("h")).select("id", "h.artist", "h.title", F.array_join("h.moods", ",").alias("moods"))


_DRAW = lambda seed, n: f"(('0x' || substr(md5(query || '{seed}'), 1, 8))::BIGINT % ({n}))"


@query(
    "oh21_perturbation",
    raw(
        f"""WITH q AS (SELECT id, query, domain, string_split(query, ' ') AS w FROM {{requests}}), s AS (SELECT id, array_to_string(list_transform(list_sort(list_transform(list_zip(w, range(len(w))), lambda p: md5(p[1] || ':' || p[2]) || '|' || p[1])), lambda x: substr(x, 34)), ' ') AS shuffled FROM q),
        p AS (SELECT id, list_filter(range(1, length(query) + 1), lambda i: query[i] <> ' ') AS places FROM q)
        SELECT id, 'sentence' AS source, replace((CASE domain {' '.join(f"WHEN '{k}' THEN {_list(v)}" for k, v in Q.TEMPLATES.items())} END)[{_DRAW('t', f"CASE domain {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {len(v)}' for k, v in Q.TEMPLATES.items())} END")} + 1], '{{q}}', query) AS query FROM q
        UNION ALL SELECT q.id, 'shuffle', shuffled FROM q JOIN s USING (id) WHERE len(w) >= 2 AND shuffled <> query
        UNION ALL SELECT id, 'particle', w[1] || {_list(Q.ADDED)}[{_DRAW('p', 4)} + 1] || CASE WHEN len(w) > 1 THEN ' ' || array_to_string(w[2:], ' ') ELSE '' END FROM q WHERE len(list_filter(w, lambda x: regexp_matches(x, '^[가-힣]{{2,}}'))) > 0
        UNION ALL SELECT q.id, 'deletion', left(query, (places[{_DRAW('d', 'len(places)')} + 1] - 1)::INT) || substr(query, (places[{_DRAW('d', 'len(places)')} + 1] + 1)::INT) FROM q JOIN p USING (id) WHERE len(places) > 4"""
    ),
)
def perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", F.explode(Q.perturbed(F.col("query"), F.col("domain"))).alias("p")).select("id", "p.source", "p.query")


_QA = "SELECT id, concat(query, CASE WHEN id % 3 = 0 THEN ' 설명하시오.' ELSE ' 무엇인가' END) AS question, CASE CAST(id % 4 AS INT) WHEN 0 THEN '짧다' WHEN 1 THEN concat('취업 통계 보고서는 산업과 교육을 다룬다. ', query) WHEN 2 THEN '전혀 다른 낱말들만 여기에 있습니다. 그렇습니다 정말로 그렇다.' ELSE '첫째 문장이다요. 둘째 문장이다요. 셋째 문장이다요. 넷째 문장이다요. 다섯째 문장이다. 여섯째 문장이다. 일곱째 문장이다.' END AS answer, '취업 통계 보고서는 산업과 교육을 다룬다. 투자 시장' AS context FROM {requests}"


@query(
    "oh22_qa_validity",
    raw(
        f"""WITH a AS ({_QA}), b AS (SELECT *, len(list_filter(regexp_split_to_array(trim(answer), '[.。!?]\\s*'), lambda s: length(trim(s)) > 5)) AS n, list_distinct(regexp_extract_all(answer, '[가-힣]{{2,}}')) AS mine, list_distinct(regexp_extract_all(context, '[가-힣]{{2,}}')) AS theirs FROM a)
        SELECT id, array_to_string(list_filter([CASE WHEN NOT (ends_with(rtrim(trim(question), '.'), '설명하시오')) THEN 'ending' END, CASE WHEN n < 1 THEN 'no sentence' WHEN n > 6 THEN 'too many sentences' END, CASE WHEN len(mine) > 0 AND len(list_intersect(mine, theirs)) < 0.2 * len(mine) THEN 'few words of the document' END, CASE WHEN length(trim(answer)) < 20 THEN 'too short' END], lambda x: x IS NOT NULL), ', ') AS faults FROM b"""
    ),
)
def qa_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.plans.registry import sql

    return sql(spark, sf_dir, _QA).select("id", F.array_join(Q.qa_faults(F.col("question"), F.col("answer"), F.col("context")), ", ").alias("faults"))


_NAMES = ["AI브리프_3월.pdf", "취업 통계 2024.pdf", "역사.pdf", "데이터센터 보고서.docx", "budget report.xlsx"]
_B = lambda c: f"lower(regexp_replace({c}, '[^0-9A-Za-z가-힣]', '', 'g'))"


@query(
    "oh23_name_match",
    raw(
        f"""WITH n AS (SELECT unnest({_list(_NAMES)}) AS name, unnest(range({len(_NAMES)})) AS ord), s AS (SELECT q.id, n.name, n.ord, len(list_intersect(list_distinct(regexp_extract_all({_B('n.name')}, '.')), list_distinct(regexp_extract_all({_B('q.query')}, '.')))) + 3 * len(list_filter(regexp_extract_all(n.name, '[가-힣A-Za-z0-9]{{2,}}'), lambda w: contains({_B('q.query')}, {_B('w')}))) AS score FROM {{requests}} q, n), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rn FROM s) SELECT id, name, score::INT AS score FROM b WHERE rn = 1 AND score >= 3"""
    ),
)
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of a short list that each request names best, if it does at all."""
    names = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(_NAMES)])
    s = asked(spark, sf_dir).select("id", F.array_max(F.transform(names, lambda n: F.struct(Q.name_score(F.col("query"), n["name"]).alias("score"), (-n["ord"]).alias("ord"), n["name"].alias("name")))).alias("b"))
    return s.where("b.score >= 3").select("id", "b.name", "b.score")


@query(
    "ob16_hint_filter",
    raw(f"SELECT c_custkey, doc_id FROM (SELECT c_custkey, segment, {_B('segment')} AS r FROM (SELECT DISTINCT c_mktsegment AS segment, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS c_custkey FROM {{customer}})) q, (SELECT doc_id, {_B('concat(file_name, path)')} AS m FROM {{files}}) f WHERE contains(r, m) OR contains(m, r) OR contains(m, substr(r, 1, 4)) UNION ALL SELECT -1, doc_id FROM (SELECT doc_id, {_B('concat(file_name, path)')} AS m FROM {{files}}) WHERE contains(m, 'repo')"),
)
def hint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose names a request hints at: five segments' names, and one that starts as all files do."""
    f = view(spark, sf_dir, "files").select("doc_id", F.concat("file_name", "path").alias("m"))
    few = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("r")).agg(F.min("c_custkey").alias("c_custkey")).union(spark.sql("SELECT 'Repository', -1L"))
    return f.join(few, Q.hint_fits(F.col("r"), F.col("m"))).select("c_custkey", "doc_id")


_FOUND = "regexp_extract(query, '([0-9A-Za-z가-힣._-]{2,})[^0-9A-Za-z가-힣._-]*문서', 1)"


@query("oh25_line_hint", raw("WITH d AS (SELECT q.id, q.query, list_filter(string_split(t.text, chr(10)), lambda x: trim(x) <> '') AS l, t.text FROM {requests} q JOIN {documents} t ON t.doc_id = q.id) SELECT id, md5(CASE WHEN trim(text) = '' OR NOT regexp_matches(query, '[2-5]\\s*줄') THEN text ELSE array_to_string(l[1:regexp_extract(query, '([2-5])\\s*줄', 1)::INT], chr(10)) END) AS kept FROM d"))
def line_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to as many lines as their request asks for."""
    d = asked(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return d.select("id", F.md5(X.line_limited(F.col("text"), F.col("query")).cast("binary")).alias("kept"))


@query("oo8_query_variants", raw("WITH v AS (SELECT id, list_filter(list_transform([query, upper(query), ' ' || query, word, domain || ' ' || word, domain], lambda x: trim(x)), lambda x: x <> '') AS v FROM {requests}), d AS (SELECT id, list_filter(v, lambda x, i: NOT list_contains(list_transform(v[1:i - 1], lambda y: lower(y)), lower(x))) AS v FROM v) SELECT id, array_to_string(v[1:4], '|') AS variants FROM d"))
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = F.array(F.upper("query"), F.concat(F.lit(" "), "query"), F.col("word"), F.concat_ws(" ", "domain", "word"), F.col("domain"))
    return asked(spark, sf_dir).select("id", F.array_join(Q.variants(F.col("query"), others, 3), "|").alias("variants"))


_KEYWORDS = ["the", "license", "30%"]
_POS = " UNION ALL ".join(f"SELECT doc_id, {i} AS word, p - 1 AS pos, {len(w)} AS len FROM (SELECT doc_id, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(t, i, {len(w)}) = '{w}')) AS p FROM (SELECT doc_id, text, lower(text) AS t FROM documents WHERE contains(lower(text), '{w}')))" for i, w in enumerate(_KEYWORDS))


@query(
    "oh16_interval_merge",
    f"""WITH p AS ({_POS}), s AS (SELECT p.doc_id, greatest(0, pos - 800) AS s, least(length(d.text), pos + len + 800) AS e FROM p JOIN documents d USING (doc_id)), m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
    g AS (SELECT *, sum(CASE WHEN s > b + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM m), i AS (SELECT doc_id, min(s) AS start, max(e) AS stop FROM g GROUP BY doc_id, island), c AS (SELECT i.*, lower(substr(d.text, (start + 1)::INT, (stop - start)::INT)) AS piece FROM i JOIN documents d USING (doc_id))
    SELECT doc_id, start::INT AS start, stop::INT AS stop, ({' + '.join(f"contains(piece, '{w}')::INT" for w in _KEYWORDS)} + 0.5 * len(regexp_extract_all(piece, '\\d+\\.?\\d*\\s*%')))::DOUBLE AS score FROM c""",
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.keyword_slices(table(spark, sf_dir, "documents"), _KEYWORDS).withColumn("score", F.col("score").cast("double"))


@query("oh15_keyword_windows")
def keyword_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three windows of each document; tests hold this against a plain loop."""
    return Q.keyword_windows(table(spark, sf_dir, "documents"), _KEYWORDS)


@query(
    "oh17_key_sentences",
    f"""WITH c AS (SELECT doc_id, list_concat(string_split(regexp_replace(text, '([다.。])\\s*\\n+', '\\1' || chr(1), 'g'), chr(1)), string_split(text, chr(10))) AS l FROM documents), e AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(l), '^\\s+', ''), '\\s+$', '') AS s, unnest(range(len(l))) AS i FROM c),
    u AS (SELECT doc_id, s, min(i) AS i FROM e WHERE length(s) >= 15 GROUP BY doc_id, s), r AS (SELECT *, {' + '.join(f"contains(lower(s), '{w}')::INT" for w in _KEYWORDS)} AS d, len(regexp_extract_all(s, '\\d+\\.?\\d*\\s*[%％만억조백천]')) AS b FROM u), k AS (SELECT *, row_number() OVER w AS place, sum(length(s)) OVER w AS used FROM r WHERE d > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY d + b DESC, i))
    SELECT doc_id, place::INT AS place, md5(s) AS sentence FROM k WHERE used <= 5000""",
)
def key_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_sentences(table(spark, sf_dir, "documents"), _KEYWORDS).withColumn("sentence", F.md5(F.col("sentence").cast("binary")))
