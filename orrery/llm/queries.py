"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import alignment, ann, chat, decontam, licences, near_dup, quality, repeats, secrets, shards, site_style, spm, urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Tools that calls may name, with their arguments' schemas.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "minLength": 1}}, "required": ["url"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"]},
    "lookup": {"type": "object", "properties": {"id": {"type": "string", "minLength": 1}, "fields": {"type": "array", "items": {"type": "string"}}}, "required": ["id"]},
}
TOKENIZER = os.environ.get("ORRERY_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
OTHER_TOKENIZER = os.environ.get("ORRERY_OTHER_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_bytes(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def held_out(col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"), TOOLS)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, similarity=0.8)


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.score(docs, ranker, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), model_bytes(), keep=["doc_id"])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


def op7_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard(table(spark, sf_dir, "documents"), 24, keep=["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    place = F.transform(F.concat("base_spans", "added_spans"), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, secrets.KINDS)), s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(place)).alias("spans"),
        F.size("added_spans").alias("n_added"),
        "oversized",
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.count_links(table(spark, sf_dir, "documents"), model_bytes(OTHER_TOKENIZER), model_bytes(), keep=["doc_id"])


def periodic(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), a tenth of the texts with a tail that repeats: the stated data of op12, by the CRC of the id. A null id leaves the text."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    tail = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    tail = tail.withColumn("a", (F.col("g") % n).cast("int")).withColumn("p", F.expr("cast(1 + floor((size(words) - a) / (3 + g % 8)) as int)"))
    again = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((size(words) - a) / p) as int))), 1, size(words) - a)), ' ')")
    return tail.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.collapse(periodic(table(spark, sf_dir, "documents")), keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def queries() -> dict:
    return {f.__name__: f for f in (op1_cross_polytope_ann, op2_tool_call_linking, op3_minhash_near_dedup, op4_bradley_terry_quality, op5_sentencepiece, op6_url_filter, op7_virtual_slot_shards, op8_secret_scan, op9_licence_scan, op10_decontamination, op11_tokenizer_alignment, op12_periodic_runs, op13_html_extraction)}


def _licence_sql() -> str:
    rows = ", ".join(f"('{k}', [{', '.join(chr(39) + g + chr(39) for g in licences.template_bigrams(v))}])" for k, v in licences.TEMPLATES.items())
    return f"""
    WITH t(licence, b) AS (VALUES {rows}),
    n AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS x FROM documents),
    u AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS unit FROM n
          UNION ALL SELECT doc_id, replace(p, chr(10), ' ') FROM (SELECT doc_id, unnest(regexp_split_to_array(x, '\\n ?\\n[ \\n]*')) AS p FROM n) WHERE contains(p, chr(10))),
    w AS (SELECT doc_id, list_filter(string_split(unit, ' '), lambda y: y <> '') AS w FROM u),
    g AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS a FROM w WHERE len(w) > 0),
    d AS (SELECT doc_id, licence, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g CROSS JOIN t WHERE len(list_intersect(a, b)) > 0)
    SELECT doc_id, licence, max(dice)::DOUBLE AS dice, count(*) AS n_units FROM d WHERE dice >= 0.8 GROUP BY doc_id, licence"""


def _url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    path = lambda u: f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    node = lambda u: f"{host(u)} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    best = lambda h, p: f"(SELECT max_by(struct_pack(rule := r.h || r.p, verdict := r.v), length(r.h || r.p)) FROM r WHERE ({h} = r.h OR ends_with({h}, '.' || r.h)) AND starts_with({p}, r.p))"
    quote = lambda s: s.replace("'", "''")
    return f"""
    WITH RECURSIVE r(v, h, p) AS (VALUES {rules}),
    pg AS (SELECT page_id, url, html, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path,
           CASE WHEN contains(url, '://') THEN {node('url')} END AS node FROM pages),
    l AS (SELECT url, node, replace(unnest(list_concat(
             list_transform(regexp_extract_all(html, '{quote(urls.CANONICAL)}'), lambda t: regexp_extract(t, '{quote(urls.HREF)}', 1)),
             list_transform(regexp_extract_all(html, '{quote(urls.REFRESH)}'), lambda t: regexp_extract(t, '{quote(urls.TARGET)}', 1)))), '&amp;', '&') AS link
          FROM pg WHERE node IS NOT NULL),
    a AS (SELECT node, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
             WHEN starts_with(link, '/') THEN 'http://' || {host('url')} || link
             ELSE 'http://' || {host('url')} || coalesce(nullif(regexp_extract({path('url')}, '(?s)^(.*/)', 1), ''), '/') || link END AS target
          FROM l WHERE link <> ''),
    e AS (SELECT node AS x, {node('target')} AS y FROM a UNION SELECT {node('target')}, node FROM a),
    c(x, y) AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
    j AS (SELECT c.x, max(CASE f.verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS says
          FROM (SELECT x, y, {best(host("('x://' || y)"), path("('x://' || y)"))} AS f FROM c) c GROUP BY c.x)
    SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN says = 1 THEN 'block' ELSE 'allow' END) AS verdict
    FROM (SELECT pg.*, {best('host', 'path')} AS f FROM pg) q LEFT JOIN j ON j.x = q.node"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": _url_sql(), "op9_licence_scan": _licence_sql()}
