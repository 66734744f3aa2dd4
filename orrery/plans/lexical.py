"""Tokens, vocabulary, inverted scores, text functions (families A, B, C, D, H, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import postings
from orrery.plans.registry import query, relational, table
from orrery.sources import workdir

_STOP = ", ".join(f"'{w}'" for w in X.EN_STOP)
TOKENS_SQL = f"tok AS (SELECT doc_id, t, pos FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[가-힣]{{2,}}|[A-Za-z][A-Za-z0-9\\-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS l FROM documents)))"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("t"))


@query("oh1_tokens", f"WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n, count(DISTINCT t) AS n_distinct FROM tok GROUP BY doc_id")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted within the row: no shuffle."""
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t")).where("size(t) > 0")
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


VOCAB_SQL = f"{TOKENS_SQL}, n AS (SELECT count(*) AS n FROM documents), voc AS (SELECT t AS token, count(DISTINCT doc_id) AS df, ln((max(n.n) + 1.0) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM tok, n GROUP BY t HAVING count(DISTINCT doc_id) BETWEEN 2 AND max(n.n) * 0.4)"


def term_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(doc_id, t, tf, dl) of all documents, and their number: tokenised once for a version of the data, then read."""
    docs = table(spark, sf_dir, "documents")

    def make() -> tuple[DataFrame, int]:
        l = docs.select("doc_id", X.tokens(F.col("text")).alias("l")).where("size(l) > 0")
        tf = l.select("doc_id", F.size("l").cast("double").alias("dl"), F.explode("l").alias("t")).groupBy("doc_id", "dl", "t").agg(F.count("*").alias("tf"))
        path = workdir.fresh(spark, "terms")
        tf.write.parquet(path)
        return spark.read.parquet(path), docs.count()

    return workdir.once(spark, docs, "terms", make)


def bm25_postings(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """Every term's share in a document's BM25 score (k1 .9, b .4), stored once for a version of the data."""

    def make() -> postings.Postings:
        tf, n_docs = term_table(spark, sf_dir)
        st = tf.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("av"))
        df = tf.groupBy("t").agg(F.count("*").alias("df"))
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 1.9 / (F.col("tf") + 0.9 * (1 - 0.4 + 0.4 * F.col("dl") / F.col("av")))
        return postings.build(tf.join(df, "t").crossJoin(F.broadcast(st)).select("t", F.col("doc_id").alias("doc"), part.alias("impact")), n_docs)  # one row

    return workdir.once(spark, table(spark, sf_dir, "documents"), "bm25", make)


def idf_postings(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """The vocabulary's terms with their idf as impact, stored once for a version of the data."""

    def make() -> postings.Postings:
        tf, n = term_table(spark, sf_dir)
        v = vocabulary_of(tf, n).select(F.col("token").alias("t"), F.col("idf").alias("impact"))
        return postings.build(tf.select("t", F.col("doc_id").alias("doc")).join(v, "t"), n)

    return workdir.once(spark, table(spark, sf_dir, "documents"), "idf", make)


def vocabulary_of(terms: DataFrame, n: int, least: int = 2, ratio: float = 0.4) -> DataFrame:
    """(token, df, idf) from a term table."""
    df = terms.groupBy(F.col("t").alias("token")).agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= least) & (F.col("df") <= int(n * ratio))).select("token", "df", (F.log((n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))


def vocabulary(spark: SparkSession, sf_dir: str, least: int = 2, ratio: float = 0.4) -> DataFrame:
    """Document frequency and idf. Distinct within the row, so one shuffle with partial counts."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= F.floor(F.col("n") * ratio))).select("token", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))


@query("od7_vocabulary", f"WITH {VOCAB_SQL} SELECT token, df, round(idf, 4) AS idf FROM voc")
def vocabulary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).withColumn("idf", F.round("idf", 4))


@query("od8_linear_vocabulary", f"WITH {TOKENS_SQL}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT t AS token, count(DISTINCT doc_id) AS df FROM tok GROUP BY t) SELECT token, df, round(2 - df::DOUBLE / n, 6) AS weight FROM d, n WHERE df BETWEEN 2 AND greatest(floor(0.3 * n), 100)")
def linear_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    v = df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).where("df >= 2 and df <= greatest(floor(0.3D * n), 100)")
    return v.select("token", "df", F.round(2 - F.col("df") / F.col("n"), 6).alias("weight"))


_BENCH = f"q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[가-힣]{{2,}}|[A-Za-z][A-Za-z0-9\\-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))) AS t FROM benchmark))"


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("t"))


@query(
    "oi9_asf",
    f"WITH {VOCAB_SQL}, {_BENCH}, dd AS (SELECT DISTINCT doc_id, t FROM tok), w AS (SELECT q.item_id, q.t, idf FROM q JOIN voc ON voc.token = q.t), nn AS (SELECT item_id, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY item_id), s AS (SELECT w.item_id, dd.doc_id, sum(w.idf) / max(nn.norm) AS s FROM w JOIN dd ON dd.t = w.t JOIN nn ON nn.item_id = w.item_id GROUP BY w.item_id, dd.doc_id), r AS (SELECT *, s / max(s) OVER (PARTITION BY item_id) AS asf, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rn FROM s) SELECT item_id, doc_id, round(asf, 6) AS asf, rn::INT AS rank FROM r WHERE rn <= 10",
)
def asf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary overlap: idf of shared tokens over the query's norm, divided by the query's best; from stored postings."""
    p, q = idf_postings(spark, sf_dir), query_tokens(spark, sf_dir)
    norm = q.join(p.terms, "t").groupBy("item_id").agg(F.sqrt(F.sum(F.col("mx") * F.col("mx"))).alias("norm"))
    s = postings.best(p, q.withColumnRenamed("item_id", "item"), 10, 7)[0].withColumnRenamed("item", "item_id").join(norm, "item_id").withColumn("s", F.col("s") / F.col("norm"))
    w = Window.partitionBy("item_id")
    return s.select("item_id", F.col("doc").alias("doc_id"), F.round(F.col("s") / F.max("s").over(w), 6).alias("asf"), F.row_number().over(w.orderBy(F.round("s", 9).desc(), "doc")).alias("rank"))


@query(
    "om10_bm25",
    f"WITH {TOKENS_SQL}, {_BENCH}, tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY doc_id, t), dl AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM tf GROUP BY doc_id), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av FROM dl), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), s AS (SELECT q.item_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / av))) AS s FROM q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY q.item_id, tf.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 8) DESC, doc_id) AS rn FROM s) SELECT item_id, doc_id, round(s, 5) AS score, rn::INT AS rank FROM r WHERE rn <= 10",
)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k1 .9, b .4, from stored postings."""
    r = postings.best(bm25_postings(spark, sf_dir), query_tokens(spark, sf_dir).withColumnRenamed("item_id", "item"), 10)[0]
    return r.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), F.round("s", 5).alias("score"), "rank")


@query(
    "oc12_sparse_inner_product",
    f"WITH {TOKENS_SQL}, {_BENCH}, tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY doc_id, t) SELECT q.item_id, tf.doc_id, sum(tf.tf)::BIGINT AS dot FROM q JOIN tf ON tf.t = q.t GROUP BY q.item_id, tf.doc_id",
)
def sparse_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).join(query_tokens(spark, sf_dir), "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("dot"))


@query(
    "oc11_substring_match",
    f"WITH {VOCAB_SQL}, {_BENCH} SELECT DISTINCT q.t AS needle, voc.token FROM q JOIN voc ON contains(voc.token, q.t) WHERE length(q.t) >= 2",
)
def substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query tokens inside vocabulary tokens: an equi-join on the needle's first bigram, then `contains`; no theta join."""
    v = vocabulary(spark, sf_dir).select("token")
    grams = v.select("token", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2))))).alias("g"))
    q = query_tokens(spark, sf_dir).select("t").distinct().where("length(t) >= 2").select(F.col("t").alias("needle"), F.substring("t", 1, 2).alias("g"))
    return grams.join(q, "g").where(F.col("token").contains(F.col("needle"))).select("needle", "token")


@query(
    "oa3_text_chunks",
    "WITH c AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 400)) AS i, text FROM documents) SELECT doc_id, count(*) AS n, sum(length(x))::BIGINT AS chars FROM (SELECT doc_id, trim(substr(text, i + 1, 500)) AS x FROM c) WHERE x <> '' GROUP BY doc_id",
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", X.chunks(F.col("text")).alias("c")).where("size(c) > 0")
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query("oa6_virtual_pages", "SELECT doc_id, (i / 1500)::INT AS page, length(substr(text, i + 1, 1500))::INT AS chars FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1500)) AS i FROM documents)")
def virtual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pages(F.col("text"))).alias("page", "t")).select("doc_id", "page", F.length("t").alias("chars"))


@query(
    "oh7_snippet",
    "WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), w AS (SELECT doc_id, text, unnest(l) AS s, unnest(range(len(l))) AS i FROM s), n AS (SELECT doc_id, text, s, i, len(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda x: x IN ('the', 'with', 'was'))) AS n FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rn FROM n) SELECT doc_id, substr(CASE WHEN n > 0 THEN s ELSE text END, 1, 220) AS snippet FROM b WHERE rn = 1",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("the"), F.lit("with"), F.lit("was"))
    return table(spark, sf_dir, "documents").where("size(filter(split(text, '\\\\n+'), x -> trim(x) != '')) > 0").select("doc_id", X.best_snippet(F.col("text"), words).alias("snippet"))


relational("oa9_content_hash", "SELECT doc_id, sha2(text, 256) AS sha FROM {documents}", "SELECT doc_id, sha256(text) AS sha FROM documents")
relational("oa10_file_key", "SELECT page_id, concat(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '[^0-9A-Za-z]+', '_'), '__', substr(md5(url), 1, 8)) AS k FROM {pages}", "SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '[^0-9A-Za-z]+', '_', 'g') || '__' || substr(md5(url), 1, 8) AS k FROM pages")
relational("oa11_parse_ids", "SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS stem, CAST(nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS INT) + 1 AS page FROM {pages}")
relational("od18_keywords", "SELECT doc_id, w, n FROM (SELECT doc_id, w, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS rn FROM (SELECT doc_id, posexplode(regexp_extract_all(lower(text), '[a-z]{4,}', 0)) AS (p, w) FROM {documents}) GROUP BY doc_id, w) WHERE rn <= 10", "SELECT doc_id, w, n FROM (SELECT doc_id, w, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS rn FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS l FROM documents)) GROUP BY doc_id, w) WHERE rn <= 10")
