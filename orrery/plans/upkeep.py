"""Upkeep of registers and indexes over the catalog's tables, and measures by class (families A, D, G, I, K, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import engine
from orrery.functions import scoring as S
from orrery.operators import registers as R
from orrery.operators import upkeep as U
from orrery.operators.axis_search import AxisSearch
from orrery.plans.registers import _type
from orrery.plans.registry import query, raw, sql, table, view
from orrery.plans.vectors import AXES_SQL, DOT, SCORED_SQL, best_rows
from orrery.sources import workdir
from orrery.sources.versioned import VersionedTable


@query("oa1_aligned_channel", "SELECT vec_id AS ord, CASE WHEN vec_id % 7 <> 0 THEN 'doc_' || vec_id ELSE '' END AS id, label AS value FROM embeddings")
def aligned_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel as long as the vectors counts; ids that lack stay empty."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "ord")
    ids = e.where("ord % 7 <> 0").select("ord", F.concat(F.lit("doc_"), F.col("ord").cast("string")).alias("id"))
    return R.aligned(e.select("ord", F.col("embedding").alias("vec")), ids, e.select("ord", F.col("label").alias("value"))).drop("vec")


@query("oa5_caption_groups", raw("WITH c AS (SELECT conv_id, caption, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS b FROM {segments}), x AS (SELECT conv_id, (f // 10)::INT AS i, string_agg(caption, '. ' ORDER BY f) AS forward FROM c GROUP BY ALL), y AS (SELECT conv_id, (b // 10)::INT AS i, string_agg(caption, '. ' ORDER BY b) AS backward FROM c GROUP BY ALL) SELECT conv_id, i, md5(forward) AS forward, md5(backward) AS backward FROM x JOIN y USING (conv_id, i)"))
def caption_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's captions ten by ten, on and back."""
    return U.caption_groups(view(spark, sf_dir, "segments"), "conv_id", "turn", "caption").select("conv_id", "i", F.md5(F.col("forward").cast("binary")).alias("forward"), F.md5(F.col("backward").cast("binary")).alias("backward"))


@query("oa8_folder_table", raw(f"WITH b AS (SELECT string_split(substr(path, 6), '/') AS p, path, size FROM {{on_disk}}), e AS (SELECT DISTINCT p[1] AS name, '/raw/' || p[1] AS path, 'folder' AS kind, NULL::VARCHAR AS type, NULL::BIGINT AS size FROM b WHERE len(p) > 1 UNION ALL SELECT p[1], path, 'file', {_type('path', R.EXTENSIONS)}, size FROM b WHERE len(p) = 1) SELECT (row_number() OVER (ORDER BY kind DESC, lower(name)))::INT AS place, * FROM e"))
def folder_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in the folder of raw files."""
    return U.listing(view(spark, sf_dir, "on_disk"), "/raw")


_RULE = "CASE WHEN contains(d.text, ' the ') THEN 'en' WHEN contains(d.text, ' der ') OR contains(d.text, ' und ') THEN 'de' WHEN contains(d.text, ' que ') THEN 'es' ELSE 'fr' END"
_LABELS = ["de", "en", "es", "fr", "it"]


@query(
    "od17_class_metrics",
    f"""WITH j AS (SELECT lang AS t, {_RULE} AS p FROM documents d), l AS (SELECT unnest({_LABELS}) AS label), m AS (SELECT label, (SELECT count(*) FROM j WHERE t = label AND p = label)::DOUBLE AS tp, (SELECT count(*) FROM j WHERE p = label AND t IN (SELECT label FROM l))::DOUBLE AS g, (SELECT count(*) FROM j WHERE t = label)::DOUBLE AS s FROM l),
    r AS (SELECT label, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS p, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS r, s FROM m), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)
    SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, s::BIGINT AS support, round((SELECT avg((t = p)::INT) FROM j), 4) AS accuracy, round((SELECT avg(f1) FROM f), 4) AS macro_f1 FROM f""",
)
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that tells languages by one word, held against the documents' own: precision, recall and F1 of each, and macro-F1."""
    d = table(spark, sf_dir, "documents").alias("d")
    return U.class_metrics(d.select(F.col("lang").alias("truth"), F.expr(_RULE).alias("guess")), _LABELS)


@query("og1_prune_registered", raw("SELECT rel_key AS key, size FROM {files} WHERE rel_key NOT IN (SELECT key FROM {registered} WHERE key NOT IN (SELECT rel_key FROM {files} f JOIN {on_disk} o ON o.path = f.path))"))
def prune_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of all files, without those registered whose file is gone."""
    f, disk = view(spark, sf_dir, "files"), view(spark, sf_dir, "on_disk").select("path")
    return U.prune(f.select(F.col("rel_key").alias("key"), "size"), view(spark, sf_dir, "registered"), f.join(disk, "path", "left_semi").select(F.col("rel_key").alias("key")))


_INDEX = "SELECT domain, doc_id, CASE WHEN domain = 'Doc' THEN concat('page_images/', stem, '__', substr(md5(CASE WHEN doc_id % 3 = 0 THEN rel_key ELSE key0 END), 1, 8), '/p0001.jpg') ELSE rel_key END AS id FROM (SELECT f.*, CASE WHEN l.quality = 0 THEN concat('staged/', f.rel_key) ELSE f.rel_key END AS key0 FROM {files} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id)"
_KEYS = "SELECT domain, key FROM {registered} WHERE domain <> 'Movie' OR doc_id % 40 = 0"


@query("og4_reconcile_registry", raw(f"WITH i AS ({_INDEX}), k AS ({_KEYS}), g AS (SELECT domain, doc_id, CASE WHEN domain = 'Doc' THEN NOT EXISTS (SELECT 1 FROM k WHERE k.domain = 'Doc' AND i.id = concat('page_images/', regexp_extract(k.key, '([^/]*)[.][^.]*$', 1), '__', substr(md5(k.key), 1, 8), '/p0001.jpg')) ELSE NOT EXISTS (SELECT 1 FROM k WHERE k.domain = i.domain AND k.key = i.id) END AS gone FROM i), p AS (SELECT domain, avg(gone::INT) > 0.8 AS keep FROM g GROUP BY domain) SELECT domain, doc_id FROM g JOIN p USING (domain) WHERE NOT gone OR keep"))
def reconcile_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of pages and media held against the register; films, of which the register has lost most, are left alone."""
    return U.reconcile(sql(spark, sf_dir, _INDEX), sql(spark, sf_dir, _KEYS))[0].select("domain", "doc_id")


_DISK = "SELECT CASE WHEN path LIKE '/raw/Movie/%' THEN 'Movie' WHEN path LIKE '/raw/Rec/%' THEN 'Rec' ELSE 'Doc' END AS domain, path FROM {on_disk}"


@query("og5_audit", raw(f"""WITH r AS {{registered}}, k AS ({_DISK}), named AS (SELECT domain, lower(abs) AS p FROM r WHERE abs IS NOT NULL UNION SELECT domain, lower(alias) FROM r WHERE alias IS NOT NULL), d AS (SELECT DISTINCT domain FROM k)
    SELECT domain, (SELECT count(*) FROM k WHERE k.domain = d.domain) AS files, (SELECT count(*) FROM r WHERE r.domain = d.domain) AS entries, (SELECT count(*) FROM {{files}} f WHERE f.domain = d.domain) AS rows, (SELECT count(*) FROM r WHERE r.domain = d.domain AND abs IS NOT NULL AND lower(abs) NOT IN (SELECT lower(path) FROM k WHERE k.domain = d.domain)) AS orphans,
    (SELECT count(*) FROM k WHERE k.domain = d.domain AND lower(path) NOT IN (SELECT p FROM named n WHERE n.domain = d.domain)) AS missing, (SELECT count(*) FROM r WHERE r.domain = d.domain AND sha IS NULL) AS no_sha, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM r WHERE r.domain = d.domain GROUP BY sha HAVING count(*) > 1)) AS sha_doubles,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM r WHERE r.domain = d.domain GROUP BY regexp_extract(key, '([^/]*)$', 1) HAVING count(*) > 1)) AS name_doubles FROM d"""))
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How files, register and index agree, by domain."""
    return U.audit(view(spark, sf_dir, "registered"), sql(spark, sf_dir, _DISK), view(spark, sf_dir, "files"))


_HITS = "SELECT s.qid, ['image', 'doc_page', 'av'][1 + (s.label % 3)::INT] AS domain, s.row_id, round(s.score, 6) AS confidence, 'f' || (s.row_id % 23) || '/P' || (s.row_id % 9) || '.jpg' AS id, CASE WHEN s.row_id % 4 = 0 THEN '' ELSE '/x/' || (s.row_id % 31) || '/N' || (s.row_id % 6) || '.pdf' END AS file_path, CASE WHEN s.row_id % 5 = 0 THEN '' ELSE 'N' || (s.row_id % 11) || '.pdf' END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) s WHERE rn <= 60"
_LEAF = "regexp_extract({c}, '([^/]*)$', 1)"
_RULES = {
    "path": "coalesce(nullif(file_path, ''), id)",
    "name": f"lower(coalesce(nullif(file_name, ''), {_LEAF.format(c='file_path')}))",
    "domain": f"CASE domain WHEN 'image' THEN 'i:' || {_LEAF.format(c='id')} WHEN 'doc_page' THEN 'd:' || coalesce(nullif(file_name, ''), {_LEAF.format(c='id')}) ELSE 'o:' || row_id END",
}


@query("og6_keep_first_rules", f"WITH {AXES_SQL}, {SCORED_SQL}, h AS ({_HITS}) " + " UNION ALL ".join(f"SELECT '{r}' AS rule, qid, row_id FROM h QUALIFY row_number() OVER (PARTITION BY qid, {k} ORDER BY confidence DESC, id, row_id) = 1" for r, k in _RULES.items()))
def keep_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's best sixty without double ones, by the three rules."""
    i = lambda n: (F.col("row_id") % n).cast("string")
    h = best_rows(spark, sf_dir, 60).select(
        "qid",
        F.array(F.lit("image"), F.lit("doc_page"), F.lit("av"))[F.col("label") % 3].alias("domain"),
        "row_id",
        F.round("score", 6).alias("confidence"),
        F.concat(F.lit("f"), i(23), F.lit("/P"), i(9), F.lit(".jpg")).alias("id"),
        F.when(F.col("row_id") % 4 == 0, "").otherwise(F.concat(F.lit("/x/"), i(31), F.lit("/N"), i(6), F.lit(".pdf"))).alias("file_path"),
        F.when(F.col("row_id") % 5 == 0, "").otherwise(F.concat(F.lit("N"), i(11), F.lit(".pdf"))).alias("file_name"),
    )
    h = workdir_saved(h)
    parts = [U.keep_first(h, r).select(F.lit(r).alias("rule"), "qid", "row_id") for r in _RULES]
    return parts[0].union(parts[1]).union(parts[2])


def workdir_saved(df: DataFrame) -> DataFrame:
    """``df`` written once and read back."""
    path = workdir.fresh(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("og8_top_difference", f"WITH {AXES_SQL}, {SCORED_SQL}, c AS (SELECT q.row_id AS qid, d.row_id, {DOT.format(a='q.re', b='d.re')} AS s FROM axes q, axes d WHERE q.row_id % 100 = 0), a AS (SELECT qid, row_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored) WHERE rn <= 20), b AS (SELECT qid, row_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_id) AS rn FROM c) WHERE rn <= 20) SELECT qid, count(*) FILTER (WHERE a.row_id IS NOT NULL AND b.row_id IS NOT NULL) AS shared, count(*) FILTER (WHERE b.row_id IS NULL) AS only_a, count(*) FILTER (WHERE a.row_id IS NULL) AS only_b FROM a FULL JOIN b USING (qid, row_id) GROUP BY qid")
def top_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best twenty by three axes and by one share, and what either has alone."""
    from orrery.operators import calibration as C
    from orrery.operators.axis_search import channel

    return C.overlap(best_rows(spark, sf_dir, 20).select("qid", "row_id"), best_rows(spark, sf_dir, 20, channel(0)).select("qid", "row_id"))


@query("og10_delete_rebuild", raw("SELECT 'index' AS part, f.file_name AS key, count(*) AS n FROM {files} f WHERE f.file_name NOT IN (SELECT file_name FROM {registered} WHERE toxic = 1) GROUP BY f.file_name UNION ALL SELECT 'recent', rel_key, 1 FROM {files} WHERE doc_id % 5 = 0 AND file_name NOT IN (SELECT file_name FROM {registered} WHERE toxic = 1)"))
def delete_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents leave the index, in one new version, and the list of recent uploads."""
    f = view(spark, sf_dir, "files").select("doc_id", "file_name", "rel_key")
    index = VersionedTable(spark, workdir.fresh(spark, "documents"), key="file_name")
    index.replace(f.select("file_name", "doc_id"))
    toxic = view(spark, sf_dir, "registered").where("toxic = 1").select(F.col("file_name").alias("name"))
    _, recent = U.delete_documents(index, toxic, f.where("doc_id % 5 = 0").select(F.col("rel_key").alias("key")))
    kept = index.read().groupBy(F.col("file_name").alias("key")).agg(F.count("*").alias("n"))
    return kept.select(F.lit("index").alias("part"), "key", "n").union(recent.select(F.lit("recent"), "key", F.lit(1).cast("long")))


@query("og12_link_paths", raw("WITH r AS {registered}, p AS (SELECT lower(abs) AS p FROM r WHERE abs IS NOT NULL UNION SELECT lower(alias) FROM r WHERE alias IS NOT NULL) SELECT arg_max(r.key, r.doc_id) AS key, o.path AS alias FROM {on_disk} o JOIN r ON r.sha = o.sha WHERE lower(o.path) NOT IN (SELECT p FROM p) GROUP BY o.path"))
def link_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk that no entry names become aliases of the entry with their content."""
    return U.link_unregistered(view(spark, sf_dir, "registered").withColumnRenamed("doc_id", "ord"), view(spark, sf_dir, "on_disk").select("path", "sha"))


_RATES = "SELECT label, (count(*) FILTER (WHERE embedding[1] > 0) + 0.5) / (count(*) + 1) AS p FROM embeddings GROUP BY label"


@query("oi2_inverse_of_rates", f"SELECT label, round(p, 4)::DOUBLE AS p, true AS back FROM ({_RATES})")
def inverse_of_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal quantile of each file's rate of positive rows, and whether the distribution of it is the rate again."""
    t = table(spark, sf_dir, "embeddings").groupBy("label").agg(((F.count(F.when(F.element_at("embedding", 1) > 0, 1)) + 0.5) / (F.count("*") + 1)).alias("p"))
    return t.select("label", F.round("p", 4).alias("p"), (F.abs(S.gaussian_cdf(S.inverse_normal(F.col("p"))) - F.col("p")) < 1e-6).alias("back"))


_TRIES = " UNION ALL ".join(f"SELECT v.vec_id - {n} AS qid, {n} AS n, (max(s.score) - avg(s.score)) / greatest(stddev_pop(s.score), 0.05) AS z FROM (SELECT a.row_id AS vec_id, b.row_id, sqrt(pow({DOT.format(a='a.re', b='b.re')}, 2) + pow(0.4 * {DOT.format(a='a.im', b='b.im')}, 2) + pow(0.2 * {DOT.format(a='a.z', b='b.z')}, 2)) AS score FROM axes a, axes b WHERE a.row_id % 100 = {n} AND a.row_id <> b.row_id) s JOIN embeddings v ON v.vec_id = s.vec_id GROUP BY v.vec_id" for n in range(3))


@query("ok6_search_loop", f"WITH {AXES_SQL}, t AS ({_TRIES}), a AS (SELECT q.vec_id AS qid, t.n, coalesce(t.z, -10) AS z FROM embeddings q CROSS JOIN (SELECT unnest([0, 1, 2]) AS n) k LEFT JOIN t ON t.qid = q.vec_id AND t.n = k.n WHERE q.vec_id % 100 = 0 AND t.n IS NOT NULL), d AS (SELECT *, CASE WHEN z >= 3.2 THEN 'return_hits' WHEN z >= 2.9 OR n = 2 THEN 'rerank' END AS decision FROM a) SELECT qid, n AS tries, decision FROM d WHERE decision IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n) = 1")
def search_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over a real search: each round asks the vectors whose queries are open, and goes by how far the best row lies above the rest. A rewritten query is the next row."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))

    def search(queries: DataFrame) -> DataFrame:
        asked = queries.withColumn("vec_id", F.col("qid") + F.length(F.regexp_extract("query", "(!*)$", 1))).join(e.select("vec_id", "embedding"), "vec_id")
        got = asked.select("qid", "vec_id", "embedding").orderBy("vec_id").collect()  # the open queries
        best = AxisSearch(*engine.as_arrays([(r.vec_id, r.embedding) for r in got])).best(rows, 1, own=False)
        z = best.select(F.col("qid").alias("vec_id"), ((F.col("score") - F.col("mu")) / F.greatest("sd", F.lit(0.05))).alias("z"))
        return asked.select("qid", "vec_id").join(z, "vec_id").select("qid", "z")

    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.lit("q").alias("query"))
    r = engine.retrieval_loop(q, search, lambda df: df.select("qid", F.concat("query", F.lit("!")).alias("query")), 3.2, 2.9)
    return r.select("qid", "tries", "decision")

