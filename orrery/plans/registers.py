"""Files, registers and their upkeep (families A, C, D, G, O): the operators of ``orrery.operators.registers`` over the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.operators import registers as R
from orrery.plans.registry import query, raw, sql, table, view
from orrery.plans.vectors import AXES_SQL, SCORED_SQL, best_rows
from orrery.sources import workdir

_END = r"lower(regexp_extract({p}, '[^./][^/]*[.]([^./]+)$', 1))"


def _type(path: str, table: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_END.format(p=path)} IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in table.items()) + " END"


@query("oa1_aligned_load", "SELECT e.vec_id AS ord, coalesce(l.id, '') AS id, CASE WHEN (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) THEN d.n_chars END AS value FROM embeddings e LEFT JOIN (SELECT doc_id AS ord, 'doc_' || doc_id AS id FROM labels) l ON l.ord = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id")
def aligned_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their names (only labelled rows have one) and a channel that counts only if it is as long as the vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"))
    channel = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("n_chars").alias("value"))
    return R.aligned(vectors, ids, channel).drop("vec")


@query("oa7_type_routing", raw(f"SELECT path, {_type('path', R.EXTENSIONS)} AS type FROM {{on_disk}} UNION ALL SELECT url, {_type('url', R.EXTENSIONS)} FROM {{pages}}"))
def type_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file on disk, and every page's address, by its ending."""
    paths = view(spark, sf_dir, "on_disk").select("path").unionAll(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    return paths.select("path", R.file_type(F.col("path")).alias("type"))


@query("oa8_folder_scan")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the data folder itself; tests hold it against the operating system's listing."""
    return R.folder_listing(spark, sf_dir).select("name", "kind", "type", "size")


_HISTORY = "id BIGINT, query STRING, method STRING, searched_at TIMESTAMP"


@query("oa15_append", "SELECT vec_id, label FROM embeddings")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index that grows by two appends."""
    path = workdir.fresh(spark, "index")
    e = table(spark, sf_dir, "embeddings")
    odd = F.col("label") % 2 == 1
    R.append(e.where(odd), path, "vec_id BIGINT, label INT")
    R.append(e.where(~odd | odd.isNull()), path, "vec_id BIGINT, label INT")
    return spark.read.parquet(path)


@query("oa17_typed_append", raw("SELECT id, query, method, searched_at FROM {history}"))
def typed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches written to a table of fixed columns, from text, and read back."""
    path = workdir.fresh(spark, "history")
    h = view(spark, sf_dir, "history")
    R.append(h.select(F.col("id").cast("string").alias("id"), "query", "method", F.col("searched_at").cast("string").alias("searched_at")), path, _HISTORY)
    return spark.read.parquet(path)


_CHUNKS = "SELECT doc_id AS id, rel_key AS file_path, sha FROM {files}"


@query("oa13_upsert", raw("WITH c AS (" + _CHUNKS + "), u AS (SELECT f.doc_id AS id, f.rel_key AS file_path, upper(f.sha) AS sha FROM {files} f JOIN {labels} l ON l.doc_id = f.doc_id WHERE l.toxic = 1), kept AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u), gone AS (SELECT r.doc_id FROM {registered} r WHERE r.quality = 0) SELECT file_path, count(*) AS n, max(sha) AS sha FROM kept WHERE id NOT IN (SELECT doc_id FROM gone) GROUP BY file_path"))
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values by id, then deletion of whole files, then the count of each file."""
    c = view(spark, sf_dir, "files").select(F.col("doc_id").alias("id"), F.col("rel_key").alias("file_path"), "sha")
    r = view(spark, sf_dir, "registered")
    news = c.join(r.where("toxic = 1").select(F.col("doc_id").alias("id")), "id").withColumn("sha", F.upper("sha"))
    kept = R.replace_by_file(c, news, "id").join(r.where("quality = 0").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return kept.groupBy("file_path").agg(F.count("*").alias("n"), F.max("sha").alias("sha"))


_ASKED = "(SELECT path FROM {on_disk} UNION SELECT alias FROM {registered} WHERE alias IS NOT NULL UNION SELECT upper(abs) FROM {registered} WHERE abs IS NOT NULL UNION SELECT concat('/raw/', domain, '/', key) FROM {registered})"


@query(
    "oc5_path_lookup",
    raw(
        f"""WITH r AS {{registered}}, a AS {_ASKED}, d AS {{on_disk}}, n AS (SELECT lower(abs) AS k, key, domain, abs AS p FROM r WHERE abs IS NOT NULL UNION ALL SELECT lower(alias), key, domain, alias FROM r WHERE alias IS NOT NULL),
        x AS (SELECT k, arg_max(domain, key) AS domain FROM n GROUP BY k), y AS (SELECT lower('/raw/' || domain || '/' || key) AS k, arg_max(domain, key) AS domain FROM r GROUP BY 1),
        z AS (SELECT d.size, lower(d.file_name) AS name, arg_max(n.domain, n.key) AS domain FROM n JOIN d ON lower(d.path) = n.k GROUP BY 1, 2)
        SELECT a.path, coalesce(x.domain, y.domain, z.domain) AS domain FROM a LEFT JOIN x ON x.k = lower(a.path) LEFT JOIN y ON y.k = lower(a.path) LEFT JOIN d ON d.path = a.path LEFT JOIN z ON z.size = d.size AND z.name = lower(d.file_name)"""
    ),
)
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = view(spark, sf_dir, "registered"), view(spark, sf_dir, "on_disk")
    asked = d.select("path").union(r.where("alias is not null").select("alias")).union(r.where("abs is not null").select(F.upper("abs"))).union(r.select(F.concat(F.lit("/raw/"), "domain", F.lit("/"), "key")))
    return R.lookup(asked, r, d)


@query(
    "oc4_prioritised_lookup",
    raw(
        """WITH r AS (SELECT *, concat(stem, '__', substr(md5(key), 1, 8)) AS hashed FROM {registered}), s AS (SELECT hashed AS stem FROM r UNION SELECT concat(stem, '__old') FROM r WHERE quality = 0 UNION SELECT stem FROM r WHERE abs IS NULL UNION SELECT 'nothing'),
        f AS (SELECT s.stem, r.*, regexp_extract(r.key, '([^/]*)$', 1) AS file FROM s JOIN r ON s.stem = r.hashed),
        g AS (SELECT s.stem AS asked, coalesce(r.abs, '') AS at, regexp_extract(r.key, '([^/]*)$', 1) AS file FROM s JOIN r ON r.stem = regexp_replace(s.stem, '__old$', '') WHERE s.stem NOT IN (SELECT stem FROM f) OR (s.stem NOT LIKE '%\\_\\_%' ESCAPE '\\'))
        SELECT s.stem, coalesce((SELECT any_value(coalesce(f.abs, '')) FROM f WHERE f.stem = s.stem), (SELECT any_value(g.at) FROM g WHERE g.asked = s.stem)) AS path, coalesce((SELECT any_value(f.file) FROM f WHERE f.stem = s.stem), (SELECT any_value(g.file) FROM g WHERE g.asked = s.stem)) AS file_name FROM s"""
    ),
)
def stem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page stems in the present form, in an older one with another hash, without one, and one that is nobody's."""
    r = view(spark, sf_dir, "registered")
    stems = r.select(R.stem_key(F.col("key")).alias("stem")).union(r.where("quality = 0").select(F.concat("stem", F.lit("__old")))).union(r.where("abs is null").select("stem")).union(spark.sql("SELECT 'nothing' AS stem"))
    return R.stem_sources(stems, r)


@query("oc6_orphans", raw("SELECT abs, domain FROM {registered} WHERE abs IS NOT NULL AND abs NOT IN (SELECT path FROM {on_disk})"))
def orphaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered path that is not on disk."""
    return R.orphans(view(spark, sf_dir, "registered"), view(spark, sf_dir, "on_disk"), "/raw")


@query("oc7_unregistered", raw("SELECT path FROM {on_disk} WHERE path NOT IN (SELECT abs FROM {registered} WHERE abs IS NOT NULL)"))
def unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "on_disk").join(view(spark, sf_dir, "registered").where("abs is not null").select(F.col("abs").alias("path")), "path", "left_anti").select("path")


_META = "SELECT d.doc_id AS ord, CASE d.lang WHEN 'en' THEN lower(f.stem) WHEN 'fr' THEN lower(f.file_name) WHEN 'de' THEN substr(lower(f.stem), 1, length(f.stem) - 1) ELSE concat('  ', substr(lower(f.stem), 4)) END AS key, d.source AS text FROM {documents} d JOIN {files} f ON f.doc_id = d.doc_id WHERE d.doc_id IN (SELECT doc_id FROM {labels})"


@query(
    "oc14_metadata_cascade",
    raw(
        f"""WITH m AS ({_META}), n AS (SELECT DISTINCT file_name, lower(stem) AS stem FROM {{files}}), h AS (
        SELECT n.file_name, m.ord, m.text, CASE WHEN m.key = n.stem THEN 1 WHEN m.key = lower(n.file_name) THEN 2 WHEN starts_with(n.stem, m.key) OR starts_with(m.key, substr(n.stem, 1, 30)) THEN 3 ELSE 4 END AS prio
        FROM n JOIN m ON m.key = n.stem OR m.key = lower(n.file_name) OR starts_with(n.stem, m.key) OR starts_with(m.key, substr(n.stem, 1, 30)) OR (length(replace(m.key, ' ', '')) >= 3 AND contains(replace(n.stem, ' ', ''), replace(m.key, ' ', ''))))
        SELECT n.file_name, arg_min(h.text, h.prio * 100000000 + h.ord) AS text FROM n LEFT JOIN h ON h.file_name = n.file_name GROUP BY n.file_name"""
    ),
)
def metadata_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata keys that are stems, whole names, starts of stems, and parts of them."""
    return R.metadata_of(view(spark, sf_dir, "files"), sql(spark, sf_dir, _META))


RECENT = [3, 1, 4]


@query(
    "oc17_recent_union",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, k(label, place) AS (VALUES {', '.join(f'({x}, {i})' for i, x in enumerate(RECENT))}), t AS (SELECT s.*, k.place, row_number() OVER (PARTITION BY qid, s.label ORDER BY score DESC, row_id) AS rn FROM scored s JOIN k ON k.label = s.label),
    u AS (SELECT *, count(*) OVER (PARTITION BY qid, place) AS n FROM t WHERE rn <= 20), c AS (SELECT u.*, coalesce((SELECT sum(x.n) FROM (SELECT DISTINCT qid, place, n FROM u) x WHERE x.qid = u.qid AND x.place < u.place), 0) AS before FROM u)
    SELECT qid, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS r FROM c WHERE before < 20) WHERE r <= 20""",
)
def recent_union(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Searches within the documents uploaded last, in that order, until k rows are together; then by score."""
    place = F.array_position(F.array(*map(F.lit, RECENT)), F.col("label"))
    s = best_rows(spark, sf_dir, k, group=F.col("label"), where=f"label IN ({', '.join(map(str, RECENT))})").withColumn("place", place).drop("n")
    n = s.groupBy("qid", "place").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.join(n.where(F.col("before") < k).select("qid", "place"), ["qid", "place"])
    return s.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row_id"))).where(F.col("r") <= k).select("qid", "row_id", F.round("score", 6).alias("score"))


@query("od14_sha_duplicates", raw("WITH r AS {registered}, d AS (SELECT DISTINCT path FROM {on_disk}), g AS (SELECT r.*, count(*) OVER (PARTITION BY sha) AS n, starts_with(key, 'staged/') AS staged, abs IN (SELECT path FROM d) AS there FROM r) SELECT sha, key, doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY staged, CASE WHEN NOT staged AND there THEN 0 ELSE 1 END, doc_id) AS keep, doc_id = min(doc_id) OVER (PARTITION BY sha) AS keep_media FROM g WHERE n > 1"))
def sha_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of equal content with what each of the two policies keeps (all keys here are relative)."""
    r = view(spark, sf_dir, "registered")
    return R.keep_one(r, view(spark, sf_dir, "on_disk")).join(R.keep_one_media(r).withColumnRenamed("keep", "keep_media"), ["sha", "key"])


_COST = "CASE " + " ".join(f"WHEN type = '{k}' THEN {b} + {m} * mb" for k, (b, m) in R.SECONDS.items()) + " END"


@query("od15_time_estimate", raw(f"WITH f AS (SELECT {_type('path', R.ESTIMATED)} AS type, size / 1048576.0::DOUBLE AS mb, path IN (SELECT abs FROM {{registered}} WHERE abs IS NOT NULL) AS skip FROM {{on_disk}}) SELECT type, count(*) AS files, count(*) FILTER (WHERE skip AND type IS NOT NULL) AS skipped, round(sum(CASE WHEN type IS NULL THEN 0 WHEN skip THEN 0.05 + 0.005 * mb ELSE {_COST} END), 4) AS seconds FROM f GROUP BY type"))
def time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "registered").where("abs is not null").select(F.col("abs").alias("path"), F.lit(True).alias("known")).distinct()
    f = view(spark, sf_dir, "on_disk").join(known, "path", "left")
    return R.estimate(f, F.coalesce("known", F.lit(False))).withColumn("seconds", F.round("seconds", 4))


@query(
    "od16_summary_candidate",
    f"""WITH {AXES_SQL}, {SCORED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rn FROM scored), g AS (SELECT qid, label, count(*) AS n, sum(score) AS s FROM t WHERE rn <= 30 GROUP BY qid, label), b AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY n DESC, round(s, 9) DESC, label) AS r FROM g)
    SELECT t.qid, t.label, t.row_id, (row_number() OVER (PARTITION BY t.qid ORDER BY t.row_id))::INT AS place FROM t JOIN b ON b.qid = t.qid AND b.label = t.label WHERE t.rn <= 30 AND b.r = 1""",
)
def summary_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a search's hits those of the document with most of them, then the greatest sum of scores; in page order."""
    q = Window.partitionBy("qid")
    hits = best_rows(spark, sf_dir, 30)
    g = hits.groupBy("qid", "label").agg(F.count("*").alias("n"), F.sum("score").alias("s")).withColumn("r", F.row_number().over(q.orderBy(F.desc("n"), F.round("s", 9).desc(), "label"))).where("r = 1")
    return hits.join(g.select("qid", "label"), ["qid", "label"]).select("qid", "label", "row_id", F.row_number().over(q.orderBy("row_id")).alias("place"))


@query("og2_replace_by_file", raw("SELECT coalesce(l.quality, -1) AS quality, count(*) AS n, sum(CASE WHEN s.turn < 100 THEN 1 ELSE 0 END)::BIGINT AS old_rows FROM (SELECT file_path, conv_id, turn FROM {segments} WHERE conv_id NOT IN (SELECT doc_id FROM {labels} WHERE quality = 0) UNION ALL SELECT file_path, conv_id, turn + 100 FROM {segments} WHERE conv_id IN (SELECT doc_id FROM {labels} WHERE quality = 0) AND turn < 3) s LEFT JOIN {labels} l ON l.doc_id = s.conv_id GROUP BY 1"))
def replace_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that were labelled poor come again with three segments each: none of their old ones stays."""
    s, labels = view(spark, sf_dir, "segments").select("file_path", "conv_id", "turn"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    again = s.where("turn < 3").join(labels.where("quality = 0").select("conv_id"), "conv_id", "left_semi").withColumn("turn", F.col("turn") + 100)
    return R.replace_by_file(s, again, "file_path").join(labels, "conv_id", "left").groupBy(F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"), F.sum((F.col("turn") < 100).cast("long")).alias("old_rows"))


@query("og2_removed", raw("SELECT (SELECT count(*) FROM {segments}) - (SELECT count(*) FROM {segments} WHERE conv_id IN (SELECT doc_id FROM {labels} WHERE quality = 0)) + (SELECT count(*) FROM {segments} WHERE conv_id IN (SELECT doc_id FROM {labels} WHERE quality = 0) AND turn < 3) AS rows, (SELECT count(*) FROM {segments} WHERE conv_id IN (SELECT doc_id FROM {labels} WHERE quality = 0)) AS removed"))
def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, labels = view(spark, sf_dir, "segments").select("file_path", "conv_id", "turn"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    again = s.where("turn < 3").join(labels.where("quality = 0").select("conv_id"), "conv_id", "left_semi")
    return R.removed_count(s, again, "file_path")


@query("og3_incremental_diff", raw("SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'deleted' WHEN o.sha <> n.sha THEN 'modified' ELSE 'same' END AS state FROM (SELECT rel_key AS key, CASE WHEN l.toxic = 0 AND l.quality = 0 THEN 'old' ELSE f.sha END AS sha FROM {files} f JOIN {labels} l ON l.doc_id = f.doc_id) o FULL JOIN (SELECT rel_key AS key, f.sha FROM {files} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id WHERE coalesce(l.toxic, 0) = 0) n ON n.key = o.key"))
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register (poor files had other content then) against what is on disk."""
    f, labels = view(spark, sf_dir, "files").select("doc_id", F.col("rel_key").alias("key"), "sha"), table(spark, sf_dir, "labels")
    old = f.join(labels, "doc_id").withColumn("sha", F.when((F.col("toxic") == 0) & (F.col("quality") == 0), "old").otherwise(F.col("sha")))
    return R.diff(old, f.join(labels.where("toxic = 1"), "doc_id", "left_anti"))


@query("og13_registry_gc", raw("SELECT key FROM {registered} WHERE abs IS NULL OR abs IN (SELECT path FROM {on_disk})"))
def registry_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register without the entries whose file is gone; those without a path stay."""
    r = view(spark, sf_dir, "registered")
    return r.join(R.orphans(r, view(spark, sf_dir, "on_disk")).select("abs").distinct(), "abs", "left_anti").select("key")


_PAGE_IDS = "SELECT doc_id, concat('page_images/', stem, '__', substr(md5(rel_key), 1, 8), '/p', lpad(CAST(i AS STRING), 4, '0'), '.jpg') AS id FROM {files}, "


@query("oo6_purge_changed", raw("SELECT id FROM (" + _PAGE_IDS + "range(3) t(i)) WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1)"))
def purge_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of documents that went, by the stem in their ids."""
    f = view(spark, sf_dir, "files").select(F.col("rel_key").alias("key"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    pages = f.select(F.concat(F.lit("page_images/"), R.stem_key(F.col("key")), F.lit("/p"), F.lpad(F.col("i").cast("string"), 4, "0"), F.lit(".jpg")).alias("id"))
    gone = view(spark, sf_dir, "files").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select(F.col("rel_key").alias("key"))
    return R.purge_pages(pages, gone)


@query("oo7_image_diff", raw("WITH o AS (SELECT rel_key AS key, f.sha FROM {files} f JOIN {labels} l ON l.doc_id = f.doc_id), n AS (SELECT rel_key AS key, CASE WHEN l.quality = 0 THEN concat(f.sha, '2') ELSE f.sha END AS sha FROM {files} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id WHERE coalesce(l.toxic, 0) = 0) SELECT n.key, n.sha, coalesce(o.sha, '') <> n.sha AS encode FROM n LEFT JOIN o ON o.key = n.key WHERE o.key IS NULL OR o.sha = n.sha OR o.sha <> n.sha"))
def image_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose file is gone are pruned, those of other content replaced; what is new or replaced must be encoded."""
    f, labels = view(spark, sf_dir, "files").select("doc_id", F.col("rel_key").alias("key"), "sha"), table(spark, sf_dir, "labels")
    old = f.join(labels, "doc_id", "left_semi")
    new = f.join(labels, "doc_id", "left").where("coalesce(toxic, 0) = 0").withColumn("sha", F.when(F.col("quality") == 0, F.concat("sha", F.lit("2"))).otherwise(F.col("sha")))
    state = R.diff(old, new)
    return new.join(state, "key").select("key", "sha", (F.col("state") != "same").alias("encode"))


@query("oo25_upload_validation", raw(f"SELECT path, coalesce({_END.format(p='path')} IN ('pdf', 'hwpx', 'png', 'jpg', 'jpeg', 'heic', 'webp'), false) AND size <= {R.UPLOAD_MOST} AS ok FROM {{on_disk}}"))
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "on_disk").select("path", (R.ending(F.col("path")).isin("pdf", "hwpx", "png", "jpg", "jpeg", "heic", "webp") & (F.col("size") <= R.UPLOAD_MOST)).alias("ok"))


_TOKENS = ["src1", "report_12", "SRC-2/", "erst", "x"]
_NORM = lambda c: f"lower(regexp_replace({c}, '[^0-9A-Za-z가-힣]', '', 'g'))"


@query(
    "ob16_document_token",
    raw(f"WITH t(token) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in _TOKENS)}), c AS (SELECT doc_id, {_NORM('concat(file_name, chr(32), path)')} AS meta, {_NORM('text')} AS body FROM {{files}}), h AS (SELECT token, doc_id, contains(meta, {_NORM('token')}) AS m, contains(body, {_NORM('token')}) AS b FROM t, c WHERE length({_NORM('token')}) >= 2), g AS (SELECT *, max(m::INT) OVER (PARTITION BY token) AS any_meta FROM h) SELECT token, doc_id FROM g WHERE CASE WHEN any_meta = 1 THEN m ELSE coalesce(b, false) END UNION ALL SELECT token, doc_id FROM t, c WHERE length({_NORM('token')}) < 2"),
)
def document_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a request's document token leaves: by name or path if any has it there, else by text; a token of one character leaves all."""
    from orrery.operators.requests import token_filter

    c = view(spark, sf_dir, "files").select("doc_id", F.concat_ws(" ", "file_name", "path").alias("meta"), "text")
    return token_filter(c, _TOKENS, "doc_id", "meta", "text")


@query("ob4_row_paired_score", f"WITH {AXES_SQL} SELECT a.row_id, round(sqrt(pow(list_sum(list_transform(list_zip(a.re, b.re), lambda p: p[1] * p[2])), 2) + pow(0.4 * list_sum(list_transform(list_zip(a.im, b.im), lambda p: p[1] * p[2])), 2) + pow(0.2 * list_sum(list_transform(list_zip(a.z, b.z), lambda p: p[1] * p[2])), 2)), 6) AS three, round(sqrt(pow(list_sum(list_transform(list_zip(a.re, b.re), lambda p: p[1] * p[2])), 2) + pow(0.4 * list_sum(list_transform(list_zip(a.im, b.im), lambda p: p[1] * p[2])), 2)), 6) AS two FROM axes a JOIN axes b ON b.row_id = a.row_id + 1")
def row_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of rows that are already side by side: each vector and the next, on three axes and on two."""
    from orrery.plans.vectors import axes

    a = axes(spark, sf_dir)
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("re").alias("re2"), F.col("im").alias("im2"), F.col("z").alias("z2"))
    d = lambda x: V.dot(F.col(x), F.col(x + "2"))
    return a.join(b, "row_id").select("row_id", F.round(V.three_axis(d("re"), d("im"), d("z")), 6).alias("three"), F.round(V.two_axis(d("re"), d("im")), 6).alias("two"))


_FOLDERS = "SELECT concat(CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'app_movie_' WHEN 1 THEN 'app_music_' ELSE 'other_' END, CAST(user_id AS STRING)) AS folder, ts AS changed, CAST(floor(value * 100) AS BIGINT) AS size FROM {events}"


@query("ok9_expired_folders", raw(f"WITH f AS ({_FOLDERS}), n AS (SELECT max(changed) AS now FROM f) SELECT folder, sum(size)::BIGINT AS bytes, max(changed) < max(now) - INTERVAL 36 HOUR AS stale FROM f, n WHERE folder LIKE 'app\\_movie\\_%' ESCAPE '\\' OR folder LIKE 'app\\_music\\_%' ESCAPE '\\' GROUP BY folder"))
def expired_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' temporary folders at the time of the last event, stale 36 hours after their own last one."""
    f = sql(spark, sf_dir, _FOLDERS)
    found = R.expired(f, ["app_movie_", "app_music_"], 36 * 3600, F.lit(f.agg(F.max("changed")).first()[0]))
    return found.select("folder", "bytes", "stale")
