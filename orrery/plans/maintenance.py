"""Joins, registry upkeep, set operations, history (families A, C, D, G, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.ordered import quantiles
from orrery.plans.registry import query, raw, relational, table

relational("oc2_history_latest", "SELECT h.event_id, h.event_type, h.user_id FROM {events} h JOIN (SELECT user_id, event_type, max(ts) AS at FROM {events} GROUP BY user_id, event_type) m ON h.user_id = m.user_id AND h.event_type = m.event_type AND h.ts = m.at")
relational("oc3_registry_lookup", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
relational("oc13_semi", "SELECT d.doc_id FROM {documents} d LEFT SEMI JOIN {labels} l ON d.doc_id = l.doc_id AND l.toxic = 1", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
relational("od10_type_counts", "SELECT source, lang, count(*) AS n, count(DISTINCT n_chars) AS sizes, sum(n_chars) AS chars FROM {documents} GROUP BY source, lang", "SELECT source, lang, count(*) AS n, count(DISTINCT n_chars) AS sizes, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source, lang")
relational("od11_document_list", "SELECT coalesce(source, '') AS k, count(*) AS n, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS en, max(doc_id) AS last FROM {documents} WHERE length(text) > 0 GROUP BY coalesce(source, '')", "SELECT coalesce(source, '') AS k, count(*) AS n, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS en, max(doc_id) AS last FROM documents WHERE length(text) > 0 GROUP BY coalesce(source, '')")
relational("og1_prune_stale", "SELECT vec_id, label FROM {embeddings} e LEFT ANTI JOIN {labels} l ON e.vec_id = l.doc_id AND l.quality = 0", "SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id AND l.quality = 0)")
relational("og5_consistency", "SELECT count(*) AS docs, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS missing FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
relational("og6_keep_first", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM {documents}) WHERE rn = 1")
# a kind's first event by partial aggregation, so a user's list holds kinds, not events
relational("og7_ordered_distinct", "SELECT user_id, array_join(transform(array_sort(collect_list(struct(first.ts, first.event_id, event_type))), x -> x.event_type), ',') AS kinds FROM (SELECT user_id, event_type, min(struct(ts, event_id)) AS first FROM {events} GROUP BY user_id, event_type) GROUP BY user_id", "SELECT user_id, string_agg(event_type, ',' ORDER BY f, g) AS kinds FROM (SELECT user_id, event_type, min(ts) AS f, min_by(event_id, ts) AS g FROM events GROUP BY user_id, event_type) GROUP BY user_id")
relational("og8_set_difference", "SELECT lang, size(array_intersect(a, b)) AS both_sets, size(array_except(a, b)) + size(array_except(b, a)) AS differ FROM (SELECT lang, collect_set(CASE WHEN doc_id % 2 = 0 THEN source END) AS a, collect_set(CASE WHEN doc_id % 3 = 0 THEN source END) AS b FROM {documents} GROUP BY lang)", "SELECT lang, len(list_intersect(a, b))::INT AS both_sets, (len(a) + len(b) - 2 * len(list_intersect(a, b)))::INT AS differ FROM (SELECT lang, list(DISTINCT source) FILTER (WHERE doc_id % 2 = 0) AS a, list(DISTINCT source) FILTER (WHERE doc_id % 3 = 0) AS b FROM documents GROUP BY lang)")
relational("og9_history_dedup", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn = 1")
relational("og11_duplicate_upload", "SELECT d.doc_id FROM {documents} d LEFT SEMI JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM {documents} GROUP BY md5(text)) k ON md5(d.text) = k.h AND d.doc_id > k.first", "SELECT doc_id FROM documents d WHERE doc_id > (SELECT min(doc_id) FROM documents x WHERE md5(x.text) = md5(d.text))")
# a row a document: a text's copies, of any number, are never put in one value
relational("og12_alias_union", "WITH d AS (SELECT md5(text) AS sha, doc_id FROM {documents}), c AS (SELECT sha, min(doc_id) AS entry, count(*) AS copies FROM d GROUP BY sha HAVING count(*) > 1) SELECT d.sha, d.doc_id AS alias, c.entry, c.copies FROM d JOIN c ON c.sha = d.sha")


@query("od6_percentiles", raw("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type"))
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 and p99 beside mean and deviation of every event type's values."""
    e = table(spark, sf_dir, "events")
    figures = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mu"), F.round(F.stddev_pop("value"), 6).alias("sd"))
    q = quantiles(e, ["event_type"], "value", {"p95": 0.95, "p99": 0.99})
    return figures.join(q, "event_type").select("event_type", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"), "mu", "sd")
