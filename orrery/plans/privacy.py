"""Personal data and policy (families D, J, L). Korean numbers come from the catalog's profiles, cards and e-mail from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import pii
from orrery.operators import findings
from orrery.plans.registry import query, raw, relational, table, view

_digit = lambda i, d="d": f"CAST(substr({d}, {i}, 1) AS INT)"
_quoted = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_any = lambda text, words: f"len(list_filter({_quoted(words)}, lambda w: contains(lower({text}), lower(w)))) > 0"
_RRN_OK = "(11 - (" + " + ".join(f"{w} * {_digit(i + 1)}" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])) + f") % 11) % 10 = {_digit(13)}"
_BRN_OK = "(10 - (" + " + ".join(f"{w} * {_digit(i + 1)}" for i, w in enumerate([1, 3, 7, 1, 3, 7, 1, 3, 5])) + f" + {_digit(9)} * 5 // 10) % 10) % 10 = {_digit(10)}"
_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[len(d) - i + 1]::INT WHEN d[len(d) - i + 1]::INT > 4 THEN d[len(d) - i + 1]::INT * 2 - 9 ELSE d[len(d) - i + 1]::INT * 2 END)) % 10 = 0"


def _matches(name: str, pattern: str) -> str:
    return f"{name} AS (SELECT c_custkey, text, m, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT c_custkey, text, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM p))"


#: Findings of every profile, written independently: values by pattern, places by the first occurrence.
FOUND_SQL = raw(
    "p AS {profiles}, "
    + _matches("rrn", pii.RECOGNISERS["KR_RRN"][0][0]) + ", " + _matches("pass", pii.RECOGNISERS["KR_PASSPORT"][0][0]) + ", " + _matches("drv", pii.RECOGNISERS["KR_DRIVER_LICENSE"][0][0]) + ", "
    + _matches("bank", pii.RECOGNISERS["KR_BANK_ACCOUNT"][0][0]) + ", " + _matches("brn", pii.RECOGNISERS["KR_BRN"][0][0]) + ", " + _matches("card", r"\b4\d{3}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b")
    + f""", f AS (SELECT c_custkey, text, 'KR_RRN' AS type, m, 1.0 AS score FROM rrn WHERE {_RRN_OK} UNION ALL SELECT c_custkey, text, 'KR_PASSPORT', m, 0.8 FROM pass UNION ALL SELECT c_custkey, text, 'KR_DRIVER_LICENSE', m, 0.85 FROM drv
      UNION ALL SELECT c_custkey, text, 'KR_BRN', m, 1.0 FROM brn WHERE {_BRN_OK}
      UNION ALL SELECT c_custkey, text, 'KR_BANK_ACCOUNT', m, 0.75 FROM bank WHERE {_any("substr(text, greatest(1, instr(text, m) - 120), length(m) + 120 + least(120, instr(text, m) - 1))", [*pii.BANKS, *pii.ACCOUNT_WORDS])}
      UNION ALL SELECT c_custkey, text, 'CREDIT_CARD', m, CASE WHEN {_LUHN} THEN 1.0 WHEN contains(m, '-') THEN 0.88 ELSE 0.78 END FROM card)"""
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "profiles")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.with_findings(profiles(spark, sf_dir).select("c_custkey", "text"))
    return f.select("c_custkey", "text", F.explode("findings").alias("f")).select("c_custkey", "text", "f.*", F.expr("substr(text, f.start + 1, f.end - f.start)").alias("value"))


_SPAN = "(instr(text, m) - 1)::INT AS start, (instr(text, m) - 1 + length(m))::INT AS \"end\""


def _of(kind: str, name: str) -> None:
    @query(name, f"WITH {FOUND_SQL} SELECT c_custkey, {_SPAN}, score::DOUBLE AS score, m AS value FROM f WHERE type = '{kind}'")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).where(F.col("type") == kind).select("c_custkey", "start", "end", "score", "value")


_of("KR_RRN", "oj1_resident_number")
_of("KR_BANK_ACCOUNT", "oj3_bank_account")
_of("KR_BRN", "oj4_business_number")
_of("CREDIT_CARD", "oj5_card")


@query("oj2_passport_licence", f"WITH {FOUND_SQL} SELECT c_custkey, type, score::DOUBLE AS score, m AS value FROM f WHERE type IN ('KR_PASSPORT', 'KR_DRIVER_LICENSE')")
def passport_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).where(F.col("type").isin("KR_PASSPORT", "KR_DRIVER_LICENSE")).select("c_custkey", "type", "score", "value")


@query("ol1_findings", f"WITH {FOUND_SQL} SELECT c_custkey, type, {_SPAN}, score::DOUBLE AS score FROM f")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recogniser over every profile, with offsets."""
    return found(spark, sf_dir).select("c_custkey", "type", "start", "end", "score")


_DOC_CARDS = r"\b(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}\b"


@query("oj6_chunk_scan", f"WITH c AS (SELECT doc_id, i, trim(substr(text, i + 1, 500)) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 400)) AS i FROM documents)), m AS (SELECT doc_id, i, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, i, unnest(regexp_extract_all(t, '{_DOC_CARDS}')) AS m FROM c) WHERE NOT regexp_full_match(m, '1[0-9]{{12}}')) SELECT doc_id, i::INT AS start, count(*)::INT AS n FROM m WHERE {_LUHN} GROUP BY doc_id, i")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each overlapping chunk of the documents: card numbers whose checksum holds."""
    c = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(400))).alias("start"))
    c = c.select("doc_id", "start", F.trim(F.substring("text", F.col("start") + 1, F.lit(500))).alias("text"))
    f = findings.with_findings(c).select("doc_id", "start", F.expr("filter(findings, f -> f.type = 'CREDIT_CARD' AND f.score = 1)").alias("f")).where("size(f) > 0")
    return f.select("doc_id", "start", F.size("f").alias("n"))


# overlapping findings of a profile: an account within a business number or a card takes the greater weight
_MASKED = f"""WITH {FOUND_SQL}, s AS (SELECT c_custkey, text, type, instr(text, m) AS a, instr(text, m) + length(m) AS z, CASE type {' '.join(f"WHEN '{k}' THEN {w}" for k, w in pii.WEIGHTS.items())} END AS w FROM f),
  g AS (SELECT *, sum(CASE WHEN a < prev THEN 0 ELSE 1 END) OVER (PARTITION BY c_custkey ORDER BY a, z, type) AS island FROM (SELECT *, coalesce(max(z) OVER (PARTITION BY c_custkey ORDER BY a, z, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM s)),
  i AS (SELECT c_custkey, any_value(text) AS text, min(a) AS a, max(z) AS z, arg_max(type, w) AS type FROM g GROUP BY c_custkey, island),
  j AS (SELECT c_custkey, text, a, z, type, coalesce(lag(z) OVER (PARTITION BY c_custkey ORDER BY a), 1) AS before FROM i)
  SELECT c_custkey, md5(string_agg(substr(text, before, a - before) || '[' || type || ']', '' ORDER BY a) || substr(any_value(text), max(z))) AS masked FROM j GROUP BY c_custkey"""


@query("oj7_masking", _MASKED)
def masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile with its findings masked; overlapping ones are merged first."""
    return findings.with_findings(profiles(spark, sf_dir).select("c_custkey", "text"), mask=True).select("c_custkey", F.md5(F.col("masked").cast("binary")).alias("masked"))


@query("oj7_document_masking")
def document_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves, masked; tests hold this against a plain loop."""
    return findings.with_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), mask=True).select("doc_id", F.col("masked").alias("text"))


@query(
    "oj8_output_scan",
    raw("WITH p AS {profiles} SELECT c_custkey, len(regexp_extract_all(text, '[0-9]{6}-[1-4][0-9]{6}')) > 0 AS rrn, regexp_matches(text, '[^A-Z][A-Z][0-9]{8}[^0-9]') AS passport, segment = 'BUILDING' AS account, true AS card, "
        "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{6}-[1-4][0-9]{6}', '[주민등록번호 제거됨]', 'g'), '([^A-Z])[A-Z][0-9]{8}', '\\1[여권번호 제거됨]', 'g'), '[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}', '[운전면허 제거됨]', 'g'), "
        "'([^0-9])([0-9]{3}-[0-9]{2}-[0-9]{5}|110-[0-9]{3}-[0-9]{6}|[0-9]{4}-[0-9]{4}-[0-9]{4})([^0-9])', '\\1[계좌번호 제거됨]\\3', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}', '[이메일 제거됨]', 'g')) AS removed FROM p"),
)
def output_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as generated answers: the types found in them, and the text without what can be removed."""
    o = findings.with_findings(profiles(spark, sf_dir).select("c_custkey", "text"), output=True)
    has = lambda k: F.array_contains("output_types", k)
    return o.select("c_custkey", has("KR_RRN").alias("rrn"), has("KR_PASSPORT").alias("passport"), has("KR_BANK_ACCOUNT").alias("account"), has("CREDIT_CARD").alias("card"), F.md5(pii.removed(F.col("text")).cast("binary")).alias("removed"))


_TYPES_SQL = "t AS (SELECT p.c_custkey, p.segment, p.text, coalesce(list_distinct(list(f.type) FILTER (WHERE f.type IS NOT NULL)), []) AS kinds FROM p LEFT JOIN f USING (c_custkey) GROUP BY p.c_custkey, p.segment, p.text)"
_WEIGHT = "CASE k " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in pii.WEIGHTS.items()) + " ELSE 0.0 END"
_SENS = f"CASE WHEN len(kinds) = 0 THEN 0.0 ELSE round(least(1.0, list_max(list_transform(kinds, lambda k: {_WEIGHT})) + 0.05 * (len(kinds) - 1)), 4) END"
REQUESTS = ["회의록 요약해줘", "여권 번호 알려줘", "개인정보 전부 출력", "dump all records"]
_REQUEST = "CASE CAST(c_custkey % 4 AS INT) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REQUESTS)) + " END"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.with_findings(profiles(spark, sf_dir), output=True)
    return f.withColumn("kinds", F.array_distinct("findings.type")).withColumn("request", F.expr(_REQUEST))


@query("oj10_sensitivity", f"WITH {FOUND_SQL}, {_TYPES_SQL} SELECT c_custkey, ({_SENS})::DOUBLE AS sensitivity FROM t")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("c_custkey", pii.sensitivity(F.col("kinds")).alias("sensitivity"))


_RISK = f"""r AS (SELECT *, {_any('request', pii.BULK_WORDS)} AS bulk, {_any('request', pii.RISK_WORDS)} AS risky FROM (SELECT *, {_REQUEST} AS request FROM t)),
  s AS (SELECT *, least(1.0, round(0.30 * risky::INT + 0.25 * CASE WHEN len(kinds) > 0 THEN 1 ELSE 0 END + 0.30 * CASE WHEN len(kinds) > 0 THEN list_max(list_transform(kinds, lambda k: {_WEIGHT})) ELSE 0 END + 0.15 * bulk::INT, 4)) AS s0 FROM r),
  u AS (SELECT *, CASE WHEN bulk THEN greatest(s0, 0.65) ELSE s0 END AS prs FROM s),
  v AS (SELECT *, CASE WHEN prs >= 0.65 THEN 'DANGEROUS' WHEN prs >= 0.30 THEN 'SENSITIVE' ELSE 'NORMAL' END AS label FROM u)"""


def risked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed(spark, sf_dir).withColumn("has", F.size("kinds") > 0).withColumn("bulk", F.lit(False))
    score = pii.privacy_risk(F.col("request"), F.col("has"), F.col("has").cast("double"), F.col("kinds"), F.col("bulk"))
    return t.withColumn("prs", score).withColumn("label", pii.risk_label(score)).withColumn("bulk", pii.any_word(F.col("request"), pii.RESULT_BULK_WORDS))


@query("oj11_privacy_risk", f"WITH {FOUND_SQL}, {_TYPES_SQL}, {_RISK} SELECT c_custkey, prs::DOUBLE AS prs, label FROM v")
def privacy_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risked(spark, sf_dir).select("c_custkey", "prs", "label")


@query(
    "oj12_policy",
    f"WITH {FOUND_SQL}, {_TYPES_SQL}, {_RISK}, c AS (SELECT *, CASE segment WHEN 'BUILDING' THEN 'mask_and_embed' WHEN 'FURNITURE' THEN 'skip_pii_chunks' WHEN 'MACHINERY' THEN 'embed_all' ELSE 'cancel' END AS choice, {_any('request', pii.RESULT_BULK_WORDS)} AS all_of_it FROM v) "
    "SELECT c_custkey, label <> 'DANGEROUS' AS allow, label = 'SENSITIVE' OR (label = 'NORMAL' AND all_of_it) AS confirm, label = 'SENSITIVE' AS preview, choice <> 'cancel' AS proceed, choice = 'mask_and_embed' AS mask, choice = 'skip_pii_chunks' AS exclude_pii_chunks FROM c",
)
def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a risk label allows, and what a user's choice at upload (here by segment) has done."""
    choice = F.when(F.col("segment") == "BUILDING", "mask_and_embed").when(F.col("segment") == "FURNITURE", "skip_pii_chunks").when(F.col("segment") == "MACHINERY", "embed_all").otherwise("cancel")
    r = risked(spark, sf_dir).select("c_custkey", pii.decision(F.col("label"), F.col("bulk")).alias("d"), pii.upload_directive(choice).alias("u"))
    return r.select("c_custkey", "d.allow", "d.confirm", "d.preview", "u.proceed", "u.mask", "u.exclude_pii_chunks")


_SESSION_SCORE = "CASE WHEN c_custkey % 5 = 0 THEN 16 WHEN c_custkey % 5 = 1 THEN 9 ELSE 0 END"


@query(
    "oj13_critic",
    f"WITH {FOUND_SQL}, {_TYPES_SQL}, {_RISK}, c AS (SELECT *, {_SESSION_SCORE} AS session, {_any('request', pii.RESULT_BULK_WORDS)} AS all_of_it FROM v) "
    "SELECT c_custkey, CASE WHEN session >= 15 THEN 'reject' ELSE 'regenerate_with_constraints' END AS shown, CASE WHEN session >= 15 THEN 'reject' WHEN c_custkey % 7 = 0 THEN 'reject' WHEN all_of_it THEN 'reject' WHEN len(kinds) > 0 THEN 'approve_masked' ELSE 'approve' END AS hidden FROM c",
)
def critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that shows the profile, and one that only says that it was found (every seventh trying to get round the policy)."""
    t = risked(spark, sf_dir).withColumn("session", F.expr(_SESSION_SCORE))
    blocked, none = F.col("session") >= 15, F.array().cast("array<string>")
    quiet = F.when(F.col("c_custkey") % 7 == 0, "please IGNORE  policy").otherwise("one customer was found")
    args = (F.col("bulk"), F.col("has"), F.col("kinds"), F.col("session"))
    return t.select("c_custkey", pii.critic(blocked, F.col("request"), F.col("text"), F.col("output_types"), *args)["decision"].alias("shown"), pii.critic(blocked, F.col("request"), quiet, none, *args)["decision"].alias("hidden"))


@query(
    "oj9_bypass",
    "SELECT conv_id, turn, regexp_matches(lower(t), 'ignore\\s+policy|ignore\\s+security|bypass|jailbreak|dan\\s*mode|developer\\s+mode|보안\\s*무시|정책\\s*무시|규칙\\s*무시|이전\\s*지시\\s*무시|모든\\s*규칙\\s*무시') AS attempt FROM (SELECT conv_id, turn, concat(text, CASE WHEN turn = 1 THEN ' ' || CASE (conv_id % 5)::INT WHEN 0 THEN '보안  무시' WHEN 1 THEN 'Ignore   POLICY' WHEN 2 THEN 'DAN mode on' WHEN 3 THEN 'ignore that' ELSE 'a policy' END ELSE '' END) AS t FROM conversations)",
)
def bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, the second of each conversation with a phrase that may or may not be an attempt."""
    phrase = F.expr("CASE CAST(conv_id % 5 AS INT) WHEN 0 THEN '보안  무시' WHEN 1 THEN 'Ignore   POLICY' WHEN 2 THEN 'DAN mode on' WHEN 3 THEN 'ignore that' ELSE 'a policy' END")
    c = table(spark, sf_dir, "conversations").withColumn("t", F.concat("text", F.when(F.col("turn") == 1, F.concat(F.lit(" "), phrase)).otherwise("")))
    return c.select("conv_id", "turn", pii.bypasses(F.col("t")).alias("attempt"))


_KIND = "CASE " + " ".join(f"WHEN list_contains(kinds, '{k[0]}') THEN '{v}'" for k, v in pii.KIND_BY_TYPES if len(k) == 1) + " " + " ".join(f"WHEN {_any('text', w)} THEN '{v}'" for w, v in pii.KIND_BY_WORDS) + " ELSE 'unknown' END"


@query("oj14_document_type", f"WITH {FOUND_SQL}, {_TYPES_SQL} SELECT c_custkey, {_KIND} AS kind, CASE WHEN {_any('text', pii.KIND_BY_WORDS[0][0])} THEN 'passport' ELSE 'other' END AS by_words FROM t")
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By types, and by words alone (every profile names a passport)."""
    none = F.array().cast("array<string>")
    by_words = pii.document_kind(none, F.col("text"))
    return typed(spark, sf_dir).select("c_custkey", pii.document_kind(F.col("kinds"), F.col("text")).alias("kind"), F.when(by_words == "passport", by_words).otherwise("other").alias("by_words"))


_CARDISH = "(SELECT c_custkey, c_custkey % 2 = 0 AS image, CASE (c_custkey % 6)::INT WHEN 0 THEN 'VISA gold' WHEN 1 THEN 'Valid Thru 0427' WHEN 2 THEN '12 34 56 78' WHEN 3 THEN 'visa 1234 5678' WHEN 4 THEN 'no card at all' ELSE 'member since 99' END AS t FROM customer)"


@query(
    "oj15_card_imagery",
    f"SELECT c_custkey, CASE WHEN image THEN word OR n >= 8 OR (n >= 4 AND four) ELSE (brand AND n >= 8) OR (word AND n >= 4 AND four) END AS likely FROM (SELECT *, {_any('t', pii.CARD_BRANDS)} AS brand, {_any('t', [*pii.CARD_BRANDS, *pii.CARD_FACE])} AS word, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n, regexp_matches(t, '[0-9]{{4}}') AS four FROM {_CARDISH})",
)
def card_imagery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read from images (even ids) and pages, of which only some show a card."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("image"), F.expr("CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'VISA gold' WHEN 1 THEN 'Valid Thru 0427' WHEN 2 THEN '12 34 56 78' WHEN 3 THEN 'visa 1234 5678' WHEN 4 THEN 'no card at all' ELSE 'member since 99' END").alias("t"))
    return rows.select("c_custkey", pii.card_imagery(F.col("t"), F.col("image")).alias("likely"))


_BLOCKS = "(SELECT c_custkey AS image, CAST(b AS INT) AS block, b * 100 AS x0, 10 AS y0, b * 100 + 90 AS x1, 30 AS y1, CASE CAST(b AS INT) WHEN 0 THEN c_name WHEN 1 THEN '900101' WHEN 2 THEN '- 1123459' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'a@b.com' ELSE 'none' END ELSE 'end' END AS text FROM {customer}, RANGE)"


@query(
    "oj16_image_regions",
    "WITH b AS " + raw(_BLOCKS.replace("RANGE", "range(5) t(b)")) + ", r AS (SELECT image, x0, x1, 'EMAIL' AS types FROM b WHERE text = 'a@b.com' UNION ALL SELECT image, 100, 290, 'KR_RRN' FROM b WHERE block = 1 UNION ALL SELECT image, 200, 390, 'EMAIL' FROM b WHERE text = 'a@b.com' UNION ALL SELECT image, 300, 490, 'EMAIL' FROM b WHERE text = 'a@b.com') SELECT image, x0::BIGINT AS x0, x1::BIGINT AS x1, types FROM r",
)
def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number over two blocks is found in their pair only; an address also in the pairs with its neighbours."""
    blocks = spark.sql(_BLOCKS.replace("RANGE", "(SELECT explode(sequence(0L, 4L)) AS b)")[1:-1], customer=table(spark, sf_dir, "customer"))
    r = findings.image_regions(blocks)
    return r.select("image", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), F.array_join("types", ",").alias("types"))


@query(
    "oc10_span_blocks",
    f"WITH {FOUND_SQL}, w AS (SELECT c_custkey, unnest(string_split(text, ', ')) AS b, generate_subscripts(string_split(text, ', '), 1) AS i FROM p), o AS (SELECT c_custkey, i, coalesce(sum(length(b) + 1) OVER (PARTITION BY c_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(b) AS n FROM w), j AS (SELECT c_custkey, string_agg(b, chr(10) ORDER BY i) AS joined FROM w GROUP BY c_custkey) "
    "SELECT DISTINCT o.c_custkey, (o.i - 1)::INT AS block FROM o JOIN (SELECT f.c_custkey, instr(j.joined, f.m) - 1 AS s, instr(j.joined, f.m) - 1 + length(f.m) AS e FROM f JOIN j USING (c_custkey)) x ON x.c_custkey = o.c_custkey AND x.s < o.a + o.n AND x.e > o.a",
)
def span_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks that a finding of their joined text touches (half-open): running offsets, one newline between blocks."""
    from pyspark.sql import Window

    w = profiles(spark, sf_dir).select("c_custkey", F.posexplode(F.split("text", ", ")).alias("block", "b"))
    o = w.withColumn("a", F.coalesce(F.sum(F.length("b") + 1).over(Window.partitionBy("c_custkey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.length("b"))
    joined = profiles(spark, sf_dir).select("c_custkey", F.replace("text", F.lit(", "), F.lit("\n")).alias("text"))
    f = findings.with_findings(joined).select("c_custkey", F.explode("findings").alias("f"))
    return o.join(f, "c_custkey").where("f.start < a + n AND f.end > a").select("c_custkey", "block").distinct()


@query(
    "od12_pii_signal",
    f"WITH {FOUND_SQL}, {_TYPES_SQL} SELECT segment, count(*) AS matched, round(avg(CASE WHEN len(kinds) > 0 THEN 1.0 ELSE 0.0 END), 4) AS ratio, array_to_string(list_sort(list_distinct(flatten(list(kinds)))), ',') AS types FROM t GROUP BY segment",
)
def pii_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all chunks of a document (here the profiles of a segment): how many, the share with protected types, and these."""
    t = typed(spark, sf_dir)
    return t.groupBy("segment").agg(F.count("*").alias("matched"), F.round(F.avg(F.when(F.size("kinds") > 0, 1.0).otherwise(0.0)), 4).alias("ratio"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))), ",").alias("types"))


@query(
    "od13_feature_map",
    f"WITH {FOUND_SQL}, {_TYPES_SQL}, s AS (SELECT *, {_SENS} AS sens, CASE segment WHEN 'BUILDING' THEN 'show ALL' ELSE 'one' END AS request FROM t) SELECT segment, max(len(kinds)) > 0 AS contains_pii, round(avg(CASE WHEN len(kinds) > 0 THEN 1.0 ELSE 0.0 END), 4) AS ratio, segment = 'BUILDING' AS bulk, round(least(1.0, max(sens) + CASE WHEN segment = 'BUILDING' THEN 0.4 ELSE 0.0 END), 4)::DOUBLE AS sensitivity FROM s GROUP BY segment",
)
def feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be told of a result set without its texts. A text with signs of a card counts as one."""
    t = typed(spark, sf_dir)
    kinds = F.when(pii.card_imagery(F.col("text"), F.lit(False)), F.array_union("kinds", F.array(F.lit("CREDIT_CARD")))).otherwise(F.col("kinds"))
    t = t.withColumn("kinds", kinds).withColumn("sens", pii.sensitivity(kinds)).withColumn("bulk", pii.any_word(F.when(F.col("segment") == "BUILDING", "show ALL").otherwise("one"), pii.RESULT_BULK_WORDS))
    return t.groupBy("segment", "bulk").agg((F.max(F.size("kinds")) > 0).alias("contains_pii"), F.round(F.avg(F.when(F.size("kinds") > 0, 1.0).otherwise(0.0)), 4).alias("ratio"), F.round(F.least(F.lit(1.0), F.max("sens") + F.when(F.first("bulk"), 0.4).otherwise(0.0)), 4).alias("sensitivity"))


_TERMS = lambda table: "CASE k " + " ".join(f"WHEN '{k}' THEN '{' '.join(v)}'" for k, v in table.items()) + " ELSE '' END"


@query("oo20_embedding_text", f"WITH {FOUND_SQL}, {_TYPES_SQL}, k AS (SELECT c_custkey, {_KIND} AS k, list_sort(kinds) AS kinds FROM t) SELECT c_custkey, md5(concat_ws(' ', coalesce(nullif({_TERMS(pii.KIND_TERMS)}, ''), k), nullif(array_to_string(list_transform(kinds, lambda k: trim(k || ' ' || {_TERMS(pii.TYPE_TERMS)})), ' '), ''), CASE WHEN len(kinds) > 0 THEN '개인정보 PII 민감문서' END)) AS text FROM k")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed(spark, sf_dir)
    return t.select("c_custkey", F.md5(pii.embedding_text(pii.document_kind(F.col("kinds"), F.col("text")), F.array_sort("kinds")).cast("binary")).alias("text"))


@query(
    "oo21_metadata_validation",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'field Phone' WHEN c_custkey % 4 = 2 THEN 'value ' || lpad(c_custkey::VARCHAR, 7, '1') END AS fault FROM customer",
)
def metadata_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with a forbidden field, with a value among its types, or sound."""
    c = table(spark, sf_dir, "customer")
    fields = F.when(F.col("c_custkey") % 4 == 1, F.array(F.lit("doc_type"), F.lit("Phone"))).otherwise(F.array(F.lit("doc_type")))
    types = F.when(F.col("c_custkey") % 4 == 2, F.array(F.lit("KR_RRN"), F.lpad(F.col("c_custkey").cast("string"), 7, "1"))).otherwise(F.array(F.lit("KR_RRN")))
    return c.select("c_custkey", pii.metadata_fault(fields, types).alias("fault"))
