"""The engine's tables, derived from the raw ones: registered files, files on disk, media segments, session events, search history, tracks.

Each is a query in the SQL that Spark and DuckDB share, over the raw tables in braces; ``expand``
puts them in place of their names in a query's text.
"""

from __future__ import annotations

_NAME = "concat(d.lang, ' ', d.source, ' report_', CAST(d.doc_id AS STRING))"
_EXT = "CASE d.lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx' WHEN 'de' THEN 'mp4' ELSE 'mp3' END"
_DOMAIN = "CASE d.lang WHEN 'de' THEN 'Movie' WHEN 'en' THEN 'Doc' WHEN 'fr' THEN 'Doc' ELSE 'Rec' END"



def _sum(digits: str, weights: list[int]) -> str:
    return " + ".join(f"{w} * CAST(substr({digits}, {i + 1}, 1) AS INT)" for i, w in enumerate(weights))


_CARD = "concat('4', lpad(CAST((n * 104729) % 1000000000 AS STRING), 9, '0'), lpad(CAST((n * 7919) % 1000000 AS STRING), 6, '3'))"

_e = lambda i: f"CAST(element_at(embedding, {i}) AS DOUBLE)"

VIEWS = {
    # every document as a file: what it is called, where it lies, what it holds
    "files": f"""SELECT d.doc_id, d.text, md5(coalesce(d.text, '')) AS sha, coalesce(d.n_chars, 0) AS size, {_DOMAIN} AS domain, {_NAME} AS stem,
        concat({_NAME}, '.', {_EXT}) AS file_name, concat(d.source, '/', {_NAME}, '.', {_EXT}) AS rel_key, concat('/raw/', {_DOMAIN}, '/', d.source, '/', {_NAME}, '.', {_EXT}) AS path FROM {{documents}} d""",
    # registered are those with a label; media entries have no absolute path, those of quality 0 were staged first and keep an alias
    "registered": """SELECT f.doc_id, f.domain, f.sha, f.size, f.stem, f.file_name, CASE WHEN l.quality = 0 THEN concat('staged/', f.rel_key) ELSE f.rel_key END AS key,
        CASE WHEN f.domain IN ('Movie', 'Rec') THEN NULL ELSE f.path END AS abs, CASE WHEN l.quality = 0 THEN concat('/inbox/', f.file_name) END AS alias, l.quality, l.toxic FROM {files} f JOIN {labels} l ON l.doc_id = f.doc_id""",
    # on disk are all files but the toxic ones, and every page
    "on_disk": """SELECT f.path, f.sha, f.size, f.file_name FROM {files} f LEFT JOIN {labels} l ON l.doc_id = f.doc_id WHERE coalesce(l.toxic, 0) = 0
        UNION ALL SELECT concat('/raw/Doc/web/page_', CAST(p.page_id AS STRING), '.html'), md5(coalesce(p.html, '')), CAST(length(coalesce(p.html, '')) AS BIGINT), concat('page_', CAST(p.page_id AS STRING), '.html') FROM {pages} p""",
    # a conversation as a recording: what users say is speech, what assistants say captions; 15 characters a second
    "segments": """SELECT conv_id, turn, concat('/raw/Movie/talk_', CAST(conv_id AS STRING), '.mp4') AS file_path, concat('talk_', CAST(conv_id AS STRING), '.mp4') AS file_name,
        CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 15 AS start_sec,
        CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 15 AS end_sec,
        CASE WHEN role = 'user' THEN text ELSE '' END AS stt_text, CASE WHEN role = 'user' THEN '' ELSE text END AS caption FROM {conversations}""",
    # k is the number in an event's properties
    "session_events": """SELECT event_id, user_id, ts, k, CASE event_type WHEN 'purchase' THEN 'dangerous_request' WHEN 'click' THEN 'sensitive_request' WHEN 'signup' THEN 'full_view_click' WHEN 'error' THEN 'regenerate_triggered' ELSE 'view' END AS event_type,
        CASE WHEN k < 30 THEN 'KR_RRN' WHEN k < 60 THEN 'KR_BANK_ACCOUNT' END AS pii_type,
        CASE WHEN k < 10 THEN '신한 계좌 알려줘' WHEN k < 20 THEN '국민 계좌 알려줘' WHEN k < 40 THEN '회의록 요약해줘' ELSE '' END AS user_query FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events})""",
    # a customer's card: numbers whose checksums hold but for every third, an account in words of one, and a payment card, in groups or in a row
    "profiles": f"""SELECT n AS c_custkey, segment, concat('고객 ', name, ', 주민번호 ', substr(r, 1, 6), '-', substr(r, 7, 6), CAST((11 - ({_sum('r', [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])}) % 11 + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) % 10 AS STRING),
        ' 사업자 ', substr(b, 1, 3), '-', substr(b, 4, 2), '-', substr(b, 6, 4), CAST((10 - ({_sum('b', [1, 3, 7, 1, 3, 7, 1, 3, 5])} + CAST(floor(CAST(substr(b, 9, 1) AS INT) * 5 / 10) AS INT)) % 10 + CASE WHEN n % 3 = 1 THEN 1 ELSE 0 END) % 10 AS STRING),
        ', 여권 ', chr(CAST(65 + n % 26 AS INT)), lpad(CAST(n AS STRING), 8, '0'), ' 면허 11-22-', lpad(CAST(n AS STRING), 6, '0'), '-44, ', CASE segment WHEN 'BUILDING' THEN '입금 계좌 ' ELSE 'tel ' END, phone, ', ',
        CASE WHEN segment = 'MACHINERY' THEN concat(substr(card, 1, 4), '-', substr(card, 5, 4), '-', substr(card, 9, 4), '-', substr(card, 13, 4)) ELSE card END) AS text
        FROM (SELECT n0 AS n, c_name AS name, c_mktsegment AS segment, concat('110-', lpad(CAST(n0 % 1000 AS STRING), 3, '0'), '-', lpad(CAST((n0 * 31) % 1000000 AS STRING), 6, '0')) AS phone, concat(lpad(CAST(n0 % 100 AS STRING), 2, '0'), lpad(CAST(1 + n0 % 12 AS STRING), 2, '0'), lpad(CAST(1 + n0 % 28 AS STRING), 2, '0'), CAST(1 + n0 % 4 AS STRING), lpad(CAST(n0 % 100000 AS STRING), 5, '0')) AS r,
        lpad(CAST((n0 * 7) % 1000000000 AS STRING), 9, '1') AS b, {_CARD.replace('n *', 'n0 *')} AS card FROM (SELECT *, c_custkey AS n0 FROM {{customer}}) c0) c1""",
    # a vector as a track: its first components, stretched, are measured features
    "tracks": f"""SELECT vec_id, label, embedding, concat('artist', CAST(label AS STRING), '_song ', CAST(vec_id AS STRING), CASE WHEN label % 2 = 0 THEN '_audio.mp3' ELSE '.mp3' END) AS filename,
        60 + abs({_e(1)}) * 400 AS tempo, abs({_e(2)}) * 30000 AS centroid, abs({_e(3)}) * 40 AS ratio, abs({_e(4)}) AS loud, abs({_e(5)}) AS zcr, abs({_e(6)}) * 2000 AS seconds, abs({_e(7)}) * 4000 AS centroid_sd, abs({_e(8)}) * 20000 AS rolloff, abs({_e(9)}) AS loud_sd,
        greatest({_e(10)}, 0) AS vocal, abs({_e(11)}) * 30000 AS vocal_centroid, abs({_e(12)}) * 3 AS vocal_high FROM {{embeddings}}""",
    # requests in two languages, put together from a customer's number
    "requests": """SELECT n AS id, domain, trim(concat(root, particle, ' ', noun, tail)) AS query, concat(root, particle) AS word FROM (SELECT c_custkey AS n,
        CASE CAST(c_custkey % 11 AS INT) WHEN 0 THEN '취업' WHEN 1 THEN '교육' WHEN 2 THEN '경제' WHEN 3 THEN '농구' WHEN 4 THEN '음악' WHEN 5 THEN '인공지능' WHEN 6 THEN '데이터센터' WHEN 7 THEN 'Research' WHEN 8 THEN 'budget' WHEN 9 THEN 'Michael Jordan' ELSE '마이클 조던' END AS root,
        CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '의' WHEN 1 THEN '에서의' WHEN 2 THEN '으로' WHEN 3 THEN '부터' WHEN 4 THEN '에서는' WHEN 5 THEN '을' ELSE '' END AS particle,
        CASE CAST(c_custkey % 13 AS INT) WHEN 0 THEN '통계' WHEN 1 THEN '보고서' WHEN 2 THEN '영상' WHEN 3 THEN '사진' WHEN 4 THEN '노래' WHEN 5 THEN 'report' WHEN 6 THEN 'meeting' WHEN 7 THEN '뉴스 좋은' WHEN 8 THEN '투자' WHEN 9 THEN '산업' WHEN 10 THEN 'data' WHEN 11 THEN '문서' ELSE '' END AS noun,
        CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN ' 3줄 요약해줘' WHEN 1 THEN ' 알려주세요' WHEN 2 THEN ' 12' ELSE '' END AS tail,
        CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'doc' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'audio' END AS domain FROM {customer})""",
    "history": "SELECT event_id AS id, concat(event_type, ' ', regexp_extract(props, '([0-9]+)', 1)) AS query, CASE WHEN user_id % 2 = 0 THEN 'hybrid' ELSE 'dense' END AS method, ts AS searched_at FROM {events}",
}


def expand(text: str) -> str:
    """The query with every derived table in place of its name in braces."""
    while any("{" + v + "}" in text for v in VIEWS):
        for name, sql in VIEWS.items():
            text = text.replace("{" + name + "}", f"({sql})")
    return text
