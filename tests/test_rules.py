"""Rules against values derived by hand, and operators against plain loops."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from orrery import engine
from orrery.functions import music, pii, scoring, text
from orrery.operators import calibration, findings, registers, requests, sessions
from orrery.plans import registry


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


# personal data


def kinds(t):
    return [(k, t[s:e], x) for s, e, k, x in findings.find(t)]


def test_findings_by_hand():
    assert kinds("오늘 회의는 3시, 참석자 5명") == []
    assert kinds("번호 900101-1123459 와 900101-1123456") == [("KR_RRN", "900101-1123459", 1.0)]
    assert kinds("번호920101-1234567입니다") == []  # Hangul is no word boundary
    assert kinds("여권 M12345678 면허 11-22-333333-44 사업자 123-45-67891, 123-45-67890") == [("KR_PASSPORT", "M12345678", 0.8), ("KR_DRIVER_LICENSE", "11-22-333333-44", 0.85), ("KR_BRN", "123-45-67891", 1.0)]
    assert kinds("m12345678") == []
    # accounts need a bank or a word of accounts within 120 characters, and may not repeat more than five times
    assert kinds("110-234-567890") == []
    assert kinds("신한 110-234-567890") == [("KR_BANK_ACCOUNT", "110-234-567890", 0.75)]
    assert kinds("입금" + "." * 117 + " 110-234-567890") == [("KR_BANK_ACCOUNT", "110-234-567890", 0.75)]
    assert kinds("입금" + "." * 121 + " 110-234-567890") == []
    assert kinds("계좌 " + "110-234-567890 " * 6) == []
    # Luhn numbers score 1, others by their layout; Amex 4-6-5
    assert kinds("4111 1111 1111 1111") == [("CREDIT_CARD", "4111 1111 1111 1111", 1.0)]
    assert kinds("4111-1111-1111-1112") == [("CREDIT_CARD", "4111-1111-1111-1112", 0.88)]
    assert kinds("4111111111111112") == [("CREDIT_CARD", "4111111111111112", 0.78)]
    assert kinds("3782 822463 10006") == [("CREDIT_CARD", "3782 822463 10006", 0.88)]


def test_masks_merge_overlaps():
    t = "국민은행 123-45-67891 끝"  # a business number, and an account by its shape
    spans = findings.find(t)
    assert [k for _, _, k, _ in spans] == ["KR_BANK_ACCOUNT", "KR_BRN"]
    assert findings.masked(t, spans) == "국민은행 [KR_BANK_ACCOUNT] 끝"


def test_masking_of_whole_documents_equals_a_loop(spark, data):
    texts = {r["doc_id"]: r["text"] for r in registry.table(spark, data, "documents").collect()}
    got = {r["doc_id"]: r["text"] for r in registry.queries()["oj7_document_masking"](spark, data).collect()}
    for i, t in texts.items():
        for m in reversed(list(re.finditer(r"(?<!\d)\d{13,19}(?!\d)", t))):
            if any(s <= m.start() and m.end() <= e for s, e, _, _ in findings.find(t)):
                t = t[: m.start()] + "[CREDIT_CARD]" + t[m.end() :]
        assert got[i] == t


def test_output_scan_and_removal(spark):
    t = "주민 900101-1123456, 계좌 신한 110-234-567890, a@b.co 4111-1111-1111-1111"
    assert findings.in_output(t) == ["KR_RRN", "KR_BANK_ACCOUNT", "CREDIT_CARD"]
    out = one(spark, pii.removed(F.col("t")), t=t)
    # of the card's four groups the first three are an account's form: the third ends where no digit follows
    assert out == "주민 [주민등록번호 제거됨], 계좌 신한 [계좌번호 제거됨], [이메일 제거됨] [계좌번호 제거됨]-1111"
    assert one(spark, pii.removed(F.col("t")), t="전화 010-1234-5678") == "전화 010-1234-5678"


@pytest.mark.parametrize(("types", "want"), [([], 0.0), (["PHONE_NUMBER"], 0.0), (["KR_BRN"], 0.6), (["CREDIT_CARD", "kr_passport"], 0.95), (["KR_RRN", "KR_BRN"], 1.0)])
def test_sensitivity(spark, types, want):
    assert one(spark, pii.sensitivity(F.array(*map(F.lit, types)) if types else F.array().cast("array<string>"))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("request_", "types", "want"),
    [("회의록 요약", [], (0.0, "NORMAL")), ("여권 알려줘", [], (0.3, "SENSITIVE")), ("여권 알려줘", ["KR_PASSPORT"], (0.82, "DANGEROUS")), ("dump it", [], (0.65, "DANGEROUS")), ("hello", ["PHONE_NUMBER"], (0.25, "NORMAL"))],
)
def test_privacy_risk(spark, request_, types, want):
    arr = F.array(*map(F.lit, types)) if types else F.array().cast("array<string>")
    s = pii.privacy_risk(F.lit(request_), F.lit(bool(types)), F.lit(float(bool(types))), arr, F.lit(False))
    got = spark.range(1).select(s.alias("s"), pii.risk_label(s).alias("l")).first()
    assert (got.s, got.l) == (pytest.approx(want[0]), want[1])


def test_exposure_weights_are_those_of_the_policy():
    assert pii.WEIGHTS == {"KR_RRN": 1.0, "KR_PASSPORT": 0.9, "KR_DRIVER_LICENSE": 0.8, "KR_BANK_ACCOUNT": 0.85, "KR_BRN": 0.6, "CREDIT_CARD": 0.88}
    assert (pii.EXPOSURE["PERSON"], pii.EXPOSURE["EMAIL_ADDRESS"], pii.EXPOSURE["KR_PHONE"]) == (0.4, 0.0, 0.0)


def test_card_imagery_and_bypass(spark):
    likely = lambda t, image: one(spark, pii.card_imagery(F.lit(t), F.lit(image)))
    assert likely("VISA", True) and not likely("VISA", False) and likely("visa 1234", False) and likely("12345678", True) and not likely("123 4", True)
    assert one(spark, pii.bypasses(F.lit("please IGNORE   policy"))) and one(spark, pii.bypasses(F.lit("보안무시"))) and not one(spark, pii.bypasses(F.lit("ignore that")))


def test_image_regions(spark):
    rows = [(1, 0, 0, 0, 10, 10, "820701"), (1, 1, 12, 0, 20, 10, "- 2345678"), (1, 2, 30, 0, 40, 10, "ok"), (2, 0, 0, 0, 5, 5, "m12345678")]
    df = spark.createDataFrame(rows, "image int, block int, x0 int, y0 int, x1 int, y1 int, text string")
    got = {(r.image, r.x0, r.x1, tuple(r.types)) for r in findings.image_regions(df).collect()}
    assert got == {(1, 0, 20, ("KR_RRN",)), (2, 0, 5, ("KR_PASSPORT",))}


# sessions

SESSION = "session string, event_id int, ts string, event_type string, pii_types array<string>, user_query string"


def brute_session(rows):
    score, warned, history, seen, names = 0, False, [], {}, set()
    for ts, _, event, types, query in sorted(rows, key=lambda r: (r[0], r[1])):
        if score >= 15:
            break
        p = sessions.EVENTS.get(event, 0)
        if sum(ts - t <= 30 for t in history) >= 3:
            p += 3
        for k in types or []:
            p += 2 * (seen.get(k, 0) >= 1)
            seen[k] = seen.get(k, 0) + 1
        if query:
            names |= {n for n in sessions.NAMES if n in query}
            p += 4 * (len(names) >= 2)
        score += p
        history.append(ts)
        if score < 15 and score >= 8:
            warned = True
    return score, warned, score >= 15


def test_session_risk_batch_and_stream_equal_a_loop(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for s in range(25):
        t = 0
        for i in range(rng.randrange(1, 14)):
            t += rng.choice([0, 1, 5, 40])
            rows.append((f"s{s}", i, t, rng.choice(["view", "sensitive_request", "full_view_click", "dangerous_request"]), rng.choice([[], ["KR_RRN"], ["KR_RRN", "KR_BRN", "KR_RRN"], None]), rng.choice(["", "신한 계좌", "국민 하나", "hello", None])))
    want = {s: brute_session([(t, i, e, k, q or "") for x, i, t, e, k, q in rows if x == s]) for s in {r[0] for r in rows}}
    df = spark.createDataFrame([(s, i, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", e, k, q) for s, i, t, e, k, q in rows], SESSION).withColumn("ts", F.to_timestamp("ts"))
    assert {r.session: (r.score, r.warned, r.blocked) for r in sessions.session_risk(df, "session").collect()} == want
    # two triggers, the second later in time
    df.where("event_id < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"))
    first = [f for f in files if spark.read.parquet(str(f)).agg(F.max("event_id")).first()[0] < 5][0]
    os.utime(first, (1, 1))
    stream = sessions.session_risk_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "session")
    q = stream.writeStream.format("memory").queryName("risk").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    last = {}
    for r in spark.table("risk").collect():
        last[r.session] = max(last.get(r.session, (0, False, False)), (r.score, r.warned, r.blocked))
    assert last == want


# registers


def test_replace_by_file(spark):
    """Three rows of a and two of b; a again with four; then c with one."""
    rows = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] * 2, "file string, v int")
    new = spark.createDataFrame([("a", 2)] * 4, "file string, v int")
    step = registers.replace_by_file(rows, new, "file")
    assert tuple(registers.removed_count(rows, new, "file").first()) == (6, 3)
    assert step.where("file = 'a' AND v = 1").count() == 0
    more = spark.createDataFrame([("c", 1)], "file string, v int")
    assert tuple(registers.removed_count(step, more, "file").first()) == (7, 0)


def test_types_and_names(spark):
    assert sum(map(len, registers.EXTENSIONS.values())) == 58
    kind = lambda p: one(spark, registers.file_type(F.lit(p)))
    assert [kind(p) for p in ("a.MP4", "x/y.z/b.flac", "c.webp", "d.PDF", "e.exe", "noext", ".pdf", "f.m2ts")] == ["video", "audio", "doc", "doc", None, None, None, "video"]
    assert one(spark, registers.stem_key(F.lit("a/b: c?.pdf"))).startswith("b_ c___")
    assert one(spark, text.title_of(F.lit("x/뉴스.zipMBC[채널] 뉴스.mp4"))) == "뉴스 MBC 뉴스"


def test_folder_listing_equals_the_system(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    for n in ("b.mp3", "A.txt", "c.bin"):
        (tmp_path / n).write_text("xy")
    rows = [(r.name, r.kind, r.type, r["size"]) for r in registers.folder_listing(spark, f"file://{tmp_path}").collect()]
    assert rows == [("Sub", "folder", None, None), ("A.txt", "file", "doc", 2), ("b.mp3", "file", "audio", 2), ("c.bin", "file", None, 2)]


def test_keep_policies(spark):
    r = spark.createDataFrame([(1, "staged/a", "s", "/d/a"), (2, "x/a", "s", "/gone"), (3, "y/a", "s", "/d/y"), (4, "staged/b", "t", None), (5, "staged/c", "t", None), (6, "z", "u", None)], "doc_id int, key string, sha string, abs string")
    disk = spark.createDataFrame([("/d/a",), ("/d/y",)], "path string")
    assert {x.key for x in registers.keep_one(r, disk).where("keep").collect()} == {"y/a", "staged/b"}
    av = spark.createDataFrame([(1, "C:/a", "s"), (2, "/b", "s"), (3, "sub/c", "s")], "doc_id int, key string, sha string")
    assert [x.key for x in registers.keep_one_media(av).where("keep").collect()] == ["sub/c"]


# requests and texts


def test_expansion(spark):
    d = spark.createDataFrame([(0, "어린이", "children"), (1, "어린이", "kids"), (2, "어린이", "child"), (3, "고양이", "cat"), (4, "통계", "statistics")], "ord int, ko string, en string")
    q = spark.createDataFrame([(1, "어린이"), (2, "cat"), (3, "통계를"), (4, "산"), (5, ""), (6, "어린이 고양이 통계 a b c")], "id int, query string")
    got = {r.id: r.expanded for r in requests.expanded(q, d).collect()}
    assert got == {1: "어린이 children kids child", 2: "cat 고양이", 3: "통계를 statistics", 4: "산", 5: "", 6: "어린이 고양이 통계 a b c children kids cat statistics"}


def test_rewrite_and_tokens(spark):
    assert one(spark, requests.rewritten(F.lit("농구 영상 보여주세요"))) == "농구 영상 basketball"
    assert one(spark, requests.rewritten(F.lit("basketball game"))) == "basketball game 농구 게임"
    assert one(spark, requests.rewritten(F.lit("농구 game"))) == "농구 game"
    assert one(spark, requests.place_tokens(F.lit("박태웅의 의장 AI를"))) == ["박태웅", "의장", "ai"]
    assert one(spark, requests.document_token(F.lit("홍길동 문서 3줄 요약해줘"))) == "홍길동"
    assert one(spark, requests.document_token(F.lit("a_b.pdf 요약"))) == "a_b.pdf"
    assert one(spark, requests.best_place(F.lit("first\nabout Employment here\nnext"), F.lit("취업")))["line"] == 2


@pytest.mark.parametrize(
    ("q", "artist", "title"),
    [("가수 아이유 노래", "아이유", None), ("'BTS' 노래 틀어줘", "BTS", None), ("아이유 음악이 배경인 영상", "아이유", None), ("아이유의 밤편지가 배경인 영상", "아이유", "밤편지"), ("잔잔한 노래", None, None), ("Coldplay", "Coldplay", None), ("비슷한 느낌", None, None)],
)
def test_music_hints(spark, q, artist, title):
    h = one(spark, requests.music_hints(F.lit(q), {"calm": ["잔잔"]}))
    assert (h["artist"], h["title"]) == (artist, title)
    assert h["moods"] == (["calm"] if "잔잔" in q else [])


def test_texts(spark):
    assert one(spark, text.clock(F.lit(3725.4))) == "1:02:05" and one(spark, text.clock(F.lit(59.6))) == "1:00" and one(spark, text.minutes(F.lit(59.9))) == "0:59"
    assert one(spark, text.without_foreign_lines(F.lit("한글\n中文內容\n中文"))) == "한글\n中文"
    assert one(spark, text.looks_like_contents(F.lit("1. 개요\n2. 본론"))) and not one(spark, text.looks_like_contents(F.lit("x" * 40)))
    assert one(spark, text.cleaned(F.lit("good\nx.toObject( return 1\n한글 文字文字文字"))) == "good"
    assert one(spark, text.clean_caption(F.lit("a photo of 漢字"))) == "" and one(spark, text.clean_caption(F.lit("a photo"))) == "a photo"
    assert [one(spark, text.says_something(F.lit(s))) for s in ("001", "x-2026-4-27-r", "코스모스", "news")] == [False, False, True, True]
    assert one(spark, text.extract(F.lit("[문서 1] 가:\n짧다\n이것은 쓸모 있는 긴 문장이다\n[문서 2] 나:\n또 다른 쓸모 있는 문장이다"))) == ["이것은 쓸모 있는 긴 문장이다", "또 다른 쓸모 있는 문장이다"]
    assert one(spark, scoring.meaningful(F.lit(" ㅋㅋ 가a1漢! "))).asDict() == {"alpha": 1, "digit": 1, "hangul": 1, "cjk": 1, "other": 4, "meaningful": 3}
    caps = [one(spark, scoring.query_cap(F.lit(q))) for q in ("", "ㅋㅋ", "1234", "꽃", "산업")]
    assert caps == [0.30, 0.30, 0.40, 0.55, 1.0]


def test_keyword_windows_equal_a_loop(spark):
    rng = random.Random(2)
    words = ["cat", "dog", "owl"]
    texts = {i: "".join(rng.choice(["cat ", "DOG ", "owl ", "x" * rng.randrange(50, 700)]) for _ in range(rng.randrange(1, 30))) for i in range(25)}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {}
    for r in requests.keyword_windows(df, words).orderBy("place").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop))
    for i, t in texts.items():
        pos = {w: [m.start() for m in re.finditer(w, t.lower())] for w in words}
        comp = [(sum(any(abs(b - a) <= 1000 for b in pos[o]) for o in words if o != w), a) for w in words for a in pos[w]]
        best = [a for s, a in sorted(comp, key=lambda x: -x[0]) if s > 0][:4]
        centres = []
        for a in [*best, *(a for w in words for a in pos[w])]:
            if len(centres) < 3 and all(abs(a - c) >= 300 for c in centres):
                centres.append(a)
        assert got.get(i, []) == [(max(0, c - 400), min(len(t), c + 400)) for c in centres]


def test_key_sentences_stop_at_the_budget(spark):
    df = spark.createDataFrame([(1, "the cat is 30% longer here.\nthe dog and the cat are here.\nthe owl sleeps in the tree.\n")], "doc_id int, text string")
    got = [r.sentence for r in requests.key_sentences(df, ["cat", "dog"], budget=60).orderBy("place").collect()]
    assert got == ["the cat is 30% longer here.", "the dog and the cat are here."]


# tracks, calibration, evaluation


def test_music_rules(spark):
    assert one(spark, music.artist_title(F.lit("x/BTS_Dynamite_audio.mp4"))).asDict() == {"artist": "BTS", "title": "Dynamite"}
    assert one(spark, music.artist_title(F.lit("song.mp3"))).asDict() == {"artist": "", "title": "song"}
    assert tuple(one(spark, music.bucket_weights(F.lit(9), F.lit(1)))) == (0.9, 0.1) and tuple(one(spark, music.bucket_weights(F.lit(0), F.lit(0)))) == (0.5, 0.5)
    assert one(spark, music.tags(*[F.lit(x) for x in (70.0, 4000.0, 0.3, 0.2, 0.2, 300.0)])) == ["slow", "bright-timbre", "rhythmic", "loud", "noisy", "long-track"]
    assert one(spark, music.description_boost(F.lit("dark tense dramatic music very"), F.lit("A Dark, dramatic piece"))) == pytest.approx(0.05)


def test_guards_and_gold(spark):
    old = spark.createDataFrame([("a", 0.1, 0.1, 0.2), ("b", 0.1, 0.1, 0.2)], "domain string, mu_null double, sigma_null double, abs_threshold double")
    new = spark.createDataFrame([("a", 0.15, 0.2, 0.41), ("b", 0.15, 0.2, 0.39), ("c", 0.3, 0.1, 9.0)], old.schema)
    assert {r.domain: (r.abs_threshold, r.status) for r in calibration.crossmodal(old, new).collect()} == {"a": (0.2, "rejected"), "b": (0.39, "ok"), "c": (9.0, "ok")}
    low = spark.createDataFrame([("a", 0.04, 0.2, 0.2), ("b", 0.19, 0.2, 0.11)], old.schema)
    assert {r.domain: r.status for r in calibration.drift_guard(old, low).collect()} == {"a": "kept", "b": "updated"}
    s = spark.createDataFrame([(1, i, 1 - i / 10) for i in range(10)], "qid int, row_id int, score double")
    assert calibration.gold(s, 0.75, 1, 5).count() == 3 and calibration.gold(s, 2.0, 4, 5).count() == 4 and calibration.gold(s, 0.0, 1, 5).count() == 5


def test_judged(spark):
    r = spark.createDataFrame([(1, 1, "B"), (1, 2, "A"), (1, 3, "a"), (2, 1, "z")], "qid int, rank int, name string")
    e = spark.createDataFrame([(1, "a"), (1, "c"), (2, "y")], "qid int, name string")
    got = {x.qid: (x.n_expected, x.hit, x.coverage, x.mrr, x.top1, x.n_dup) for x in calibration.judged(r, e, 10).collect()}
    assert got == {1: (2, True, 1.0, 0.5, False, 1), 2: (1, False, 0.0, 0.0, False, 0)}


def test_metadata_cascade_by_hand(spark):
    names = spark.createDataFrame([(n,) for n in ("Alpha.pdf", "alpha two.pdf", "beta.txt", "xx gamma yy.txt", "none.txt", "Alpha.pdf")], "file_name string")
    keys = spark.createDataFrame([(1, "al", "start"), (2, "alpha", "stem"), (3, "beta.txt", "whole"), (4, "be", "start of beta"), (5, "gam ma", "inside"), (6, "", "empty")], "ord int, key string, text string")
    got = {tuple(r) for r in registers.metadata_of(names, keys).collect()}
    # a stem before the start that has the smaller place; of starts the first; a whole name before a start; blanks aside within
    assert got == {("Alpha.pdf", "stem"), ("alpha two.pdf", "start"), ("beta.txt", "whole"), ("xx gamma yy.txt", "inside"), ("none.txt", None)}
    none = registers.metadata_of(names, keys.where("ord > 9"))
    assert {r.text for r in none.collect()} == {None} and none.count() == 5
    scans = none._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in scans  # the joins read what was written


def test_metadata_cascade_equals_a_plain_loop(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abBc \u200b\U0001f3b5") for _ in range(rng.randint(1, n)))
    names = sorted({f"x{word(9)}.{rng.choice(['pdf', 'mp3'])}" for _ in range(150)} | {f"{word(5)}b.pdf" for _ in range(80)})
    stems = [n.rsplit(".", 1)[0].lower() for n in names]
    keys = [(i, rng.choice([word(4).lower(), rng.choice(stems), rng.choice(names).lower(), rng.choice(stems)[: rng.randint(1, 5)] + word(3), " " + rng.choice(stems)[1:], ""]), f"t{i}") for i in range(300)]
    want = {}
    for name, stem in zip(names, stems, strict=True):
        fits = []
        for i, key, text in keys:
            bare = key.replace(" ", "")
            if key:
                inside = len(bare) >= 3 and bare in stem.replace(" ", "").replace("\u200b", "")
                prio = 1 if key == stem else 2 if key == name.lower() else 3 if stem.startswith(key) or key.startswith(stem[:4]) else 4 if inside else 5
                fits += [(prio, i, text)] if prio < 5 else []
        want[name] = min(fits)[::2] if fits else (None, None)
    got = registers.metadata_of(spark.createDataFrame([(n,) for n in names], "file_name string"), spark.createDataFrame(keys, "ord int, key string, text string"), head=4)
    assert {r.file_name: r.text for r in got.collect()} == {n: t for n, (_, t) in want.items()}
    assert {p for p, _ in want.values()} == {None, 1, 2, 3, 4}


def test_metadata_cascade_makes_no_row_a_pair(spark):
    """500 names hold what 500 keys are, and 500 start as 500 keys do: the joins give a row for a part of a name that some key may answer, not one for each key."""
    names = [(f"{i} common.pdf",) for i in range(500)] + [(f"{'head' * 10} {i}.pdf",) for i in range(500)]
    keys = [(i, "com" + " " * i + "mon", f"a{i}") for i in range(500)] + [(500 + i, f"{'head' * 10}, {i}", f"b{i}") for i in range(500)]
    df = registers.metadata_of(spark.createDataFrame(names, "file_name string"), spark.createDataFrame(keys, "ord int, key string, text string"))
    assert {r.text for r in df.collect()} == {"a0", "b0"}
    todo, rows = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.endswith("Join"):
                rows.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert rows and max(rows) <= 10 * len(names)


# the engine


def test_index_stream_replaces_by_file(spark, tmp_path):
    schema = "key string, sha string, v int"
    for n, rows in enumerate([[("a", "1", 1), ("b", "1", 1)], [("a", "2", 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = engine.index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), lambda d: d, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert {tuple(r) for r in engine.current_index(spark, str(tmp_path / "index")).select("key", "sha", "v").collect()} == {("a", "2", 5), ("b", "1", 1)}


def test_search_refuses_too_many_queries(spark):
    q = spark.createDataFrame([(i, [1.0] * 64) for i in range(3)], "qid long, vec array<double>")
    rows = spark.createDataFrame([(i, [float(j == i) for j in range(64)]) for i in range(30)], "row_id long, vec array<double>")
    assert engine.search_by_vector(q, rows, 5).count() == 15
    with pytest.raises(ValueError, match="in parts"):
        engine.search_by_vector(q, rows, 5, most=2)


def test_settings_are_json(spark):
    assert json.loads(json.dumps(registers.SECONDS))["doc"] == [5.0, 1.0]
