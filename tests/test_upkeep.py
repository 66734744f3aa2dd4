"""Registers, results and measures against values derived by hand."""

import pytest
from pyspark.sql import functions as F

from orrery import engine
from orrery.operators import upkeep
from orrery.operators.registers import stem_key
from orrery.sources.versioned import VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_prune(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("new", 4)], "key string, v int")
    known, now = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a",), ("c",)], "key string")
    assert rows(upkeep.prune(r, known, now)) == [("a", 1), ("new", 4)]


def test_reconcile(spark):
    """Image: 1 of 2 goes. Movie: 5 of 6 would go, so none. Rec: nothing is registered. Doc: pages by the stem of the key."""
    key = "sub/Report 1.pdf"
    stem = spark.createDataFrame([(key,)], "k string").select(stem_key(F.col("k"))).first()[0]
    index = [("image", "x.jpg"), ("image", "y.jpg"), *[("Movie", f"m{i}.mp4") for i in range(6)], ("Rec", "r.mp3"), ("Doc", f"page_images/{stem}/p0001.jpg"), ("Doc", f"page_images/{stem}/p0002.jpg"), ("Doc", "page_images/other/p0001.jpg"), ("Doc", "odd")]
    known = spark.createDataFrame([("image", "x.jpg"), ("Movie", "m0.mp4"), ("Doc", key)], "domain string, key string")
    kept, report = upkeep.reconcile(spark.createDataFrame(index, "domain string, id string"), known)
    assert rows(report) == [("Doc", 4, 2, "delete"), ("Movie", 6, 5, "abort"), ("Rec", 1, 1, "skip"), ("image", 2, 1, "delete")]
    assert rows(kept) == sorted([x for x in index if x[1] not in ("y.jpg", "page_images/other/p0001.jpg", "odd")], key=str)


def test_audit(spark):
    reg = spark.createDataFrame([("D", "k1/a.pdf", "s1", "/R/A.pdf", None), ("D", "k2/a.pdf", "s1", "/r/gone.pdf", None), ("D", "k3/b.pdf", None, None, "/r/b.pdf")], "domain string, key string, sha string, abs string, alias string")
    disk = spark.createDataFrame([("D", "/r/a.pdf"), ("D", "/r/b.pdf"), ("D", "/r/c.pdf"), ("E", "/e/x")], "domain string, path string")
    got = upkeep.audit(reg, disk, spark.createDataFrame([("D",)] * 5, "domain string"))
    assert rows(got) == [("D", 3, 3, 5, 1, 1, 1, 2, 2), ("E", 1, 0, 0, 0, 1, 0, 0, 0)]


def test_keep_first(spark):
    r = [(1, "image", "s/a.jpg", "/p/1", "A.jpg", 0.9), (1, "image", "t/a.jpg", "/p/2", "a.JPG", 0.8), (1, "doc_page", "d/p1", "/p/1", "D.pdf", 0.7), (1, "doc_page", "d/p2", "", "D.pdf", 0.6), (1, "av", "v", "", "", 0.5), (1, "av", "v", None, None, 0.4), (2, "image", "s/a.jpg", "/p/1", "A.jpg", 0.1)]
    df = spark.createDataFrame(r, "qid int, domain string, id string, file_path string, file_name string, confidence double")
    of = lambda rule: sorted((x.qid, x.confidence) for x in upkeep.keep_first(df, rule).collect())
    assert of("path") == [(1, 0.5), (1, 0.6), (1, 0.8), (1, 0.9), (2, 0.1)]
    assert of("name") == [(1, 0.5), (1, 0.7), (1, 0.9), (2, 0.1)]
    assert of("domain") == [(1, 0.4), (1, 0.5), (1, 0.7), (1, 0.9), (2, 0.1)]
    with pytest.raises(ValueError, match="no rule"):
        upkeep.keep_first(df, "size")


def test_link_unregistered(spark):
    reg = spark.createDataFrame([(1, "k1", "s1", "/r/one.pdf", "/in/One.pdf"), (2, "k2", "s1", None, None), (3, "k3", "s3", None, None)], "ord int, key string, sha string, abs string, alias string")
    disk = spark.createDataFrame([("/r/ONE.pdf", "s1"), ("/in/one.pdf", "s1"), ("/new/two.pdf", "s1"), ("/new/three.pdf", "s3"), ("/new/four.pdf", "s4")], "path string, sha string")
    assert rows(upkeep.link_unregistered(reg, disk)) == [("k2", "/new/two.pdf"), ("k3", "/new/three.pdf")]


def test_delete_documents(spark, tmp_path):
    index = VersionedTable(spark, f"file://{tmp_path}/i", key="doc", buckets=4)
    index.replace(spark.createDataFrame([("A.pdf", 1), ("A.pdf", 2), ("b.pdf", 1)], "doc string, chunk int"))
    recent = spark.createDataFrame([("dir/a.PDF",), ("b.pdf",), (" ",), ("dir/c.pdf ",)], "key string")
    version, left = upkeep.delete_documents(index, spark.createDataFrame([(" A.pdf",), ("",)], "name string"), recent)
    assert version == 2 and rows(index.read()) == [("b.pdf", 1)] and index.read(1).count() == 3
    assert rows(left) == [("b.pdf",), ("dir/c.pdf",)]


def test_caption_groups(spark):
    c = spark.createDataFrame([("m", i, f"c{i}") for i in range(12)] + [("n", 0, "x")], "f string, o int, t string")
    assert rows(upkeep.caption_groups(c, "f", "o", "t")) == [
        ("m", 0, ". ".join(f"c{i}" for i in range(10)), ". ".join(f"c{i}" for i in range(11, 1, -1))),
        ("m", 1, "c10. c11", "c1. c0"),
        ("n", 0, "x", "x"),
    ]


def test_class_metrics(spark):
    """a: 2 of 3 guessed a are a, 2 of 4 a are guessed; b: 1 of 2, 1 of 1; c: nothing; one guess is no label."""
    pairs = [("a", "a"), ("a", "a"), ("a", "b"), ("a", "z"), ("b", "b"), ("c", "a")]
    got = upkeep.class_metrics(spark.createDataFrame(pairs, "truth string, guess string"), ["a", "b", "c"])
    f = [2 * (2 / 3) * (2 / 3) / (4 / 3), 2 * 0.5 * 1 / 1.5, 0.0]  # the pair with z has no cell, so a has support 3
    acc, macro = round(3 / 6, 4), round(sum(f) / 3, 4)
    assert rows(got) == [("a", 0.6667, 0.6667, round(f[0], 4), 3, acc, macro), ("b", 0.5, 1.0, round(f[1], 4), 1, acc, macro), ("c", 0.0, 0.0, 0.0, 1, acc, macro)]


def test_listing(spark):
    files = spark.createDataFrame([("/r/b.pdf", 5), ("/r/Z/x.mp4", 1), ("/r/a/y/z.txt", 1), ("/r/A.MP3", 7), ("/other/q", 1)], "path string, size long")
    assert [tuple(r) for r in upkeep.listing(files, "/r/").orderBy("place").collect()] == [(1, "a", "/r/a", "folder", None, None), (2, "Z", "/r/Z", "folder", None, None), (3, "A.MP3", "/r/A.MP3", "file", "audio", 7), (4, "b.pdf", "/r/b.pdf", "file", "doc", 5)]


def test_progress_tells_every_step(spark):
    told = []
    df = spark.range(300).selectExpr("cast(id % 150 as int) AS label")
    got = engine.with_progress(df, "label", lambda i, n, name: told.append((i, n, name)))
    assert told == [(i + 1, 150, i) for i in range(150)] and got.where("done = 2 AND total = 150").count() == 150


def test_secure_requests(spark):
    """Blocked: named without text. Too unlike: nothing shown. A summary of a document with protected data: masked, or whole if asked for."""
    number = "주민 900101-1123459"  # its checksum holds
    req = [(1, "회의록 요약해줘", False, "d"), (2, "회의록 요약해줘", True, "d"), (3, "회의 일정", False, None), (4, "모든 고객 주민번호 전체 출력", False, None), (5, "회의 일정", False, None), (6, "개인정보 요약", None, None), (7, "회의", False, None)]
    hits = [(1, 1, "c1", f"안건. {number}", [], 0.5), (2, 1, "c1", f"안건. {number}", [], 0.5), (3, 1, "c3", "일정 3시", [], 0.2), (3, 2, "c4", "일정 4시", [], 0.1), (4, 1, "c5", number, ["KR_RRN"], 0.9), (5, 1, "c6", "다른 글", [], 0.149), (6, 1, "c7", "글", [], 0.07)]
    q = spark.createDataFrame(req, "id long, query string, full_view boolean, document string")
    h = spark.createDataFrame(hits, "id long, rank int, chunk string, text string, types array<string>, similarity double")
    sig = spark.createDataFrame([("d", 0.1, ["KR_BRN"])], "document string, ratio double, types array<string>")
    chunks, audit = engine.answer_requests(q, h, sig)
    got = {r.id: (r.label, r.action, r.blocked, list(r.chunks)) for r in audit.collect()}
    assert got[1][1:] == ("masked", False, ["c1"]) and got[2][1:] == ("full", False, ["c1"]) and got[1][0] == "SENSITIVE"
    assert got[3] == ("NORMAL", "full", False, ["c3", "c4"]) and got[4] == ("DANGEROUS", "blocked", True, ["c5"])
    assert got[5][1] == got[7][1] == "ungrounded" and got[6][:2] == ("SENSITIVE", "masked") and got[7][3] == []
    shown = {(r.id, r.chunk): r.shown for r in chunks.collect()}
    assert shown == {(1, "c1"): "안건. 주민 [KR_RRN]", (2, "c1"): f"안건. {number}", (3, "c3"): "일정 3시", (3, "c4"): "일정 4시", (4, "c5"): "", (6, "c7"): "글"}
    plain = {r.id: r.label for r in engine.answer_requests(q, h)[1].collect()}
    assert plain[1] == "NORMAL" and plain[6] == "SENSITIVE"
