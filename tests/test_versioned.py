"""Tables of versions: replaced rows, two writers, crashes, compaction, readers of one version."""

import pytest

from orrery import engine
from orrery.sources.versioned import Conflict, VersionedTable

ROWS = "key string, v int"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", buckets=16, most_parts=4)


def rows(spark, *some):
    return spark.createDataFrame(list(some), ROWS)


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_replace_by_file(spark, table):
    """a x 3, b x 2; a anew with 4; then c: rows of other keys stay."""
    table.replace(rows(spark, *[("a", i) for i in range(3)], ("b", 10), ("b", 11)))
    assert len(held(table)) == 5
    table.replace(rows(spark, *[("a", 100 + i) for i in range(4)]))
    assert held(table) == [("a", 100), ("a", 101), ("a", 102), ("a", 103), ("b", 10), ("b", 11)]
    table.replace(rows(spark, ("c", 1)))
    assert len(held(table)) == 7
    table.delete(rows(spark, ("a", 0), ("never", 0)).select("key"))
    assert held(table) == [("b", 10), ("b", 11), ("c", 1)]
    assert held(table, 1) == [("a", 0), ("a", 1), ("a", 2), ("b", 10), ("b", 11)]


def test_a_change_of_few_keys_writes_only_their_buckets(spark, table):
    table.replace(spark.range(1000).selectExpr("concat('k', id) AS key", "cast(id AS int) AS v"))
    before = table.manifest()["parts"]
    table.replace(rows(spark, *[(f"k{i}", -1) for i in range(10)]))
    after = table.manifest()["parts"]
    changed = {b for b in after if after[b] != before.get(b)}
    touched = {str(r[0]) for r in spark.range(10).selectExpr("pmod(xxhash64(concat('k', id)), 16)").collect()}
    assert changed == touched and len(before) == 16
    assert table.read().count() == 1000 and table.read().where("v = -1").count() == 10


def test_two_writers_lose_nothing(spark, table, monkeypatch):
    """Another writer commits while this one writes: keys of both stay, of one key the later change."""
    table.replace(rows(spark, ("a", 1), ("b", 1), ("c", 1)))
    other, create, met = VersionedTable(spark, table.path), table.store.create, []

    def late(name, text):
        if not met:
            met.append(name)
            other.replace(rows(spark, ("a", 2), ("b", 2)))
        return create(name, text)

    monkeypatch.setattr(table.store, "create", late)
    assert table.replace(rows(spark, ("b", 3), ("d", 3))) == 3 and met[0].endswith("2.json")
    assert held(table) == [("a", 2), ("b", 3), ("c", 1), ("d", 3)]
    with pytest.raises(Conflict):  # rows made from version 2
        table.replace(rows(spark, ("a", 9)), expect=2)
    assert held(table) == [("a", 2), ("b", 3), ("c", 1), ("d", 3)]


def test_crash_before_the_manifest(spark, table, monkeypatch):
    table.replace(rows(spark, ("a", 1)))
    with monkeypatch.context() as m:
        m.setattr(table.store, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.replace(rows(spark, ("a", 2)))
    assert held(table) == [("a", 1)] and len(table.store.list(f"{table.path}/data")) == 2
    assert table.vacuum(older=3600) == []  # it may still be under way
    assert len(table.vacuum(older=-1)) == 1 and held(table) == [("a", 1)]
    table.replace(rows(spark, ("a", 3)))
    assert held(table) == [("a", 3)]


def test_compaction_beside_writers_and_readers(spark, table, monkeypatch):
    """Buckets of many parts are written anew; a change that comes meanwhile stays on top; a reader keeps its version."""
    for n in range(3):
        table.replace(rows(spark, ("a", n), (f"x{n}", n)))
    reader = table.read()
    other, create, met = VersionedTable(spark, table.path), table.store.create, []

    def late(name, text):
        if not met:
            met.append(name)
            other.replace(rows(spark, ("a", 77)))
        return create(name, text)

    monkeypatch.setattr(table.store, "create", late)
    m = table.compact(1)
    assert [len(p) for p in m["parts"].values() if len(p) > 1] == [2] and m["whole"]
    assert held(table) == [("a", 77), ("x0", 0), ("x1", 1), ("x2", 2)]
    assert ("a", 2) in map(tuple, reader.collect())
    for n in range(6):
        table.replace(rows(spark, ("a", n)))
    assert all(len(p) <= 4 for p in table.manifest()["parts"].values()) and held(table)[0] == ("a", 5)
    table.vacuum(keep=1, older=-1)
    assert held(table) == [("a", 5), ("x0", 0), ("x1", 1), ("x2", 2)] and len(table.versions()) == 1


def test_batches_count_once_and_null_keys(spark, table):
    table.replace(rows(spark, ("a", 1), (None, 1)), batch=("s", 0))
    assert table.replace(rows(spark, ("a", 9)), batch=("s", 0)) == 1
    table.replace(rows(spark, (None, 2)), batch=("s", 1))
    table.replace(rows(spark, ("b", 2)), batch=("other", 0))
    assert held(table) == [("a", 1), ("b", 2), (None, 2)]
    with pytest.raises(ValueError, match="no version"):
        VersionedTable(spark, f"{table.path}-none").read()


def test_index_stream_keeps_other_buckets(spark, tmp_path):
    schema = "key string, sha string, v int"
    path = f"file://{tmp_path}/index"
    for n, some in enumerate([[(f"k{i}", "1", i) for i in range(50)], [("k1", "2", -1), ("k1", "1", -2), ("new", "1", 7)]]):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        files = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        engine.index_stream(files, path, lambda d: d, f"{tmp_path}/cp").awaitTermination()
    table = VersionedTable(spark, path)
    assert table.versions() == [1, 2] and sum(len(p) > 1 for p in table.manifest()["parts"].values()) <= 2
    got = {r.key: (r.sha, r.v) for r in engine.current_index(spark, path).collect()}
    assert len(got) == 51 and got["k1"] == ("2", -1) and got["new"] == ("1", 7)
