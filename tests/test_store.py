"""Commits, conflicts, crashes and snapshots of the store."""

import pytest

from skarn.sources.readers import merge_table, read_table
from skarn.sources.store import Conflict, Store, content_id, freeze, publish, read_snapshot

ROW = "id int, v string"


def frame(spark, rows, schema=ROW):
    return spark.createDataFrame(rows, schema)


def held(store, name="t", version=None):
    return sorted(map(tuple, store.table(name, ROW, version).select("id", "v").collect()), key=repr)


def test_a_key_stands_once_whatever_the_buckets(spark, tmp_path):
    path = str(tmp_path)
    merge_table(spark, path, frame(spark, [(i, "a") for i in range(50)]), ["id"], 64)
    merge_table(spark, path, frame(spark, [(i, "b") for i in range(20, 70)]), ["id"], 8)
    got = merge_table(spark, path, frame(spark, [(5, "x"), (5, "z"), (5, "y"), (None, "n"), (None, "m")]), ["id"], 8, ["v"])
    rows = {r.id: r.v for r in got.collect()}
    assert got.count() == 71 and rows[5] == "z" and rows[None] == "n" and rows[19] == "a" and rows[20] == "b"
    assert read_table(spark, str(tmp_path / "none"), ROW).count() == 0


def test_writes_are_seen_together_or_not_at_all(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    t = store.begin()
    t.upsert("t", frame(spark, [(1, "a")]), ["id"])
    t.upsert("u", frame(spark, [(2, "b")]), ["id"])
    t.set("w", 1)
    t.commit()
    for crash in range(3):  # after the first table's files, after both, within the manifest
        t = store.begin()
        t.upsert("t", frame(spark, [(1, "lost")]), ["id"])
        if crash:
            t.upsert("u", frame(spark, [(3, "lost")]), ["id"])
            t.set("w", 2)
        if crash == 2:
            out = store.fs.create(store.at(f"{store.path}/manifest/{t.next['version']:08d}.json"), False)
            out.write(bytearray(b'{"version": 9, "tab'))
            out.close()
        assert held(store) == [(1, "a")] and held(store, "u") == [(2, "b")] and store.value("w") == 1
    t = store.begin()
    t.upsert("t", frame(spark, [(1, "c"), (4, "d")]), ["id"])
    t.commit()
    assert held(store) == [(1, "c"), (4, "d")] and held(store, version=0) == [(1, "a")]
    assert store.clean(keep=1) > 0 and held(store) == [(1, "c"), (4, "d")] and held(store, "u") == [(2, "b")]


def test_of_two_writers_one_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one, two = store.begin(), store.begin()
    one.upsert("t", frame(spark, [(1, "one")]), ["id"])
    two.upsert("t", frame(spark, [(1, "two")]), ["id"])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert held(store) == [(1, "one")]
    with pytest.raises(ValueError):
        store.begin().upsert("t", frame(spark, [(1, "x")]), ["v"])
    t = store.begin()
    t.reset("t")
    t.commit()
    assert held(store) == [] and held(store, version=0) == [(1, "one")]


def test_publishing_twice_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    store = Store(spark, str(tmp_path))
    rows = frame(spark, [(1, "a"), (2, "b")])
    args = (F.lit("run"), F.lit("unit"), "id")
    assert publish(store, "t", rows, *args) == 1 and publish(store, "t", rows, *args) == 1
    assert publish(store, "t", frame(spark, [(2, "c"), (1, "a")]), *args, revision=1) == 2
    with pytest.raises(Conflict):
        publish(store, "t", rows, *args, revision=1)
    assert publish(store, "t", rows, F.lit("run2"), F.lit("unit"), "id") == 3
    assert held(store) == [(1, "a"), (1, "a"), (2, "b"), (2, "c")]


def test_snapshots_are_named_by_their_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))

    def put(name, rows):
        t = store.begin()
        t.upsert(name, frame(spark, rows), ["id"])
        t.commit()

    put("t", [(1, "2"), (2, None)])
    put("u", [(2, "x")])
    tables, refs = {"t": ROW, "u": ROW}, [("t", "v", "u", "id")]
    first = freeze(store, tables, refs)
    version = store.manifest()["version"]
    assert freeze(store, tables, refs) == first and store.manifest()["version"] == version
    put("t", [(1, "9")])
    with pytest.raises(ValueError, match="9"):
        freeze(store, tables, refs)
    other = freeze(store, tables)
    put("t", [(1, "2")])
    assert freeze(store, tables) == first != other
    store.clean(keep=1)
    assert sorted(r.v for r in read_snapshot(store, other, "t", ROW).where("id = 1").collect()) == ["9"]
    a, b = frame(spark, [(1, "a"), (1, "a"), (2, None)]), frame(spark, [(2, None), (1, "a"), (1, "a")])
    assert content_id(a) == content_id(b) != content_id(a.distinct()) and content_id(a.limit(0)) == content_id(b.limit(0))
