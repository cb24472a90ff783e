import datetime as dt

import pytest
from pyspark.sql import functions as F

from tempora.sources.store import Conflict, Database, scan_index, scan_index_range


def ts(day):
    return dt.datetime(2024, 1, day, tzinfo=dt.UTC)


@pytest.fixture
def res(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, n int")
    return db.create("people", rows, ["id"], "ann", "start", ts(1))


def state(df):
    return {r["id"]: (r["name"], r["n"]) for r in df.collect()}


def test_commits_and_snapshots(res, spark):
    res.set(F.col("id") == 1, n=11).delete(F.col("id") == 3).insert(spark.createDataFrame([(4, "d", 40)], "id int, name string, n int"))
    assert res.commit("second", "bob", ts(2)) == 2
    res.rekey(F.col("id") == 2, id=5)
    assert res.commit("third", "ann", ts(3)) == 3
    assert state(res.snapshot(1)) == {1: ("a", 10), 2: ("b", 20), 3: ("c", 30)}
    assert state(res.snapshot(2)) == {1: ("a", 11), 2: ("b", 20), 4: ("d", 40)}
    assert state(res.snapshot()) == {1: ("a", 11), 4: ("d", 40), 5: ("b", 20)}
    assert state(res.at_time(ts(2))) == state(res.snapshot(2))
    assert {r["rev"] for r in res.open_revisions(ts(1), ts(2)).select("rev").distinct().collect()} == {1, 2}
    assert [r["author"] for r in res.history().collect()] == ["ann", "bob", "ann"]
    assert {(r["id"], r["op"]) for r in res.diff(1, 2).collect()} == {(1, "updated"), (3, "deleted"), (4, "inserted")}
    assert res.revert_to(1) == 4
    assert state(res.snapshot()) == state(res.snapshot(1))
    res.truncate_to(2)
    assert res.latest() == 2 and state(res.snapshot()) == {1: ("a", 11), 2: ("b", 20), 4: ("d", 40)}


def test_rollback_hooks_and_last_change_wins(res):
    seen = []
    res.post_commit.append(lambda r, rev: seen.append(rev))
    res.delete(F.col("id") == 1)
    res.rollback()
    assert res.commit() == 1 and seen == []
    res.set(F.col("id") == 1, n=1).set(F.col("id") == 1, n=2)
    assert res.commit() == 2 and seen == [2]
    assert state(res.snapshot())[1] == ("a", 2)


def test_second_writer_conflicts(res):
    other = res.db.open("people", ["id"])
    res.set(F.col("id") == 1, n=5)
    other.set(F.col("id") == 2, n=5)
    latest = res.latest()
    other.commit()
    res.latest = lambda: latest
    with pytest.raises(Conflict):
        res.commit()


def test_a_writer_that_dies_leaves_nothing_behind(res, spark):
    before = state(res.snapshot())
    res._commit_file, real = (lambda commit: (_ for _ in ()).throw(OSError("died"))), res._commit_file
    res.set(F.col("id") == 1, n=99)
    with pytest.raises(OSError):
        res.commit()
    assert res.latest() == 1 and state(res.snapshot()) == before and res.changes().where("rev > 1").count() == 0
    again = res.db.open("people", ["id"])
    again.set(F.col("id") == 1, n=7)
    assert again.commit() == 2 and state(again.snapshot())[1] == ("a", 7)
    assert res.db.open("people", ["id"]).most_recent()[0] == 2


def test_catalogue_and_indexes(res, tmp_path):
    db = res.db
    assert db.exists() and db.exists("people") and db.resources() == ["people"]
    index = res.create_value_index("n", str(tmp_path / "by_n"))
    assert [r["id"] for r in scan_index(index, "n", 20).collect()] == [2]
    assert sorted(r["id"] for r in scan_index_range(index, "n", 10, 30, False, True).collect()) == [2, 3]
    assert res.create_projection(["n"], str(tmp_path / "p")).columns == ["id", "n"]
    assert res.compact(str(tmp_path / "v")).count() == 3
    assert db.drop("people") and not db.exists("people")


def test_streamed_change_log(spark, tmp_path):
    from tempora import streaming

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string").coalesce(1).write.parquet(src)
    s = streaming.read_changes(spark, src, "id int, v string", 1)
    q = streaming.commit_batches(s, str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
