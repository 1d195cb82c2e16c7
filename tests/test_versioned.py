"""Tables that change in one step: failed, repeated and concurrent writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackspark.operators import tables
from trackspark.sources import versioned
from trackspark.sources.versioned import Conflict, VersionedTable, replace_keys
from trackspark.streaming import jobs

SCHEMA = "session_id int, day int"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(spark, path):
    return {tuple(r) for r in tables.read_rows(spark, path).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "days")
    tables.replace_rows(rows(spark, [(s, d) for s in range(6) for d in range(3)]), path, buckets=4)
    return path


def test_crash_between_data_and_commit_leaves_the_old_rows(spark, table, monkeypatch):
    old = content(spark, table)

    def crash(self, manifest):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", crash)
        with pytest.raises(OSError, match="killed"):
            tables.replace_rows(rows(spark, [(1, 9), (2, 9)]), table, buckets=4)
    assert content(spark, table) == old
    tables.replace_rows(rows(spark, [(1, 9)]), table, buckets=4)
    assert content(spark, table) == {r for r in old if r[0] != 1} | {(1, 9)}
    handle = VersionedTable.at(spark, table)
    assert handle.vacuum(keep=1) > 0 and handle.vacuum(keep=1) == 0
    assert content(spark, table) == {r for r in old if r[0] != 1} | {(1, 9)}


def test_failing_job_leaves_the_old_rows(spark, table):
    old = content(spark, table)
    bad = rows(spark, [(1, 9)]).withColumn("day", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        tables.replace_rows(bad, table, buckets=4)
    assert content(spark, table) == old


def test_readers_keep_their_version(spark, table):
    before = tables.read_rows(spark, table)
    tables.replace_rows(rows(spark, [(s, 7) for s in range(6)]), table, buckets=4)
    assert before.count() == 18 and content(spark, table) == {(s, 7) for s in range(6)}
    assert VersionedTable.at(spark, table).read(version=1).count() == 18


def test_emptied_sessions_null_and_wide_keys(spark, table):
    gone = spark.createDataFrame([(2,), (None,)], "session_id bigint")
    tables.replace_rows(rows(spark, [(None, 1)]), table, buckets=4)
    assert (None, 1) in content(spark, table)
    tables.replace_rows(rows(spark, []), table, buckets=4, sessions=gone)
    assert content(spark, table) == {(s, d) for s in (0, 1, 3, 4, 5) for d in range(3)}
    some = spark.createDataFrame([(3,), (77,)], "session_id bigint")
    assert {tuple(r) for r in tables.read_rows(spark, table, some).collect()} == {(3, d) for d in range(3)}
    with pytest.raises(Exception, match="the table is"):
        tables.replace_rows(spark.createDataFrame([(1, "x")], "session_id int, day string"), table, buckets=4)
    with pytest.raises(ValueError, match="buckets"):
        tables.replace_rows(rows(spark, [(1, 1)]), table, buckets=5)


@pytest.mark.parametrize("other", [1, 2])
def test_concurrent_writers_lose_nothing(spark, table, monkeypatch, other):
    """A second writer commits while the first one has its data written: same session or another one."""
    real, done = VersionedTable._publish, []

    def publish(self, *args):
        if not done:
            done.append(1)
            tables.replace_rows(rows(spark, [(other, 8)]), table, buckets=4)
        return real(self, *args)

    monkeypatch.setattr(VersionedTable, "_publish", publish)
    tables.replace_rows(rows(spark, [(1, 9)]), table, buckets=4)
    want = {(s, d) for s in range(6) for d in range(3) if s not in (1, other)} | {(1, 9)} | ({(2, 8)} if other == 2 else set())
    assert content(spark, table) == want


def test_taken_version_is_a_conflict(spark, table):
    handle = VersionedTable.at(spark, table)
    with pytest.raises(Conflict):
        handle.commit(handle.manifest())
    assert [n for n in (handle.path,) if "tmp" in n] and handle.versions() == [1]


def test_frames_keep_the_newest_and_repeat_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "task_id long, ts timestamp, phase string, km double, covered_ids array<bigint>"
    first = [(1, at(1), "baseline", 1.0, [1, 2]), (2, at(1), "anchor", 2.0, []), (3, at(5), "init-grow", 3.0, [1])]
    second = [(1, at(2), "round-batch", 4.0, [1, 2, 3, 3, 99]), (3, at(4), "baseline", 5.0, [2]), (4, at(1), None, 6.0, None)]
    areas = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "area_id bigint, level_id int")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_latest_frames(stream, out, str(tmp_path / "ck"), areas, buckets=4).awaitTermination()
    table = VersionedTable.at(spark, out)
    got = {r.task_id: (r.phase, r.km, r.covered_by_level) for r in table.read().collect()}
    assert got == {1: ("GROWING", 4.0, {7: 2, 8: 1}), 2: ("SMOOTHING", 2.0, {}), 3: ("GROWING", 3.0, {7: 1}), 4: ("SMOOTHING", 6.0, {})}
    assert table.manifest().tag == 1 and len(table.versions()) == 2
    assert versioned.BUCKET not in table.read().columns
    again = spark.createDataFrame([(1, 1)], SCHEMA)
    replace_keys(VersionedTable(spark, str(tmp_path / "other"), "session_id", 2), again)
