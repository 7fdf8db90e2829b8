"""Appends and landings that share a table: every key once, nothing half written, little read."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plumbline.operators.checks import CheckFailed
from plumbline.operators.latest import latest_per_key
from plumbline.session import scratch_path
from plumbline.sources import commits, keyed, newest

SCHEMA = "k bigint, s string, v double"


def batch(spark, lo, hi, v=1.0):
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(v).alias("v"))


def held(spark, root):
    return sorted(tuple(r) for r in keyed.read_appended(spark, root, SCHEMA).collect())


def test_an_entry_is_created_once(spark):
    log = commits.CommitLog(spark, scratch_path(spark, "log"))
    assert log.last() == 0 and log.commit(1, "a") and not log.commit(1, "b") and log.commit(2, "c")
    assert [tuple(r) for r in log.entries().orderBy("number").collect()] == [(1, "a"), (2, "c")] and log.last() == 2
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.commit(3, f"t{i}"), range(8)))
    assert sum(won) == 1 and log.entries(2).first().attempt == f"t{won.index(True)}"


def test_append_adds_each_key_once(spark):
    root = scratch_path(spark, "keyed")
    assert held(spark, root) == []
    assert keyed.append_once(batch(spark, 0, 10), root, ["k"]) == 10
    assert keyed.append_once(batch(spark, 5, 15, 2.0).unionAll(batch(spark, 5, 15, 3.0)), root, ["k"]) == 5
    assert keyed.append_once(batch(spark, 0, 15, 9.0), root, ["k"]) == 0
    assert keyed.append_once(batch(spark, 0, 0), root, ["k"]) == 0
    assert held(spark, root) == [(k, "x", 1.0 if k < 10 else 3.0) for k in range(15)]
    with pytest.raises(CheckFailed):
        keyed.append_once(batch(spark, 0, 2).withColumn("k", F.lit(None).cast("bigint")), root, ["k"])


@pytest.mark.parametrize("other", [(3, 13), (100, 110)])
def test_an_append_overtaken_looks_again(spark, monkeypatch, other):
    """Another session appends after this one has looked and before it commits."""
    root, commit, calls = scratch_path(spark, "keyed"), commits.CommitLog.commit, []

    def overtaken(log, number, attempt):
        calls.append(number)
        if len(calls) == 1:
            assert keyed.append_once(batch(spark.newSession(), *other, 7.0), root, ["k"]) == 10
        return commit(log, number, attempt)

    monkeypatch.setattr(commits.CommitLog, "commit", overtaken)
    theirs = set(range(*other))
    assert keyed.append_once(batch(spark, 0, 10), root, ["k"]) == len(set(range(10)) - theirs)
    assert calls == [1, 1, 2]
    assert held(spark, root) == [(k, "x", 7.0 if k in theirs else 1.0) for k in sorted(theirs | set(range(10)))]


def test_appends_at_once(spark):
    root = scratch_path(spark, "keyed")
    with ThreadPoolExecutor(3) as pool:
        counts = list(pool.map(lambda i: keyed.append_once(batch(spark.newSession(), 4 * i, 4 * i + 12, float(i)), root, ["k"]), range(3)))
    assert sum(counts) == 20 and [r[0] for r in held(spark, root)] == list(range(20))


def test_a_stopped_append_leaves_nothing_readable(spark, monkeypatch):
    root = scratch_path(spark, "keyed")
    keyed.append_once(batch(spark, 0, 3), root, ["k"])

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "commit", lost)
        with pytest.raises(OSError):
            keyed.append_once(batch(spark, 0, 9), root, ["k"])
    assert [r[0] for r in held(spark, root)] == [0, 1, 2]
    assert keyed.append_once(batch(spark, 0, 9), root, ["k"]) == 6


def test_only_files_of_the_batch_s_keys_are_read(spark):
    root = scratch_path(spark, "keyed")
    for day in range(6):
        keyed.append_once(batch(spark, 1000 * day, 1000 * day + 1000).repartition(4), root, ["s", "k"])
    log = commits.CommitLog(spark, root)
    key = ["s", "k"]
    every = log.parts("files", keyed._range_schema(batch(spark, 0, 1), key)).count()
    mine = keyed._write_sorted(batch(spark, 4990, 5005), key, scratch_path(spark, "mine"))
    met = keyed.files_met(log, mine, key, 0, log.last())
    assert 1 <= len(met) <= 2 and every >= 6


def test_newest_rows_from_late_and_overlapping_landings(spark):
    root = scratch_path(spark, "newest")
    rows = spark.range(600).select((F.col("id") % 100).alias("k"), F.col("id").cast("string").alias("s"), ((F.col("id") * 7) % 50).cast("double").alias("v"))
    rows = rows.withColumn("v", F.when(F.col("k") % 9 > 0, F.col("v")))
    assert newest.newest(spark, root, SCHEMA).count() == 0
    for part in ("s >= 300", "s < 350", "s < 350", "true", "false"):
        newest.land(rows.where(part.replace("s ", "cast(s as int) ")), root, ["k"], ["v"])
    found = sorted(map(tuple, newest.newest(spark, root, SCHEMA).collect()), key=repr)
    assert found == sorted(map(tuple, latest_per_key(rows, ["k"], ["v"]).select("k", "s", "v").collect()), key=repr)


def test_a_landing_touches_only_its_buckets(spark):
    root, by = scratch_path(spark, "newest"), F.floor(F.col("k") / 100)
    assert newest.land(batch(spark, 0, 1000), root, ["k"], ["v"], by) == list(range(10))
    before = set(newest._current(commits.CommitLog(spark, root)))
    assert newest.land(batch(spark, 250, 420, 2.0), root, ["k"], ["v"], by) == [2, 3, 4]
    log = commits.CommitLog(spark, root)
    assert len(before & set(newest._current(log))) == 7 and len(newest._current(log, touched=[2, 3, 4])) == 3
    found = newest.newest(spark, root, SCHEMA)
    assert found.count() == 1000 and found.where("v = 2").agg(F.min("k"), F.max("k"), F.count("*")).first()[:] == (250, 419, 170)
    assert newest.land(batch(spark, 0, 2).withColumn("k", F.lit(None).cast("bigint")), root, ["k"], ["v"], by) == [-1]
    assert newest.newest(spark, root, SCHEMA).count() == 1001


@pytest.mark.parametrize("other", [(50, 150), (900, 950)])
def test_a_landing_overtaken_merges_again(spark, monkeypatch, other):
    root, by, commit, calls = scratch_path(spark, "newest"), F.floor(F.col("k") / 100), commits.CommitLog.commit, []

    def overtaken(log, number, attempt):
        calls.append(number)
        if len(calls) == 1:
            newest.land(batch(spark.newSession(), *other, 7.0), root, ["k"], ["v"], by)
        return commit(log, number, attempt)

    monkeypatch.setattr(commits.CommitLog, "commit", overtaken)
    newest.land(batch(spark, 0, 200), root, ["k"], ["v"], by)
    found = {r.k: r.v for r in newest.newest(spark, root, SCHEMA).collect()}
    assert found == {k: 1.0 for k in range(200)} | {k: 7.0 for k in range(*other)}
