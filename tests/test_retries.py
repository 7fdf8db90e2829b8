"""Same rows whatever the size, and storage that can be written again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from plumbline.functions.scalars import relative_drop
from plumbline.operators import checks, grid, joins, latest, ordered
from plumbline.plans import reallocation as plan
from plumbline.session import scratch_path
from plumbline.sources import readers, writers

AT = datetime(2025, 1, 1, 12, 0)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("max_axis", [grid.MAX_AXIS, 1])
def test_grids_ignore_null_foreign_and_repeated_axis_values(spark, max_axis):
    ent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "e int, name string")
    axis = spark.createDataFrame([(10,), (20,), (20,), (None,)], "x int")
    counts = spark.createDataFrame([(1, 10, 5), (1, 30, 2), (1, None, 7), (2, 20, None), (9, 10, 1)], "e int, x int, m int")
    full = [(e, n, x) for e, n in ((1, "a"), (2, "b"), (3, "c")) for x in (10, 20)]
    assert rows(grid.dense_grid(ent, axis, max_axis)) == full
    assert rows(grid.filled_grid(ent, counts, axis, "e", "m", max_axis)) == [(*r, 5 if r[0] == 1 and r[2] == 10 else 0) for r in full]
    landed = counts.select("e", "x")
    assert rows(grid.missing_pairs(ent, axis, landed, "e", max_axis)) == [r for r in full if (r[0], r[2]) not in ((1, 10), (2, 20))]


def test_tiles_follow_the_row_counts(spark, monkeypatch):
    monkeypatch.setattr(grid, "TILE_ENTITIES", 3)
    monkeypatch.setattr(grid, "TILE_VALUES", 2)
    ent, axis = spark.range(10).toDF("e"), spark.range(7).toDF("x")
    assert rows(grid.dense_grid(ent, axis, 1)) == [(e, x) for e in range(10) for x in range(7)]


def test_a_run_stored_again_replaces_itself(spark, monkeypatch):
    root = scratch_path(spark, "runs")
    edges = spark.createDataFrame([("p", "c", "a", "b", 2)], "problem string, cadre string, from_region string, to_region string, headcount long")
    rest = spark.createDataFrame([("p", "a", 1.0)], "problem string, region string, ratio double")
    write = writers._counted_write

    def stops_at(name):
        def failing(df, path, *args):
            if path.endswith(name):
                raise OSError("lost")
            return write(df, path, *args)

        return failing

    for part in ("allocations", "runs"):
        monkeypatch.setattr(writers, "_counted_write", stops_at(part))
        with pytest.raises(OSError):
            writers.write_run(edges, rest, rest, root, AT)
        with pytest.raises(LookupError):
            writers.read_latest_run(spark, root)
    monkeypatch.setattr(writers, "_counted_write", write)
    writers.write_run(edges, rest, rest, root, AT)
    writers.write_run(edges.withColumn("headcount", F.lit(3).cast("long")), rest, rest, root, AT)
    summary, moved, after = writers.read_latest_run(spark, root)
    assert summary.count() == 1 and [r.headcount for r in moved.collect()] == [3] and after.count() == 1


def test_the_last_reload_wins_and_a_failed_one_can_be_repeated(spark, monkeypatch):
    root, write = scratch_path(spark, "reload"), writers._counted_write
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    monkeypatch.setattr(writers, "_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        writers.reload_tables({"t": one}, root, AT)
    monkeypatch.undo()
    assert writers._counted_write is write
    writers.reload_tables({"t": one}, root, AT)
    assert rows(writers.read_table(spark, root, "t")) == [(1,)]
    writers.reload_tables({"t": two}, root, AT - timedelta(days=9))
    assert rows(writers.read_table(spark, root, "t")) == [(2,)]


def test_publishing_over_its_own_input(spark):
    path, kind = scratch_path(spark, "mart"), T.StructType([T.StructField("k", T.LongType())])
    first = writers.publish(spark.range(3).toDF("k"), "m", "table", path)
    writers.publish(first.where("k > 0"), "m", "table", path)
    assert rows(readers.read_mart(spark, path, kind, ["k"])) == [(1,), (2,)]


def test_append_refuses_null_keys_and_names_the_row_it_takes(spark):
    target = scratch_path(spark, "append")
    df = spark.createDataFrame([(1, "x", 5), (1, "x", 7), (2, "y", 1)], "k int, p string, v int")
    assert writers.append_if_absent(df, target, ["k", "p"], ["p"]) == 2
    assert writers.append_if_absent(df.union(df), target, ["k", "p"], ["p"]) == 0
    assert rows(spark.read.parquet(target).select("k", "v")) == [(1, 7), (2, 1)]
    with pytest.raises(checks.CheckFailed, match="not null"):
        writers.append_if_absent(spark.createDataFrame([(None, "x", 1)], "k int, p string, v int"), target, ["k", "p"])


def test_an_unreadable_target_is_not_absent(spark, tmp_path):
    assert not writers.exists(spark, str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        writers.exists(spark, str(tmp_path / "bad"))


def _impossible(spark, edge):
    regions = spark.createDataFrame([("p", r, 10, 100.0) for r in "ab"], "problem string, region string, grand_total long, denominator double")
    caps = spark.createDataFrame([("p", "a", "c1", 0, 0), ("p", "b", "c1", 3, 2)], "problem string, region string, cadre string, n long, cap long")
    edges = spark.createDataFrame([edge], "problem string, cadre string, from_region string, to_region string, headcount long")
    return regions, caps, edges


@pytest.mark.parametrize(
    "edge, found",
    [
        (("p", "c1", "a", "b", 4), "floor_kept"), (("p", "c1", "b", "a", 3), "floor_kept"), (("p", "c1", "y", "z", 1), "known_ends"),
        (("p", "other", "a", "b", 1), "known_ends"), (("p", "c1", "b", "z", 1), "known_ends"), (("p", "c1", None, "b", 1), "known_ends"),
        (("p", "c1", "b", "a", 0), "positive_edges"),
    ],
)
def test_every_impossible_edge_is_found(spark, edge, found):
    with pytest.raises(checks.CheckFailed, match=found):
        plan.verify(*_impossible(spark, edge))


def test_possible_edge_passes(spark):
    plan.verify(*_impossible(spark, ("p", "c1", "b", "a", 2)))


def test_slices_follow_all_rows(spark):
    many = spark.range(0, 4000).select((F.col("id") % 40).alias("g"), "id")
    mixed = many.union(spark.range(0, 150).select(F.lit(99).cast("long"), "id"))
    assert ordered.slices_for(many, ["g"], 100) is None
    slices = ordered.slices_for(mixed, ["g"], 100)
    assert slices >= 4150 / 100
    sized = ordered._sliced(mixed, ["g"], [F.col("id")], slices).groupBy("_slice").count()
    assert sized.agg(F.max("count")).first()[0] <= 300
    plain = ordered.running_total(mixed, ["g"], [F.col("id")], "id", "s", None)
    assert rows(plain) == rows(ordered.running_total(mixed, ["g"], [F.col("id")], "id", "s", slices)) == rows(ordered.running_total(mixed, ["g"], [F.col("id")], "id", "s"))


def test_commented_csv_with_a_header_per_file(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.IntegerType())])
    (tmp_path / "1.csv").write_text("# note\n a,b\n".replace(" a", "a") + "x,1\n   \n#c\ny,\n")
    (tmp_path / "2.csv").write_text("b,a\n2,z\n")
    assert rows(readers.read_commented_csv(spark, str(tmp_path), schema)) == [("x", 1), ("y", None), ("z", 2)]
    (tmp_path / "3.csv").write_text("b,a\nno number,z\n")
    with pytest.raises(Exception, match=r"3\.csv: malformed row: no number,z"):
        readers.read_commented_csv(spark, str(tmp_path), schema).collect()
    (tmp_path / "3.csv").write_text("a\nq\n")
    with pytest.raises(checks.CheckFailed, match=r"3\.csv: missing columns \['b'\]"):
        readers.read_commented_csv(spark, str(tmp_path), schema)


def test_broadcast_by_rows_and_bytes(spark):
    def marked(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert marked(joins.broadcast_if_short(spark.range(100)))
    assert not marked(joins.broadcast_if_short(spark.range(101), 100))
    wide = spark.range(2000).withColumn("w", F.repeat(F.lit("x"), 20_000))
    assert not marked(joins.broadcast_if_short(wide))


def test_unique_leaves_nulls_to_not_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, 1), (1, 1)], "a int, b int")
    assert rows(checks.unique(df, ["a", "b"]).failing) == [(1, 1, 2)]


def test_relative_drop_of_any_scale(spark):
    df = spark.createDataFrame([(0.123456, 0.061728), (0.00004, 0.00001), (3e10, 1.5e10), (0.0, 1.0), (None, 1.0), (0.8, 0.3001)], "p double, c double")
    assert [r[0] for r in df.select(relative_drop("p", "c")).collect()] == [0.5, 0.75, 0.5, None, None, 0.6249]


def test_latest_row_with_a_map(spark):
    df = spark.sql("select 1 k, 1 o, map('a', 1) m union all select 1, 2, map('b', 2) union all select 2, 5, null")
    assert sorted((r.k, r.o, r.m) for r in latest.latest_per_key(df, ["k"], ["o"]).collect()) == [(1, 2, {"b": 2}), (2, 5, None)]
