"""Long filter lists, counts from footers, keyless tables, published runs, filtered masters."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilscope.operators import joins, report
from perilscope.sources import footers
from perilscope.sources.outputs import publish_outputs, published, read_output, write_outputs


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_long_list_is_no_part_of_the_plan(spark, tmp_path):
    spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("t")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    wanted = [i * 2 for i in range(-50, 1200)] + [None, 4]
    got = report.slice_rows(df, {"id": wanted, "t": ["1", "2"]})
    want = {i for i in range(0, 2400, 2) if i % 7 in (1, 2)}
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    plan = plan_of(got)
    assert " INSET " not in plan and "1236" not in plan
    assert "GreaterThanOrEqual(id,-100)" in plan and "LeftSemi" in plan


def test_lists_of_other_types_and_frames(spark):
    df = spark.createDataFrame([(i, str(i), "x") for i in range(3000)] + [(None, None, "x")], "id int, t string, value string")
    many = [str(i) for i in range(0, 4000, 3)]
    assert report.slice_rows(df, {"t": many}).count() == 1000
    frame = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("other"))
    assert report.slice_rows(df, {"id": frame.union(frame)}).count() == 10
    assert report.slice_rows(df, {"id": frame.limit(0)}).count() == 0
    assert report.slice_rows(df, {"id": [], "t": None}).count() == 3001


def test_null_counts_come_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, "a").alias("some text"), F.lit(None).cast("double").alias("never"),
        F.when(F.col("id") % 2 == 0, F.array("id")).alias("list"),
        F.when(F.col("id") < 10, F.struct("id")).alias("record"),
    )
    df.repartition(4).write.parquet(path)
    want = report.null_counts(spark.read.parquet(path)).collect()
    assert footers.null_counts(spark, path).collect() == want
    assert footers.read_filled(spark, path).columns == ["id", "some text", "list", "record"]
    plan = plan_of(footers.counted(footers.pushed(spark, path), ["id", "some text", "never"]))
    assert "PushedAggregation: [COUNT(*), COUNT(id), COUNT(`some text`), COUNT(never)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # for no one else


def test_files_without_statistics_are_scanned(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(pa.table({"a": pa.array(["x", None, "y"]), "b": pa.array([None, None, None], pa.int64())}))
    df.coalesce(1).write.option("parquet.column.statistics.enabled", "false").parquet(path)
    assert footers.filled_counts(spark, path) == (3, {"a": 2, "b": 0})


def test_copies_of_a_row_without_a_key_keep_their_own_values(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1)] * 50 + [(None, 2)] * 50, "t string, n int").repartition(3).write.parquet(path)
    table = joins.positioned(spark.read.parquet(path))
    assert table.select(joins.POSITION).distinct().count() == 100
    derived = table.withColumn("mark", F.col("row_position.row") % 2).select(joins.POSITION, "mark")
    got = joins.personalised(table, derived.where("mark = 1"), None, {"mark": "odd", "no": "x"})
    assert got.columns == ["t", "n", "odd"] and got.count() == 100
    assert got.where("odd = 1").count() == derived.where("mark = 1").count()


def test_a_key_filter_lets_few_others_through(spark):
    keys = spark.range(0, 30_000, 3).select(F.col("id").cast("string").alias("k")).union(
        spark.range(5).select(F.lit(None).cast("string"))
    )
    may_have = joins.key_filter(keys, [F.col("k")])
    others = spark.range(30_000).select(F.col("id").cast("string").alias("k"))
    passed = {int(r["k"]) for r in others.where(may_have([F.col("k")])).collect()}
    assert set(range(0, 30_000, 3)) <= passed and len(passed) < 10_000 + 1500
    none = joins.key_filter(keys.limit(0), [F.col("k")])
    assert others.where(none([F.col("k")])).count() == 0


def test_a_large_master_is_filtered_before_it_is_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i % 20), i, "r") for i in range(200)] + [(None, 1, "r")], "k string, n int, _salt string")
    master = spark.range(50_000).select(
        F.col("id").cast("double").alias("k"), F.col("id").alias("n"), F.lit("m").alias("_hot")
    )
    kept = joins.partners(master.withColumn("k", joins.join_key(F.col("k"))), rows, "k").count()
    assert 20 <= kept < 3000
    want = sorted(map(str, joins.join_master(rows, master, "k").collect()))
    assert sorted(map(str, joins.join_master(rows, master, "k", limit=-1).collect())) == want
    monkeypatch.setattr(joins, "FILTER_WORDS", 0)  # too many keys for a filter
    assert sorted(map(str, joins.join_master(rows, master, "k", limit=-1).collect())) == want


def test_a_failed_run_leaves_the_earlier_one(spark, frame, tmp_path):
    base = str(tmp_path)
    first = frame(a=[1, 2])
    paths = publish_outputs({"x": first, "y": first, "unmapped": first.limit(0)}, base, "r")
    assert set(paths) == {"x", "y"}
    broken = first.select(F.raise_error(F.lit("no")).alias("a"))
    with pytest.raises(Exception, match="no"):
        publish_outputs({"x": frame(a=[7]), "y": frame(a=[8]), "z": broken}, base, "r")
    assert read_output(spark, base, "x", "r").count() == 2
    assert set(published(spark, base, "r")) == {"x", "y"}
    publish_outputs({"x": frame(a=[7]), "z": frame(a=[9])}, base, "r", "csv")
    assert read_output(spark, base, "x", "r", "csv").collect()[0]["a"] == "7"
    with pytest.raises(ValueError, match="no frame 'y'"):
        read_output(spark, base, "y", "r")
    write_outputs({"x": first}, base, "other")  # written, not published
    assert published(spark, base, "other") is None and read_output(spark, base, "x", "other").count() == 2
    assert publish_outputs({"x": None}, base, "r") == {}
