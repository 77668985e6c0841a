"""Sums over a runner's past: in segments, and kept by day."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from furlong.operators import history, standing
from furlong.plans import queries

KIND = "race_id string, race_date date, horse_id string, horse_name string, horse_number int, finish_position double, odds double, k string, runner string, s_odds int"


@pytest.fixture(scope="module")
def rows(spark):
    """Most rows are one runner's; NULL dates, ids, finishes and odds, several rows a day, columns named as the operators' own."""
    draw = random.Random(4)
    day = lambda: draw.choice([None, *(datetime.date(2020, 1, 1 + i) for i in range(28))])
    own = [(f"r{i // 5}", day(), draw.choice(["a", "b", None, None, None]), draw.choice(["x", None, None]), i, draw.choice([None, 1.0, 2.0, 5.0]), draw.choice([None, 3.0, 7.5]), "own", "own", 1) for i in range(700)]
    return spark.createDataFrame(own, KIND).repartition(3).cache()


def shown(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.mark.parametrize("segments", [1, 7, 200])
def test_segmented_features_equal_those_of_one_window(spark, rows, segments):
    want = history.historical_features(rows)
    got = history.historical_features_segmented(rows, segments)
    assert got.columns == want.columns and shown(got) == shown(want)
    assert history.historical_features_segmented(rows.limit(0), segments).count() == 0


def test_a_runner_with_most_rows_is_many_tasks(spark):
    n = 40_000
    hot = spark.range(n).select(
        F.lit("r").alias("race_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 3000).cast("int")).alias("race_date"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("horse_id"),
        F.lit(None).cast("string").alias("horse_name"), F.col("id").cast("int").alias("horse_number"), F.lit(1.0).alias("finish_position"), F.lit(2.0).alias("odds"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda df: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("prior_avg_odds")).collect()]
        sizes = tasks(history.historical_features_segmented(hot, 256))
        assert sum(sizes) == n and max(sizes) <= 2 * statistics.median(sizes)
        assert max(tasks(history.historical_features(hot))) >= 0.9 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_standings_by_day_equal_asof_features(spark, rows, tmp_path):
    path, last = str(tmp_path / "s"), datetime.date(2020, 1, 26)
    standing.build(rows.filter(F.col("race_date") < last), path)
    base = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "s/days/part=0").glob("*.parquet")}
    for i in range(3):
        standing.add_day(spark, path, rows, last + datetime.timedelta(days=i))
    assert base == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "s/days/part=0").glob("*.parquet")}
    want = history.asof_features(rows)
    got = standing.asof_features(spark, path, rows)
    assert got.columns == want.columns and shown(got) == shown(want)
    with pytest.raises(ValueError, match="not after"):
        standing.add_day(spark, path, rows, last)
    cards = rows.limit(40).withColumns({"race_date": F.lit(datetime.date(2020, 2, 3)), "horse_number": F.lit(-1)}).unionByName(rows.limit(1).withColumns({"race_date": F.lit(datetime.date(2020, 2, 3)), "horse_number": F.lit(-1), "horse_id": F.lit("new")}))
    both = history.asof_features(rows.unionByName(cards)).filter("horse_number = -1")
    assert shown(standing.card_features(spark, path, cards)) == shown(both)


def test_a_day_added_reads_neither_past_rows_nor_past_days(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    standing.build(rows.filter("race_date < '2020-01-10'"), path)
    current, last = standing._newest(spark, path)
    days, after = standing.advance(current, standing.day_sums(rows.filter("race_date = '2020-01-10'")))
    for frame in (days, after):
        assert not [f for f in frame.inputFiles() if "/days/" in f] and [f for f in frame.inputFiles() if "/current/" in f]
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    assert last == (datetime.date(2020, 1, 9) - datetime.date(1970, 1, 1)).days


def test_rows_are_dealt_to_as_many_tasks_as_told(spark, rows, tmp_path):
    dated = rows.filter("race_date IS NOT NULL")
    standing.build(dated.filter("race_date < '2020-01-20'"), str(tmp_path), 9)
    for day in sorted(r.race_date for r in dated.filter("race_date >= '2020-01-20'").select("race_date").distinct().collect()):
        standing.add_day(spark, str(tmp_path), rows, day, 9)
    got = standing.asof_features(spark, str(tmp_path), rows, 9)
    assert shown(got.select(*(F.round(c, 9) for c in history.FEATURES), "race_id", "horse_number")) == shown(history.asof_features(rows).select(*(F.round(c, 9) for c in history.FEATURES), "race_id", "horse_number"))
    sums = standing.day_sums(rows, 9)
    days, current = standing.standings(sums, 9)
    for one, exchanges in ((sums, 1), (days, 2), (current, 2), (got, 2), (standing.card_features(spark, str(tmp_path), rows, 9), 2)):
        plan = one._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(dealt) == exchanges and all(", 9)" in line for line in dealt) or "BroadcastHashJoin" in plan, plan


def test_standings_read_runner_rows_that_are_made_once(spark, tmp_path):
    spark.range(400).selectExpr("id div 4 as l_orderkey", "id % 9 as l_partkey", "id % 7 as l_suppkey", "10.0D + id % 37 as l_extendedprice", "1.0D as l_quantity", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id as o_orderkey", "timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 20 as int)) as o_orderdate", "'F' as o_orderstatus", "'1-X' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["asof_from_standings"](spark, str(tmp_path))
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()
    assert shown(got) == shown(queries.QUERIES["asof_features"](spark, str(tmp_path)))
