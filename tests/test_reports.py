"""Medians in one pass, splits, years of pages and rows, deletes by any number of prefixes."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from furlong.operators import cards, history, maintenance, modeling, prepare, runs, summary
from furlong.plans import queries
from furlong.sources import records as records_module


def test_medians(spark):
    draw = random.Random(2)
    odd = [None, 0.0, -0.0, 1e-300, -5.0, 3.0, 3.0, 1e18, 2.5, 7.0]
    rows = [(draw.choice(odd), float(draw.randrange(-9, 9)), draw.randrange(10**6, 10**6 + 40), None) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c long, d double")
    got = {r.column_name: r.median_value for r in modeling.fit_medians(df, ["a", "b", "c", "d"]).collect()}
    want = {n: statistics.median([r[i] for r in rows if r[i] is not None]) for i, n in enumerate("abc")}
    assert got == want | {"d": None}
    assert {r.column_name: r.median_value for r in modeling.fit_medians(df.limit(0), ["a"]).collect()} == {"a": None}
    far = spark.createDataFrame([(math.inf,), (-math.inf,), (4.0,), (float("nan"),), (5.0,)], "a double")
    assert modeling.fit_medians(far, ["a"]).first().median_value == 5.0
    plan = modeling.fit_medians(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()


def test_split_reads_dates_once_and_keeps_columns(spark):
    df = spark.range(40).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("race_date"), F.col("id").alias("i"), F.lit("own").alias("_i"), F.lit(1).alias("n"))
    out = modeling.chronological_split(df)
    assert out.columns == ["race_date", "i", "_i", "n", "split"] and {r._i for r in out.collect()} == {"own"}
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 28, "validation": 6, "test": 6}
    with pytest.raises(ValueError, match="there are 7"):
        modeling.chronological_split(df.filter("i < 7"))
    with pytest.raises(ValueError, match="there are 0"):
        modeling.chronological_split(df.limit(0))


def test_years_of_pages_and_rows(spark, tmp_path):
    for name in ("2022/result/a.html", "2022/result/b.html", "2023/card/c.html", "2024/result/d.txt", "2025/result/e.html"):
        (tmp_path / "historical" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "historical" / name).write_text("x")
    found = summary.page_years(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(2022, 2), (2025, 1)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([("historical", "2022-05-01"), ("historical", "2021-05-01"), ("upcoming", "2020-05-01"), ("historical", None)], "dataset_type string, d string").withColumn("race_date", F.to_date("d"))
    assert [tuple(r) for r in summary.collected_years(found, df).collect()] == [(2025, True, False, 1), (2022, True, True, 2), (2021, False, True, 0)]
    assert summary.page_years(spark, f"{tmp_path}/none").count() == 0


def test_deletes_by_many_prefixes_keep_the_plan_small(spark):
    rows = spark.createDataFrame([("12a",), ("1",), ("123",), (None,), ("77",), ("7",)], "race_id string")
    other = spark.createDataFrame([(1,)], "x int")
    for n in (3, 100_000):
        wanted = spark.range(n).select(F.concat(F.lit("z"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("p")).union(spark.createDataFrame([("12",), ("77",), (None,)], "p string"))
        tables, counts = maintenance.delete_joined({"races": rows, "other": other}, "race_id", wanted, prefix=True)
        assert sorted(r.race_id or "" for r in tables["races"].collect()) == ["", "1", "7"] and [tuple(r) for r in counts.collect()] == [("races", 3)]
        assert tables["other"] is other and len(tables["races"]._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    same, counts = maintenance.delete_joined({"races": rows}, "race_id", wanted)
    assert sorted(r.race_id or "" for r in same["races"].collect()) == ["", "1", "123", "12a", "7"] and counts.first().deleted == 1
    assert maintenance.delete_joined({"races": rows}, "race_id", wanted.limit(0), prefix=True)[0]["races"].count() == 6


def test_tasks_follow_from_rows(spark, tmp_path):
    lines = spark.range(3000).selectExpr("id div 4 as l_orderkey", "id as l_partkey", "id % 7 as l_suppkey", "10.0D as l_extendedprice", "1.0D as l_quantity", "'N' as l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(750).selectExpr("id as o_orderkey", "timestamp_ntz'1995-01-01 00:00:00' as o_orderdate", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    assert records_module.task_count(spark, str(tmp_path), 100) == 30 and records_module.task_count(spark, str(tmp_path)) == spark.sparkContext.defaultParallelism
    r = records_module.records(spark, str(tmp_path))
    assert r.count() == 3000
    for one in (summary.race_options(r), summary.race_options_history(r, 9), cards.race_runners(r, tasks=9)):  # races stay in their tasks
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(race_id" in plan and plan.count("hashpartitioning(race_id") <= 2
    assert [x.race_id for x in cards.race_runners(r, tasks=9).collect()] == [x.race_id for x in cards.race_runners(r).collect()]


def test_no_step_is_dealt_by_the_session(spark, tmp_path, monkeypatch):
    """Runner rows, and whatever is made of them by race, runner or order, go to as many tasks as their number asks for."""
    spark.range(3000).selectExpr("id div 4 as l_orderkey", "id as l_partkey", "id % 7 as l_suppkey", "10.0D as l_extendedprice", "1.0D as l_quantity", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(750).selectExpr("id as o_orderkey", "timestamp_ntz'1995-01-01 00:00:00' as o_orderdate", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(records_module.task_count, "__defaults__", (100,))
    for name in ("backtest_rows", "hist_prior_avg_finish", "hist_prior_top3_rate", "hist_prior_win_rate", "race_runners", "registered_races", "fn_labels", "filter_audit", "prediction_vs_actual"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
        assert dealt and all(", 30)" in line for line in dealt), (name, dealt)


def test_feature_vectors_make_runner_rows_once(spark, tmp_path, monkeypatch):
    """What is read again is the written table; categories too many to broadcast are joined in tasks that follow from the rows."""
    duck = pytest.importorskip("duckdb").connect()
    spark.range(3000).selectExpr("id div 4 as l_orderkey", "id % 90 as l_partkey", "id % 70 as l_suppkey", "10.0D + id % 37 as l_extendedprice", "1.0D as l_quantity", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(750).selectExpr("id as o_orderkey", "timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 40 as int)) as o_orderdate", "'F' as o_orderstatus", "concat(id % 3, '-X') as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("orders", "lineitem"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(duck.execute(f"SELECT race_id, horse_id, odds_scaled, hot_slots FROM ({queries.ORACLE_SQL['feature_vectors']})").fetchall())
    monkeypatch.setattr(records_module.task_count, "__defaults__", (200,))
    for small in (200_000, 10):
        monkeypatch.setattr(prepare, "SMALL", small)
        out = queries.QUERIES["feature_vectors"](spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and ("REPARTITION_BY_NUM" in plan) == (small == 10) and (small > 10 or ", 15), REPARTITION_BY_NUM" in plan)
        assert sorted(map(tuple, out.collect())) == want


def test_counts_of_missing_values(spark):
    rows = spark.createDataFrame([("a", "1", "x", "2020-01-01", 1.0), ("a", "1", None, None, None), (None, None, "x", "2020-01-01", 2.0), ("a", "2", "y", "2020-01-02", None)], "run string, race_id string, horse_id string, day string, finish_position double").withColumn("race_date", F.to_date("day"))
    for tasks in (None, 3):
        found = {r.run: (r.n_rows, r.n_days, r.n_races, r.n_horses) for r in runs.run_counters(rows, "run", tasks).collect()}
        assert found == {"a": (3, 2, 2, 2), None: (1, 1, 0, 1)}
    assert tuple(summary.filter_audit(rows).first()) == (4, 2, 2, 2, 1)
    assert tuple(summary.filter_audit(rows.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_ingest_where_numbers_of_races_repeat(spark, tmp_path):
    """Orders 13 and 1,440,013 of one year have one number, on two days; the page of the higher order counts for both. No day is left out."""
    duck = pytest.importorskip("duckdb").connect()
    days = {13: "1992-02-01", 1440013: "1992-03-01", 2880013: "1998-07-01", 14: "1993-01-01"}
    spark.createDataFrame([(k, d) for k, d in days.items()], "o_orderkey long, d string").selectExpr("o_orderkey", "cast(d as timestamp_ntz) as o_orderdate", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 10 * i + j, 3, 100.0 + j, 2.0, "N") for i, k in enumerate(days, 1) for j in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("orders", "lineitem"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.QUERIES["ingest_date_range"](spark, str(tmp_path)).select("race_id", "race_date", "horse_id").collect()
    want = duck.execute(f"SELECT race_id, race_date, horse_id FROM ({queries.ORACLE_SQL['ingest_date_range']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 8
    assert sorted({(str(r.race_date), r.horse_id) for r in got if r.race_id[:4] == "1992"}) == [(d, h) for d in ("1992-02-01", "1992-03-01") for h in ("20", "21")]


def test_backtest_tells_the_day_and_the_rows_of_earlier_days(spark):
    rows = [("a", "2020-01-02", "h1", 1, 1.0), ("a", "2020-01-02", "h2", 2, 4.0), ("b", "2020-01-02", "h1", 1, 2.0), ("c", "2020-01-01", "h1", 1, None), ("d", "2020-03-01", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "race_id string, d string, horse_id string, predicted_rank int, finish_position double").select("*", F.to_date("d").alias("race_date"), F.expr("predicted_rank <= 3 and coalesce(finish_position <= 3, false)").alias("top3_hit"))
    more = df.unionByName(df.limit(2).withColumn("race_date", F.lit("2020-02-01").cast("date")))
    for used, counts in ((None, (1, 1, 0, 4)), (more, (1, 1, 0, 6))):
        got = {r.race_id: (r.hit_count, str(r.race_date), r.history_rows_used) for r in history.backtest_summary(df, used).collect()}
        assert got == dict(zip("abcd", zip((1, 1, 0, 0), ("2020-01-02", "2020-01-02", "2020-01-01", "2020-03-01"), counts)))
