"""Runner rows: their schema, and the view of the driver tables that has it (an order is a race, a part a runner)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of runner rows in order.
TYPES = {
    "race_id": "string", "race_date": "date", "course_name": "string", "race_number": "int", "race_name": "string", "surface": "string", "distance": "double", "weather": "string",
    "track_condition": "string", "horse_id": "string", "horse_name": "string", "horse_number": "int", "frame_number": "int", "sex": "string", "age": "int", "carried_weight": "double",
    "jockey_id": "string", "jockey_name": "string", "trainer_id": "string", "trainer_name": "string", "sire_id": "string", "sire_name": "string", "dam_id": "string", "dam_name": "string",
    "damsire_id": "string", "damsire_name": "string", "odds": "double", "popularity": "double", "body_weight": "double", "body_weight_change": "double", "finish_position": "double",
    "time_seconds": "double", "last_3f_time": "double", **{f"passing_position_{i}": "int" for i in range(1, 5)}, "dataset_type": "string", "collection_run_id": "string", "collected_at": "timestamp",
}
#: What models learn from.
NUMERIC = [
    "race_number", "distance", "horse_number", "frame_number", "age", "carried_weight", "odds", "popularity",
    "prior_starts", "prior_win_rate", "prior_top3_rate", "prior_avg_finish", "prior_avg_odds", "days_since_last_race",
]
CATEGORICAL = ["course_name", "surface", "weather", "track_condition", "sex", "jockey_id", "trainer_id", "sire_id", "dam_id", "damsire_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """The typed columns in order: missing ones are NULL, others go, values that don't parse become NULL."""
    types = types or TYPES
    return df.select(*(F.col(n).try_cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in types.items()))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in TYPES.items()))


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def preferred(df: DataFrame, *names: str) -> DataFrame:
    """Those of the columns that are there, in this order."""
    return df.select(*(n for n in names if n in df.columns))


def union_aligned(*frames: DataFrame) -> DataFrame:
    """All rows, by column name. A column that a frame lacks, or has without a type, is NULL there and takes the others' type."""
    types: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            types[name] = kind if types.get(name, "void") == "void" else types[name]
    one = lambda df: df.select(*(F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in types.items()))
    return functools.reduce(DataFrame.unionByName, map(one, frames))


#: Runner rows of a task, on average.
ROWS = 200_000


def task_count(spark: SparkSession, sf_dir: str, rows: int = ROWS) -> int:
    """How many tasks runner rows are dealt to: they follow from the number of rows (Parquet keeps it, nothing is read), so that
    what a task sorts doesn't grow with the input. At least as many as the session has cores."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(table(spark, sf_dir, "lineitem").count() / rows))


def dealt(df: DataFrame, tasks: int | None, *columns: str) -> DataFrame:
    """df dealt by these columns to so many tasks; without a number it stays as it is, and the session deals it."""
    return df.repartition(tasks, *columns) if tasks else df


def ordered(df: DataFrame, tasks: int | None, *order: Column | str) -> DataFrame:
    """df in this order; with a number, in ranges that so many tasks sort."""
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if tasks else df.orderBy(*order)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runner rows, dealt by race_id to ``task_count`` tasks: sums, both windows and whatever goes by race need no further exchange."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("race_id"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    lines = lines.repartition(task_count(spark, sf_dir), "race_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("race_id"), "o_orderdate", "o_orderstatus", "o_orderpriority")
    runners = lines.groupBy("race_id", "l_partkey").agg(
        F.min("l_suppkey").cast("string").alias("jockey_id"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.max("l_returnflag").alias("flag"),
    )
    last = orders.select(F.max(F.col("o_orderdate").cast("date"))).scalar()
    race = Window.partitionBy("race_id")
    day = F.col("o_orderdate").cast("date")
    upcoming = (F.col("o_orderstatus") == "O") & (day >= F.date_sub(last, 60))
    return runners.join(orders, "race_id").select(
        "race_id", day.alias("race_date"), F.col("l_partkey").cast("string").alias("horse_id"),
        F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("horse_name"), "jockey_id", F.col("o_orderpriority").alias("surface"),
        F.row_number().over(race.orderBy("l_partkey")).alias("horse_number"),
        F.when(~((F.col("flag") == "R") & (F.col("l_partkey") % 7 == 0)), F.row_number().over(race.orderBy(F.desc("cents"), "l_partkey")).cast("double")).alias("finish_position"),
        F.when(F.col("l_partkey") % 11 != 0, F.expr("cents div greatest(qty * 100, 1)").cast("double")).alias("odds"),
        F.when(upcoming, "upcoming").otherwise("historical").alias("dataset_type"),
    )


RECORDS_SQL = """
g AS (
  SELECT l_orderkey, l_partkey, CAST(min(l_suppkey) AS VARCHAR) AS jockey_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(l_quantity) AS BIGINT) AS qty, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL
), r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS race_id, CAST(o_orderdate AS DATE) AS race_date, CAST(l_partkey AS VARCHAR) AS horse_id, 'n' || l_partkey AS horse_name, jockey_id, o_orderpriority AS surface,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS INTEGER) AS horse_number,
    CASE WHEN NOT (flag = 'R' AND l_partkey % 7 = 0) THEN CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY cents DESC, l_partkey) AS DOUBLE) END AS finish_position,
    CASE WHEN l_partkey % 11 <> 0 THEN CAST(cents // greatest(qty * 100, 1) AS DOUBLE) END AS odds,
    CASE WHEN o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 60 THEN 'upcoming' ELSE 'historical' END AS dataset_type
  FROM g JOIN orders ON l_orderkey = o_orderkey
)"""


def load_records(df: DataFrame, dataset_type: str | None = None) -> DataFrame:
    some = df if dataset_type is None else df.filter(F.col("dataset_type") == dataset_type)
    return some.orderBy(F.asc_nulls_last("race_date"), F.asc_nulls_last("race_id"), F.asc_nulls_last("horse_number"))
