"""The standing of runners: sums over their past, kept by day, so that cards to come and new days need not sort it again.

Two tables in a folder: ``days`` has for each runner and day that it ran the sums before that day (a partition for what was
built at once, and one for each day added since), and ``current`` has each runner's sums after the last day (a partition for
each of these states; the newest counts). A new day reads ``current`` and its own rows alone. Features of rows that are in the table come from an equal join on runner and day, those of cards after the
last day from a join on the runner.

Cases: rows without a date are in no day. A day is added once; adding it again, or one that isn't after the last, is an error.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.names import exact, fresh
from furlong.operators import history
from furlong.sources.records import dealt
from furlong.sources.shared import written

SUMS = ["starts", *(f"{p}_{n}" for n in history._SUMS for p in "sn")]
_DAYS = "runner string, " + ", ".join(f"{n} {'double' if n.startswith('s_') else 'long'}" for n in SUMS) + ", last int, day int"


def _zero(name: str) -> Column:
    return F.lit(0.0) if name.startswith("s_") else F.lit(0).cast("long")


def day_sums(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """(runner, day, SUMS) of each runner's rows of each day."""
    own = dealt(df.filter(F.col("race_date").isNotNull()).withColumns({"runner_key": history.entity(), "day_key": history.day_number()}), tasks, "runner_key", "day_key")
    sums = {"starts": F.count("*")} | {f"s_{n}": F.coalesce(F.sum(x()), F.lit(0.0)) for n, x in history._SUMS.items()} | {f"n_{n}": F.count(x()) for n, x in history._SUMS.items()}
    return own.groupBy(F.col("runner_key").alias("runner"), F.col("day_key").alias("day")).agg(*(sums[n].alias(n) for n in SUMS))


def standings(sums: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(days, current) of all day sums. The window is over a runner's days, which are as few as it has dates."""
    sums = dealt(sums, tasks, "runner")
    before = history.Window.partitionBy("runner").orderBy("day").rowsBetween(history.Window.unboundedPreceding, -1)
    days = sums.select("runner", *(F.coalesce(F.sum(n).over(before), _zero(n)).alias(n) for n in SUMS), F.max("day").over(before).alias("last"), "day")
    current = sums.groupBy("runner").agg(*(F.sum(n).alias(n) for n in SUMS), F.max("day").alias("last"))
    return days, current


def advance(current: DataFrame, sums: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(days, current) of one day more: ``days`` has that day's rows alone, ``current`` all runners'. sums: of that day."""
    new = sums.select("runner", "day", *(F.col(n).alias(f"add_{n}") for n in SUMS))
    both = dealt(current, tasks, "runner").join(dealt(new, tasks, "runner"), "runner", "full_outer")
    old = {n: F.coalesce(F.col(n), _zero(n)) for n in SUMS}
    days = both.filter(F.col("day").isNotNull()).select("runner", *(old[n].alias(n) for n in SUMS), "last", "day")
    after = both.select("runner", *((old[n] + F.coalesce(F.col(f"add_{n}"), _zero(n))).alias(n) for n in SUMS), F.coalesce("day", "last").alias("last"))
    return days, after


def _write_days(days: DataFrame, path: str, part: int) -> None:
    days.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/days")


def build(df: DataFrame, path: str, tasks: int | None = None) -> None:
    """Writes both tables from all rows, into a folder that has none yet. tasks, here and below: how many tasks rows are dealt
    to by runner and day, and sums by runner; the session's number by default."""
    sums = written(day_sums(df, tasks))
    days, current = standings(sums, tasks)
    _write_days(days, path, 0)
    last = sums.agg(F.max("day")).first()[0]
    if last is not None:
        current.write.mode("overwrite").parquet(f"{path}/current/upto={last}")


def _newest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest current table and its day; the partition's value is in its path, so no file is read to find it."""
    schema = _DAYS.replace(", day int", "")
    found = spark.read.schema(f"{schema}, upto int").option("basePath", f"{path}/current").parquet(f"{path}/current")
    last = found.agg(F.max("upto")).first()[0]
    return found.filter(F.col("upto") == last).drop("upto"), last


def add_day(spark: SparkSession, path: str, rows: DataFrame, day: datetime.date, tasks: int | None = None) -> None:
    """Adds one day's rows: reads the newest current table and these rows, writes that day's partition and the next current one.
    The days come first, so that a run which fails in between can be repeated."""
    number = (day - datetime.date(1970, 1, 1)).days
    current, last = _newest(spark, path)
    if number <= last:
        raise ValueError("the day is not after the last one")
    days, after = advance(current, day_sums(rows.filter(F.col("race_date") == F.lit(day))), tasks)
    _write_days(days, path, number)
    after.write.mode("overwrite").parquet(f"{path}/current/upto={number}")


def _features(day: Column) -> list[Column]:
    means = [F.when(F.col(f"n_{s}") > 0, F.col(f"s_{s}") / F.col(f"n_{s}")).otherwise(history.FILL[n]).alias(n) for n, s in history._MEANS.items()]
    since = F.coalesce((day - F.col("last")).cast("double"), F.lit(history.FILL["days_since_last_race"])).alias("days_since_last_race")
    return [F.coalesce(F.col("starts").cast("double"), F.lit(0.0)).alias("prior_starts"), *means, since]


def _joined(df: DataFrame, table: DataFrame, by_day: bool, tasks: int | None) -> DataFrame:
    names = [n for n in df.columns if n not in history.FEATURES]
    inner = [*SUMS, "last", "runner", "day"]
    own = {n: fresh(n, df.columns, inner) for n in names if n.lower() in inner}
    keyed = df.filter(F.col("race_date").isNotNull()).withColumns({"runner_key": history.entity(), "day_key": history.day_number()}).withColumnsRenamed(own)
    on = (F.col("runner_key") == F.col("runner")) & (F.col("day_key") == F.col("day")) if by_day else F.col("runner_key") == F.col("runner")
    keyed = dealt(keyed, tasks, "runner_key", *(["day_key"] if by_day else []))
    return keyed.join(table, on, "left").select(*(exact(own.get(n, n)).alias(n) for n in names), *_features(F.col("day_key")))


def asof_features(spark: SparkSession, path: str, df: DataFrame, tasks: int | None = None) -> DataFrame:
    """What ``history.asof_features`` gives for rows that are in the table, without sorting anybody's past."""
    return _joined(df, spark.read.schema(_DAYS).parquet(f"{path}/days"), True, tasks)


def card_features(spark: SparkSession, path: str, cards: DataFrame, tasks: int | None = None) -> DataFrame:
    """The features of cards after the last day of the table, from the runners' current sums."""
    return _joined(cards, _newest(spark, path)[0], False, tasks)
