"""Leak-free history features: what is known of a runner from rows before, or days before, its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.names import exact, fresh
from furlong.sources.records import dealt
from furlong.sources.shared import checkpointed

FEATURES = ["prior_starts", "prior_win_rate", "prior_top3_rate", "prior_avg_finish", "prior_avg_odds", "days_since_last_race"]
#: Fixed values for runners without a past.
FILL = {"prior_win_rate": 0.0, "prior_top3_rate": 0.0, "prior_avg_finish": 9.0, "prior_avg_odds": 20.0, "days_since_last_race": 999.0}


def entity() -> Column:
    return F.coalesce(F.col("horse_id"), F.col("horse_name"), F.lit("None"))


def day_number() -> Column:
    return F.datediff("race_date", F.lit("1970-01-01").cast("date"))


_ORDER = ("race_date", "race_id", "horse_number")
#: What is summed up over a runner's past: name to (value, whether a missing one counts as 0).
_SUMS = {
    "wins": lambda: F.coalesce((F.col("finish_position") == 1).cast("double"), F.lit(0.0)),
    "tops": lambda: (F.col("finish_position") <= 3).cast("double"),
    "finish": lambda: F.col("finish_position").cast("double"),
    "odds": lambda: F.col("odds").cast("double"),
}
#: The sum that each mean is made of.
_MEANS = {"prior_win_rate": "wins", "prior_top3_rate": "tops", "prior_avg_finish": "finish", "prior_avg_odds": "odds"}


def _is_top3() -> Column:
    return F.when(F.col("finish_position") <= 3, 1.0).when(F.col("finish_position").isNotNull(), 0.0).alias("is_top3")


def _kept(df: DataFrame) -> list[str]:
    """The columns of df that aren't replaced by a feature."""
    return [n for n in df.columns if n not in (*FEATURES, "is_top3")]


def historical_features(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df with the features and is_top3, which replace columns of these names. One order, so one exchange, one sort and one
    window node. Frames end before the row. A missing finish counts as no win, and is left out of top-three rate and average
    finish. Rows of one runner are one task; where one may have very many (those without id and name are one), use
    ``historical_features_segmented``. tasks: how many runners are dealt to, the session's number by default."""
    k = fresh("k", df.columns)
    by = Window.partitionBy(k).orderBy(*(F.asc_nulls_last(c) for c in _ORDER))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return dealt(df.withColumn(k, entity()), tasks, k).select(
        *map(exact, _kept(df)),
        _is_top3(),
        (F.row_number().over(by) - 1).cast("double").alias("prior_starts"),
        *(F.coalesce(F.avg(_SUMS[s]()).over(before), F.lit(FILL[n])).alias(n) for n, s in _MEANS.items()),
        F.coalesce(F.datediff("race_date", F.lag("race_date").over(by)).cast("double"), F.lit(FILL["days_since_last_race"])).alias("days_since_last_race"),
    )


def historical_features_segmented(df: DataFrame, segments: int | None = None) -> DataFrame:
    """The same rows as ``historical_features``, for runners with any number of rows.

    All rows are dealt in ranges of (runner, order), so a runner with many rows is many segments. Within each segment sums run
    as ever; what a runner has in the segments before it is a row for each segment that goes on with a runner of another one,
    at most one a segment, so these offsets are broadcast. segments: 16 for each shuffle partition, by default."""
    spark = df.sparkSession
    segments = segments or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    k, seg, off = fresh("k", df.columns), fresh("segment", df.columns), fresh("before", df.columns)
    order = [F.asc_nulls_last(c) for c in _ORDER]
    ranges = df.withColumn(k, entity()).repartitionByRange(segments, F.col(k), *order).withColumn(seg, F.spark_partition_id())
    ranges = checkpointed(ranges)  # the segments are read twice and have to be the same ones
    total = ranges.groupBy(k, seg).agg(F.count("*").alias("rows"), F.max("race_date").alias("last"), *(F.sum(x()).alias(f"s_{n}") for n, x in _SUMS.items()), *(F.count(x()).alias(f"n_{n}") for n, x in _SUMS.items()))
    ahead = Window.partitionBy(k).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    names = ["rows", *(f"{p}_{n}" for n in _SUMS for p in "sn")]
    offsets = total.select(k, seg, F.struct(*(F.sum(n).over(ahead).alias(n) for n in names), F.max("last").over(ahead).alias("last")).alias(off)).filter(F.col(f"{off}.rows").isNotNull())
    by = Window.partitionBy(seg, k).orderBy(*order)
    own = by.rowsBetween(Window.unboundedPreceding, -1)
    more = lambda c: F.coalesce(F.col(f"{off}.{c}"), F.lit(0))

    def mean(name: str) -> Column:
        x = _SUMS[_MEANS[name]]()
        n = F.count(x).over(own) + more(f"n_{_MEANS[name]}")
        return F.when(n > 0, (F.coalesce(F.sum(x).over(own), F.lit(0.0)) + more(f"s_{_MEANS[name]}")) / n).otherwise(FILL[name]).alias(name)

    last = F.when(F.row_number().over(by) > 1, F.lag("race_date").over(by)).otherwise(F.col(f"{off}.last"))
    return ranges.join(F.broadcast(offsets), [k, seg], "left").select(
        *map(exact, _kept(df)),
        _is_top3(),
        (F.row_number().over(by) - 1 + more("rows")).cast("double").alias("prior_starts"),
        *map(mean, _MEANS),
        F.coalesce(F.datediff("race_date", last).cast("double"), F.lit(FILL["days_since_last_race"])).alias("days_since_last_race"),
    )


def training_frame(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Features first, then only rows with an outcome; target_top3."""
    return historical_features(df, tasks).filter(F.col("finish_position").isNotNull()).withColumn("target_top3", (F.col("finish_position") <= 3).cast("int"))


def prediction_frame(history: DataFrame, upcoming: DataFrame, strict: bool = True, tasks: int | None = None) -> DataFrame:
    """Features of the upcoming rows. strict: past rows of a race that is also upcoming aren't history of it. Only the history
    of runners that are upcoming is sorted."""
    if strict:
        history = history.join(upcoming.select("race_id").distinct(), "race_id", "left_anti")
    k, u = fresh("k", history.columns, upcoming.columns), fresh("u", history.columns, upcoming.columns)
    runners = upcoming.select(entity().alias(k)).distinct()
    own = history.withColumn(k, entity()).join(runners, k, "left_semi").drop(k)
    both = own.withColumn(u, F.lit(0)).unionByName(upcoming.withColumns({u: F.lit(1), "finish_position": F.lit(None).cast("double")}), allowMissingColumns=True)
    return historical_features(both, tasks).filter(F.col(u) == 1).drop(u)


def asof_features(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df with the same features from days strictly before the row's own, for every race in one pass."""
    k, d = fresh("k", df.columns), fresh("d", df.columns)
    days = Window.partitionBy(k).orderBy(d).rangeBetween(Window.unboundedPreceding, -1)
    dated = df.filter(F.col("race_date").isNotNull()).withColumns({k: entity(), d: day_number()})
    return dealt(dated, tasks, k).select(
        *map(exact, [n for n in df.columns if n not in FEATURES]),
        F.count("*").over(days).cast("double").alias("prior_starts"),
        *(F.coalesce(F.avg(_SUMS[s]()).over(days), F.lit(FILL[n])).alias(n) for n, s in _MEANS.items()),
        F.coalesce((F.col(d) - F.max(d).over(days)).cast("double"), F.lit(FILL["days_since_last_race"])).alias("days_since_last_race"),
    )


def scored(df: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """A fixed linear scorer, and the expected value index (probability times odds)."""
    z = sum((F.col(n) * w for n, w in weights.items()), F.lit(bias))
    return df.withColumn("probability", 1 / (1 + F.exp(-z))).withColumn("expected_value_index", F.col("probability") * F.col("odds"))


def ranked(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ranks by probability to nine digits, so that the order in which averages were summed can't decide; then by number."""
    order = Window.partitionBy("race_id").orderBy(F.desc(F.round("probability", 9)), "horse_number")
    return dealt(df, tasks, "race_id").withColumn("predicted_rank", F.row_number().over(order))


def compared(rows: DataFrame) -> DataFrame:
    """Ranked rows beside their outcome: predicted_top3, actual_top3 and top3_hit, none of them NULL."""
    rows = rows.withColumns({"predicted_top3": F.col("predicted_rank") <= 3, "actual_top3": F.coalesce(F.col("finish_position") <= 3, F.lit(False))})
    return rows.withColumn("top3_hit", F.col("predicted_top3") & F.col("actual_top3"))


def backtest_rows(df: DataFrame, weights: dict[str, float], bias: float, tasks: int | None = None) -> DataFrame:
    """Every race scored with what was known the day before, against its outcome."""
    return compared(ranked(scored(asof_features(df, tasks), weights, bias), tasks))


def backtest_summary(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Of each race its hits, the finish of its first pick, the rank of its winner, its day and how many rows of earlier days it
    was judged by. history: the rows that ``rows`` are made of, where these take fewer steps; a table of as many rows as days is
    made of them."""
    races = rows.groupBy("race_id").agg(
        F.countDistinct(F.when(F.col("top3_hit"), F.col("horse_id"))).alias("hit_count"),
        (F.countDistinct(F.when(F.col("top3_hit"), F.col("horse_id"))) / F.lit(3.0)).alias("hit_rate"),
        F.max(F.when(F.col("predicted_rank") == 1, F.col("finish_position"))).alias("top_pick_finish"),
        F.min(F.when(F.col("finish_position") == 1, F.col("predicted_rank"))).alias("winner_rank"),
        F.min("race_date").alias("race_date"),
    )
    days = (rows if history is None else history).groupBy("race_date").agg(F.count("*").alias("n")).filter(F.col("race_date").isNotNull())
    before = F.sum("n").over(Window.orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("race_date", F.coalesce(before, F.lit(0)).alias("history_rows_used"))
    return races.join(F.broadcast(days), "race_date", "left").select(*races.columns, "history_rows_used")
