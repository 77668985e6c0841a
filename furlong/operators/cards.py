"""Cards of races to come: newer values put in, completeness, attributes of runners, predictions beside results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.names import exact, fresh
from furlong.sources.records import dealt, ordered

#: Fixed value: how a printed price looks.
PRICE = r"^[0-9]+(\.[0-9]+)?$"
_PAYLOAD = T.StructType([T.StructField("official_datetime", T.StringType()), T.StructField("odds", T.MapType(T.StringType(), T.StringType()))])
_WIN = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def valid_price(odds: Column, popularity: Column) -> Column:
    return F.coalesce(odds.rlike(PRICE) & popularity.rlike("^[0-9]+$"), F.lit(False))


def enrich_odds(cards: DataFrame, snapshots: DataFrame, tasks: int | None = None) -> DataFrame:
    """cards with the odds and popularity of their race's latest valid snapshot (race_id, horse_number, ts, odds, popularity,
    as text); runners without one keep theirs. Numbers match with or without leading zeros. enriched tells which were set."""
    key, new = fresh("number", cards.columns), fresh("new", cards.columns)
    number = lambda d: F.when(F.length(d["horse_number"].cast("string")) < 2, F.lpad(d["horse_number"].cast("string"), 2, "0")).otherwise(d["horse_number"].cast("string"))
    valid = snapshots.filter(valid_price(F.col("odds"), F.col("popularity")))
    valid = dealt(valid, tasks, "race_id")
    last = valid.groupBy("race_id", number(valid).alias(key)).agg(F.max(F.struct("ts", "odds", "popularity")).alias(new))
    joined = cards.withColumn(key, number(cards)).join(last, ["race_id", key], "left")
    return joined.withColumns({
        "odds": F.coalesce(F.col(f"{new}.odds").try_cast("double"), F.col("odds")), "popularity": F.coalesce(F.col(f"{new}.popularity").try_cast("int"), F.col("popularity")),
        "enriched": F.col(new).isNotNull(),
    }).drop(key, new)


def payload_snapshots(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(race_id, horse_number, ts, odds, popularity, as text) of published odds, as ``enrich_odds`` takes them.

    payloads: race_id and JSON ``{"data": {"official_datetime": ..., "odds": {"1": {number: [odds, any, popularity]}}}}``, where
    data may itself be JSON inside a string. A payload without data, or whose data is none of these, is not published yet and
    gives no row; nor do entries with fewer than three values. ts is the time as it is written, NULL where there is none."""
    outer = F.get_json_object(F.col(payload), "$.data")  # text as it is, or the object's JSON
    data = F.from_json(outer, _PAYLOAD)
    won = F.try_element_at(data.getField("odds"), F.lit("1"))
    entries = F.map_entries(F.from_json(won, _WIN))
    rows = payloads.select("race_id", data.getField("official_datetime").alias("ts"), F.explode(entries).alias("e")).filter(F.size("e.value") >= 3)
    text = lambda i: F.trim(F.get(F.col("e.value"), F.lit(i)))
    return rows.select("race_id", F.col("e.key").alias("horse_number"), F.nullif("ts", F.lit("")).alias("ts"), text(0).alias("odds"), text(2).alias("popularity"))


def odds_complete(cards: DataFrame) -> DataFrame:
    """Of each race whether all its runners have valid odds and popularity (given as text)."""
    return cards.groupBy("race_id").agg(F.bool_and(valid_price(F.col("odds"), F.col("popularity"))).alias("complete"))


def attach_latest(rows: DataFrame, dimension: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with the columns of the dimension's first row of their key in that order; NULLs without one. Keys match exactly."""
    n = fresh("n", dimension.columns)
    one = dimension.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(n) == 1).drop(n)
    return rows.join(one, key, "left")


def race_runners(rows: DataFrame, race_ids: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """The runners of races (all without ids), by finish and number, missing ones last."""
    some = rows if race_ids is None else rows.filter(F.col("race_id").isin(race_ids))
    return ordered(some, tasks, "race_id", F.asc_nulls_last("finish_position"), F.asc_nulls_last("horse_number"))


def prediction_vs_actual(predicted: DataFrame, actual: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each prediction beside its result: by horse_id, or by horse_number in races whose results carry no horse_id at all. A
    missing id (or number) is the same as another one of its race. Columns of predicted named like an output are replaced.
    tasks: how many both sides are dealt to, the session's number by default."""
    predicted = predicted.drop("actual_finish")
    k, n, i, other = (fresh(x, predicted.columns) for x in ("key", "nameless", "id", "number"))
    a = actual.select("race_id", F.col("horse_id").alias(i), F.col("horse_number").alias(other), F.col("finish_position").alias("actual_finish"))
    a = a.withColumn(n, F.max(F.col(i).isNotNull().cast("int")).over(Window.partitionBy("race_id")) == 0)
    key = lambda nameless, horse, number: F.concat(F.when(nameless, "#").otherwise("="), F.coalesce(F.concat(F.lit("="), F.when(nameless, number.cast("string")).otherwise(horse)), F.lit("")))
    a = a.withColumn(k, key(F.col(n), F.col(i), F.col(other)))
    kinds = a.groupBy("race_id").agg(F.bool_or(n).alias(n))
    p = predicted.join(kinds, "race_id", "left").withColumn(k, key(F.coalesce(n, F.lit(False)), F.col("horse_id"), F.col("horse_number")))
    joined = dealt(p.drop(n), tasks, "race_id", k).join(a.drop(n, i), ["race_id", k], "left")
    return joined.withColumn("horse_number", F.coalesce("horse_number", other)).select(*map(exact, predicted.columns), "actual_finish")


def onehot_long(rows: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """rows with ``category``: the value where training had it twice or more, ``__infrequent__`` where once, NULL where never;
    a missing value is ``__missing__``. counts: (value, n) of the training rows."""
    rows = rows.drop(*([] if column == "category" else ["category"]))
    own = fresh("value", rows.columns)
    known = counts.select(F.col("value").alias(own), F.when(F.col("n") < 2, "__infrequent__").otherwise(F.col("value")).alias("category"))
    return rows.withColumn(own, F.coalesce(F.col(column), F.lit("__missing__"))).join(known, own, "left").drop(own)
