"""Ledgers of runs: comparison of training curves, advice, labels, and what goes when a run is deleted."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.names import fresh
from furlong.operators.maintenance import matches
from furlong.sources.records import dealt

#: Gaps of AUC between training and validation, and the growth of the loss, that count as overfit.
MILD_GAP, SEVERE_GAP, LOSS_GROWTH = 0.08, 0.15, 1.15
#: The steps that hidden sizes and learning rates take.
HIDDEN_SIZES = [32, 64, 128, 256]
LEARNING_RATES = [0.0001, 0.0003, 0.001, 0.003]


def early_stop_point(curves: DataFrame, run: str, epoch: str, loss: str, patience: int, least: float = 1e-4) -> DataFrame:
    """Of each run: the epoch that training keeps and the last one it reaches. The best epoch moves only when the loss falls by
    more than ``least``; training stops after ``patience`` epochs without. A run's epochs (some hundreds) are one array."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("best_epoch"), F.lit(0).alias("misses"), F.lit(None).cast("int").alias("last_epoch"))

    def step(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (x["v"] < s["best"] - least)
        moved = F.struct(
            F.when(better, x["v"]).otherwise(s["best"]).alias("best"), F.when(better, x["e"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            F.when(better, 0).otherwise(s["misses"] + 1).alias("misses"), x["e"].alias("last_epoch"),
        )
        return F.when(s["misses"] >= patience, s).otherwise(moved)

    points = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("int").alias("e"), F.col(loss).cast("double").alias("v"))))
    return curves.groupBy(run).agg(F.aggregate(points, start, step).alias("s")).select(run, "s.best_epoch", "s.last_epoch")


def overfit_verdict(curves: DataFrame, run: str = "model_run_id", patience: int = 12, least: float = 1e-4) -> DataFrame:
    """severe, mild or ok for each run: the AUC gap at the epoch that early stopping keeps, and how the last loss compares
    with the least one of all."""
    kept = early_stop_point(curves, run, "epoch", "val_loss", patience, least)
    at = F.filter("points", lambda p: p.epoch == F.col("best_epoch"))
    points = curves.groupBy(run).agg(F.collect_list(F.struct("epoch", "train_auc", "val_auc")).alias("points"), F.min("val_loss").alias("least_loss"), F.max_by("val_loss", "epoch").alias("last_loss"), F.count("*").alias("n_epochs"))
    one = points.join(kept.select(run, "best_epoch"), run).withColumn("b", F.get(at, F.lit(0)))
    gap, grown = F.col("b.train_auc") - F.col("b.val_auc"), F.col("last_loss") > F.col("least_loss") * LOSS_GROWTH
    verdict = F.when((gap >= SEVERE_GAP) | grown, "severe").when(gap >= MILD_GAP, "mild").otherwise("ok")
    return one.select(run, "best_epoch", F.col("b.train_auc").alias("train_auc"), gap.alias("gap"), "n_epochs", verdict.alias("verdict"))


def _step(value: Column, grid: list, by: int) -> Column:
    """The neighbour on the grid, or its end; a value off the grid stays."""
    steps = F.array(*map(F.lit, grid))
    at = F.array_position(steps, value).cast("int")
    return F.when(at > 0, F.element_at(steps, F.least(F.greatest(at + by, F.lit(1)), F.lit(len(grid))))).otherwise(value)


def tuning_advice(runs: DataFrame) -> DataFrame:
    """runs (overfit_verdict beside hidden_size, dropout, learning_rate, patience and epochs) with the values to try next."""
    severe, mild, weak = F.col("verdict") == "severe", F.col("verdict") == "mild", F.col("train_auc") < 0.70
    early = F.col("best_epoch") <= 3
    unfinished = ~early & (F.col("n_epochs") >= F.col("epochs")) & (F.col("best_epoch") >= F.col("n_epochs") * 0.9)
    calmer = F.when(severe, F.least(F.round(F.col("dropout") + 0.10, 2), F.lit(0.7))).when(mild, F.least(F.round(F.col("dropout") + 0.05, 2), F.lit(0.7))).otherwise(F.col("dropout"))
    smaller = F.when(severe, _step(F.col("hidden_size"), HIDDEN_SIZES, -1)).otherwise(F.col("hidden_size"))
    reasons = F.array_compact(F.array(F.when(severe, "severe_overfit"), F.when(mild, "mild_overfit"), F.when(weak, "weak_training"), F.when(early, "early_best"), F.when(unfinished, "still_improving")))
    halfway = runs.withColumns({"_dropout": calmer, "_hidden": smaller})
    return halfway.withColumns({
        "next_hidden_size": F.when(weak, _step(F.col("_hidden"), HIDDEN_SIZES, 1)).otherwise(F.col("_hidden")),
        "next_dropout": F.when(weak, F.greatest(F.round(F.col("_dropout") - 0.05, 2), F.lit(0.0))).otherwise(F.col("_dropout")),
        "next_patience": F.when(severe, F.greatest(F.lit(5), F.col("patience") - 3)).otherwise(F.col("patience")),
        "next_learning_rate": F.when(early, _step(F.col("learning_rate"), LEARNING_RATES, -1)).otherwise(F.col("learning_rate")),
        "next_epochs": F.when(unfinished, F.least(F.col("epochs") + 20, F.lit(500))).otherwise(F.col("epochs")),
        "reasons": F.when(F.size(reasons) == 0, "keep").otherwise(F.array_join(reasons, ",")),
    }).drop("_dropout", "_hidden")


def newest_first(ledger: DataFrame, at: str, key: str, top: int | None = None) -> DataFrame:
    """The ledger by time, newest first (a missing time last, equal times by key); with top, a top-k without a full sort."""
    ordered = ledger.orderBy(F.desc_nulls_last(at), key)
    return ordered if top is None else ordered.limit(top)


def delete_run(tables: dict[str, DataFrame], ledger: DataFrame, run_ids: list[str], columns: tuple[str, ...] = ("run_id", "collection_run_id", "source_run_id")) -> dict[str, DataFrame]:
    """The tables without what the runs brought: the rows of races that their ledger entries (run_id, race_id) name, and rows
    that carry a run's id, or an id beginning with it, in one of the columns. NULL ids and races stay."""
    races = ledger.filter(matches(F.col("run_id"), run_ids, prefix=True) & F.col("race_id").isNotNull()).select("race_id").distinct()
    out = {}
    for name, t in tables.items():
        left = t.join(races, "race_id", "left_anti") if "race_id" in t.columns else t
        for c in columns:
            left = left.filter(~matches(F.col(c), run_ids, prefix=True)) if c in t.columns else left
        out[name] = left
    return out


def delete_model(tables: dict[str, DataFrame], model_ids: list[str], column: str = "model_run_id") -> dict[str, DataFrame]:
    """The tables without rows that carry exactly one of the ids; tables without the column and NULL ids stay."""
    return {name: t.filter(~matches(F.col(column), model_ids)) if column in t.columns else t for name, t in tables.items()}


def deleted_run_counts(tables: dict[str, DataFrame], ledger: DataFrame, run_ids: list[str], columns: tuple[str, ...] = ("run_id", "collection_run_id", "source_run_id")) -> DataFrame:
    """Of each table that ``delete_run`` takes rows from: how many. Each table is read once."""
    races = ledger.filter(matches(F.col("run_id"), run_ids, prefix=True) & F.col("race_id").isNotNull()).select("race_id").distinct().withColumn("_gone", F.lit(True))
    found = []
    for name, t in tables.items():
        own = t.join(races, "race_id", "left") if "race_id" in t.columns else t.withColumn("_gone", F.lit(False))
        gone = F.coalesce("_gone", F.lit(False))
        for c in columns:
            gone = gone | matches(F.col(c), run_ids, prefix=True) if c in t.columns else gone
        found.append(_count(own, name, gone))
    return _counts(found)


def deleted_model_counts(tables: dict[str, DataFrame], model_ids: list[str], column: str = "model_run_id") -> DataFrame:
    """Of each table that ``delete_model`` takes rows from: how many."""
    return _counts([_count(t, name, matches(F.col(column), model_ids) if column in t.columns else F.lit(False)) for name, t in tables.items()])


def _count(t: DataFrame, name: str, gone: Column) -> DataFrame:
    return t.agg(F.count_if(gone).alias("deleted")).filter("deleted > 0").select(F.lit(name).alias("table_name"), "deleted")


def _counts(found: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, found)


def run_counters(rows: DataFrame, run: str, tasks: int | None = None) -> DataFrame:
    """Of each run: rows, days, races and runners. Values are counted once each, in so many tasks, before they are a run's."""
    key, kinds = fresh("run", rows.columns), {"n_days": "race_date", "n_races": "race_id", "n_horses": "horse_id"}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(c).cast("string").alias("value")) for n, c in kinds.items())))
    values = dealt(rows.select(F.col(run).alias(key), each.alias("x")).select(key, "x.*"), tasks, key, "kind", "value")
    one = values.groupBy(key, "kind", "value").agg(F.count("*").alias("n"))
    counts = (F.count(F.when(F.col("kind") == n, F.col("value"))).alias(n) for n in kinds)
    return one.groupBy(key).agg(F.sum(F.when(F.col("kind") == "n_days", F.col("n"))).alias("n_rows"), *counts).withColumnRenamed(key, run)


def latest_version(pages: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key: the first in that order."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def test_period_flag(rows: DataFrame, first: str, last: str, date: str = "race_date") -> DataFrame:
    """rows with in_test_period: whether the model that was tested from first to last hasn't learned from the date; NULL without a range."""
    return rows.withColumn("in_test_period", F.col(date).between(F.col(first), F.col(last)))


test_period_flag.__test__ = False


def runs_by_source(ledger: DataFrame, sources: list[str]) -> DataFrame:
    """The ids of runs whose data came from one of the sources."""
    return ledger.filter(F.col("source").isin(sources)).select("run_id").distinct()


def delete_by_source(tables: dict[str, DataFrame], ledger: DataFrame, sources: list[str], columns: tuple[str, ...] = ("run_id", "collection_run_id", "source_run_id")) -> dict[str, DataFrame]:
    """The tables without what any run of these sources brought, all runs in one pass: rows that carry such a run's id in one
    of the columns, and rows of races that the ledger's entries (run_id, race_id) of such runs name. Ids match exactly."""
    gone = runs_by_source(ledger, sources)
    races = ledger.join(gone, "run_id", "left_semi").filter(F.col("race_id").isNotNull()).select("race_id").distinct()
    out = {}
    for name, t in tables.items():
        left = t.join(races, "race_id", "left_anti") if "race_id" in t.columns else t
        for c in columns:
            left = left.join(gone.withColumnRenamed("run_id", c), c, "left_anti") if c in t.columns else left
        out[name] = left.select(*t.columns)
    return out
