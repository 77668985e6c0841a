"""Keyed upsert and delete of plain tables: new versions from anti-joins and unions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.names import exact, fresh


def upsert_records(existing: DataFrame, incoming: DataFrame, run_id: str, dataset_type: str) -> DataFrame:
    """existing without the rows whose (race_id, horse_id or '', dataset_type) comes in, and all of incoming, stamped.

    Duplicates within incoming all stay; a NULL race_id replaces nothing."""
    stamped = incoming.withColumns({"dataset_type": F.lit(dataset_type), "collection_run_id": F.lit(run_id)})
    h = fresh("h", existing.columns, stamped.columns)
    key = lambda d: d.withColumn(h, F.coalesce("horse_id", F.lit("")))
    keys = key(stamped).select("race_id", h, "dataset_type").distinct()
    kept = key(existing).join(keys, ["race_id", h, "dataset_type"], "left_anti").select(*map(exact, existing.columns))
    return kept.unionByName(stamped, allowMissingColumns=True)


def upsert_ledger(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def matches(column: Column, values: list[str], prefix: bool = False) -> Column:
    """Equal to one of the values as text, or beginning with one (literally; no wildcard). One expression, however many values:
    equality is a set; a prefix is looked up by each length that there is."""
    text = column.cast("string")
    if not values:
        return F.lit(False)
    lengths = sorted({len(v) for v in values}) if prefix else [None]
    same = [(text if n is None else F.substring(text, 1, n)).isin([v for v in values if n is None or len(v) == n]) for n in lengths]
    return F.coalesce(functools.reduce(lambda a, b: a | b, same), F.lit(False))


def delete_rows(tables: dict[str, DataFrame], column: str, values: list[str], prefix: bool = False) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """(the tables without the matching rows, how many went from each that has the column and lost any)."""
    having = {n: t for n, t in tables.items() if column in t.columns}
    counts = None
    for n, t in having.items():
        own = t.filter(matches(t[column], values, prefix)).agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table_name"), "deleted").filter("deleted > 0")
        counts = own if counts is None else counts.unionByName(own)
    return {n: t.filter(~matches(t[column], values, prefix)) if n in having else t for n, t in tables.items()}, counts


def values_with(values: DataFrame, wanted: DataFrame, prefix: bool = False) -> DataFrame:
    """Those of the distinct texts (one column) that equal a wanted text (one column), or begin with one. A text is looked up by
    each length that wanted texts have, so the plan depends on these lengths alone, not on how many texts are wanted."""
    v, w = values.columns[0], wanted.columns[0]
    own = values.select(exact(v).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    ids = wanted.select(exact(w).cast("string").alias("p")).filter("p IS NOT NULL").distinct()
    if not prefix:
        return own.join(ids, F.col("v") == F.col("p"), "left_semi")
    lengths = [r.n for r in ids.select(F.length("p").alias("n")).distinct().collect()]
    if not lengths:
        return own.filter("false")
    parts = own.select("v", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, sorted(lengths))), lambda n: F.substring(F.col("v"), F.lit(1), n)))).alias("p"))
    return parts.join(ids, "p", "left_semi").select("v").distinct()


def delete_joined(tables: dict[str, DataFrame], column: str, wanted: DataFrame, prefix: bool = False) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """What ``delete_rows`` does, for any number of wanted texts (one column): joins instead of literals in the plan."""
    kept, counts = dict(tables), []
    for n, t in tables.items():
        if column not in t.columns:
            continue
        gone = values_with(t.select(column), wanted, prefix)
        on = exact(column).cast("string") == F.col("v")
        kept[n] = t.join(gone, on, "left_anti")
        counts.append(t.join(gone, on, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(n).alias("table_name"), "deleted").filter("deleted > 0"))
    return kept, functools.reduce(DataFrame.unionByName, counts) if counts else None
