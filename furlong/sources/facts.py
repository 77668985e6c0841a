"""The table of runner rows on disk: Parquet partitioned by dataset and year, changed one partition at a time.

A row's partition follows from its key alone (the year is the first four digits of a 12-digit race id; other ids are dealt to
numbered groups), so the partitions that incoming rows can touch are known from their keys. Only these are read, joined and
written again; all others keep their files. A change is staged in full before the first old file goes: Spark writes new
partitions aside and swaps them in when its job commits, so a run that fails leaves the table as it was, and one that is
repeated gives the same rows. One writer at a time.

Cases: a table that isn't there yet is made. No incoming rows is an error. A NULL race_id replaces nothing, and its rows are
kept. Columns that the table's rows lack are NULL, others are dropped, by ``conform``.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators.maintenance import matches
from furlong.sources.records import TYPES, conform

PARTS = ["dataset_type", "year"]
#: Groups of rows whose race id has no year.
GROUPS = 16
#: Files of a partition: at least so many can be, and more where rows are more than these for each.
FILES, ROWS = 4, 200_000


def year_of(race_id: Column) -> Column:
    """The partition of a race: its year, or ``g`` and a group's number."""
    return F.when(race_id.rlike("^[0-9]{12}$"), F.substring(race_id, 1, 4)).otherwise(F.concat(F.lit("g"), F.pmod(F.xxhash64(race_id), F.lit(GROUPS)).cast("string")))


def _types(types: dict[str, str] | None) -> dict[str, str]:
    return TYPES if types is None else types


def read_facts(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """The rows, with year; without a table there are none."""
    fields = ", ".join(f"`{n}` {t}" for n, t in _types(types).items() if n not in PARTS)
    schema = f"{fields}, dataset_type string, year string"
    try:
        return spark.read.schema(schema).parquet(path).select(*_types(types), "year")
    except AnalysisException:
        return spark.createDataFrame([], schema).select(*_types(types), "year")


def _in_parts(touched: list) -> Column:
    """A filter on partitions alone. touched: (dataset_type, year); there are as many as years, not as rows."""
    own: dict[str, list[str]] = {}
    for r in touched:
        own.setdefault(r.dataset_type, []).append(r.year)
    each = [(F.col("dataset_type") == k) & F.col("year").isin(sorted(v)) for k, v in own.items()]
    return functools.reduce(lambda a, b: a | b, each, F.lit(False))


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _dealt(df: DataFrame, rows: int, files: int) -> DataFrame:
    """df with file_no, in tasks by partition and file: rows of a partition go to files by race, so that a year is many."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS))
    return df.withColumn("file_no", F.pmod(F.xxhash64("race_id"), F.lit(files))).repartition(tasks, *PARTS, "file_no")


def _files(rows: int, parts: int) -> int:
    return max(FILES, math.ceil(rows / ROWS / parts))


def _write(dealt: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replaces the partitions that the rows, dealt before, belong to."""
    dealt.drop("file_no").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def upsert_facts(path: str, incoming: DataFrame, run_id: str, dataset_type: str, types: dict[str, str] | None = None) -> int:
    """Puts incoming into the table in place of its rows with the same (race_id, horse_id or '', dataset_type), stamped with run,
    dataset and time. Repeated rows of incoming all stay. Returns how many partitions were written.

    incoming is evaluated once: it is staged beside the table first."""
    spark, stage = incoming.sparkSession, f"{path}/_staged-{uuid.uuid4().hex}"
    stamps = {"dataset_type": F.lit(dataset_type), "collection_run_id": F.lit(run_id), "collected_at": F.current_timestamp()}
    stamped = conform(incoming.withColumns({n: c for n, c in stamps.items() if n in _types(types)}), _types(types))
    try:
        stamped.withColumn("year", year_of(F.col("race_id"))).write.partitionBy(*PARTS).parquet(stage)
        new = read_facts(spark, stage, types)
        touched = new.select(*PARTS).distinct().collect()
        if not touched:
            raise ValueError("there are no rows to put in")
        key = lambda d: d.select("*", F.coalesce("horse_id", F.lit("")).alias("same_horse"))
        old = read_facts(spark, path, types).filter(_in_parts(touched))
        rows = old.count() + new.count()  # Parquet keeps these
        place = [*PARTS, "file_no"]
        deal = lambda d: _dealt(d, rows, _files(rows, len(touched)))
        # A key's rows are in one file of one partition, so what is dealt for the join is dealt for the write.
        keys = key(deal(new.select("race_id", "horse_id", *PARTS))).select("race_id", "same_horse", *place).distinct()
        kept = key(deal(old)).join(keys, ["race_id", "same_horse", *place], "left_anti").drop("same_horse")
        _write(kept.unionByName(deal(new)), path)
        return len(touched)
    finally:
        _delete(spark, stage)


def delete_facts(spark: SparkSession, path: str, column: str, values: list[str], prefix: bool = False, types: dict[str, str] | None = None) -> int:
    """Deletes rows whose column equals one of the values (or begins with one); partitions without such rows aren't touched, and
    those that lose all their rows go. Returns how many rows went."""
    found = read_facts(spark, path, types)
    gone = matches(F.col(column), values, prefix)
    counts = found.groupBy(*PARTS).agg(F.count_if(gone).alias("gone"), F.count("*").alias("n")).filter("gone > 0").collect()
    some, whole = [r for r in counts if r.gone < r.n], [r for r in counts if r.gone == r.n]
    if some:
        rows = sum(r.n for r in some)
        _write(_dealt(found.filter(_in_parts(some) & ~gone), rows, _files(rows, len(some))), path)
    for r in whole:
        _delete(spark, f"{path}/dataset_type={r.dataset_type}/year={r.year}")
    return sum(r.gone for r in counts)
