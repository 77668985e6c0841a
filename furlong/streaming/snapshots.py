"""Streams: the latest snapshot of a value per key, and pages that arrive as files."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from furlong.functions.names import fresh
from furlong.operators import extract
from furlong.sources import facts, files


def latest_snapshot(events: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """The last value of each key; equal times: the larger value. Works on batches and (with complete or update output) streams,
    where it remembers every key for good; ``latest_stream`` doesn't."""
    last = F.max(F.struct(ts, value))
    return events.groupBy(*keys).agg(last.getField(ts).alias(f"last_{ts}"), last.getField(value).alias(f"last_{value}"))


#: Cells that the keys of ``latest_stream`` are dealt to; a cell is one value of the state.
CELLS = 1024


def _packed(key: Column, kind: str) -> Column:
    """Numbers and times as text, as pandas has no missing whole numbers, and knows neither NaN from missing nor repeated hours."""
    numeric = kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    return F.unix_micros(key).cast("string") if kind == "timestamp" else key.cast("string") if numeric else key


def _unpacked(key: Column, kind: str) -> Column:
    return F.timestamp_micros(key.cast("bigint")) if kind == "timestamp" else key.cast(kind)


def latest_stream(events: DataFrame, keys: list[str], ts: str, value: str, delay: str = "1 hour", expire_ms: int = 86_400_000, cells: int = CELLS) -> DataFrame:
    """A stream of what became the last value of a key: keys, last_<ts>, last_<value>, for update output. A sink that replaces by
    key holds the same rows as ``latest_snapshot`` of the events that weren't late.

    Events that are more than ``delay`` behind the newest are late and dropped. What is held of a key is its last time and value,
    and goes when the watermark is expire_ms beyond that time; a later event of the key begins anew, with a later time, as
    earlier ones would be late. Older and repeated events change nothing; equal times: the larger value, a missing one is the
    smallest. Events without a time are dropped. Keys are of plain types.

    Keys are dealt to so many cells by their hash, and a cell's keys are compared at once, as a call of Python for each key costs
    far more than its events do. A batch writes the cells anew that it has events of, so their number should grow with that of
    keys (some thousands each are well); it stays the same as long as a checkpoint is gone on with."""
    kinds, types = {f.name: f.dataType for f in events.schema.fields}, dict(events.dtypes)
    cell, at, has, old = (fresh(n, events.columns) for n in ("cell", "at", "has", "old"))
    own = [fresh(f"key{i}", events.columns) for i in range(len(keys))]
    state = T.StructType([T.StructField("rows", T.BinaryType())])
    plain = {k: F.col(k) + F.lit(0).cast(types[k]) if types[k] in ("float", "double") else F.col(k) for k in keys}  # -0.0 is 0.0
    empty = F.lit(0).cast(types[value]) if types[value] in ("tinyint", "smallint", "int", "bigint", "boolean") else F.lit(None).cast(types[value])
    watched = events.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    dealt = watched.select(
        F.pmod(F.xxhash64(*plain.values()), F.lit(cells)).alias(cell), *(_packed(plain[k], types[k]).alias(o) for k, o in zip(keys, own)),
        F.unix_micros(ts).alias(at), F.col(value).isNotNull().alias(has), F.coalesce(value, empty).alias(value), ts,
    )
    names = [*own, at, has, value]
    out = T.StructType([dealt.schema[n] for n in names])

    def newest(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = pd.read_feather(io.BytesIO(held.get[0])) if held.exists else None
        rows = None if before is None else before.assign(**{old: True})
        for batch in () if held.hasTimedOut else batches:
            one = batch[names].assign(**{old: False})
            rows = one if rows is None else pd.concat([one, rows])  # of equal ones the last stays, which is the held one
            for by in (value, has, at):
                rows = rows.sort_values(by, kind="stable")  # NaN is the largest
            rows = rows.drop_duplicates(own, keep="last")
        new = rows[~rows[old]]
        if len(new):
            yield new[names]
        left = rows[rows[at] // 1000 + expire_ms > held.getCurrentWatermarkMs()][names]
        if left.empty:
            held.remove()
            return
        if len(new) or len(left) < len(before):
            left.reset_index(drop=True).to_feather(packed := io.BytesIO())
            held.update((packed.getvalue(),))
        held.setTimeoutTimestamp(int(left[at].min()) // 1000 + expire_ms)

    found = dealt.groupBy(cell).applyInPandasWithState(newest, out, state, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        *(_unpacked(F.col(o), types[k]).alias(k) for k, o in zip(keys, own)), F.timestamp_micros(at).cast(kinds[ts]).alias(f"last_{ts}"), F.when(F.col(has), F.col(value)).alias(f"last_{value}")
    )


def ingest(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Runs what has arrived through ``write`` and stops; a repeated batch replaces its own rows when write is an upsert."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_stream(spark: SparkSession, root: str, dataset_type: str, kind: str = "result", files_a_batch: int = 1000) -> DataFrame:
    """The saved pages of ``read_pages`` as they arrive under root/<dataset_type>/<year>/<kind>/."""
    arriving = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.html").option("maxFilesPerTrigger", files_a_batch)
    found = arriving.text(f"{root}/{dataset_type}/[0-9]*/{kind}")
    return files.placed(found.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")))


def ingest_pages(stream: DataFrame, table: str, checkpoint: str, dataset_type: str, run_id: str = "stream", dates: DataFrame | None = None, errors: str | None = None):
    """Reads arriving pages into the table of runner rows, partition by partition, and stops when all that is there is in.

    stream: what ``page_stream`` gives. dates: (race_id, race_date), else dates are NULL. Of several pages of a race in a batch
    that with the last file name counts. A runner's rows are replaced by those of a later page of its race, so files that
    come again, or a batch that does, change nothing. errors: a folder that gets (race_id, reason) of the pages without
    runners, one subfolder a batch, which a repeated batch writes anew. Pages whose name has no race id are errors too."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.filter("race_id IS NOT NULL").groupBy("race_id").agg(F.max_by("html", "file_name").alias("html"))
        dated = last.withColumn("race_date", F.lit(None).cast("date")) if dates is None else last.join(dates.select("race_id", "race_date"), "race_id", "left")
        read = extract.read_races(dated.withColumn("dataset_type", F.lit(dataset_type))).persist()
        try:
            runners = extract.runners_of(read)
            if not runners.isEmpty():
                facts.upsert_facts(table, runners, f"{run_id}_{number}", dataset_type)
            if errors:
                nameless = batch.filter("race_id IS NULL").select("race_id", F.concat(F.lit("no race id: "), "file_name").alias("reason"))
                extract.errors_of(read).unionByName(nameless).write.mode("overwrite").parquet(f"{errors}/batch={number}")
        finally:
            read.unpersist()

    return ingest(stream, checkpoint, write)
