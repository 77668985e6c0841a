"""What the operators share: reading tables, the shared folder, folds, names that don't clash."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints, which all machines reach.

    It is the session's spark.checkpoint.dir; only where that is unset (a local session, as in tests) is one made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, without their lineage."""
    spark = df.sparkSession
    shared(spark)
    # Rows of text, or of packed blocks, are large: batches for Python are bounded by bytes rather than by their usual rows.
    before = spark.conf.get(BATCH_BYTES[0], None)
    spark.conf.set(*BATCH_BYTES)
    try:
        return df.checkpoint()
    finally:
        spark.conf.unset(BATCH_BYTES[0]) if before is None else spark.conf.set(BATCH_BYTES[0], before)


def free(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that no frame can reach any more go from disk now, not when the driver next happens to
    collect its garbage. Nothing that is still needed is touched."""
    spark.range(1).count()  # Spark holds on to the last plan that ran until another one has
    gc.collect()
    time.sleep(1.5)  # the JVM is told once a second which frames Python has dropped
    spark.sparkContext._jvm.System.gc()


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) leaves that remainder; false for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fresh(name: str, *taken) -> str:
    """A column name that isn't among these lists of names, in any case."""
    used = {n.lower() for names in taken for n in names}
    while name.lower() in used:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for columns of any name; Spark's own looks columns up by expressions that odd names can't be in."""
    names = df.columns

    def named(batches):
        yield from run(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
