"""A global shuffle into shards, as a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit into memory, by a seeded hash; pass two puts each bucket in
order with a seeded Fisher-Yates shuffle. A record's place in the whole order is its bucket's offset plus its place in the
bucket; shard and slot follow from that place, so shard sizes differ by one row at most (the law ``rows``).

Cases: NULLs hash like any value. Maps and variants count as equal where their JSON is. Rows that are equal in every column would meet in one bucket; they are counted first, and
scattered by the row and an occurrence number from 0 (very many are dealt evenly over the buckets). A row's places so depend
on the rows and the seed alone, not on the input's files, partitions or order. Only rows with counts move, so a large group
of equal rows is no large task. An empty table gives an empty one. Columns named ``shard`` or ``slot`` are replaced. The
order within a bucket is fixed by sorting before the shuffle, so a recomputed task writes the same rows to the same places.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _common as common

BUCKET_BYTES = 16 << 20
#: So many equal rows at most are scattered one by one; more are dealt evenly.
MANY = 1024


def _bytes(name: str, kind: str) -> Column:
    """About the bytes of a value; nested ones by their text."""
    value = common.col(name)
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(value), F.lit(0))
    return F.coalesce(F.octet_length(value.cast("string")), F.lit(0)) if kind.startswith(("array", "map", "struct")) else F.lit(16)


def shuffle(df: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of df with shard (0 to shards - 1) and slot (from 0 in each shard, without gaps)."""
    names = [n for n in df.columns if n not in ("shard", "slot")]
    fields = [f for f in df.schema.fields if f.name in names]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    # Grouping takes -0.0 for 0.0 and folds collated strings: such columns are told apart by their text too.
    loose = [n for n in names if any(x in kinds[n] for x in ("float", "double", "collate"))]
    # Maps and variants can't be grouped or hashed: their JSON stands for them.
    odd = [n for n in names if "map<" in kinds[n] or "variant" in kinds[n]]
    loose = [n for n in names if n in loose or n in odd]
    own = [f"c{i}" for i in range(len(names))]  # within the shuffle columns have names of its own
    base = df.select(*(common.col(n).alias(o) for n, o in zip(names, own, strict=True)))
    total = df.select(sum((_bytes(n, kinds[n]) for n in names), F.lit(64)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    plain = [o for n, o in zip(names, own, strict=True) if n not in odd]
    shown = lambda n, o: F.to_json(F.struct(o)) if n in odd else F.col(o).cast("string")
    texts = {f"t{names.index(n)}": shown(n, own[names.index(n)]) for n in loose}
    keyed = base.withColumns({"h": F.xxhash64(F.lit(seed), *plain, *texts.values()), "g": F.xxhash64(F.lit(seed + 2), *plain, *texts.values()), **texts})
    keep = [F.first(f"c{names.index(n)}").alias(f"v{names.index(n)}") for n in loose]
    distinct = keyed.groupBy(*plain, "h", "g", *texts).agg(F.count("*").alias("m"), *keep)
    distinct = distinct.select(*(F.col(f"v{i}").alias(o) if n in loose else F.col(o) for i, (n, o) in enumerate(zip(names, own, strict=True))), "h", "g", "m")
    one = lambda i: F.pmod(F.xxhash64(F.lit(seed + 1), "h", i), F.lit(buckets)).cast("int")
    start = one(F.lit(-1).cast("long"))
    share = lambda b: F.expr(f"m div {buckets}") + (F.pmod(b - start, F.lit(buckets)) < F.col("m") % buckets).cast("long")
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda i: F.struct(one(i).alias("b"), F.lit(1).cast("long").alias("n")))
    even = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.struct(b.alias("b"), share(b).alias("n")))
    dealt = distinct.withColumn("d", F.explode(F.when(F.col("m") <= MANY, each).otherwise(even)))
    scattered = dealt.select(*own, "h", "g", F.col("d.b").alias("b"), F.col("d.n").alias("times")).filter("times > 0")
    counts = scattered.groupBy("b").agg(F.sum("times").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("b", before.alias("o"))

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("h", "ascending"), ("g", "ascending")])
        bucket = bucket.take(pa.array(np.repeat(np.arange(bucket.num_rows), bucket.column("times").to_numpy())))
        n, order = bucket.num_rows, list(range(bucket.num_rows))
        draw = random.Random(f"{seed}/{bucket.column('b')[0].as_py()}")
        for i in range(n - 1, 0, -1):
            j = draw.randrange(i + 1)
            order[i], order[j] = order[j], order[i]
        first = bucket.column("o")[0].as_py()
        places = [first + i for i in range(n)]
        mixed = bucket.take(pa.array(order)).select(own).rename_columns(names)
        return mixed.append_column("shard", pa.array([p % shards for p in places], pa.int32())).append_column("slot", pa.array([p // shards for p in places], pa.int64()))

    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return scattered.join(offsets, "b").groupBy("b").applyInArrow(fisher_yates, schema)


def write(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in the order of their slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle(docs, shards=8, seed=17).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
