"""Registered queries of tables that are written to the shared folder and read back: partitioned facts, standings, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furlong.operators import history, maintenance, standing, summary
from furlong.plans.queries import _ASOF, _FEATURES, _WINDOWS, ORACLE_SQL, _parts, _register
from furlong.sources import facts
from furlong.sources.records import records, table, task_count
from furlong.sources.shared import shared_folder, written
from furlong.streaming import snapshots


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


@_register("""SELECT race_id, horse_id, finish_position, dataset_type, 'one' AS collection_run_id FROM r WHERE NOT (dataset_type = 'historical' AND surface = '1-URGENT')
UNION ALL SELECT race_id, horse_id, 1.0::DOUBLE, dataset_type, 'two' FROM r WHERE surface = '1-URGENT' AND dataset_type = 'historical' AND CAST(race_id AS BIGINT) % 2 = 0
UNION ALL SELECT race_id, horse_id, finish_position, dataset_type, 'one' FROM r WHERE surface = '1-URGENT' AND dataset_type = 'historical' AND CAST(race_id AS BIGINT) % 2 = 1""")
def upsert_partitioned(spark, sf_dir):
    """The table on disk: both datasets written, then some races of one of them replaced."""
    path, r = _folder(spark), records(spark, sf_dir)
    for kind, rows in zip(("historical", "upcoming"), _parts(spark, sf_dir)):
        facts.upsert_facts(path, rows, "one", kind)
    new = r.filter("surface = '1-URGENT' AND dataset_type = 'historical' AND cast(race_id AS bigint) % 2 = 0").withColumn("finish_position", F.lit(1.0))
    facts.upsert_facts(path, new, "two", "historical")
    return facts.read_facts(spark, path).select("race_id", "horse_id", "finish_position", "dataset_type", "collection_run_id")


@_register(f"SELECT *, {_FEATURES} FROM (SELECT * REPLACE (CASE WHEN CAST(horse_id AS BIGINT) % 3 > 0 THEN horse_id END AS horse_id, CASE WHEN CAST(horse_id AS BIGINT) % 3 > 0 THEN horse_name END AS horse_name) FROM r) {_WINDOWS}")
def historical_features_segmented(spark, sf_dir):
    """A third of all rows are one runner's, who has neither id nor name."""
    known = F.col("horse_id").cast("long") % 3 > 0
    r = records(spark, sf_dir).withColumns({"horse_id": F.when(known, F.col("horse_id")), "horse_name": F.when(known, F.col("horse_name"))})
    return history.historical_features_segmented(r)


@_register(f"SELECT race_id, horse_id, {', '.join(f'round({c}, 9) AS {c}' for c in history.FEATURES)} FROM (SELECT *, {_ASOF})")
def asof_from_standings(spark, sf_dir):
    """All rows but those of the last two days first, then each of these by itself."""
    path, tasks = _folder(spark), task_count(spark, sf_dir)
    r = written(records(spark, sf_dir).select("race_id", "race_date", "horse_id", "horse_name", "finish_position", "odds"))
    last = [x.race_date for x in r.select("race_date").distinct().orderBy(F.desc("race_date")).limit(2).collect()][::-1]
    standing.build(r.filter(F.col("race_date") < last[0]), path, tasks)
    for day in last:
        standing.add_day(spark, path, r, day, tasks)
    return standing.asof_features(spark, path, r, tasks).select("race_id", "horse_id", *(F.round(c, 9).alias(c) for c in history.FEATURES))


@_register(ORACLE_SQL["latest_snapshot_per_user"], False)
def latest_stream_per_user(spark, sf_dir):
    """The events as a stream with keyed state that expires; what it emits is kept by batch, and the last of each key counts."""
    path, schema = _folder(spark), table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = snapshots.latest_stream(events, ["user_id", "event_type"], "ts", "value")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/latest/batch={n}")
    query = out.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = F.max(F.struct("last_ts", "last_value"))
    return spark.read.parquet(f"{path}/latest").groupBy("user_id", "event_type").agg(last.alias("x")).select("user_id", "event_type", "x.*")


@_register("""SELECT r.race_id, r.horse_id FROM r WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 50 = 0 AND starts_with(race_id, CAST(c_custkey AS VARCHAR)))""")
def delete_prefixes_joined(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select("c_custkey")
    return maintenance.delete_joined({"races": records(spark, sf_dir)}, "race_id", wanted, prefix=True)[0]["races"].select("race_id", "horse_id")


@_register("""SELECT year, p.n IS NOT NULL AS has_pages, has IS NOT NULL AS has_rows, coalesce(p.n, 0) AS n_pages FROM (SELECT CAST(year(o_orderdate) AS INTEGER) + 2 AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p
FULL JOIN (SELECT DISTINCT CAST(year(race_date) AS INTEGER) AS year, true AS has FROM r WHERE dataset_type = 'historical') USING (year)""")
def collected_years(spark, sf_dir):
    """Years of finished orders, moved by two, stand for those of saved pages."""
    pages = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy((F.year("o_orderdate") + 2).alias("year")).agg(F.count("*").alias("n_pages"))
    return summary.collected_years(pages, records(spark, sf_dir))
