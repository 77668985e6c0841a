"""Registered queries of files, labels, ledgers, preparation and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions import labels
from furlong.operators import history, modeling, prepare, runs, summary, tasks
from furlong.plans.queries import _SPLIT, WEIGHTS, BIAS, _register
from furlong.sources import files
from furlong.sources.records import records, table, task_count, union_aligned
from furlong.sources.shared import written

_NUMERIC, _CATEGORICAL = [*history.FEATURES, "horse_number", "odds"], ["surface", "jockey_id"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@_register("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders", False)
def race_ids_from_files(spark, sf_dir):
    names = ("orders.parquet", "part.parquet", "nowhere.parquet", "nowhere.csv", "orders.txt")
    return files.ids_from_files(spark, [f"{sf_dir}/{n}" for n in names], "o_orderkey")


@_register("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS race_id FROM orders WHERE o_custkey IN (SELECT user_id FROM events)", False)
def cached_page_count(spark, sf_dir):
    listed = _orders(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("race_id"))
    return files.races_with_page(listed, table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("race_id")))


@_register("SELECT o_orderpriority AS dataset_type, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS kind, count(*) AS n_pages, count(DISTINCT o_custkey) AS n_races FROM orders GROUP BY ALL", False)
def cached_page_counts(spark, sf_dir):
    pages = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("dataset_type"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("race_id"))
    return files.cached_page_counts(pages)


@_register("SELECT CAST(o_orderkey AS VARCHAR) AS model_run_id, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'top3') AS task_name, 'mlp' AS estimator_name FROM orders", False)
def manifest_default(spark, sf_dir):
    ledger = _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("model_run_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("task_name"))
    return files.with_manifest(ledger)


@_register("SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_orderdate AS DATE) AS created FROM orders ORDER BY created DESC NULLS LAST, run_id", False)
def ledger_newest_first(spark, sf_dir):
    return runs.newest_first(_orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("date").alias("created")), "created", "run_id")


@_register("SELECT race_id, race_date, surface FROM r QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY race_date, horse_number) = 1")
def race_options_history(spark, sf_dir):
    return summary.race_options_history(records(spark, sf_dir), task_count(spark, sf_dir))


@_register("SELECT dataset_type, race_id, race_date, surface, CAST(year(race_date) AS INTEGER) AS year FROM r QUALIFY row_number() OVER (PARTITION BY dataset_type, race_id ORDER BY race_date, horse_number) = 1")
def registered_races(spark, sf_dir):
    return summary.registered_races(records(spark, sf_dir), task_count(spark, sf_dir))


@_register("SELECT race_id, horse_id, odds, NULL::VARCHAR AS surface, NULL::DATE AS race_date FROM r WHERE dataset_type = 'historical' UNION ALL SELECT race_id, NULL, NULL, surface, race_date FROM r WHERE dataset_type = 'upcoming'")
def union_aligned_frames(spark, sf_dir):
    r = records(spark, sf_dir)
    past, to_come = r.filter("dataset_type = 'historical'").select("race_id", "horse_id", "odds"), r.filter("dataset_type = 'upcoming'").select("surface", "race_id", "race_date", F.lit(None).alias("odds"))
    return union_aligned(past, to_come)


@_register("""SELECT 'run_' || jockey_id AS collection_run_id, race_id, horse_id FROM r WHERE jockey_id NOT IN (SELECT jockey_id FROM r WHERE CAST(jockey_id AS BIGINT) % 3 = 0)
  AND race_id NOT IN (SELECT race_id FROM r WHERE CAST(jockey_id AS BIGINT) % 3 = 0)""")
def delete_by_source(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run_"), "jockey_id"))
    ledger = r.select("run_id", "race_id", F.when(F.col("jockey_id").cast("long") % 3 == 0, "pages").otherwise("generator").alias("source"))
    return runs.delete_by_source({"races": r.select(F.col("run_id").alias("collection_run_id"), "race_id", "horse_id")}, ledger, ["pages"])["races"]


@_register("SELECT p_partkey, ['x', NULL, 'y', NULL][CAST(p_partkey % 4 AS INTEGER) + 1] AS place, CASE WHEN p_partkey % 100 < 10 THEN '0' || (p_partkey % 100) ELSE CAST(p_partkey % 100 AS VARCHAR) END = lpad(CAST(n AS VARCHAR), 2, '0') AS same, n FROM (SELECT p_partkey, CAST(p_partkey % 100 AS INTEGER) AS n FROM part)", False)
def fn_code_lookup(spark, sf_dir):
    k = F.col("p_partkey")
    code, race = F.concat(F.lit("0"), (k % 4).cast("string")), F.format_string("2024%06d%02d", k, (k % 100).cast("int"))
    n = labels.race_number(race)
    return table(spark, sf_dir, "part").select("p_partkey", labels.lookup(code, {"00": "x", "02": "y"}).alias("place"), (n == (k % 100)).alias("same"), n.alias("n"))


@_register("""SELECT race_id, horse_id, strftime(race_date, '%Y-%m-%d') || ' ' || surface || ' ' || CASE WHEN h % 5 = 0 THEN 'レース番号不明' ELSE horse_number || 'R' END || ' ' || horse_name || ' [' || CASE dataset_type WHEN 'historical' THEN '学習用' ELSE '予想用' END || ']' AS label,
  CASE WHEN odds IS NULL THEN '-' ELSE printf('%.2f', odds) END AS price, CASE WHEN finish_position <= 3 THEN '○' ELSE '-' END AS hit, printf('%.1f%%', (h % 1000) / 10.0::DOUBLE) AS share, race_date + 7 AS day_limit, least(make_date(year(race_date), 12, 31), DATE '1996-06-30') AS year_end
  FROM (SELECT *, CAST(horse_id AS BIGINT) AS h FROM r)""")
def fn_labels(spark, sf_dir):
    from furlong.functions.pages import percent

    h, r = F.col("horse_id").cast("long"), records(spark, sf_dir)
    number = F.when(h % 5 != 0, F.col("horse_number"))
    return r.select(
        "race_id", "horse_id", labels.race_label(F.col("race_date"), F.col("surface"), number, F.col("horse_name"), F.col("dataset_type")).alias("label"), labels.index_label(F.col("odds")).alias("price"),
        labels.mark(F.col("finish_position") <= 3).alias("hit"), percent(h % 1000 / F.lit(1000.0)).alias("share"), labels.date_limit(F.col("race_date")).alias("day_limit"), labels.year_end(F.year("race_date"), F.lit("1996-06-30").cast("date")).alias("year_end"),
    )


@_register("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE o_orderstatus WHEN 'F' THEN '各馬が3着以内に入る確率を予測するモデル' ELSE 'モデル種別: ' || o_orderstatus END || '｜' || CASE WHEN o_orderkey % 7 = 0 THEN '作成日時不明' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
  || '｜テストAUC ' || CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE printf('%.3f', (o_orderkey % 1000) / 1000.0::DOUBLE) END || '｜' || o_orderkey AS label FROM orders""", False)
def model_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    target = F.when(F.col("o_orderstatus") == "F", "top3").otherwise(F.col("o_orderstatus"))
    label = labels.model_label(target, F.when(k % 7 != 0, F.col("o_orderdate")), F.when(k % 5 != 0, k % 1000 / F.lit(1000.0)), k.cast("string"))
    return _orders(spark, sf_dir).select(k.cast("string").alias("run_id"), label.alias("label"))


@_register("SELECT 'p_' || race_id AS prediction_run_id, race_id, 'm1' AS model_run_id, count(*) AS row_count FROM r WHERE dataset_type = 'upcoming' GROUP BY race_id")
def prediction_ledger(spark, sf_dir):
    r = records(spark, sf_dir)
    scored = history.ranked(history.scored(history.prediction_frame(r.filter("dataset_type = 'historical'"), r.filter("dataset_type = 'upcoming'")), WEIGHTS, BIAS))
    return summary.prediction_runs(scored, "p", "m1", "2024-01-01 00:00:00", "out").select("prediction_run_id", "race_id", "model_run_id", "row_count")


@_register("SELECT round(avg(-(2.5::DOUBLE * y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss FROM (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM (SELECT round(1 / (1 + exp(-(n_chars / 1000.0::DOUBLE - 2))), 9) AS p, quality AS y FROM documents JOIN labels USING (doc_id)))", False)
def weighted_log_loss(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    judged = docs.select(F.round(1 / (1 + F.exp(-(F.col("n_chars") / 1000.0 - 2))), 9).alias("p"), F.col("quality").alias("y"))
    return modeling.log_loss(judged, "y", "p", 2.5)


_JSON = """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_totalprice AS test_auc, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS status, CAST(o_custkey AS BIGINT) AS rows FROM orders"""


@_register(_JSON, False)
def metrics_json(spark, sf_dir):
    k = F.col("o_orderkey")
    written = _orders(spark, sf_dir).select(k.cast("string").alias("run_id"), files.metrics_json(test_auc=F.col("o_totalprice"), status=F.when(k % 2 == 0, F.col("o_orderpriority")), rows=F.col("o_custkey")).alias("j"))
    return written.select("run_id", F.from_json("j", "test_auc double, status string, rows bigint").alias("x")).select("run_id", "x.*")


@_register(f"""{_SPLIT}, t AS (SELECT * FROM s WHERE split = 'train'), m AS (SELECT median(odds) AS odds FROM t), f AS (SELECT avg(coalesce(t.odds, m.odds)) AS a, stddev_pop(coalesce(t.odds, m.odds)) AS d FROM t, m),
k AS (SELECT surface AS c, count(*) AS n FROM t GROUP BY 1), j AS (SELECT jockey_id AS c, count(*) AS n FROM t GROUP BY 1)
SELECT race_id, horse_id, round((coalesce(s.odds, m.odds) - a) / d, 6) AS odds_scaled, CAST((k.n >= 2)::INTEGER + coalesce((j.n >= 1)::INTEGER, 0) AS DOUBLE) AS hot_slots FROM s LEFT JOIN k ON k.c = surface LEFT JOIN j ON j.c = jockey_id, m, f""")
def feature_vectors(spark, sf_dir):
    """Runner rows are made once, and written with the columns at hand: the split and each thing that is fitted read them again."""
    rows = written(records(spark, sf_dir).select("race_id", "horse_id", "race_date", "odds", "surface", "jockey_id"))
    s = modeling.chronological_split(rows).drop("race_date")
    fitted = prepare.fit_features(s.filter("split = 'train'"), ["odds"], _CATEGORICAL)
    hot = F.size(F.filter("slots", lambda i: i.isNotNull())).cast("double")
    return fitted.transform(s, tasks=task_count(spark, sf_dir)).select("race_id", "horse_id", F.round(F.get("numbers", F.lit(0)), 6).alias("odds_scaled"), hot.alias("hot_slots"))


@_register()
def train_rounds(spark, sf_dir):
    """Runner rows are made once, and written: the audit, the split's days and the features read them again."""
    return tasks.train_task("top3", written(records(spark, sf_dir)), modeling.TrainConfig(), _NUMERIC, _CATEGORICAL)[1]
