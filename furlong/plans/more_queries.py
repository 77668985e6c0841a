"""Further registered queries: ledgers of runs, cards, pages. Curves of training are made of runner rows: a race is a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions import pages, parse
from furlong.operators import cards, maintenance, modeling, runs
from furlong.plans.queries import _SPLIT, _register
from furlong.sources.records import records, table, task_count

_CURVES = """, c AS (SELECT race_id AS model_run_id, horse_number AS epoch, 0.5::DOUBLE + (h % 50) / 100.0::DOUBLE AS train_auc, 0.45::DOUBLE + (h * 7 % 50) / 100.0::DOUBLE AS val_auc,
  0.3::DOUBLE + (h % 13) / 20.0::DOUBLE AS val_loss FROM (SELECT *, CAST(horse_id AS INTEGER) AS h FROM r))"""


def _curves(spark, sf_dir):
    h = F.col("horse_id").cast("int")
    return records(spark, sf_dir).select(
        F.col("race_id").alias("model_run_id"), F.col("horse_number").alias("epoch"), (F.lit(0.5) + (h % 50) / F.lit(100.0)).alias("train_auc"),
        (F.lit(0.45) + (h * 7 % 50) / F.lit(100.0)).alias("val_auc"), (F.lit(0.3) + (h % 13) / F.lit(20.0)).alias("val_loss"),
    )


_FOLD = f"""{_CURVES}, walk AS (
  SELECT model_run_id, epoch, val_loss AS best, epoch AS best_epoch, 0 AS misses FROM c WHERE epoch = 1
  UNION ALL SELECT c.model_run_id, c.epoch, CASE WHEN c.val_loss < best - 1e-4::DOUBLE THEN c.val_loss ELSE best END, CASE WHEN c.val_loss < best - 1e-4::DOUBLE THEN c.epoch ELSE best_epoch END,
    CASE WHEN c.val_loss < best - 1e-4::DOUBLE THEN 0 ELSE misses + 1 END FROM walk JOIN c ON c.model_run_id = walk.model_run_id AND c.epoch = walk.epoch + 1 WHERE misses < {{patience}}),
kept AS (SELECT model_run_id, arg_max(best_epoch, epoch) AS best_epoch, max(epoch) AS last_epoch FROM walk GROUP BY 1)"""
_VERDICT = f"""{_FOLD.replace('{patience}', '12')}, v AS (SELECT model_run_id, best_epoch, b.train_auc AS train_auc, b.train_auc - b.val_auc AS gap, n_epochs,
  CASE WHEN b.train_auc - b.val_auc >= 0.15::DOUBLE OR last_loss > least_loss * 1.15::DOUBLE THEN 'severe' WHEN b.train_auc - b.val_auc >= 0.08::DOUBLE THEN 'mild' ELSE 'ok' END AS verdict
  FROM (SELECT model_run_id, min(val_loss) AS least_loss, arg_max(val_loss, epoch) AS last_loss, count(*) AS n_epochs FROM c GROUP BY 1) JOIN kept USING (model_run_id)
  JOIN (SELECT model_run_id, epoch, train_auc, val_auc FROM c) AS b ON b.model_run_id = kept.model_run_id AND b.epoch = best_epoch)"""


@_register(f"{_VERDICT} SELECT * FROM v", recursive=True)
def overfit_verdict(spark, sf_dir):
    return runs.overfit_verdict(_curves(spark, sf_dir))


@_register(f"""{_VERDICT}, s AS (SELECT *, CAST(model_run_id AS BIGINT) % 4 AS k, (CAST(model_run_id AS BIGINT) % 12) * 5 / 100.0::DOUBLE AS dropout, train_auc < 0.7::DOUBLE AS weak FROM v),
t AS (SELECT *, CASE verdict WHEN 'severe' THEN greatest(k - 1, 0) ELSE k END AS a,
  CASE verdict WHEN 'severe' THEN least(round(dropout + 0.1::DOUBLE, 2), 0.7::DOUBLE) WHEN 'mild' THEN least(round(dropout + 0.05::DOUBLE, 2), 0.7::DOUBLE) ELSE dropout END AS d,
  best_epoch > 3 AND n_epochs >= 4 AND best_epoch >= n_epochs * 0.9::DOUBLE AS rising FROM s)
SELECT model_run_id, CAST([32, 64, 128, 256][CAST(CASE WHEN weak THEN least(a + 1, 3) ELSE a END AS INTEGER) + 1] AS INTEGER) AS next_hidden_size,
  CASE WHEN weak THEN greatest(round(d - 0.05::DOUBLE, 2), 0.0::DOUBLE) ELSE d END AS next_dropout, CAST(CASE verdict WHEN 'severe' THEN 9 ELSE 12 END AS INTEGER) AS next_patience,
  [0.0001::DOUBLE, 0.0003::DOUBLE, 0.001::DOUBLE, 0.003::DOUBLE][CAST(CASE WHEN best_epoch <= 3 THEN greatest(k - 1, 0) ELSE k END AS INTEGER) + 1] AS next_learning_rate,
  CAST(CASE WHEN rising THEN 24 ELSE 4 END AS INTEGER) AS next_epochs,
  coalesce(nullif(concat_ws(',', CASE verdict WHEN 'severe' THEN 'severe_overfit' WHEN 'mild' THEN 'mild_overfit' END, CASE WHEN weak THEN 'weak_training' END,
    CASE WHEN best_epoch <= 3 THEN 'early_best' END, CASE WHEN rising THEN 'still_improving' END), ''), 'keep') AS reasons FROM t""", recursive=True)
def tuning_advice(spark, sf_dir):
    k = F.col("model_run_id").cast("long")
    own = runs.overfit_verdict(_curves(spark, sf_dir)).withColumns({
        "hidden_size": F.get(F.array(*map(F.lit, runs.HIDDEN_SIZES)), (k % 4).cast("int")), "learning_rate": F.get(F.array(*map(F.lit, runs.LEARNING_RATES)), (k % 4).cast("int")),
        "dropout": (k % 12) * 5 / F.lit(100.0), "patience": F.lit(12), "epochs": F.lit(4),
    })
    return runs.tuning_advice(own).select("model_run_id", "next_hidden_size", "next_dropout", "next_patience", "next_learning_rate", "next_epochs", "reasons")


@_register(f"{_FOLD.replace('{patience}', '2')} SELECT * FROM kept", recursive=True)
def early_stop_point(spark, sf_dir):
    return runs.early_stop_point(_curves(spark, sf_dir), "model_run_id", "epoch", "val_loss", 2)


@_register(f"""{_CURVES} SELECT model_run_id, epoch, 'train_auc' AS curve, train_auc AS value FROM c UNION ALL SELECT model_run_id, epoch, 'val_auc', val_auc FROM c
UNION ALL SELECT model_run_id, epoch, 'val_loss', val_loss FROM c""")
def unpivot_curves(spark, sf_dir):
    return _curves(spark, sf_dir).unpivot(["model_run_id", "epoch"], ["train_auc", "val_auc", "val_loss"], "curve", "value")


@_register("SELECT jockey_id, count(*) AS n_rows, count(DISTINCT race_date) AS n_days, count(DISTINCT race_id) AS n_races, count(DISTINCT horse_id) AS n_horses FROM r GROUP BY 1")
def run_counters(spark, sf_dir):
    return runs.run_counters(records(spark, sf_dir), "jockey_id", task_count(spark, sf_dir))


@_register("SELECT race_id, horse_id, race_date BETWEEN CASE WHEN surface <> '5-LOW' THEN DATE '1994-01-01' END AND DATE '1995-12-31' AS in_test_period FROM r")
def in_test_period(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"first": F.when(F.col("surface") != "5-LOW", F.lit("1994-01-01").cast("date")), "last": F.lit("1995-12-31").cast("date")})
    return runs.test_period_flag(rows, "first", "last").select("race_id", "horse_id", "in_test_period")


@_register("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_orderdate AS DATE) AS created FROM orders ORDER BY created DESC NULLS LAST, run_id LIMIT 10""", False)
def recent_runs_topk(spark, sf_dir):
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("date").alias("created"))
    return runs.newest_first(ledger, "created", "run_id", 10)


_GONE = "(race_id IN (SELECT race_id FROM r WHERE starts_with('run_' || jockey_id, 'run_1')))"


@_register(f""", b AS (SELECT 'riders' AS table_name, count(*) AS deleted FROM r WHERE starts_with('run_' || jockey_id, 'run_1')
  UNION ALL SELECT 'races', count(*) FROM r WHERE {_GONE}) SELECT * FROM b WHERE deleted > 0""")
def delete_run_cascade(spark, sf_dir):
    r = records(spark, sf_dir)
    ledger = r.select(F.concat(F.lit("run_"), "jockey_id").alias("run_id"), "race_id")
    tables = {"races": r.select("race_id", "horse_id"), "riders": ledger.select("run_id")}
    return runs.deleted_run_counts(tables, ledger, ["run_1"])


@_register(""", b AS (SELECT 'models' AS table_name, count(DISTINCT jockey_id) AS deleted FROM r WHERE jockey_id = '1'
  UNION ALL SELECT 'predictions', count(*) FROM r WHERE jockey_id = '1') SELECT * FROM b WHERE deleted > 0""")
def delete_model_cascade(spark, sf_dir):
    predictions = records(spark, sf_dir).select(F.col("jockey_id").alias("model_run_id"), "race_id", "horse_id")
    tables = {"models": predictions.select("model_run_id").filter("model_run_id IS NOT NULL").distinct(), "predictions": predictions, "races": predictions.select("race_id")}
    return runs.deleted_model_counts(tables, ["1"])


@_register("SELECT race_id, horse_id, horse_number, jockey_id FROM r QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY race_date DESC, horse_number DESC) = 1")
def latest_page_version(spark, sf_dir):
    return runs.latest_version(records(spark, sf_dir), "race_id", F.desc("race_date"), F.desc("horse_number")).select("race_id", "horse_id", "horse_number", "jockey_id")


_NEW = "(SELECT race_id, horse_number, (h % 90 + 10) / 10.0::DOUBLE AS price, CAST(h % 18 + 1 AS INTEGER) AS popularity FROM (SELECT *, CAST(horse_id AS INTEGER) AS h FROM r) WHERE h % 3 > 0)"


@_register(f"SELECT race_id, horse_id, coalesce(price, odds) AS odds, popularity, price IS NOT NULL AS enriched FROM r LEFT JOIN {_NEW} USING (race_id, horse_number)")
def enrich_latest_value(spark, sf_dir):
    r = records(spark, sf_dir)
    h = F.col("horse_id").cast("int")
    price = F.when(h % 3 > 0, ((h % 90 + 10) / F.lit(10.0)).cast("string")).otherwise("--")
    new = r.select("race_id", "horse_number", F.lit(2).alias("ts"), price.alias("odds"), (h % 18 + 1).cast("string").alias("popularity"))
    old = new.withColumns({"ts": F.lit(1), "odds": F.when(h_valid := F.col("odds") != "--", "1.0").otherwise(F.col("odds")), "popularity": F.when(h_valid, "1").otherwise(F.col("popularity"))})
    carded = r.withColumn("popularity", F.lit(None).cast("int"))
    return cards.enrich_odds(carded, old.unionByName(new), task_count(spark, sf_dir)).select("race_id", "horse_id", "odds", "popularity", "enriched")


@_register("""SELECT race_id, horse_id, CASE WHEN k % 5 > 0 AND h % 3 > 0 THEN (h % 90 + 10) / 10.0::DOUBLE ELSE odds END AS odds, CASE WHEN k % 5 > 0 AND h % 3 > 0 THEN CAST(h % 18 + 1 AS INTEGER) END AS popularity
  FROM (SELECT *, CAST(race_id AS BIGINT) AS k, CAST(horse_id AS BIGINT) AS h FROM r)""")
def enrich_from_payload(spark, sf_dir):
    """One published payload a race: a fifth has none yet, half of the others hold their data as JSON in a string."""
    r, h = records(spark, sf_dir).withColumn("popularity", F.lit(None).cast("int")), F.col("horse_id").cast("int")
    price = F.when(h % 3 > 0, ((h % 90 + 10) / F.lit(10.0)).cast("string")).otherwise("---.-")
    entry = F.struct(F.lpad(F.col("horse_number").cast("string"), 2, "0").alias("key"), F.array(price, F.lit("0"), (h % 18 + 1).cast("string")).alias("value"))
    each = r.groupBy("race_id").agg(F.map_from_entries(F.collect_list(entry)).alias("won"))
    data = F.to_json(F.struct(F.lit("2026-07-26 09:30:00").alias("official_datetime"), F.create_map(F.lit("1"), F.col("won")).alias("odds")))
    k = F.col("race_id").cast("long")
    text = F.when(k % 5 == 0, F.lit('{"data": ""}')).when(k % 2 == 0, F.to_json(F.struct(data.alias("data")))).otherwise(F.concat(F.lit('{"data": '), data, F.lit("}")))
    return cards.enrich_odds(r, cards.payload_snapshots(each.select("race_id", text.alias("payload")))).select("race_id", "horse_id", "odds", "popularity")


@_register("SELECT race_id, bool_and(odds IS NOT NULL AND finish_position IS NOT NULL) AS complete FROM r GROUP BY 1")
def all_valid_per_group(spark, sf_dir):
    r = records(spark, sf_dir)
    return cards.odds_complete(r.select("race_id", F.col("odds").cast("decimal(18,1)").cast("string").alias("odds"), F.col("finish_position").cast("int").cast("string").alias("popularity")))


@_register("""SELECT race_id, horse_id, first_rider FROM r LEFT JOIN (SELECT horse_id, jockey_id AS first_rider FROM r WHERE surface = '1-URGENT'
  QUALIFY row_number() OVER (PARTITION BY horse_id ORDER BY race_date, race_id, horse_number) = 1) USING (horse_id)""")
def attach_dimension_latest(spark, sf_dir):
    r = records(spark, sf_dir)
    own = r.filter("surface = '1-URGENT'").select("horse_id", F.col("jockey_id").alias("first_rider"), "race_date", F.col("race_id").alias("_race"), "horse_number")
    return cards.attach_latest(r.select("race_id", "horse_id"), own, "horse_id", F.asc("race_date"), F.asc("_race"), F.asc("horse_number")).select("race_id", "horse_id", "first_rider")


@_register("SELECT race_id, horse_id, horse_number, finish_position FROM r")
def race_runners(spark, sf_dir):
    return cards.race_runners(records(spark, sf_dir), tasks=task_count(spark, sf_dir)).select("race_id", "horse_id", "horse_number", "finish_position")


@_register("SELECT race_id, CASE WHEN CAST(race_id AS BIGINT) % 3 = 0 OR horse_number > 1 THEN horse_id END AS horse_id, horse_number, finish_position AS actual_finish FROM r")
def prediction_vs_actual(spark, sf_dir):
    """A third of the races have results without any id; in the others one runner has none, in both tables."""
    r = records(spark, sf_dir)
    third = F.col("race_id").cast("long") % 3 == 0
    predicted = r.select("race_id", F.when(third | (F.col("horse_number") > 1), F.col("horse_id")).alias("horse_id"), "horse_number")
    results = r.withColumn("horse_id", F.when(~third & (F.col("horse_number") > 1), F.col("horse_id")))
    return cards.prediction_vs_actual(predicted, results, task_count(spark, sf_dir)).select("race_id", "horse_id", "horse_number", "actual_finish")


@_register(f"""{_SPLIT}, k AS (SELECT coalesce(jockey_id, '__missing__') AS c, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1)
SELECT race_id, horse_id, CASE WHEN n < 2 THEN '__infrequent__' ELSE c END AS category FROM s LEFT JOIN k ON coalesce(jockey_id, '__missing__') = c WHERE split = 'test'""")
def onehot_long(spark, sf_dir):
    s = modeling.chronological_split(records(spark, sf_dir))
    counts = s.filter("split = 'train'").groupBy(F.coalesce("jockey_id", F.lit("__missing__")).alias("value")).agg(F.count("*").alias("n"))
    return cards.onehot_long(s.filter("split = 'test'"), "jockey_id", counts).select("race_id", "horse_id", "category")


@_register(r"""SELECT page_id, regexp_replace(regexp_replace(html || '<div CONTENT="a; charset=x-' || page_id || '; b">', '(?i)(<meta\b[^>]*\bcharset\s*=\s*["'']?)[^"''\s/>]+', '\1UTF-8', 'g'),
  '(?i)(content\s*=\s*["''][^"'']*?charset\s*=\s*)[^;"''\s/>]+', '\1UTF-8', 'g') AS html FROM pages""", False)
def normalise_charset(spark, sf_dir):
    html = F.concat("html", F.lit('<div CONTENT="a; charset=x-'), F.col("page_id").cast("string"), F.lit('; b">'))
    return table(spark, sf_dir, "pages").select("page_id", pages.normalise_charset(html).alias("html"))


@_register("SELECT race_id, horse_id, race_id || '_' || surface || '_' || strftime(race_date, '%Y%m%d') || '_R' || lpad(CAST(horse_number AS VARCHAR), 2, '0') || '_' || horse_name AS page_name FROM r")
def fn_page_name(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("race_id", "horse_id", pages.page_name(*(F.col(c) for c in ("race_id", "surface", "race_date", "horse_number", "horse_name"))).alias("page_name"))


@_register("SELECT user_id, ts, CASE WHEN hour(ts) < 9 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + 1 END AS prediction_date FROM events", False)
def fn_prediction_date(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", pages.prediction_date(F.col("ts")).alias("prediction_date"))


@_register("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'レース名不明' ELSE 'a_b ' || p_partkey END AS x FROM part", False)
def fn_safe_name(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, " ._\u3000").otherwise(F.concat(F.lit("\u3000 .a:b \u3000\xa0"), k.cast("string"), F.lit("._\u3000")))
    return table(spark, sf_dir, "part").select("p_partkey", parse.safe_name(text).alias("x"))


@_register("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN ['牡', '牝', 'セ'][p_partkey % 4 + 1] END AS sex, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey % 9 AS INTEGER) END AS age FROM part", False)
def fn_sex_age(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.get(F.array(*map(F.lit, ["牡 ", "牝", "騙\u3000", "x"])), (k % 4).cast("int")), (k % 9).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", *parse.sex_age(text))


def _ledger(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source"))


@_register("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS source FROM orders""", False)
def upsert_ledger(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    new = ledger.filter(F.col("run_id").cast("long") % 5 == 0).select("run_id", F.lit("done").alias("status"))
    return maintenance.upsert_ledger(ledger, new, "run_id")


@_register("SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", False)
def runs_by_source(spark, sf_dir):
    return runs.runs_by_source(_ledger(spark, sf_dir), ["1-URGENT", "2-HIGH"])
