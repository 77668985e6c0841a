"""The registered queries over the driver tables, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions import pages as page_functions
from furlong.functions import parse
from furlong.operators import history, maintenance, modeling, summary
from furlong.sources.records import RECORDS_SQL, conform, load_records, records, table, task_count
from furlong.streaming.snapshots import latest_snapshot

#: White space of every kind, within a class of DuckDB's regular expressions.
SPACE_SQL = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(sql: str | None = None, with_records: bool = True, recursive: bool = False):
    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{RECORDS_SQL}\n{sql}" if with_records else sql
        return query

    return add


WEIGHTS, BIAS = {"prior_win_rate": 2.0, "prior_top3_rate": 1.0, "prior_avg_finish": -0.25, "horse_number": -0.125}, 0.5
_KEY = "coalesce(horse_id, horse_name, 'None')"
_FEATURES = f"""
  CASE WHEN finish_position <= 3 THEN 1.0::DOUBLE WHEN finish_position IS NOT NULL THEN 0.0::DOUBLE END AS is_top3,
  CAST(row_number() OVER w - 1 AS DOUBLE) AS prior_starts,
  coalesce(avg(coalesce(CAST(finish_position = 1 AS INTEGER), 0)::DOUBLE) OVER p, 0.0) AS prior_win_rate,
  coalesce(avg(CAST(finish_position <= 3 AS INTEGER)::DOUBLE) OVER p, 0.0) AS prior_top3_rate,
  coalesce(avg(finish_position) OVER p, 9.0) AS prior_avg_finish,
  coalesce(avg(odds) OVER p, 20.0) AS prior_avg_odds,
  coalesce(CAST(race_date - lag(race_date) OVER w AS DOUBLE), 999.0) AS days_since_last_race
"""
_WINDOWS = f"""
WINDOW w AS (PARTITION BY {_KEY} ORDER BY race_date NULLS LAST, race_id NULLS LAST, horse_number NULLS LAST),
  p AS (PARTITION BY {_KEY} ORDER BY race_date NULLS LAST, race_id NULLS LAST, horse_number NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_ASOF = f"""
  CAST(count(*) OVER d AS DOUBLE) AS prior_starts,
  coalesce(avg(coalesce(CAST(finish_position = 1 AS INTEGER), 0)::DOUBLE) OVER d, 0.0) AS prior_win_rate,
  coalesce(avg(CAST(finish_position <= 3 AS INTEGER)::DOUBLE) OVER d, 0.0) AS prior_top3_rate,
  coalesce(avg(finish_position) OVER d, 9.0) AS prior_avg_finish,
  coalesce(avg(odds) OVER d, 20.0) AS prior_avg_odds,
  coalesce(CAST(day - max(day) OVER d AS DOUBLE), 999.0) AS days_since_last_race
FROM (SELECT *, race_date - DATE '1970-01-01' AS day FROM r)
WINDOW d AS (PARTITION BY {_KEY} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _features_sql(name: str) -> str:
    keep = ", ".join(f"{n}" for n in ("race_id", "horse_id"))
    return f"SELECT {keep}, {name} FROM (SELECT *, {_FEATURES} FROM r {_WINDOWS})"


def _feature_query(name: str, column: str):
    def query(spark, sf_dir):
        return history.historical_features(records(spark, sf_dir), task_count(spark, sf_dir)).select("race_id", "horse_id", column)

    query.__name__ = name
    return query


for _name, _column in {
    "hist_prior_starts": "prior_starts", "hist_prior_win_rate": "prior_win_rate", "hist_prior_top3_rate": "prior_top3_rate",
    "hist_prior_avg_finish": "prior_avg_finish", "hist_prior_avg_odds": "prior_avg_odds", "hist_days_since_last": "days_since_last_race",
}.items():
    _register(_features_sql(_column))(_feature_query(_name, _column))


@_register(f"SELECT *, {_FEATURES} FROM r {_WINDOWS}")
def historical_features(spark, sf_dir):
    return history.historical_features(records(spark, sf_dir), task_count(spark, sf_dir))


@_register(f"SELECT *, CAST(finish_position <= 3 AS INTEGER) AS target_top3 FROM (SELECT *, {_FEATURES} FROM r {_WINDOWS}) WHERE finish_position IS NOT NULL")
def training_frame(spark, sf_dir):
    return history.training_frame(records(spark, sf_dir), task_count(spark, sf_dir))


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    return r.filter("dataset_type = 'historical'"), r.filter("dataset_type = 'upcoming'")


_PREDICTION = f"""SELECT * FROM (SELECT *, {_FEATURES} FROM (
  SELECT * REPLACE (CASE WHEN dataset_type = 'historical' THEN finish_position END AS finish_position) FROM r
  WHERE dataset_type = 'upcoming' OR race_id NOT IN (SELECT race_id FROM r WHERE dataset_type = 'upcoming')) {_WINDOWS}) WHERE dataset_type = 'upcoming'"""


@_register(_PREDICTION)
def prediction_frame(spark, sf_dir):
    return history.prediction_frame(*_parts(spark, sf_dir), tasks=task_count(spark, sf_dir))


_SCORE = "1 / (1 + exp(-(0.5::DOUBLE + prior_win_rate * 2.0::DOUBLE + prior_top3_rate * 1.0::DOUBLE + prior_avg_finish * -0.25::DOUBLE + horse_number * -0.125::DOUBLE)))"


@_register(f"""SELECT race_id, horse_id, round(probability, 9) AS probability, round(probability * odds, 6) AS expected_value_index,
  CAST(row_number() OVER (PARTITION BY race_id ORDER BY round(probability, 9) DESC, horse_number) AS INTEGER) AS predicted_rank
FROM (SELECT *, {_SCORE} AS probability FROM ({_PREDICTION}))""")
def score_races(spark, sf_dir):
    scored = history.scored(history.prediction_frame(*_parts(spark, sf_dir), tasks=task_count(spark, sf_dir)), WEIGHTS, BIAS)
    return history.ranked(scored).select("race_id", "horse_id", F.round("probability", 9).alias("probability"), F.round("expected_value_index", 6).alias("expected_value_index"), "predicted_rank")


_ROWS = f"""rows_ AS (
  SELECT *, predicted_rank <= 3 AS predicted_top3, coalesce(finish_position <= 3, false) AS actual_top3, predicted_rank <= 3 AND coalesce(finish_position <= 3, false) AS top3_hit
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY race_id ORDER BY round(probability, 9) DESC, horse_number) AS INTEGER) AS predicted_rank
    FROM (SELECT *, {_SCORE} AS probability FROM (SELECT *, {_ASOF})))
)"""


@_register(f"SELECT race_id, horse_id, {', '.join(f'round({c}, 9) AS {c}' for c in history.FEATURES)} FROM (SELECT *, {_ASOF})")
def asof_features(spark, sf_dir):
    return history.asof_features(records(spark, sf_dir), task_count(spark, sf_dir)).select("race_id", "horse_id", *(F.round(c, 9).alias(c) for c in history.FEATURES))


@_register(f", {_ROWS} SELECT race_id, horse_id, predicted_rank, predicted_top3, actual_top3, top3_hit FROM rows_")
def backtest_rows(spark, sf_dir):
    return history.backtest_rows(records(spark, sf_dir), WEIGHTS, BIAS, task_count(spark, sf_dir)).select("race_id", "horse_id", "predicted_rank", "predicted_top3", "actual_top3", "top3_hit")


@_register(f""", {_ROWS}, days AS (
  SELECT race_date, CAST(coalesce(sum(count(*)) OVER (ORDER BY race_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_rows_used FROM r WHERE race_date IS NOT NULL GROUP BY race_date
) SELECT s.*, history_rows_used FROM (SELECT race_id, count(DISTINCT horse_id) FILTER (WHERE top3_hit) AS hit_count, count(DISTINCT horse_id) FILTER (WHERE top3_hit) / 3.0::DOUBLE AS hit_rate,
  max(finish_position) FILTER (WHERE predicted_rank = 1) AS top_pick_finish, min(predicted_rank) FILTER (WHERE finish_position = 1) AS winner_rank,
  min(race_date) AS race_date FROM rows_ GROUP BY race_id) s LEFT JOIN days USING (race_date)""")
def backtest_summary(spark, sf_dir):
    r = records(spark, sf_dir)
    return history.backtest_summary(history.backtest_rows(r, WEIGHTS, BIAS, task_count(spark, sf_dir)), r)


@_register("SELECT * FROM r WHERE dataset_type = 'historical'")
def load_historical(spark, sf_dir):
    return load_records(records(spark, sf_dir), "historical")


@_register("SELECT count(*) AS row_count, count(DISTINCT race_id) AS race_count FROM r WHERE dataset_type = 'historical' AND race_date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'")
def record_summary(spark, sf_dir):
    return summary.record_summary(records(spark, sf_dir), "historical", "1993-01-01", "1996-12-31")


@_register("""SELECT count(*) FILTER (WHERE dataset_type = 'historical') AS historical_rows, count(*) FILTER (WHERE dataset_type <> 'historical') AS upcoming_rows,
  count(DISTINCT race_id) FILTER (WHERE dataset_type = 'historical') AS historical_races, count(DISTINCT race_id) FILTER (WHERE dataset_type <> 'historical') AS upcoming_races,
  count(DISTINCT race_id) AS races, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS model_count, max(race_date) FILTER (WHERE dataset_type = 'historical') AS latest_past_date, max(race_date) AS latest_date FROM r""")
def dashboard_summary(spark, sf_dir):
    models = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return summary.dashboard_summary(records(spark, sf_dir), models)


@_register("""SELECT column_name, missing, missing / n AS ratio FROM (
  SELECT 'finish_position' AS column_name, count(*) - count(finish_position) AS missing, count(*)::DOUBLE AS n FROM r
  UNION ALL SELECT 'odds', count(*) - count(odds), count(*) FROM r UNION ALL SELECT 'surface', count(*) - count(surface), count(*) FROM r) WHERE missing > 0""")
def missing_profile(spark, sf_dir):
    return summary.missing_profile(records(spark, sf_dir), ["finish_position", "odds", "surface"])


@_register("""SELECT 'horse_id' AS column_name, count(horse_id) AS present, count(TRY_CAST(horse_id AS DOUBLE)) AS valid, count(horse_id) - count(TRY_CAST(horse_id AS DOUBLE)) AS failed FROM r
UNION ALL SELECT 'surface', count(surface), count(TRY_CAST(surface AS DOUBLE)), count(surface) - count(TRY_CAST(surface AS DOUBLE)) FROM r""")
def coercion_failures(spark, sf_dir):
    return summary.coercion_failures(records(spark, sf_dir), {"horse_id": "double", "surface": "double"})


@_register("SELECT CAST(CAST(finish_position AS INTEGER) AS VARCHAR) AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 20")
def value_counts_top20(spark, sf_dir):
    return summary.value_counts(records(spark, sf_dir).withColumn("finish_position", F.col("finish_position").cast("int")), "finish_position")


@_register("""SELECT count(*) AS rows_before, count(finish_position) AS rows_valid, count(*) - count(finish_position) AS rows_removed,
  count(DISTINCT race_id) AS races_before, count(DISTINCT race_id) FILTER (WHERE finish_position IS NOT NULL) AS races_after FROM r""")
def filter_audit(spark, sf_dir):
    return summary.filter_audit(records(spark, sf_dir))


@_register("SELECT dataset_type, race_id, race_date, surface FROM r QUALIFY row_number() OVER (PARTITION BY dataset_type, race_id ORDER BY race_date, horse_number) = 1")
def race_options(spark, sf_dir):
    return summary.race_options(records(spark, sf_dir))


@_register("SELECT DISTINCT CAST(year(race_date) AS INTEGER) AS year FROM r")
def registered_years(spark, sf_dir):
    return summary.registered_years(records(spark, sf_dir))


@_register("SELECT CAST(year(race_date) AS INTEGER) AS year, bool_or(dataset_type = 'historical') AS has_history, bool_or(dataset_type = 'upcoming') AS has_upcoming FROM r GROUP BY 1")
def year_status(spark, sf_dir):
    return summary.year_status(records(spark, sf_dir))


_SPLIT = """, days AS (SELECT race_date, row_number() OVER (ORDER BY race_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT race_date FROM r)),
s AS (SELECT r.*, CASE WHEN i <= greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) THEN 'train'
  WHEN i <= greatest(greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)) THEN 'validation' ELSE 'test' END AS split FROM r JOIN days USING (race_date))"""


@_register(f"{_SPLIT} SELECT race_id, horse_id, split FROM s")
def chronological_split(spark, sf_dir):
    return modeling.chronological_split(records(spark, sf_dir)).select("race_id", "horse_id", "split")


@_register(f"""{_SPLIT} SELECT split, count(*) AS n_rows, min(race_date) AS first_date, max(race_date) AS last_date, count(*) FILTER (WHERE finish_position <= 3) AS positives,
  greatest(count(*) FILTER (WHERE finish_position > 3), 1)::DOUBLE / greatest(count(*) FILTER (WHERE finish_position <= 3), 1) AS pos_weight FROM s WHERE finish_position IS NOT NULL GROUP BY split""")
def split_profile(spark, sf_dir):
    return modeling.split_profile(modeling.chronological_split(records(spark, sf_dir)).filter(F.col("finish_position").isNotNull()))


@_register(f"{_SPLIT} SELECT 'odds' AS column_name, median(odds) AS median_value FROM s WHERE split = 'train' UNION ALL SELECT 'finish_position', median(finish_position) FROM s WHERE split = 'train'")
def fit_medians(spark, sf_dir):
    return modeling.fit_medians(modeling.chronological_split(records(spark, sf_dir)).filter("split = 'train'"), ["odds", "finish_position"])


@_register(f"""{_SPLIT} SELECT column_name, round(m, 6) AS mean_value, round(CASE WHEN d = 0 THEN 1.0 ELSE d END, 6) AS scale_value FROM (
  SELECT 'odds' AS column_name, avg(odds) AS m, stddev_pop(odds) AS d FROM s WHERE split = 'train' UNION ALL SELECT 'finish_position', avg(finish_position), stddev_pop(finish_position) FROM s WHERE split = 'train')""")
def standardise(spark, sf_dir):
    fitted = modeling.fit_scales(modeling.chronological_split(records(spark, sf_dir)).filter("split = 'train'"), ["odds", "finish_position"])
    return fitted.select("column_name", F.round("mean_value", 6).alias("mean_value"), F.round("scale_value", 6).alias("scale_value"))


@_register(f"""{_SPLIT} SELECT CASE WHEN k < 2 THEN '__infrequent__' ELSE c END AS category, CAST(sum(k) AS BIGINT) AS n
FROM (SELECT coalesce(jockey_id, '__missing__') AS c, count(*) AS k FROM s WHERE split = 'train' GROUP BY 1) GROUP BY 1""")
def category_counts(spark, sf_dir):
    return modeling.category_counts(modeling.chronological_split(records(spark, sf_dir)).filter("split = 'train'"), "jockey_id")


_JUDGED = "(SELECT round(1 / (1 + exp(-(n_chars / 1000.0::DOUBLE - 2))), 9) AS p, quality AS y FROM documents JOIN labels USING (doc_id))"


def _judged(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return docs.select(F.round(1 / (1 + F.exp(-(F.col("n_chars") / 1000.0 - 2))), 9).alias("p"), F.col("quality").alias("y"))


@_register(f"""WITH q AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM {_JUDGED})
SELECT round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 9) AS auc FROM q""", False)
def exact_auc(spark, sf_dir):
    return modeling.exact_auc(_judged(spark, sf_dir), "y", "p").select(F.round("auc", 9).alias("auc"))


@_register(f"SELECT round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss FROM (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM {_JUDGED})", False)
def log_loss(spark, sf_dir):
    return modeling.log_loss(_judged(spark, sf_dir), "y", "p")


@_register(f"""SELECT avg((y = 1) = (p >= 0.5))::DOUBLE AS accuracy, count(*) FILTER (WHERE y = 1 AND p >= 0.5)::DOUBLE / count(*) FILTER (WHERE p >= 0.5) AS precision_value,
  count(*) FILTER (WHERE y = 1 AND p >= 0.5)::DOUBLE / count(*) FILTER (WHERE y = 1) AS recall_value FROM (SELECT p, y = 1 AS yy, y FROM {_JUDGED})""".replace("avg((y = 1) = (p >= 0.5))::DOUBLE", "avg(CAST((y = 1) = (p >= 0.5) AS INTEGER))"), False)
def confusion_metrics(spark, sf_dir):
    return modeling.confusion_metrics(_judged(spark, sf_dir), "y", "p")


@_register("""SELECT race_id, horse_id, finish_position, dataset_type, NULL::VARCHAR AS collection_run_id FROM r WHERE NOT (dataset_type = 'historical' AND race_id IN (SELECT race_id FROM r WHERE surface = '1-URGENT') AND horse_id IN (SELECT horse_id FROM r WHERE surface = '1-URGENT') AND surface = '1-URGENT')
UNION ALL SELECT race_id, horse_id, finish_position, 'historical', 'run_2' FROM r WHERE surface = '1-URGENT' AND dataset_type = 'historical'""")
def upsert_records(spark, sf_dir):
    r = records(spark, sf_dir).select("race_id", "horse_id", "finish_position", "dataset_type", "surface")
    incoming = r.filter("surface = '1-URGENT' AND dataset_type = 'historical'")
    return maintenance.upsert_records(r, incoming, "run_2", "historical").select("race_id", "horse_id", "finish_position", "dataset_type", "collection_run_id")


@_register("SELECT 'races' AS table_name, count(*) AS deleted FROM r WHERE starts_with(race_id, '12') UNION ALL SELECT 'riders', count(*) FROM (SELECT DISTINCT race_id, jockey_id FROM r) WHERE starts_with(race_id, '12')")
def delete_prefix_counts(spark, sf_dir):
    r = records(spark, sf_dir)
    return maintenance.delete_rows({"races": r, "riders": r.select("race_id", "jockey_id").distinct(), "parts": table(spark, sf_dir, "part")}, "race_id", ["12"], prefix=True)[1]


@_register("SELECT race_id, TRY_CAST(surface AS INTEGER) AS finish_position, CAST(NULL AS DOUBLE) AS body_weight FROM r")
def conform_types(spark, sf_dir):
    r = records(spark, sf_dir).select("race_id", F.col("surface").alias("finish_position"), "odds")
    return conform(r, {"race_id": "string", "finish_position": "int", "body_weight": "double"})


_TEXTS = "(SELECT p_partkey, p_name, '1:' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || (p_partkey % 10) AS t, p_size || '-' || (p_size + 1) || '-' || p_partkey AS q, (400 + p_size) || '(' || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END || (p_size % 10) || ')' AS b, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE p_size || ',' || p_partkey || '.5 yen' END AS f FROM part)"


def _texts(spark, sf_dir) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name",
        F.concat(F.lit("1:"), F.lpad(s, 2, "0"), F.lit("."), (F.col("p_partkey") % 10).cast("string")).alias("t"),
        F.concat(s, F.lit("-"), (F.col("p_size") + 1).cast("string"), F.lit("-"), k).alias("q"),
        F.concat((F.col("p_size") + 400).cast("string"), F.lit("("), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), (F.col("p_size") % 10).cast("string"), F.lit(")")).alias("b"),
        F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.concat(s, F.lit(","), k, F.lit(".5 yen"))).alias("f"),
    )


@_register(f"SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace(f, ',', ''), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS x FROM {_TEXTS}", False)
def fn_to_float(spark, sf_dir):
    return _texts(spark, sf_dir).select("p_partkey", parse.to_float(F.col("f")).alias("x"))


@_register(f"SELECT p_partkey, TRY_CAST(nullif(regexp_extract(f, '^([0-9]+)', 1), '') AS INTEGER) AS x FROM {_TEXTS}", False)
def fn_finish_position(spark, sf_dir):
    return _texts(spark, sf_dir).select("p_partkey", parse.finish_position(F.col("f")).alias("x"))


@_register(f"SELECT p_partkey, {', '.join(f'TRY_CAST(regexp_extract_all(q, $$[0-9]+$$)[{i}] AS INTEGER) AS passing_position_{i}' for i in range(1, 5))} FROM {_TEXTS}", False)
def fn_passing_positions(spark, sf_dir):
    return _texts(spark, sf_dir).select("p_partkey", *parse.passing_positions(F.col("q")))


@_register(f"SELECT p_partkey, CAST(split_part(t, ':', 1) AS DOUBLE) * 60 + CAST(split_part(t, ':', 2) AS DOUBLE) AS x FROM {_TEXTS}", False)
def fn_time_seconds(spark, sf_dir):
    return _texts(spark, sf_dir).select("p_partkey", parse.time_to_seconds(F.col("t")).alias("x"))


@_register(f"SELECT p_partkey, CAST(regexp_extract(b, '^([0-9]+)', 1) AS DOUBLE) AS body_weight, CAST(regexp_extract(b, '\\(([+-]?[0-9]+)\\)', 1) AS DOUBLE) AS body_weight_change FROM {_TEXTS}", False)
def fn_body_weight(spark, sf_dir):
    return _texts(spark, sf_dir).select("p_partkey", *parse.body_weight(F.col("b")))


@_register(f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '[{SPACE_SQL}]+', ' ', 'g')) AS body FROM pages""", False)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parse.html_to_text(F.col("html")).alias("body"))


@_register("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""", False)
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(parse.links(F.col("html"))).alias("link"))


@_register("""WITH p AS (SELECT page_id, html || (202401000000 + page_id) || ' ' || (202401000000 + page_id) || ' 1' || (202402000000 + page_id) || 'x' || (202403000000 + page_id // 2) AS html FROM pages)
SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, CAST(len(list_distinct(list_filter(regexp_extract_all(html, '[0-9]+'), lambda x: len(x) = 12))) AS BIGINT) AS n_ids FROM p""", False)
def page_diagnostics(spark, sf_dir):
    """The pages with some ids put in: one twice, one with a digit too many."""
    number = lambda first, k: F.expr(f"cast({first} + {k} as string)")
    one = number(202401000000, "page_id")
    html = F.concat("html", one, F.lit(" "), one, F.lit(" 1"), number(202402000000, "page_id"), F.lit("x"), number(202403000000, "page_id div 2"))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html")).select("page_id", F.length("html").cast("long").alias("n_chars"), page_functions.race_id_count(F.col("html")).alias("n_ids"))


@_register("SELECT user_id, event_type, max((ts, value))[1] AS last_ts, max((ts, value))[2] AS last_value FROM events GROUP BY ALL".replace("max((ts, value))[1]", "max(ts)").replace("max((ts, value))[2]", "arg_max(value, (ts, value))"), False)
def latest_snapshot_per_user(spark, sf_dir):
    return latest_snapshot(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value")


from furlong.plans import more_queries, page_queries, table_queries, task_queries  # noqa: E402, F401  (they register their own here)
