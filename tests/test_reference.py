import json
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from furlong.functions import parse
from furlong.operators import extract, history, maintenance, modeling, prepare, runs, tasks
from furlong.plans.queries import ORACLE_SQL, QUERIES
from furlong.sources import files
from furlong.sources import records as records_module
from furlong.sources.records import conform
from furlong.streaming import snapshots

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "pages", "events", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    theirs = sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()))
    assert mine == theirs


def test_features_against_a_loop(spark):
    """With NULL ids, names, finishes and odds, and a runner twice on a day."""
    draw = random.Random(3)
    rows = [
        (str(i // 4), f"2020-01-{1 + draw.randrange(20):02d}", draw.choice(["a", "b", "c", None]), draw.choice(["x", None]), i, draw.choice([None, 1.0, 2.0, 5.0]), draw.choice([None, 3.0, 7.0]))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "race_id string, d string, horse_id string, horse_name string, horse_number int, finish_position double, odds double").withColumn("race_date", F.to_date("d"))
    got = {r.horse_number: r for r in history.historical_features(df).collect()}
    past: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.race_date, r.race_id, r.horse_number)):
        before = past.setdefault(r.horse_id or r.horse_name or "None", [])
        known = [b.finish_position for b in before if b.finish_position is not None]
        g = got[r.horse_number]
        assert g.prior_starts == len(before)
        assert g.prior_win_rate == pytest.approx(sum(b.finish_position == 1 for b in before) / len(before) if before else 0)
        assert g.prior_top3_rate == pytest.approx(sum(k <= 3 for k in known) / len(known) if known else 0)
        assert g.prior_avg_finish == pytest.approx(sum(known) / len(known) if known else 9)
        assert g.days_since_last_race == ((r.race_date - before[-1].race_date).days if before else 999)
        before.append(r)


def test_own_result_does_not_leak(spark):
    base = spark.createDataFrame([("1", "a", 1, 1.0), ("2", "a", 1, 2.0)], "race_id string, horse_id string, horse_number int, finish_position double").withColumns({"race_date": F.to_date(F.lit("2020-01-01")), "horse_name": F.lit("n"), "odds": F.lit(2.0)})
    pick = lambda d: [tuple(r) for r in history.historical_features(d).select(*history.FEATURES).filter("prior_starts = 1").collect()]
    assert pick(base) == pick(base.withColumn("finish_position", F.when(F.col("race_id") == "2", 9.0).otherwise(F.col("finish_position"))))


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("1", None, "historical"), ("1", "a", "historical"), (None, "b", "historical")], "race_id string, horse_id string, dataset_type string")
    new = spark.createDataFrame([("1", None), ("1", None)], "race_id string, horse_id string")
    once = maintenance.upsert_records(old.withColumn("collection_run_id", F.lit("r0")), new, "r1", "historical")
    twice = maintenance.upsert_records(once, new, "r1", "historical")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == 4


def test_delete_takes_prefixes_literally(spark):
    t = spark.createDataFrame([("run_1",), ("runX1",), (None,)], "run_id string")
    left, counts = maintenance.delete_rows({"t": t}, "run_id", ["run_"], prefix=True)
    assert left["t"].count() == 2 and counts.first().deleted == 1


def test_conform_and_parse(spark):
    one = conform(spark.createDataFrame([("abc", 1)], "finish_position string, extra int")).first()
    assert one.finish_position is None and one.race_id is None and "extra" not in one.asDict()
    s = spark.createDataFrame([("7-5",), (None,)], "s string")
    assert [tuple(r) for r in s.select(*parse.passing_positions(F.col("s"))).collect()] == [(7, 5, None, None), (None,) * 4]
    t = spark.createDataFrame([("1:59.8", "480(+4)", "1,234.5 yen")], "t string, w string, f string")
    assert tuple(t.select(parse.time_to_seconds(F.col("t")), *parse.body_weight(F.col("w")), parse.to_float(F.col("f"))).first()) == (pytest.approx(119.8), 480.0, 4.0, 1234.5)


def test_parse_edges(spark):
    """White space, units, full-width digits, both signs of a gelding, and what doesn't parse."""
    cases = [
        ("　 1 ", " 1:59.8　", "480 (+4)", "牡 4"), ("12同", "12:100.25", " 480kg", "騙　3"), ("４", "1:5", "体重 500( -2 )", "セ10歳"),
        ("中止", "59.8", "計不", "馬3"), (None, None, None, None), ("", "1:59.8x", "(+4)", "牝"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, t string, w string, s string").orderBy("i")
    c = F.col
    got = [tuple(r) for r in df.select(parse.finish_position(c("f")), F.round(parse.time_to_seconds(c("t")), 6), *parse.body_weight(c("w")), *parse.sex_age(c("s"))).collect()]
    assert got == [
        (1, 119.8, 480.0, 4.0, "牡", 4), (12, 820.25, 480.0, None, "セ", 3), (4, 65.0, 500.0, None, "セ", 10),
        (None, None, None, None, None, None), (None,) * 6, (None, None, 4.0, None, None, None),
    ]


def test_verdict_is_taken_at_the_epoch_that_stopping_keeps(spark):
    """Losses that fall by less than a ten-thousandth don't move the best epoch; the last loss is compared with the least."""
    rows = [("a", e, 0.7 + e / 100, 0.7, 0.5 - e * 5e-5) for e in range(1, 4)] + [("b", 1, 0.9, 0.75, 0.5), ("b", 2, 0.6, 0.6, 0.3), ("b", 3, 0.9, 0.6, 0.4)]
    got = {r.model_run_id: r for r in runs.overfit_verdict(spark.createDataFrame(rows, "model_run_id string, epoch int, train_auc double, val_auc double, val_loss double")).collect()}
    assert (got["a"].best_epoch, round(got["a"].gap, 6), got["a"].verdict) == (1, 0.01, "ok")
    assert (got["b"].best_epoch, got["b"].gap, got["b"].verdict) == (2, 0.0, "severe")


def test_delete_by_source(spark):
    ledger = spark.createDataFrame([("r1", "x", "1"), ("r2", "y", "2"), (None, "x", "3")], "run_id string, source string, race_id string")
    rows = spark.createDataFrame([("1", "r9"), ("2", "r9"), ("3", "r9"), (None, "r1"), ("4", None)], "race_id string, collection_run_id string")
    left = runs.delete_by_source({"races": rows, "other": rows.select(F.lit(1).alias("k"))}, ledger, ["x"])
    assert sorted(map(str, left["races"].collect())) == sorted(map(str, rows.filter("race_id IN ('2', '3', '4')").collect())) and left["other"].count() == 5


def test_split_counts_dates_as_doubles(spark):
    df = spark.range(90).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("race_date"))
    assert {r.split: r["count"] for r in modeling.chronological_split(df).groupBy("split").count().collect()}["train"] == 62
    with pytest.raises(ValueError):
        modeling.chronological_split(df.limit(5))


def test_medians_of_odd_and_even_counts_ties_and_nothing(spark):
    rows = [(float(i % 7), float(i), None, 1.0 if i == 3 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert {r.column_name: r.median_value for r in modeling.fit_medians(df, ["a", "b", "c", "d"]).collect()} == {"a": 3.0, "b": 499.5, "c": None, "d": 1.0}
    assert {r.column_name: r.median_value for r in modeling.fit_medians(df.limit(0), ["a"]).collect()} == {"a": None}


def test_auc_of_groups_and_any_scores(spark):
    rows = [("x", y, s) for y, s in [(1, 1e9), (0, -1e9), (1, 0.2), (0, 0.2), (1, 0.2)]] + [("y", 1, 0.5)]
    got = {r.g: r.auc for r in modeling.exact_auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ("g",)).collect()}
    assert got["x"] == pytest.approx((2 + 2 * 1.5) / 6) and got["y"] is None


def test_required_and_preferred_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert records_module.require(df, "a") is df and records_module.preferred(df, "b", "z", "a").columns == ["b", "a"]
    with pytest.raises(ValueError, match="y, z"):
        records_module.require(df, "a", "y", "z")
    assert records_module.empty_records(spark).count() == 0 and len(records_module.empty_records(spark).columns) == 40


def learnable(spark, n=3000):
    """Runners whose odds tell much of their result; with missing numbers, rare, unseen and missing categories."""
    draw = random.Random(1)
    rows = []
    for i in range(n):
        odds = draw.choice([1.5, 3.0, 8.0, 20.0])
        place = float(draw.randrange(1, 4) if draw.random() < 1.2 / odds + 0.2 else draw.randrange(4, 9))
        rows.append((f"r{i // 6}", f"h{i % 97}", i % 6 + 1, place if i % 50 else None, odds if i % 11 else None, "once" if i == 7 else draw.choice(["a", "b", None]), "late" if i > n - 300 else "old"))
    df = spark.createDataFrame(rows, "race_id string, horse_id string, horse_number int, finish_position double, odds double, surface string, weather string")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.substring("race_id", 2, 9).cast("int") / 5).cast("int"))
    return df.withColumns({"race_date": day, "horse_name": F.col("horse_id"), "age": F.lit(None).cast("int")})


def test_training_task_is_saved_loaded_and_used(spark, tmp_path):
    records = learnable(spark)
    config = modeling.TrainConfig(epochs=12, patience=3, hidden_size=8)
    bundle, rounds, test = tasks.train_task("top3", records, config)
    rows = rounds.orderBy("epoch").collect()
    m = bundle.metrics
    assert [r.epoch for r in rows] == list(range(1, len(rows) + 1)) and rows[m["best_epoch"] - 1].train_loss < rows[0].train_loss + 1e-9
    assert len(rows) == 12 or len(rows) == m["best_epoch"] + 3
    best = math.inf
    for r in rows:  # the fold of early stopping
        if r.validation_loss < best - 1e-4:
            best, at = r.validation_loss, r.epoch
    assert at == m["best_epoch"] and m["validation_auc"] > 0.6 and m["test_auc"] > 0.6 and m["test_rows"] == test.count()
    assert m["pos_weight"] != 1 and 0 <= m["test_precision"] <= 1 and m["date_ranges"]["train"][1] < m["date_ranges"]["test"][0]
    bundle.save(str(tmp_path))
    again = tasks.load_bundle(spark, str(tmp_path))
    frame = history.training_frame(records)
    p = lambda b: [r.probability for r in b.score(frame).orderBy("race_id", "horse_number").collect()]
    assert p(again) == pytest.approx(p(bundle)) and again.metrics == json.loads(json.dumps(m, default=str))
    upcoming = records.filter("race_id = 'r499'").withColumn("race_date", F.lit("2030-01-01").cast("date"))
    card = tasks.predict_task("top3", records, upcoming, bundle)
    assert sorted(r.predicted_rank for r in card.collect()) == list(range(1, 7))
    backtest, summary = tasks.backtest_task("top3", records, bundle)
    assert summary.count() == 500
    told = lambda df: sorted((r.race_id, r.horse_number, r.predicted_rank, round(r.probability, 9)) for r in df.collect())
    assert told(tasks.predict_race(records, upcoming, "r499", again)) == told(card)
    assert told(tasks.predict_historical_race(records, "r321", again)) == told(backtest.filter("race_id = 'r321'"))
    with pytest.raises(ValueError, match="no rows of race r9999"):
        tasks.predict_historical_race(records, "r9999", bundle)
    with pytest.raises(ValueError, match="of 100 rows 98 have a result, 2 don't"):
        tasks.train_task("top3", records.filter("int(substr(race_id, 2)) * 6 + horse_number <= 100"), config)


def test_features_of_rare_missing_and_unseen_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0), (None, 2.0), ("it's \\", None)], "c string, x double")
    fitted = prepare.feature_pipeline(train, ["x"], ["c"])
    other = spark.createDataFrame([("a", None), ("b", None), ("it's \\", 2.0), (None, 2.0), ("new", 2.0)], "c string, x double")
    got = [r.features.toArray().tolist() for r in fitted.transform(other).collect()]
    hot = [x[1:] for x in got]
    assert got[0][0] == 0.0 and hot[1] == hot[2] and hot[4] == [0.0] * len(hot[4]) and len(hot[0]) == 3
    assert [sum(x) for x in hot] == [1, 1, 1, 1, 0] and len({tuple(x) for x in hot}) == 4
    assert sorted(fitted.transform(train).select(vector_to_array("features")[0]).toPandas().iloc[:, 0].round(6)) == pytest.approx([-1.732051, 0, 0, 0, 0, 1.732051])


def test_ids_of_many_files_take_few_plans(spark, tmp_path):
    """Ids as text and as every kind of number, columns in other places, files without the column, unreadable ones, odd names."""
    from decimal import Decimal

    kinds = {"text": (["a1", None], pa.string()), "long": ([202101010101], pa.int64()), "int": ([7], pa.int32()), "double": ([202101010102.0, 1.5, float("nan")], pa.float64()), "float": ([3.0], pa.float32()), "decimal": ([Decimal("12.00")], pa.decimal128(9, 2)), "many": ([float(100 * i) for i in range(3)], pa.float64())}
    for name, (values, kind) in kinds.items():
        pq.write_table(pa.table({"x": pa.array(range(len(values))), "race_id": pa.array(values, kind)}), tmp_path / f"{name}.parquet")
    pq.write_table(pa.table({"other": [1]}), tmp_path / "other.parquet")
    (tmp_path / "junk.parquet").write_text("junk")
    texts = {"a b+c%20.csv": "race_id,x\n21,0\n22.0,1\n", "turned.csv": 'x,"race_id"\n0,"23"\n', "other.csv": "x,y\n1,2\n", "empty.csv": ""} | {f"n{i}.csv": f"x,race_id\n9,{1000 + i}\n" for i in range(30)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = files.ids_from_files(spark, [str(tmp_path / n) for n in [*texts, "gone.csv", "gone.parquet", "junk.parquet", "other.parquet", *(f"{k}.parquet" for k in kinds)]])
    want = {"a1", "202101010101", "7", "202101010102", "1.5", "NaN", "3", "12", "0", "100", "200", "21", "22", "23", *(str(1000 + i) for i in range(30))}
    assert sorted(r.race_id for r in found.collect()) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == len(files.ID_TYPES) + 3


def test_files_are_written_and_read(spark, tmp_path):
    root = tmp_path / "pages"
    for place, text in (("historical/2024/result/202401010101_a.html", b"<p>\xe9 x"), ("historical/2024/result/202401010101_b.html", b"b"), ("historical/horse/h1.html", b"h"), ("upcoming/2025/card/202501010101.html", b"c")):
        (root / place).parent.mkdir(parents=True, exist_ok=True)
        (root / place).write_bytes(text)
    pages = files.read_pages(spark, str(root))
    assert sorted((r.dataset_type, r.year, r.kind, r.race_id) for r in pages.filter("kind <> 'horse'").collect()) == [("historical", 2024, "result", "202401010101")] * 2 + [("upcoming", 2025, "card", "202501010101")]
    assert files.read_pages(spark, str(root), "historical", "result").filter("html = '<p>\ufffd x'").count() == 1 and pages.count() == 4 and files.read_pages(spark, str(tmp_path / "none")).count() == 0
    assert runs.latest_version(pages.filter("kind = 'result'"), "race_id", F.desc("file_name")).first().html == "b"
    assert {(r.kind, r.n_pages, r.n_races) for r in files.cached_page_counts(pages).collect()} == {("result", 2, 1), ("card", 1, 1), ("horse", 1, 0)}
    csv = tmp_path / "ids.csv"
    csv.write_text("race_id,x\n12.0,1\n13,2\n,3\n12,4\n")
    spark.createDataFrame([("14",), ("13",)], "race_id string").write.parquet(str(tmp_path / "ids.parquet"))
    assert sorted(r[0] for r in files.ids_from_files(spark, [str(csv), str(tmp_path / "ids.parquet"), str(tmp_path / "gone.csv"), str(root)]).collect()) == ["12", "13", "14"]
    assert files.ids_from_files(spark, []).count() == 0
    rounds = spark.createDataFrame([("m1", 1, 0.5, 0.6, 0.7, 0.6), ("m2", 1, 0.4, None, 0.7, 0.6)], f"model_run_id string, {files.HISTORY}")
    files.write_history(rounds, str(tmp_path / "history"))
    files.write_history(rounds.filter("model_run_id = 'm1'").withColumn("epoch", F.lit(9)), str(tmp_path / "history"))
    assert sorted((r.model_run_id, r.epoch, r.validation_loss) for r in files.read_training_history(spark, str(tmp_path / "history")).select("model_run_id", "epoch", F.coalesce("validation_loss", F.lit(-1.0)).alias("validation_loss")).collect()) == [("m1", 9, 0.6), ("m2", 1, -1.0)]
    files.write_predictions(rounds, rounds.limit(1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/predictions.parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "out/predictions.csv")).count() == 2
    assert files.read_metrics(spark, str(tmp_path / "out/summary.json")).first().model_run_id in ("m1", "m2")


def test_streamed_ingest_twice_changes_nothing(spark, tmp_path):
    """Pages that arrive are parsed and upserted; the same files once more replace their own rows."""
    arrived, table = tmp_path / "in", str(tmp_path / "table")
    arrived.mkdir()
    heads, cells = "".join(f"<th>{h}</th>" for h in ["着順", "馬番", "馬名", "騎手"]), "<td>1</td><td>2</td><td><a href='/horse/h1'>N</a></td><td>J</td>"
    for name in ("202401010101.html", "202401010102.html"):
        (arrived / name).write_text(f"<table><tr>{heads}</tr><tr>{cells}</tr></table>")

    def write(batch, number):
        pages = batch.select(F.regexp_extract("path", "([0-9]{12})", 1).alias("race_id"), F.lit(None).cast("date").alias("race_date"), F.lit("historical").alias("dataset_type"), F.col("value").alias("html"))
        rows = records_module.conform(extract.parse_pages(pages)[0])
        old = spark.read.parquet(table) if (tmp_path / "table").exists() else records_module.empty_records(spark)
        new = maintenance.upsert_records(old, rows, "run", "historical").collect()
        spark.createDataFrame(new, old.schema).write.mode("overwrite").parquet(table)

    for again in range(2):
        stream = spark.readStream.option("wholetext", True).text(str(arrived)).select("value", F.col("_metadata.file_path").alias("path"))
        snapshots.ingest(stream, str(tmp_path / f"checkpoint{again}"), write).awaitTermination()
        rows = spark.read.parquet(table).orderBy("race_id").collect()
        assert [(r.race_id, r.horse_id, r.finish_position, r.collection_run_id) for r in rows] == [("202401010101", "h1", 1.0, "run"), ("202401010102", "h1", 1.0, "run")]


def test_streamed_snapshot_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    snapshots.latest_snapshot(stream, ["user_id"], "ts", "value").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.table("latest").collect())) == sorted(map(str, snapshots.latest_snapshot(events, ["user_id"], "ts", "value").collect()))


def test_unknown_task():
    with pytest.raises(ValueError, match="nope"):
        modeling.get_task("nope")
