"""Rules of pages, names and odds, by literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from furlong.functions import pages, parse
from furlong.functions.names import exact, fresh
from furlong.operators import cards, maintenance


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(http://a/b)c", ["http://a/b"]), ("HTTPS://D/e f", ["HTTPS://D/e"]), ("http://f/g!?", ["http://f/g"]), ("http://h/i。」 http://h/i", ["http://h/i"]), ("http://j/k　x", ["http://j/k"]),
        ("[http://l/m]x 'http://n'", ["http://l/m", "http://n"]), ("http://o/;p.,;:", ["http://o/;p"]), ("ftp://q", []), ("", []),
    ],
)
def test_urls(spark, text, want):
    assert one(spark, pages.urls(F.lit(text))) == want


def test_urls_in_nested_values(spark):
    kind = "source_url struct<a: array<string>, m: map<string, struct<n: int, t: string>>>, url string, url_2 string"
    row = ((["see http://a/1, http://a/2", None], {"k": (3, "http://b"), "n": None}), None, "http://never")
    df = spark.createDataFrame([row, (None, "http://c http://c", None), (None, None, None)], kind)
    assert [r.x for r in df.select(pages.source_urls(df).alias("x")).collect()] == [["http://a/1", "http://a/2", "http://b"], ["http://c"], []]
    assert df.select(pages.source_urls(df.select("url_2")).alias("x")).first().x == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<meta charset="Shift_JIS">', '<meta charset="UTF-8">'), ("<META CHARSET=euc-jp/>", "<META CHARSET=UTF-8/>"), ('<meta charset="a;b">', '<meta charset="UTF-8">'),
        ('<meta content="text/html; charset=euc-jp; x">', '<meta content="text/html; charset=UTF-8 x">'), ('<div content="t; charset=x-1; y">', '<div content="t; charset=UTF-8; y">'), ("<p charset=x>", "<p charset=x>"),
    ],
)
def test_charset(spark, html, want):
    assert one(spark, pages.normalise_charset(F.lit(html))) == want


def test_text_and_names(spark):
    assert one(spark, parse.html_to_text(F.lit("<p>a&#160;　b\xa0<b>c</b>&nbsp;\n"))) == "a b c"
    name = lambda s: one(spark, parse.safe_name(F.lit(s)))
    assert name("　第1回　 a:b*　") == "第1回 a_b" and name("x" * 90) == "x" * 80 and name(" ._　") == name(None) == "レース名不明" and name("_.a/b?.") == "a_b"
    assert one(spark, pages.race_id_count(F.lit("202401010101 x202401010101 1202401010101 202401010102"))) == 2


def test_prediction_beside_result_without_ids(spark):
    predicted = spark.createDataFrame([("r1", "a", 1), ("r1", None, 2), ("r2", None, 1), ("r2", "b", None), ("r3", "c", 1)], "race_id string, horse_id string, horse_number int").withColumn("_key", F.lit("own"))
    actual = spark.createDataFrame([("r1", "a", 1, 3.0), ("r1", None, 7, 2.0), ("r2", None, 1, 5.0), ("r2", None, None, 6.0)], "race_id string, horse_id string, horse_number int, finish_position double")
    got = sorted((r.race_id, r.horse_id or "", r.horse_number, r.actual_finish) for r in cards.prediction_vs_actual(predicted, actual).collect())
    assert got == [("r1", "", 2, 2.0), ("r1", "a", 1, 3.0), ("r2", "", 1, 5.0), ("r2", "b", None, 6.0), ("r3", "c", 1, None)]
    assert {r["_key"] for r in cards.prediction_vs_actual(predicted, actual).collect()} == {"own"}


def test_published_odds(spark):
    won = {"01": ["3.2", "0", "1"], "2": ["8.6", "0", "2"], "03": ["---.-", "0", "3"], "04": ["1.5", "0"], "105": ["9.9", "0", "4"]}
    data = {"official_datetime": "2026-07-26 09:30:00", "odds": {"1": won, "2": {"01": ["1.1", "", "1"]}}}
    rows = [("a", json.dumps({"data": data})), ("b", json.dumps({"data": json.dumps(data)})), ("c", json.dumps({"data": ""})), ("d", "[]"), ("e", None), ("f", json.dumps({"data": {"odds": []}})), ("g", "no json")]
    found = cards.payload_snapshots(spark.createDataFrame(rows, "race_id string, payload string"))
    assert sorted((r.race_id, r.horse_number, r.odds, r.popularity) for r in found.collect()) == sorted((k, n, v[0], v[2]) for k in "ab" for n, v in won.items() if len(v) > 2)
    assert {r.ts for r in found.collect()} == {"2026-07-26 09:30:00"}
    own = spark.createDataFrame([("a", 1, None, None), ("a", 2, 5.0, 9), ("a", 3, 7.0, 1), ("a", 105, None, None), ("c", 1, 4.0, 2)], "race_id string, horse_number int, odds double, popularity int")
    got = [(r.race_id, r.horse_number, r.odds, r.popularity, r.enriched) for r in cards.enrich_odds(own, found).orderBy("race_id", "horse_number").collect()]
    assert got == [("a", 1, 3.2, 1, True), ("a", 2, 8.6, 2, True), ("a", 3, 7.0, 1, False), ("a", 105, 9.9, 4, True), ("c", 1, 4.0, 2, False)]


def test_own_columns_keep_their_values(spark):
    assert fresh("h", ["_H", "h"], ["__h"]) == "___h"
    have = spark.createDataFrame([("r", "a", "historical", "mine", 1)], "race_id string, horse_id string, dataset_type string, h string, `a.b` int")
    out = maintenance.upsert_records(have, have.filter("false"), "run", "historical").collect()
    assert [(r.h, r["a.b"]) for r in out] == [("mine", 1)] and have.select(exact("a.b")).first()[0] == 1
