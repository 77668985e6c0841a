"""Extraction from literal pages: whole ones, broken ones, and ones without what is looked for."""

import random

import pytest
from pyspark.sql import functions as F

from furlong.functions import outline
from furlong.functions import pages as page
from furlong.functions.outline import Outline, shaped
from furlong.operators import extract

HEAD = "".join(f"<th>{h}</th>" for h in ["着 順", "枠", "馬番", "馬名", "性齢", "斤量", "騎手", "タイム", "通過", "上り", "単勝", "人気", "馬体重", "厩舎"])


def runner(*cells):
    return '<tr class="HorseList">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


ONE = runner("1", "3", "5", '<a href="/horse/2020100001">Able<br>Archer</a>', "牡4", "57.0", '<a href="/jockey/result/recent/01234/">J. Doe</a>', "1:59.8", "4-3-2-1", "34.5", "1,203.2", "1", "480(+4)", '<a href="/trainer/01001">T. Roe</a>')
GONE = runner("中止", "4", "6", '<a href="/horse/ab12">Baker</a>', "騙 3", "55", "", "", "", "", "---", "**", "計不", "")
RESULT = f"""<html><head><title>7月12日 11R</title><script>var x = "<table><td>馬名</td>";</script></head><body><h2>福島 中山</h2>
<div class="RaceName">Seven Star｜G3</div><div class="RaceData01">芝右 外2000m / 天候 : 晴 / 芝 : 稍重</div><div class="RaceData02">2回 福島 6日目</div>
<table class="RaceTable01"><thead><tr>{HEAD}</tr></thead><tbody>{ONE}{GONE}{runner("着順", "枠", "馬番", "馬名")}{runner("", "", "", "")}</tbody></table>
<table class="pay"><thead></thead></table></body></html>"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "race_id string, dataset_type string, html string").withColumn("race_date", F.lit("2026-07-12").cast("date"))


def test_result_page(spark):
    runners, errors = extract.parse_pages(frame(spark, [("202603020611", "historical", RESULT)]))
    one, two = runners.orderBy("row_idx").collect()
    assert (one.horse_id, one.horse_name, one.jockey_id, one.trainer_id, one.trainer_name) == ("2020100001", "Able Archer", "01234", "01001", "T. Roe")
    assert (one.finish_position, one.time_seconds, one.last_3f_time, one.odds, one.sex, one.age) == (1, pytest.approx(119.8), 34.5, 1203.2, "牡", 4)
    assert [one[f"passing_position_{i}"] for i in range(1, 5)] == [4, 3, 2, 1] and (one.body_weight, one.body_weight_change, one.horse_number) == (480, 4, 5)
    assert (one.course_name, one.race_number, one.race_name, one.surface, one.distance, one.weather, one.track_condition) == ("福島", 11, "Seven Star", "芝", 2000, "晴", "稍重")
    assert (two.horse_id, two.finish_position, two.sex, two.odds, two.jockey_name, two.time_seconds, two.passing_position_1) == ("ab12", None, "セ", None, None, None, None)
    assert errors.count() == 0


def test_pages_without_runners_are_errors_and_end_nothing(spark):
    rows = [("1", "historical", None), ("2", "historical", "<table><tr><td>a</td></tr></table>"), ("3", "upcoming", "<table><tr"), ("202603020611", "historical", RESULT), ("5", "historical", f"<table class=RaceTable01><tr>{HEAD}</tr></table>")]
    runners, errors = extract.parse_pages(frame(spark, rows))
    assert runners.count() == 2 and {r.race_id: r.reason for r in errors.collect()} == dict.fromkeys(["1", "2", "3", "5"], "no table of runners")
    assert extract.parse_pages(frame(spark, rows).limit(0))[0].count() == 0


def test_columns_without_headings_are_found_by_their_place(spark):
    """A card of races to come whose heading of the odds is blank."""
    heads = "".join(f"<th>{h}</th>" for h in ["枠", "馬番", "印", "馬名", "性齢", "斤量", "騎手", "厩舎", "馬体重(増減)", "", ""])
    card = f"<table class='RaceTable01'><tr>{heads}</tr>{runner('1', '01', '', 'Ann', '牝3', '54.0', 'J', 'T', '450', '3.2', '1')}</table><p>2200m (芝・左)"
    one = extract.parse_pages(frame(spark, [("20260399", "upcoming", card)]))[0].first()
    assert (one.horse_number, one.odds, one.popularity, one.body_weight, one.finish_position, one.surface, one.distance) == (1, 3.2, 1, 450, None, "芝", 2200)
    assert (one.course_name, one.horse_id) == ("福島", None)


def test_pedigree(spark):
    cell = lambda i, rows=1: f'<td rowspan="{rows}"><a href="/horse/ped/{i}/">N{i}</a></td>'
    half = lambda a, b, c: f"<tr>{cell(a, 4)}{cell(b, 2)}{cell('x')}</tr><tr>{cell('x')}</tr><tr>{cell(c, 2)}{cell('x')}</tr><tr>{cell('x')}</tr>"
    html = f'<table class="blood_table">{half("s1", "s2", "s3")}{half("d1", "d2", "d3")}</table>'
    rows = spark.createDataFrame([("a", html), ("b", "<p>none"), ("c", None), ("d", '<table class="pedigree_table"><tr><td rowspan="x">no link</td></tr></table>')], "horse_id string, html string")
    got = {r.horse_id: tuple(r)[1:] for r in extract.parse_pedigrees(rows).collect()}
    assert got == {"a": ("s1", "Ns1", "d1", "Nd1", "d2", "Nd2"), "b": (None,) * 6, "c": (None,) * 6, "d": (None,) * 6}


def test_tables_of_several_heads_spans_and_nesting(spark):
    html = "<table><thead><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><th>x</th><th>y</th></tr></thead><tr><td>1<td>2<table><tr><td>inner</table><td>3</tr></table>"
    found = Outline(html).tables
    assert shaped(found[0][1]) == (["AA", "Bx", "By"], [(["1", "2", "3"], [])]) and shaped(found[1][1])[1] == [(["inner"], [])]
    cells = spark.createDataFrame([(html,), ("",)], "html string")
    assert extract.extract_tables(extract.outlines(cells), "html").count() == 2


def test_headings_ids_groups_and_addresses(spark):
    df = spark.createDataFrame([(["馬　名 ", None, "nan", "Unnamed: 3", "騎手"], "race_id=2024010203041 x 202411020304 /race/202405020312/ 202405020313 1202405020301", '<li date="20260725" group="a"></li><li class="x"\n  date="20260726"\n group=" "><li group=\'b \' date="20260726">', "https://a.org/x). <a href='http://b.org/'>https://a.org/x,")], "h array<string>, ids string, g string, u string")
    one = df.select(page.normalise_headers(F.col("h")).alias("h"), page.extract_ids(F.col("ids"), F.lit("2024")).alias("ids"), page.group_attribute(F.col("g"), F.lit("20260726")).alias("g"), page.urls(F.col("u")).alias("u")).first()
    assert one.h == ["馬名", "column_1", "column_2", "column_3", "騎手"] and one.ids == ["202401020304", "202405020312"]
    assert one.g == "b" and one.u == ["https://a.org/x", "http://b.org/"]


def test_range_of_days(spark):
    lists = spark.createDataFrame([("2026-07-12", "/race/202603020611/ /race/202603020612/"), ("2026-07-13", "/race/202603020701/")], "d string, html string").select(F.to_date("d").alias("date"), "html")
    files = spark.createDataFrame([("202603020611", "202603020611.html", "<p>old"), ("202603020611", "202603020611_x.html", RESULT), ("202603020701", "a.html", RESULT)], "race_id string, file_name string, html string")
    kin = spark.createDataFrame([("ab12", "s")], "horse_id string, sire_id string")
    runners, errors = extract.ingest_date_range(lists, files, kin, "2026-07-12", "2026-07-12", "historical")
    assert sorted((r.race_id, r.horse_id, r.sire_id or "") for r in runners.collect()) == [("202603020611", "2020100001", ""), ("202603020611", "ab12", "s")] and errors.count() == 0
    with pytest.raises(ValueError):
        extract.ingest_date_range(lists, files, kin, "2026-07-13", "2026-07-12", "historical")


ODD = [
    "", "x", "a < b", "<td>1", "<table><tr><td/></td><td>2</table>", "<p selected>a<br/>b&amp;c<!-- d -->e", "<title>a<b>c</title>d", "<script>if (a < b) '<td>'</script>c", "<style></p></style>d", "<a href=x>y</a>", "a<td",
    "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=\"2\">1</td><td><a href='/horse/9'>n</a> m</td></tr><tr><td>2</td></tr></table>", "<diary_cut>4-3</diary_cut>", "<table><td class='TimeIndex'>x</td><td>y&nbsp;z</TD></table>",
]


def test_plain_markup_reads_as_the_parser_reads_it(monkeypatch):
    texts = [*ODD, *(f"<html><table class='race_table_01'>{a}{b}</table>{a}" for a in ODD for b in ODD)]
    quick = [extract._outline(t) for t in texts]
    plain = [outline.tokens(t) is not None for t in texts]
    monkeypatch.setattr(outline, "tokens", lambda html: None)
    assert quick == [extract._outline(t) for t in texts]
    assert sum(plain) > 20 and not all(plain)
    assert extract._columns(quick).to_pylist() == quick


def test_whole_pages_do_not_need_the_parser(monkeypatch):
    page = "<!DOCTYPE html><html><head><title>t</title><script>var t='<td>';</script></head><table class='race_table_01'><tr><th>a_b</th></tr><tr><td><diary_snap_cut>1</diary_snap_cut></td></tr></table>"
    monkeypatch.setattr(outline.Outline, "feed", None)
    assert extract._outline(page)["error"] is None and extract._outline(page)["tables"][0]["rows"] == [{"cells": ["1"], "links": []}]


BITS = [
    "<td>", "</td>", "<TD>", "<th>", "</th>", "<tr>", "</tr>", "<table class='RaceTable01'>", "<table>", "</table>", "<table class='blood_table'>", "<br/>", "</br>", "<p/>", '<div class="RaceData01 x">', "</div>", "<h1>", "</h1>",
    "<script>", "</script>", "<title>", "</title>", "a", "b c", "&amp;", "<", ">", " ", " 　 ", "<!-- c -->", "<!---->", "<!-->", "<a href='/horse/1/'>", "<a class='q\"r' href='u'>", "<A HREF=\"/jockey/2/\">", "<a class='x TimeIndex' href=\"v\">",
    "</a>", "<td rowspan='2'>", "<td colspan=2>", "<thead>", "</thead>", "<td class=\"TimeIndexCell\">", "<span class='smalltxt'>", "</span>", "</td x>", "<svg/>", "\r",
]


def test_pages_of_the_same_tags_are_read_by_one_template(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choices(BITS, k=draw.randint(1, 25))) for _ in range(3000)]
    page = "<html><title>{}</title><div class='RaceData01'>x{}</div><table class='RaceTable01'><tr><th>h {}</th></tr><tr><td>{}</td><td><a href='/horse/{}/'>n{}</a> {}</td></tr></table>"
    texts += [page.format(*(draw.choice(["", " ", "a", "b&lt;", "c > d"]) for _ in range(7))) for _ in range(200)]
    calls, read = [], outline.Outline._read
    monkeypatch.setattr(outline.Outline, "_read", lambda self, *a: calls.append(1) or read(self, *a))
    outline.template.cache_clear()
    quick = [extract._outline(t) for t in texts[-200:]]
    assert len(calls) == 1
    quick = [extract._outline(t) for t in texts]
    monkeypatch.setattr(outline, "tokens", lambda html: None)
    assert quick == [extract._outline(t) for t in texts]


def test_rows_are_not_made_once_more_to_see_whether_there_are_any(spark):
    pages = spark.createDataFrame([("202603020611", "2026-07-12", "historical", t) for t in (RESULT, "<p>none", None)], "race_id string, race_date string, dataset_type string, html string")
    for df, n in ((extract.parse_pages(pages)[0], 2), (extract.extract_tables(extract.outlines(pages), "race_id"), 4)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(line.strip(" +-:").startswith("Filter") and "size(" in line for line in plan.split("\n"))
        assert df.count() >= n


def test_conditions_outside_the_text_are_found(spark):
    hidden = "<html><title>t</title><div class='TimeIndex'>芝1600m / 天候 : 晴 / 芝 : 良</div></html>"
    pages = spark.createDataFrame([("202603020611", "2026-07-12", "historical", hidden), ("202603020612", "2026-07-12", "historical", "<p>ダ1200m")], "race_id string, race_date string, dataset_type string, html string")
    got = {r.race_id: (r.surface, r.distance) for r in extract.race_metadata(extract.outlines(pages)).collect()}
    assert got == {"202603020611": ("芝", 1600.0), "202603020612": ("ダート", 1200.0)}
