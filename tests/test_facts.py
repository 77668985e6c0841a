"""The table of runner rows on disk, pages that stream into it, and the latest value of a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from furlong.sources import facts
from furlong.sources.records import TYPES
from furlong.streaming import snapshots


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "race_id string, horse_id string, finish_position double, horse_name string")


def content(spark, path):
    return sorted((r.dataset_type, r.race_id or "", r.horse_id or "", r.finish_position, r.collection_run_id) for r in facts.read_facts(spark, str(path)).collect())


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


YEARS = [("202305010101", "a", 1.0, "A"), ("202305010101", None, 2.0, "B"), ("202305010101", None, 3.0, "C"), ("202405010101", "a", 4.0, "A"), ("x1", "a", 5.0, "A"), (None, "z", 6.0, "Z")]


def test_upsert_touches_only_partitions_of_incoming_keys(spark, tmp_path):
    path = tmp_path / "facts"
    assert facts.read_facts(spark, str(path)).count() == 0
    facts.upsert_facts(str(path), rows_of(spark, YEARS), "one", "historical")
    facts.upsert_facts(str(path), rows_of(spark, YEARS[:1]), "up", "upcoming")
    assert facts.read_facts(spark, str(path)).columns == [*TYPES, "year"]
    before = files_of(path)
    new = [("202305010101", None, 8.0, "D"), ("202305010101", "n", 9.0, "N"), ("202305010101", "n", 9.5, "N")]
    assert facts.upsert_facts(str(path), rows_of(spark, new), "two", "historical") == 1
    after = files_of(path)
    touched = "dataset_type=historical/year=2023"
    assert {f: t for f, t in before.items() if not f.startswith(touched)} == {f: t for f, t in after.items() if not f.startswith(touched)}
    assert not {f for f in before if f.startswith(touched)} & set(after)
    want = [
        ("historical", "", "z", 6.0, "one"), ("historical", "202305010101", "", 8.0, "two"), ("historical", "202305010101", "a", 1.0, "one"), ("historical", "202305010101", "n", 9.0, "two"),
        ("historical", "202305010101", "n", 9.5, "two"), ("historical", "202405010101", "a", 4.0, "one"), ("historical", "x1", "a", 5.0, "one"), ("upcoming", "202305010101", "a", 1.0, "up"),
    ]
    assert content(spark, path) == want
    facts.upsert_facts(str(path), rows_of(spark, new), "two", "historical")
    assert content(spark, path) == want and not list(path.glob("_staged*"))
    facts.upsert_facts(str(path), rows_of(spark, YEARS[-1:]), "one", "historical")
    assert len(content(spark, path)) == len(want) + 1  # a NULL race replaces nothing


def test_only_those_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "facts")
    facts.upsert_facts(path, rows_of(spark, YEARS), "one", "historical")
    touched = facts.read_facts(spark, path).filter("year = '2023'").select(*facts.PARTS).distinct().collect()
    pruned = facts.read_facts(spark, path).filter(facts._in_parts(touched))
    scan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "(dataset_type" in filters and "(year" in filters and pruned.count() == 3


def test_failed_runs_leave_the_table(spark, tmp_path):
    path = tmp_path / "facts"
    facts.upsert_facts(str(path), rows_of(spark, YEARS), "one", "historical")
    before, rows = files_of(path), content(spark, path)
    bad = rows_of(spark, YEARS).withColumn("finish_position", F.when(F.col("horse_id") == "z", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("finish_position")))
    with pytest.raises(Exception, match="broken"):
        facts.upsert_facts(str(path), bad, "two", "historical")
    with pytest.raises(ValueError, match="no rows"):
        facts.upsert_facts(str(path), rows_of(spark, YEARS).limit(0), "two", "historical")
    assert files_of(path) == before and content(spark, path) == rows and not list(path.glob("_staged*"))


def test_delete_drops_empty_partitions_and_leaves_others(spark, tmp_path):
    path = tmp_path / "facts"
    facts.upsert_facts(str(path), rows_of(spark, YEARS), "one", "historical")
    before = files_of(path)
    assert facts.delete_facts(spark, str(path), "horse_id", ["a"]) == 3
    assert [r[2:4] for r in content(spark, path)] == [("z", 6.0), ("", 2.0), ("", 3.0)]
    group = facts.read_facts(spark, str(path)).filter("race_id IS NULL").first().year
    assert {f: t for f, t in before.items() if f"year={group}/" in f}.items() <= files_of(path).items()  # nothing of it went
    assert not (path / "dataset_type=historical/year=2024").exists()
    assert facts.delete_facts(spark, str(path), "race_id", ["2023"], prefix=True) == 2 and facts.delete_facts(spark, str(path), "race_id", ["2023"], prefix=True) == 0
    facts.upsert_facts(str(path), rows_of(spark, YEARS[:1]), "three", "historical")
    assert [r[2] for r in content(spark, path)] == ["z", "a"]


def page(number, runners):
    rows = "".join(f"<tr><td>{i + 1}</td><td>{i + 1}</td><td><a href='/horse/{h}/'>{h}</a></td><td>j</td></tr>" for i, h in enumerate(runners))
    return f"<html><body>{number}<table class='race_table_01'><tr><th>着順</th><th>馬番</th><th>馬名</th><th>騎手</th></tr>{rows}</table></body></html>"


def test_streamed_pages_into_the_table(spark, tmp_path):
    root, table, errors = tmp_path / "pages", tmp_path / "facts", tmp_path / "errors"

    def save(race, text, end=""):
        place = root / "historical" / race[:4] / "result"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{race}{end}.html").write_text(text)

    def run(checkpoint):
        stream = snapshots.page_stream(spark, str(root), "historical", files_a_batch=2)
        dates = spark.createDataFrame([("202305010101", datetime.date(2023, 5, 1))], "race_id string, race_date date")
        query = snapshots.ingest_pages(stream, str(table), str(tmp_path / checkpoint), "historical", dates=dates, errors=str(errors / checkpoint))
        query.awaitTermination()
        return sorted((r.race_id, r.horse_id, r.finish_position, str(r.race_date)) for r in facts.read_facts(spark, str(table)).collect())

    save("202305010101", page(1, ["a1", "b1"]))
    save("202305010102", page(2, ["c1"]))
    save("202405010103", "<html>nothing")
    save("nothing", "<html>no id")
    (root / "historical" / "noth").rename(root / "historical" / "2022")
    first = run("one")
    assert first == [("202305010101", "a1", 1.0, "2023-05-01"), ("202305010101", "b1", 2.0, "2023-05-01"), ("202305010102", "c1", 1.0, "None")]
    found = sorted((r.race_id or "", r.reason) for r in spark.read.parquet(f"{errors}/one").collect())
    assert found == [("", "no race id: nothing"), ("202405010103", "no table of runners")]
    assert run("one") == first  # nothing new
    assert run("two") == first  # all of them again
    save("202405010103", page(3, ["d1"]), "_later")
    assert run("one") == sorted([*first, ("202405010103", "d1", 1.0, "None")])


def test_latest_stream_equals_the_batch_and_forgets(spark, tmp_path):
    """Repeated, disordered, late and NULL events, in files read one by one."""
    draw, start = random.Random(5), datetime.datetime(2024, 1, 1)
    kind, batches, on_time = "user string, ts timestamp, value double", [], []
    for hour in range(8):
        own = [(draw.choice("abc") if hour < 3 else draw.choice("cd"), start + datetime.timedelta(hours=6 * hour, minutes=draw.randrange(50)), draw.choice([None, 1.0, 2.0, 9.0])) for _ in range(12)]
        batches.append(own + own[:3])
        on_time += own
    batches[5].append(("a", start, 77.0))  # late
    batches[6].append(("c", None, 5.0))
    source = tmp_path / "in"
    for i, own in enumerate(batches):
        spark.createDataFrame(own, kind).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    source.mkdir()
    seen = {}

    def sink(batch, _):
        for r in batch.collect():
            seen[r.user] = (r.last_ts, r.last_value)

    states = []
    for i in range(len(batches)):
        next((tmp_path / f"b{i}").glob("*.parquet")).rename(source / f"{i}.parquet")
        events = spark.readStream.schema(kind).parquet(str(source))
        out = snapshots.latest_stream(events, ["user"], "ts", "value", "1 hour", expire_ms=7_200_000)
        query = out.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    want = {r.user: (r.last_ts, r.last_value) for r in snapshots.latest_snapshot(spark.createDataFrame(on_time, kind), ["user"], "ts", "value").collect()}
    assert seen == want
    assert max(states) >= 3 and states[-1] <= 2


def test_latest_stream_compares_many_keys_in_few_calls(spark, tmp_path):
    """Whole numbers beyond 2**53 beside missing ones, NaN, equal times, and keys of a cell that expire at different times."""
    start, kind = datetime.datetime(2024, 1, 1), "user bigint, share double, ts timestamp, value bigint"
    big, hours = 2**53 + 1, lambda n: start + datetime.timedelta(hours=n)
    draw = random.Random(3)
    batches = [
        [(draw.randrange(3000), 0.5, hours(draw.random()), draw.choice([None, 1, 2])) for _ in range(9000)] + [(big + i, 0.5, hours(0), v) for i in range(2) for v in (big + i, None, 5)],
        [(None, float("nan"), hours(30), big), (None, float("nan"), hours(30), big + 1), (None, None, hours(30), None), (big, 0.0, hours(30), 1), (big, -0.0, hours(30), 2)],
        [(big, 0.5, hours(30), 7), (big, 0.0, hours(30), 1), (None, None, hours(29.5), 9)],
        [(1, 1.0, hours(90), 1)],
        [(1, 1.0, hours(91), 2)],
    ]
    seen, calls, states = {}, [], []

    def sink(batch, _):
        found = batch.collect()
        calls.append(len(found))
        seen.update({(r.user, str(r.share)): (r.last_ts, r.last_value) for r in found})

    (tmp_path / "in").mkdir()
    for i, own in enumerate(batches):
        spark.createDataFrame(own, kind).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        next((tmp_path / f"b{i}").glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
        out = snapshots.latest_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ["user", "share"], "ts", "value", cells=2)
        query = out.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    rows = spark.createDataFrame([r for own in batches for r in own], kind)
    want = {(r.user, str(r.share)): (r.last_ts, r.last_value) for r in snapshots.latest_snapshot(rows, ["user", "share"], "ts", "value").collect()}
    assert seen == want and len(seen) > 2500
    assert max(states) == 2 and states[-1] == 1 and sum(calls) == len({(r[0], str(r[1] if r[1] is None else r[1] + 0.0)) for own in batches for r in own}) + 2
