import bisect
import collections
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from wardmap.session import drop_work, new_path, stored, work_dir
from wardmap.sources import tables
from wardmap.streaming import jobs
from wardmap.streaming.runs import RunTable

EVENTS = "/root/testdata/sf0.001"


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "registry.csv"
    path.write_text('pk_unique_id,name,unknown,specialties,numberDoctors\n'
                    '001,"A ""quoted""\nname",u,"[""x"",""y""]",12.0\n', encoding="utf-8")
    df = tables.read_registry_csv(spark, str(path))
    assert df.columns == ["pk_unique_id", "name", "specialties", "numberDoctors"]
    assert tuple(df.first()) == ("001", 'A "quoted"\nname', '["x","y"]', "12.0")


def test_append_with_a_new_column(spark, tmp_path):
    path = str(tmp_path / "trace")
    tables.write_table(spark.createDataFrame([(1,)], "a int"), path)
    tables.write_table(spark.createDataFrame([(2, "x")], "a int, b string"), path, "append")
    assert sorted((r["a"], r["b"]) for r in tables.read_evolving(spark, path).collect()) == [(1, None), (2, "x")]
    tables.write_table(spark.createDataFrame([(3,)], "a int"), path)
    assert [tuple(r) for r in tables.read_evolving(spark, path).collect()] == [(3,)]


def test_literal_rows_views_and_descriptions(spark):
    now = datetime.datetime(2024, 1, 1)
    df = tables.rows_from_records(spark, [{"question": "q", "timestamp": now, "total_time_seconds": 1.5}], tables.TRACE_SCHEMA)
    tables.register_view(df, "traces")
    assert spark.sql("SELECT question, category, total_time_seconds FROM traces").first() == ("q", None, 1.5)
    described = tables.describe_columns(df)
    assert described.orderBy("position").first()["col_name"] == "question" and described.count() == 8
    assert tables.rows_from_records(spark, [], tables.EVALUATION_SCHEMA).count() == 0


def test_domain_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "x string, y int")
    got = sorted(tuple(r) for r in tables.domain_values(df, ["x", "y"]).collect())
    assert got == [("x", "a", 2), ("y", "1", 1), ("y", "2", 1)]


def test_work_folder_is_read_from_the_session(spark):
    assert work_dir(spark) == work_dir(spark)
    table = stored(spark.range(5).toDF("id"), "numbers")
    assert table.count() == 5 and work_dir(spark).removeprefix("file:") in table.inputFiles()[0]


def test_intermediate_tables_are_dropped_on_demand(spark):
    drop_work(spark)
    folder = stored(spark.range(3), "kept").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    assert drop_work(spark) == 1 and not os.path.exists(folder)
    assert drop_work(spark) == 0


@pytest.fixture()
def feed(spark, tmp_path):
    """Events in four files, so that the streams run in several batches."""
    folder = str(tmp_path / "feed")
    spark.read.parquet(f"{EVENTS}/events.parquet").repartition(4, "event_id").write.parquet(folder)
    return folder


def by_window(df):
    return {(r["window_start"], r["event_type"]): (r["events"], round(r["value_sum"], 4), r["value_max"]) for r in df.collect()}


def hourly(spark):
    return by_window(jobs.hourly_activity(spark.read.parquet(f"{EVENTS}/events.parquet")))


def test_windowed_stream_equals_the_batch_result(spark, feed):
    read = lambda: jobs.read_event_stream(spark, feed, "*.parquet", files_per_trigger=1)
    # The four files overlap in time.
    assert by_window(jobs.rolling_statistics(read(), new_path(spark, "windows"))) == hourly(spark)


def test_late_rows_are_counted_beside_the_windows(spark, feed):
    path = new_path(spark, "windows")
    read = lambda: jobs.read_event_stream(spark, feed, "*.parquet", files_per_trigger=1)
    windows = jobs.windowed(read(), path, jobs.ACTIVITY, "1 hour")
    late = sum(r["events"] for r in windows.late().collect())
    kept = sum(r["events"] for r in windows.on_time().collect())
    # Three of the four files come after the newest hours have been seen.
    assert late > kept and late + kept == spark.read.parquet(feed).count()
    assert by_window(windows.corrected()) == hourly(spark)
    # Nothing is late within a delay that covers the feed; a restart has nothing left to do.
    assert jobs.windowed(read(), new_path(spark, "windows"), jobs.ACTIVITY, "60 days").late().isEmpty()
    assert by_window(jobs.windowed(read(), path, jobs.ACTIVITY, "1 hour").corrected()) == hourly(spark)


def test_latency_sketches_merge(spark, tmp_path):
    rng = random.Random(8)
    rows = [(datetime.datetime(2024, 1, 1, rng.randrange(2)), rng.choice("ab"), round(rng.lognormvariate(6, 1)))
            for _ in range(40_000)]
    schema = "ts timestamp, agent string, ms long"
    for i in range(5):
        spark.createDataFrame(rows[i::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    windows = jobs.windowed(stream, new_path(spark, "latency"), jobs.LATENCY, "1 day")
    for r in jobs.agent_latency(windows.on_time()).collect():
        mine = sorted(ms for ts, agent, ms in rows if ts == r.window_start and agent == r.agent)
        assert r.runs == len(mine) and r.max_ms == mine[-1] and abs(r.avg_ms - sum(mine) / len(mine)) < 1e-5
        for found, q in ((r.median_ms, 0.5), (r.p95_ms, 0.95)):
            low, high = bisect.bisect_left(mine, found), bisect.bisect_right(mine, found)
            assert low - 0.005 * len(mine) <= q * len(mine) <= high + 0.005 * len(mine)


def test_run_table_keeps_few_runs_and_ignores_replays(spark):
    table = RunTable(spark, new_path(spark, "runs"), ("k",), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")),
                     fan_in=3, levels=3, buckets=4)
    assert table.read() is None
    expected = collections.Counter()
    for batch in range(23):
        rows = [(i % 7 if batch % 5 else None, batch + i) for i in range(batch)]
        frame = spark.createDataFrame(rows, "k int, n long")
        table.append(frame, batch)
        table.append(frame, batch)
        for k, n in rows:
            expected[k] += n
        assert len(table.manifest().runs) <= 2 * 2 + 1
    assert {r.k: r.n for r in table.read().collect()} == expected
    # A run that was cut short before its manifest is written again.
    frame = spark.createDataFrame([(1, 5)], "k int, n long")
    table._write(table.fold(frame), 0, 23)
    table.append(frame, 23)
    expected[1] += 5
    assert {r.k: r.n for r in table.read().collect()} == expected


def test_keyed_stream_equals_the_batch_result_and_survives_a_replay(spark, feed):
    path = new_path(spark, "keyed")
    columns = ["user_id", "ts", "event_id", "event_type"]
    read = lambda: jobs.read_event_stream(spark, feed, "*.parquet", files_per_trigger=1).select(columns)
    table = jobs.keyed_table(read(), path, "user_id", ["ts", "event_id"])
    newest = spark.read.parquet(f"{EVENTS}/events.parquet").groupBy("user_id").agg(
        F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    expected = rows(newest)
    assert rows(table) == expected
    assert 1 <= len(jobs.RunTable(spark, path, ("user_id",), None).manifest().runs) <= 4
    # A restart has nothing left to do.
    assert rows(jobs.keyed_table(read(), path, "user_id", ["ts", "event_id"])) == expected
