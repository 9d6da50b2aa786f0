import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomsift.operators.endpoints import endpoint_state
from loomsift.options import GateOptions
from loomsift.plans import curate
from loomsift.streaming import jobs
from loomsift.streaming.segments import SegmentTable

SCHEMA = "page_id bigint, url string, html string"
GATE = GateOptions(use_quality_filter=False, digit_density=False, min_chars=20)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(i, f"https://h.com/p{i % 7}?v={i}", f"<p>{'text of page ' * (i % 9)} {i}</p>") for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    return path


def test_curation_equals_batch(spark, folder):
    stream = jobs.stream_curate(jobs.pages_stream(spark, folder, files_per_trigger=1), GATE).select("page_id", "chat")
    got = sorted(tuple(r) for r in jobs.run_to_table(stream, "t").collect())
    batch = curate.training_rows(curate.curation_funnel(spark.read.parquet(folder), GATE)).select("page_id", "chat")
    assert got == sorted(tuple(r) for r in batch.collect()) and got


def test_dedup_over_batches(spark, folder):
    stream = jobs.pages_stream(spark, folder, files_per_trigger=1).select("url")
    assert sorted(r[0] for r in jobs.stream_dedup(stream).collect()) == [f"https://h.com/p{i}" for i in range(7)]


def test_dedup_goes_on_where_it_ended(spark, folder, tmp_path):
    target, state = str(tmp_path / "known"), str(tmp_path / "state")
    first = jobs.stream_dedup(jobs.pages_stream(spark, folder).select("url"), target=target, state=state)
    assert first.count() == 7
    rows = [(90, "https://h.com/p3#x", ""), (91, "https://h.com/new", ""), (92, "https://h.com/new?y", "")]
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
    again = jobs.stream_dedup(jobs.pages_stream(spark, folder).select("url"), target=target, state=state)
    assert sorted(r[0] for r in again.collect()) == ["https://h.com/new", *[f"https://h.com/p{i}" for i in range(7)]]


def test_a_stream_keeps_no_state_in_executors(spark, folder):
    stream = jobs.pages_stream(spark, folder, files_per_trigger=1).select("url")
    jobs.stream_dedup(stream)
    assert not any(q.lastProgress and q.lastProgress["stateOperators"] for q in spark.streams.active)
    assert "Deduplicate" not in jobs.stream_dedup(stream)._jdf.queryExecution().analyzed().toString()


def _numbers(spark, *values):
    return spark.createDataFrame([(v, 1) for v in values], "k int, n int")


def test_segments_stay_few_and_hold_every_batch(spark, tmp_path):
    merge = lambda df: df.groupBy("k").agg(F.sum("n").cast("int").alias("n")).coalesce(1)
    table = SegmentTable(spark, str(tmp_path / "t"), "k int, n int", merge, fan=3)
    most = 0
    for batch in range(28):
        table.add(_numbers(spark, batch % 5, 7).coalesce(1), batch)
        most = max(most, len(table.segments()))
    assert most <= 2 * 4 and table.segments()[0] == (0, 26)
    got = {r.k: r.n for r in table.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert got == {0: 6, 1: 6, 2: 6, 3: 5, 4: 5, 7: 28}
    # what a reader at an earlier batch sees does not change
    assert table.read(12).agg(F.sum("n")).first()[0] == 24


def test_a_replayed_batch_counts_once(spark, tmp_path):
    table = SegmentTable(spark, str(tmp_path / "t"), "k int, n int", fan=2)
    for batch, times in ((0, 1), (1, 3), (2, 1), (3, 2)):
        for _ in range(times):
            table.add(_numbers(spark, batch), batch)
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 3] and table.segments() == [(0, 3)]
    # a batch that was cut off before its manifest leaves nothing behind that counts
    table._write(_numbers(spark, 9), (4, 4))
    assert table.read().count() == 4
    table.add(_numbers(spark, 4), 4)
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2, 3, 4]


@pytest.fixture
def events(spark, tmp_path):
    path = str(tmp_path / "events")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", t0 + dt.timedelta(seconds=37 * i), i, i % 4 == 0, 0.5) for i in range(300)]
    spark.createDataFrame(rows, "key string, ts timestamp, id bigint, ok boolean, seconds double").coalesce(1).write.parquet(path)
    return path


def _late(spark, events, tmp_path):
    """The log in several files, the last with old rows."""
    path = str(tmp_path / "log")
    batch = spark.read.parquet(events)
    batch.filter("id >= 100").repartition(3).write.parquet(path)
    batch.filter("id < 100").coalesce(1).write.mode("append").parquet(path)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stats_hold_every_row(spark, events, tmp_path):
    batch, stream = _late(spark, events, tmp_path)
    partials = jobs.run_partials(stream, lambda b: jobs.partial_stats(b, key="key"), "t", lambda p: jobs.current_stats(p, "key"), fan=2)
    got = {(r.window_start, r.key): r.rows for r in jobs.current_stats(partials, "key").collect()}
    rows = batch.groupBy(F.window("ts", "1 minute")["start"].alias("w"), "key").count().collect()
    assert got == {(r.w, r.key): r["count"] for r in rows} and sum(got.values()) == 300


def test_health_equals_batch(spark, events, tmp_path):
    batch, stream = _late(spark, events, tmp_path)
    partials = jobs.run_partials(stream, jobs.partial_health, "t")
    assert partials.count() > 3
    assert sorted(map(tuple, jobs.current_health(partials).collect())) == sorted(map(tuple, endpoint_state(batch).collect()))
