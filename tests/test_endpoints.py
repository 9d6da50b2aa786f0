import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomsift.operators import endpoints
from loomsift.sources.tables import numbered_lines
from loomsift.operators.ranking import first_per_group, first_rows, ranked_in_groups, with_global_rank

T0 = dt.datetime(2024, 1, 1)


def _log(spark, marks, key="k"):
    rows = [(key, T0 + dt.timedelta(seconds=i), i, m == "+", 1.5) for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, "key string, ts timestamp, id bigint, ok boolean, seconds double")


def _replay(marks):
    """Quarantine minutes after the last event, from event by event."""
    good = bad = 0
    held = None
    for m in marks:
        if m == "+":
            good, held = good + 1, None
            continue
        bad += 1
        if good + bad >= 3:
            rate = bad / (good + bad)
            held = 30 if rate > 0.7 else 10 if rate > 0.5 else held
    return held


@pytest.mark.parametrize("marks", ["--", "---", "+--", "++--", "+---", "++-----", "+++-------", "---+", "-+-", "--++-", "++--+---"])
def test_quarantine(spark, marks):
    row = endpoints.endpoint_state(_log(spark, marks)).first()
    minutes = _replay(marks)
    last = T0 + dt.timedelta(seconds=len(marks) - 1)
    assert row.quarantine_until == (last + dt.timedelta(minutes=minutes) if minutes else None)
    assert (row.success, row.fail, row.total_time) == (marks.count("+"), marks.count("-"), 1.5 * marks.count("+"))


def test_quarantine_equals_replay_on_random_logs(spark):
    rng = random.Random(11)
    logs = {f"k{i}": "".join(rng.choice("+--") for _ in range(rng.randint(1, 12))) for i in range(200)}
    rows = [(k, T0 + dt.timedelta(seconds=i), i, m == "+", 1.0) for k, marks in logs.items() for i, m in enumerate(marks)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, ok boolean, seconds double")
    for r in endpoints.endpoint_state(log).collect():
        minutes = _replay(logs[r.key])
        held = None if r.quarantine_until is None else round((r.quarantine_until - r.last_ts).total_seconds() / 60)
        assert held == minutes, logs[r.key]


def test_pool_at_an_instant(spark):
    log = _log(spark, "---", "bad").union(_log(spark, "+++", "good"))
    at = lambda minutes: F.lit(T0 + dt.timedelta(minutes=minutes))
    assert tuple(endpoints.pool_stats(log, at(5)).first()) == (2, 1, 1)
    assert tuple(endpoints.pool_stats(log, at(60)).first()) == (2, 2, 0)
    scores = {r.key: r.score for r in endpoints.quarantine(log, at(5)).collect()}
    assert scores == {"bad": -1000.0, "good": 100.0}
    keys = spark.createDataFrame([("new",), ("good",)], "key string")
    assert {r.key: r.score for r in endpoints.endpoint_health(log, keys).collect()} == {"new": 50.0, "good": 100.0}


def test_gap_audit_over_bucket_borders(spark):
    rng = random.Random(2)
    rows, now = [], T0
    for i in range(300):
        now += dt.timedelta(seconds=rng.choice([0.5, 30, 2000, 9000]))
        rows.append((f"k{i % 3}", now, i, True, 1.0))
    log = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, ok boolean, seconds double")
    got = {r.id: (r.gap, r.wait) for r in endpoints.request_gap_audit(log, 60.0).collect()}
    last = {}
    for key, ts, i, _, _ in rows:
        gap = (ts - last[key]).total_seconds() if key in last else None
        assert got[i][0] == (pytest.approx(gap) if gap is not None else None)
        assert got[i][1] == pytest.approx(max(0.0, 60.0 - gap) if gap is not None else 0.0)
        last[key] = ts


def test_gap_audit_with_most_rows_in_one_hour_of_a_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else f"k{i % 40}", T0 + dt.timedelta(seconds=rng.randrange(3600)), i, True, 1.0) for i in range(30_000)]
    rows += [(None, T0, -1, True, 1.0), (None, T0, -2, True, 1.0), ("hot", None, -3, True, 1.0)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, id bigint, ok boolean, seconds double").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        audit = endpoints.request_gap_audit(log, 60.0)
        sizes = sorted(r["count"] for r in audit.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) > 3 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got, last = {r.id: r.gap for r in audit.collect()}, {}
    for key, ts, i, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or T0, r[2])):
        gap = (ts - last[key]).total_seconds() if last.get(key) and ts else None
        assert got[i] == (pytest.approx(gap) if gap is not None else None)
        last[key] = ts


def test_endpoints_of_files(spark, tmp_path):
    files = {
        "list": "a.org:80\n\n  1.2.3.4:99 \nuser:k@h:1\nno-colon:\n", "mixed": "a.org:80\nsome words: 5.6.7.8 : 90\n", "one": '{"data":[{"ip":"5.5.5.5","port":"90"}]}',
        "long": '\n{ "data":\n[ {"ip"\n: "x"},\n{\n"ip": "7.7.7.7",\n"since": 3,\n"port": 81\n}, {"port": "5", "ip": "h.org"}, {"ip": "only"}, {"port": "6"}\n] }\n', "none": "\n \n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    lines = numbered_lines(spark, str(tmp_path))
    forms = {r.file.rsplit("/", 1)[1]: r.form for r in endpoints.file_forms(lines).collect()}
    assert forms == {"list.txt": "list", "mixed.txt": "text", "one.txt": "object", "long.txt": "object"}
    got = {r[0] for r in endpoints.endpoints_of_files(lines).collect()}
    assert got == {"a.org:80", "1.2.3.4:99", "user:k@h:1", "no-colon:", "5.6.7.8:90", "5.5.5.5:90", "7.7.7.7:81", "h.org:5"}


def test_endpoints_in_text(spark):
    texts = ["1.2.3.4:80 and 10.0.0.1 - 8080, 9.9.9.9 too far......... 77", '{"data":[{"ip":"5.5.5.5","port":"90"},{"ip":"6.6.6.6"}]}', '{"data": broken', "1.2.3.4:80"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r[0] for r in endpoints.extract_endpoints(df).collect()} == {"1.2.3.4:80", "10.0.0.1:8080", "5.5.5.5:90"}


@pytest.mark.parametrize("n", [1, 4, 5, 10, 57])
def test_top_fifth(spark, n):
    df = spark.createDataFrame([(f"k{i:02d}", float(i % 3)) for i in range(n)], "key string, score double").repartition(3)
    got = [r.key for r in endpoints.top_fifth(df).orderBy(F.desc("score"), "key").collect()]
    expected = sorted(range(n), key=lambda i: (-(i % 3), i))[: max(1, n // 5)]
    assert got == [f"k{i:02d}" for i in expected]


def test_quarantined_keys_are_not_ranked(spark):
    df = spark.createDataFrame([("a", -1000.0, True), ("b", 5.0, False)], "key string, score double, quarantined boolean")
    assert [r.key for r in endpoints.top_fifth(df).collect()] == ["b"]


def test_global_rank_and_groups(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("o"))
    ranked, total = with_global_rank(df, F.col("o").asc())
    assert total == 5000
    expected = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r.o), 1)}
    assert all(expected[r.id] == r["rank"] for r in ranked.collect())
    assert first_per_group(df, ["g"], [F.asc("o")], 5).count() == 35


def test_ranks_in_groups_of_any_size(spark):
    group = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 50))
    df = spark.range(4000).select(group.alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("a"), "id").repartition(3)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(((r.a is not None, r.a or 0), r.id))
    expected = {i: k for rows in groups.values() for k, (_, i) in enumerate(sorted(rows), 1)}
    assert {r.id: r.rn for r in ranked_in_groups(df, ["g"], ["a", "id"]).collect()} == expected


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1999, 2000, 5000])
def test_first_rows_are_selected(spark, n):
    df = spark.range(2000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 4).alias("a"), F.md5(F.col("id").cast("string")).alias("b"), "id")
    rows = sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b))
    got = first_rows(df, n, "a", "b", pivots=5, few=20)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows[:n])
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_at_the_limit_stay(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "a int")
    assert first_rows(df, 10, "a", pivots=3, few=5).count() == 50 and first_rows(df, 60, "a", pivots=3, few=5).count() == 100


def test_speed(spark):
    row = endpoints.speed(_log(spark, "+" * 11)).first()
    assert (row.processed, row.seconds) == (11, 10.0) and row.per_second == pytest.approx(1.1)
    assert endpoints.speed(_log(spark, "+")).first()["per_second"] is None
