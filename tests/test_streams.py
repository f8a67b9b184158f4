"""Streams against batches: rows, restarts from a checkpoint, odd events."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.plans.views import LIMITS
from tessera.streaming import events as E

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, extra string"


def files(spark, tmp_path, *parts):
    """A stream over files that were written one after the other."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_count_as_the_batch_does(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = E.tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.value, 4)) for r in df.collect())
    assert rows(spark.table("tumbling")) == rows(E.tumbling_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))))


def test_first_seen_keeps_one_of_each(spark, tmp_path):
    at = datetime(2024, 1, 1)
    stream = files(spark, tmp_path, [(1, at, 7, "view", 0.0, "a"), (1, at, 7, "view", 0.0, "a"), (2, at, 8, "view", 0.0, "a")], [(1, at + timedelta(minutes=5), 7, "view", 0.0, "b"), (3, at, 9, "view", 0.0, "b")])
    stream = E.first_seen_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"])
    got = E.collected(stream.select("event_id", "user_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 8), (3, 9)]


def admitted(events, limits):
    """One event after the other, in the order of time."""
    days, months, out = Counter(), Counter(), {}
    for _, ts, _, kind, *_ in sorted(events, key=lambda e: e[1]):
        day, cap = ts.strftime("%Y-%m-%d"), limits.get(kind, 0)
        used, took = out.setdefault((kind, day), [0, 0])
        ok = cap is None or (days[kind, day] < cap // 28 and months[kind, day[:7]] < cap)
        days[kind, day] += ok
        months[kind, day[:7]] += ok
        out[kind, day] = [used + 1, took + ok]
    return {k: tuple(v) for k, v in out.items()}


def test_admission_goes_on_from_its_checkpoint(spark, tmp_path):
    """Three months of events, in parts with a restart between them; limits of days and of months are met, and days that
    are past are forgotten by timers."""
    limits = {"view": 56, "click": None, "purchase": 84}
    at = datetime(2024, 1, 1)
    events = [(k, at + timedelta(hours=5 * k % 2100, minutes=k), k % 9, ["view", "click", "purchase", "other"][k % 4], 1.0, "x") for k in range(1600)]
    events.sort(key=lambda e: e[1])
    odd = [(9001, None, 1, "view", 1.0, "x"), (9002, at, 1, None, 1.0, "x")]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for rows in (events[:500] + odd, events[500:501], events[501:1100], events[1100:]):
        got = E.collected(E.admission_stream(files(spark, tmp_path, rows), limits), out, check)
    sums = got.groupBy("kind", "day").agg(F.sum("used").alias("used"), F.sum("admitted").alias("admitted"))
    want = admitted(events, limits)
    assert {(r.kind, r.day): (r.used, r.admitted) for r in sums.collect()} == want
    assert any(a < u for (k, _), (u, a) in want.items() if k == "view") and got.count() == len(got.collect())


def test_status_goes_forward_and_restarts(spark, tmp_path):
    at = datetime(2024, 1, 1)
    event = lambda k, user, kind: (k, at + timedelta(minutes=k), user, kind, 0.0, "x")
    parts = [
        [event(1, 1, "view"), event(2, 1, "click"), event(3, 2, "purchase"), event(4, 3, "error"), (5, None, 4, "click", 0.0, "x"), (6, at, None, "click", 0.0, "x")],
        [event(7, 1, "error"), event(8, 2, "click"), event(9, 3, "view"), event(9, 3, "view")],
        [event(10, 1, "view"), event(11, 5, "view")],
    ]
    for rows in parts:
        got = E.collected(E.status_stream(files(spark, tmp_path, rows)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.user_id, r.was, r.status) for r in got.collect()) == sorted(
        [(1, "not_started", "attempted"), (2, "not_started", "interested"), (3, "not_started", "do_not_contact"), (1, "attempted", "do_not_contact"), (3, "do_not_contact", "not_started"), (1, "do_not_contact", "attempted")]
    )


def test_streams_of_nothing(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = E.in_micro_batches(events.limit(0), str(tmp_path / "in"), 3)
    assert E.collected(E.admission_stream(stream, LIMITS), str(tmp_path / "out"), str(tmp_path / "check")).count() == 0
