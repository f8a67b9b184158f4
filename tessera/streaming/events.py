"""Event streams: windows, first sights, admission under limits and status of users.

The two with keyed state of their own (``admission_stream``, ``status_stream``) count rows in tasks as they
come and keep a few numbers for each key. Defined results: events without a time or a key are left out; a repeated
event counts again, unless ``first_seen_stream`` stands before; of a kind without a limit nothing is admitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value of each kind and window; for batches and streams alike (a stream forgets
    windows once it is ``late`` past them)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.col("value").cast("double").alias("value"))


def first_seen_stream(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, the state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state of several variables needs the state store on disk; the session's own choice comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Admission(StatefulProcessor):
    """Per kind: how many uses of each day and month were admitted. A day's limit is a 28th of the month's."""

    def __init__(self, limits: dict[str, int | None], late_days: int):
        self.limits, self.late = limits, timedelta(days=late_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day string", "admitted long")
        self.months = handle.getMapState("months", "month string", "admitted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts: dict[str, int] = {}
        for part in rows:
            for day, n in part["day"].value_counts().items():
                counts[day] = counts.get(day, 0) + int(n)
        out, kind = [], key[0]
        for day in sorted(counts):
            n, month = counts[day], day[:7]
            today = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            so_far = self.months.getValue((month,))[0] if self.months.containsKey((month,)) else 0
            cap = self.limits.get(kind, 0)
            take = n if cap is None else max(0, min(n, cap // 28 - today, cap - so_far))
            self.days.updateValue((day,), (today + take,))
            self.months.updateValue((month,), (so_far + take,))
            end = datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=timezone.utc) + timedelta(days=32) + self.late
            self.handle.registerTimer(int(end.timestamp() * 1000))
            out.append((kind, day, n, take))
        if out:
            yield pd.DataFrame(out, columns=["kind", "day", "used", "admitted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Days and months that no event can reach any more are forgotten."""
        until = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc) - self.late - timedelta(days=31)
        for state, shape in ((self.days, "%Y-%m-%d"), (self.months, "%Y-%m")):
            gone = [k[0] for k in state.keys() if k[0] < until.strftime(shape)]
            for k in gone:
                state.removeKey((k,))
        return iter(())

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limits: dict[str, int | None], late_days: int = 1) -> DataFrame:
    """kind, day, used, admitted: of each micro-batch, the uses of each kind and day and how many the limits of the day
    and the month admit (None: no limit). Summed over all micro-batches that is what a batch over the days gives."""
    rows = events.filter("ts is not null and event_type is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_days} days")
    rows = rows.select(F.col("event_type").alias("kind"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rows.groupBy("kind").transformWithStateInPandas(Admission(limits, late_days), "kind string, day string, used long, admitted long", "Append", "EventTime")


class Status(StatefulProcessor):
    """Per user: the newest event, and how far it has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ts string, event_id long, newest string, bought boolean, clicked boolean, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts, event, newest, bought, clicked, status = self.seen.get() if self.seen.exists() else ("", -1, "", False, False, "not_started")
        for part in rows:
            bought, clicked = bought or bool((part["event_type"] == "purchase").any()), clicked or bool((part["event_type"] == "click").any())
            last = part.sort_values(["ts", "event_id"]).iloc[-1]
            if (last["ts"], int(last["event_id"])) > (ts, event):
                ts, event, newest = last["ts"], int(last["event_id"]), last["event_type"]
        now = "do_not_contact" if newest == "error" else "interested" if bought else "attempted" if clicked else "not_started"
        self.seen.update((ts, event, newest, bought, clicked, now))
        if now != status:
            yield pd.DataFrame([(key[0], status, now, ts)], columns=["user_id", "was", "status", "ts"])

    def close(self) -> None:
        pass


def status_stream(events: DataFrame) -> DataFrame:
    """user_id, was, status, ts: every change of a user's status. A user goes forward from not_started over attempted
    (a click) to interested (a purchase) and never back, but while its newest event is an error it is do_not_contact."""
    rows = events.filter("ts is not null and user_id is not null and event_id is not null")
    rows = rows.select("user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id", F.coalesce("event_type", F.lit("")).alias("event_type"))
    return rows.groupBy("user_id").transformWithStateInPandas(Status(), "user_id long, was string, status string, ts string", "Append", "None")


def in_micro_batches(events: DataFrame, folder: str, parts: int) -> DataFrame:
    """``events`` as a stream of ``parts`` micro-batches in the order of time, by files written one after the other."""
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        events.coalesce(1).write.mode("append").parquet(folder)
        parts = 0
    for k in range(parts):
        rows = events.filter(F.col("ts") >= F.lit(lo + (hi - lo) * k / parts))
        if k < parts - 1:
            rows = rows.filter(F.col("ts") < F.lit(lo + (hi - lo) * (k + 1) / parts))
        rows.coalesce(1).write.mode("append").parquet(folder)
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream gives until its source is used up, as a table in ``folder``; it goes on from ``checkpoint``."""
    spark = stream.sparkSession
    with keyed_state(spark):
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
