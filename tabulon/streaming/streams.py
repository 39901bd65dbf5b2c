"""Structured Streaming forms: event sink, load on arrival, windowed marts, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tabulon.operators.loads import Lake


def sink_events(events: DataFrame, path: str, checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Buffered events to gzip JSON files by day and hour."""
    rows = events.withColumn("dt", F.date_format("ts", "yyyy-MM-dd")).withColumn("hour", F.date_format("ts", "HH"))
    w = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("compression", "gzip").partitionBy("dt", "hour")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def load_on_arrival(files: DataFrame, lake: Lake, dataset: str, mode: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """One load for each micro-batch; the batch number is the load id, so a repeated batch loads once."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            lake.run_load(dataset, batch, mode, f"{dataset}-{number:012d}", keys)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events, total and peak by type and tumbling or sliding window; later rows than ``delay`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("peak")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "peak")


class WindowedMart:
    """Counts by type and window of a stream, with every late row counted beside them.

    Each micro-batch adds its own partial counts under its number, so a batch that
    is run again replaces what it wrote. A row is late if its window ended at or
    before the watermark: the newest event time of the batches before, less
    ``delay``. Late rows change no window; on time and late rows are all rows.
    Rows without a time are counted as late of no window.
    """

    SCHEMA = "start timestamp, event_type string, late boolean, n bigint, total double, peak double, newest timestamp, batch bigint"

    def __init__(self, spark: SparkSession, path: str, window: str = "1 day", slide: str | None = None, delay: str = "1 day"):
        self.spark, self.path, self.window, self.slide, self.delay = spark, path.rstrip("/"), window, slide, delay

    def parts(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/parts") if there else self.spark.createDataFrame([], self.SCHEMA)

    def watermark(self, batch: int) -> Column:
        """What batches before ``batch`` have seen, as a literal; null for the first."""
        newest = self.parts().filter(F.col("batch") < batch).agg(F.max("newest").cast("string")).first()[0]
        return F.lit(newest).cast("timestamp") - F.expr(f"interval {self.delay}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch, in one aggregation."""
        w = F.window("ts", self.window, self.slide) if self.slide else F.window("ts", self.window)
        timed = rows.filter("ts is not null").withColumn("w", w)
        untimed = rows.filter("ts is null").withColumn("w", F.lit(None).cast(timed.schema["w"].dataType))
        late = F.coalesce(F.col("w.end") <= self.watermark(batch), F.col("w").isNull())
        found = timed.unionByName(untimed).groupBy(F.col("w.start").alias("start"), "event_type", late.alias("late"))
        part = found.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"), F.max("ts").alias("newest"))
        part.write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Work off what has arrived."""
        return events.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def counts(self) -> DataFrame:
        """``start, event_type, n, total, peak`` of the rows on time."""
        g = self.parts().filter("not late").groupBy("start", "event_type")
        return g.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.max("peak").alias("peak"))

    def late_rows(self) -> DataFrame:
        """``start, n``: rows that came too late for their window."""
        return self.parts().filter("late").groupBy("start").agg(F.sum("n").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each user."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def admit(times: list[float], now: float, limit: int, seconds: float) -> tuple[bool, list[float]]:
    """Whether an event is admitted when fewer than ``limit`` admitted ones lie in the window before it."""
    held = [t for t in times if t > now - seconds]
    return (True, [*held, now]) if len(held) < limit else (False, held)


AUDIT = "user_id long, event_id long, ts timestamp, admitted boolean"


def rate_limit_audit(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Sequential admission per user over a table.

    A task goes through its users' events in order, batch by batch, and holds at
    most ``limit`` times of one user, so a user may have any number of events.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, times = object(), []  # no user yet
        for pdf in frames:
            out = []
            at = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            for who, now in zip(pdf["user_id"].array, at.tolist(), strict=True):
                who = None if pd.isna(who) else who
                if who != user:
                    user, times = who, []
                ok, times = admit(times, now, limit, seconds)
                out.append(ok)
            yield pdf.assign(admitted=out)

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, AUDIT)


class _Limiter(StatefulProcessor):
    """Admission of one user's events; the admitted times within the window are the state.

    A timer forgets the user once the watermark has passed the window of the last
    admitted time, from where on no event can be affected by it.
    """

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        times, out = list(self.times.get()[0]) if self.times.exists() else [], []
        for now in pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6:
            ok, times = admit(times, float(now), self.limit, self.seconds)
            out.append(ok)
        self.times.update(([float(x) for x in times],))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer(int((max(times) + self.seconds) * 1000) + 1)
        yield pdf.assign(admitted=out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


#: The state store that timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limit_stream(events: DataFrame, limit: int, seconds: float, delay: str = "1 day") -> DataFrame:
    """The same over a stream. Users idle beyond the window are forgotten; rows later than ``delay`` are dropped.

    Timers need the RocksDB state store, so the session's streams use it from here on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(_Limiter(limit, seconds), AUDIT, "Append", "EventTime")
