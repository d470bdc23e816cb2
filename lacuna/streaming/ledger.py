"""Streams over the ledger. Each runs with availableNow to the end of what is there and returns what it wrote to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; only where none is named and Spark runs in one process, in a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table's files; the table may be a folder or a single file, which a stream takes as a pattern only."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Runs the stream over all files there are, in append mode, and returns its output. State is kept in RocksDB, on disk, row by row."""
    spark = stream.sparkSession
    path = shared_folder(spark, label)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_captures(landing: DataFrame) -> DataFrame:
    """Landed rows (capture_id, ..., payload) as captures with the payload's checksum; works on streams and tables."""
    return landing.withColumn("checksum", F.sha2(F.col("payload").cast("binary"), 256))


def stream_project(captures: DataFrame, key: str, at: str, delay: str, label: str = "projected") -> DataFrame:
    """Each key once, whatever comes twice within the delay. A batch writes its own folder anew, so a repeated batch leaves one copy."""
    spark = captures.sparkSession
    path = shared_folder(spark, label)
    once = captures.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    once.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch").select(captures.columns)


def policy_periods(policies: DataFrame) -> DataFrame:
    """app_id, from_t, until_t (null: still), interval_seconds of each policy; of several from one time on the one with the largest id."""
    one = policies.groupBy("app_id", "started").agg(F.max_by("interval_seconds", "id").alias("interval_seconds"))
    following = F.lead("started").over(Window.partitionBy("app_id").orderBy("started"))
    return one.select("app_id", F.col("started").alias("from_t"), following.alias("until_t"), "interval_seconds")


def stream_paced_sessions(samples: DataFrame, policies: DataFrame, at: str, delay: str, multiplier: int = 2) -> DataFrame:
    """app_id, first, last_end, n of runs of samples, each of which lies within `multiplier` intervals of an earlier one.

    A sample's gap is that of the app's policy at its time: the stream is joined as of then with the policies' table, which needs no
    state. samples: app_id, t (microseconds) and the time `at`; samples before any policy belong to no run. Rows come out
    when the watermark has passed the session's end.
    """
    held = policy_periods(policies).withColumnRenamed("app_id", "policy_app")
    as_of = (F.col("app_id") == F.col("policy_app")) & (F.col("t") >= F.col("from_t")) & (F.col("until_t").isNull() | (F.col("t") < F.col("until_t")))
    paced = samples.withWatermark(at, delay).join(held, as_of)
    gap = F.concat((F.col("interval_seconds") * multiplier).cast("string"), F.lit(" seconds"))
    runs = paced.groupBy(F.session_window(at, gap), "app_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.select("app_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last_end"), "n")


def stream_sessions(samples: DataFrame, at: str, gap: str, delay: str) -> DataFrame:
    """app_id, first, last_end, n of runs of samples that no gap of that length parts; a session comes out when the watermark has passed it."""
    runs = samples.withWatermark(at, delay).groupBy(F.session_window(at, gap), "app_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.select("app_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last_end"), "n")


class CappedSpans(StatefulProcessor):
    """The state of one app: what holds now, and the rows that wait for the watermark, each its own entry, so no value grows with a batch.

    Input only enters the entries and sets a timer for the first of them. A timer takes the entries that the watermark has passed, in
    order of (t, kind, id), closes spans, and is set anew for the first entry left or for the end of the open span.
    """

    def __init__(self, multiplier: int) -> None:
        self.multiplier = multiplier

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "interval long, since long, players long")
        self.waiting = handle.getMapState("waiting", "t long, kind long, id long", "amount long")

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(t // 1000 + 1)  # the watermark is beyond t then

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.updateValue((r.t, r.kind, r.id), (r.amount,))
            first = r.t if first is None else min(first, r.t)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        interval, since, players = self.now.get() if self.now.exists() else (-1, -1, -1)
        due, later = [], None
        for k, v in self.waiting.iterator():
            if k[0] // 1000 < mark:
                due.append((k[0], k[1], k[2], v[0]))
            else:
                later = k[0] if later is None else min(later, k[0])
        length = lambda seconds: seconds * self.multiplier * 1_000_000
        until = since + length(interval) if since >= 0 else None
        for t, kind, number, amount in sorted(due):
            self.waiting.removeKey((t, kind, number))
            if kind == 0:
                interval = amount
                continue
            if until is not None and min(t, until) > since:
                yield Row(app_id=key[0], a=since, b=min(t, until), player_count=players, expired=until < t)
            since, players = (t, amount) if interval >= 0 else (-1, -1)
            until = t + length(interval) if interval >= 0 else None
        if until is not None and until // 1000 < mark:
            if until > since:
                yield Row(app_id=key[0], a=since, b=until, player_count=players, expired=True)
            since, until = -1, None
        self.now.update((interval, since, players))
        for t in (until, later):
            if t is not None:
                self._wake(t)

    def close(self) -> None:
        pass


def stream_capped_spans(rows: DataFrame, at: str, delay: str, multiplier: int = 2) -> DataFrame:
    """app_id, a, b, player_count, expired of spans that have ended; rows are (app_id, t, kind, id, amount, and the time `at`).

    Of kind 0, amount is the interval in seconds from then on; of kind 1, it is a sample's player count. A span ends with
    the app's next sample, or after `multiplier` intervals: then it has expired. The same rows come out however the input is
    split into batches. What comes behind the watermark is dropped here; late_rows and rewrite_touched are for that. t is in
    microseconds. The state needs RocksDB, which `drained` sets.
    """
    own = rows.withWatermark(at, delay).select("app_id", "t", F.col("kind").cast("long").alias("kind"), "id", "amount", at)
    return own.groupBy("app_id").transformWithState(CappedSpans(multiplier), "app_id long, a long, b long, player_count long, expired boolean", "Append", "EventTime")


def stream_freshness(rows: DataFrame, at: str, delay: str, multiplier: int = 2) -> DataFrame:
    """app_id, stale_at: when an app's newest sample grew older than `multiplier` intervals, once the watermark is past that. Rows as of stream_capped_spans."""
    return stream_capped_spans(rows, at, delay, multiplier).where("expired").select("app_id", F.col("b").alias("stale_at"))


def stream_quota(attempts: DataFrame, at: str, delay: str, length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """host_group, window_end, attempts over sliding windows; a window comes out when the watermark has passed it."""
    counted = attempts.withWatermark(at, delay).groupBy(F.window(at, length, step), "host_group").agg(F.count(F.lit(1)).alias("attempts"))
    return counted.select("host_group", F.col("window.end").alias("window_end"), "attempts")


def touched_rollup(samples: DataFrame, late: DataFrame, bucket: int) -> DataFrame:
    """app_id, bucket, n, highest, recomputed for the buckets of an app in which rows came late; other buckets are not read into the aggregation."""
    key = F.expr(f"t div {bucket} * {bucket}").alias("bucket")
    touched = late.select("app_id", key).distinct()
    every = samples.unionByName(late).select("app_id", key, "player_count")
    return every.join(touched, ["app_id", "bucket"], "left_semi").groupBy("app_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("player_count").alias("highest"))


def rewrite_touched(batch: DataFrame, number: int, path: str, delay: int, day: int, buckets: int = 64) -> None:
    """One batch of samples (capture_id, app_id, t, player_count) into the rollup at path; a repeated batch leaves what it left before.

    path/rows holds the samples by day, bucket of apps and batch; path/late those that came behind the mark, which is the newest
    time of all earlier batches less `delay`; path/rollup app_id, n, highest, n_late by day and bucket. Only the days and buckets that
    the batch touches are read and written anew: their folders alone change.
    """
    spark = batch.sparkSession
    rows = batch.select("capture_id", "app_id", "t", "player_count", F.expr(f"floor(t / {day})").alias("day"), F.pmod(F.xxhash64("app_id"), F.lit(buckets)).cast("int").alias("bucket"))
    mark = None
    if number:
        mark = spark.read.schema("newest long, batch long").parquet(f"{path}/marks").where(F.col("batch") < number).agg(F.max("newest")).first()[0]  # one number
    late = F.lit(False) if mark is None else F.col("t") < mark - delay
    rows = rows.withColumn("late", late).withColumn("batch", F.lit(number).cast("long"))
    put = lambda df, name, *parts: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{name}")
    put(rows.repartition("day", "bucket"), "rows", "day", "bucket", "batch")
    every = spark.read.parquet(f"{path}/rows").where(F.col("batch") <= number)
    own = every.where(F.col("batch") == number)
    put(own.where("late").drop("late"), "late", "batch")
    put(own.agg(F.max("t").alias("newest")).withColumn("batch", F.lit(number).cast("long")), "marks", "batch")
    touched = own.select("day", "bucket").distinct()  # some folders' names
    rolled = every.join(F.broadcast(touched), ["day", "bucket"], "left_semi").groupBy("day", "bucket", "app_id")
    rolled = rolled.agg(F.count(F.lit(1)).alias("n"), F.max("player_count").alias("highest"), F.sum(F.col("late").cast("long")).alias("n_late"))
    put(rolled.repartition("day", "bucket"), "rollup", "day", "bucket")


def stream_rollup(samples: DataFrame, path: str, delay: int, day: int, buckets: int = 64) -> DataFrame:
    """Runs a stream of samples into the rollup at path (see rewrite_touched) to the end of what is there, and returns the rollup.

    The checkpoint lies at path too: a later run over the same stream takes what has come since. A day has at most `buckets` folders; few
    suffice while a day's samples are few.
    """
    query = samples.writeStream.foreachBatch(lambda batch, number: rewrite_touched(batch, number, path, delay, day, buckets)).option("checkpointLocation", f"{path}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return samples.sparkSession.read.parquet(f"{path}/rollup")
