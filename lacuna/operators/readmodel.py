"""The read model: JSON documents of apps, histories and the dashboard, written with a commit.

A version's documents are written first, by kind and with bounded files; then a row for each kind is written to the commits.
Readers take the newest version that has its commits, so an interrupted write is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("app", "history", "dashboard")


def app_documents(summary: DataFrame) -> DataFrame:
    """kind, key, document: an app's summary; its latest sample, policy and attempt are objects, null where there is none."""
    sample = F.when(F.col("observed").isNotNull(), F.struct(F.col("observed").alias("observed_at_micros"), "player_count"))
    policy = F.when(F.col("interval_seconds").isNotNull(), F.struct("interval_seconds"))
    attempt = F.when(F.col("last_status").isNotNull(), F.struct(F.col("last_status").alias("status")))
    body = F.struct("app_id", "name", "availability", F.col("samples").alias("sample_count"), F.col("highest").alias("highest_recorded"), "highest_24h", sample.alias("latest"), policy.alias("tracking"), attempt.alias("last_attempt"))
    return _documents(summary, "app", F.col("app_id").cast("string"), body)


def history_documents(history: DataFrame, start: int, end: int) -> DataFrame:
    """kind, key, document: window, points, coverage, metrics and gaps of history(); a rejected app's points and gaps are null, not empty."""
    points = F.when(~F.col("rejected"), F.transform(F.coalesce("series", F.array().cast(history.schema["series"].dataType)), lambda p: F.struct(p["t"].alias("observed_at_micros"), p["player_count"].alias("player_count"))))
    window = F.struct(F.lit(start).cast("bigint").alias("from_micros"), F.lit(end).cast("bigint").alias("to_micros"))
    coverage = F.struct(F.col("points").alias("sample_count"), "expected", "covered", "requested", "tracked", "ratio", "longest_gap")
    metrics = F.struct(F.col("average").alias("time_weighted_average"), F.col("peak").alias("observed_peak"))
    body = F.struct("app_id", F.col("estimator").alias("estimator_version"), window.alias("window"), points.alias("points"), coverage.alias("coverage"), metrics.alias("metrics"), "gaps", "rejected")
    return _documents(history, "history", F.col("app_id").cast("string"), body)


def dashboard_document(known: DataFrame, tracked: DataFrame, sources: DataFrame, charts: DataFrame) -> DataFrame:
    """One row, kind, key, document: how many apps are known and tracked, each source's status, and the newest chart of each.

    known, tracked: app_id; sources: source, at, status; charts: source, app_id, rank, players, image, age_seconds, 100 rows a source at most.
    Only what is bounded by the number of sources is gathered.
    """
    counts = known.agg(F.count_distinct("app_id").alias("catalog_apps")).crossJoin(tracked.agg(F.count_distinct("app_id").alias("tracked_apps")))  # one row each
    states = sources.agg(F.array_sort(F.collect_list(F.struct("source", F.col("at").alias("at_micros"), "status"))).alias("sources"))
    shown = charts.groupBy("source").agg(F.max("age_seconds").alias("age_seconds"), F.array_sort(F.collect_list(F.struct("rank", "app_id", "players", "image"))).alias("items"))
    shown = shown.agg(F.array_sort(F.collect_list(F.struct("source", "age_seconds", "items"))).alias("charts"))
    return _documents(counts.crossJoin(states).crossJoin(shown), "dashboard", F.lit("dashboard"), F.struct("catalog_apps", "tracked_apps", "sources", "charts"))


def _documents(df: DataFrame, kind: str, key: Column, body: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), key.alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_read_model(documents: DataFrame, path: str, version: int, records_per_file: int = 100_000) -> None:
    """Writes the documents (kind, key, document) as a version, then commits it. A version that is written again replaces what it held."""
    spark = documents.sparkSession
    at = f"{path}/documents/version={version}"
    documents.write.mode("overwrite").partitionBy("kind").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").json(at)
    counts = _read(spark, at).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")  # a row for each kind


def _read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("key string, document string, kind string").json(at)


def committed_versions(spark: SparkSession, path: str) -> DataFrame:
    """version, kind, n of the committed versions."""
    return spark.read.schema("kind string, n long, version long").parquet(f"{path}/commits")


def read_read_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """kind, key, document of the given or the newest committed version; a version without its commits is an error. A filter on kind prunes folders."""
    versions = committed_versions(spark, path)
    found = (versions if version is None else versions.where(F.col("version") == version)).agg(F.max("version")).first()[0]
    if found is None:
        raise ValueError("no committed version")
    return _read(spark, f"{path}/documents/version={found}").select("kind", "key", "document")
