"""Captured responses as they land, and the ledger they are appended to.

A landing folder holds lines of JSON, a response each, with its request's identity and timings. The ledger is Parquet by days
of receipt, source and batch. A batch owns its partitions: taking it in again, whole, writes them anew, so a repeated or interrupted
ingest leaves one copy, and nothing that other batches wrote is touched. A folder holds FOLDER_DAYS days, in order, and a file for each
PIECE of payload or so, that few captures a day don't become a folder and a file each.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a landed line holds. Times are microseconds; parameters are the request's, as JSON; payload is the response's text.
LANDED = T.StructType(
    [
        T.StructField("capture_id", T.StringType()), T.StructField("attempt_id", T.LongType()), T.StructField("run_id", T.LongType()), T.StructField("app_id", T.LongType()), T.StructField("source", T.StringType()),
        T.StructField("source_version", T.StringType()), T.StructField("request_started", T.LongType()), T.StructField("received", T.LongType()), T.StructField("http_status", T.IntegerType()),
        T.StructField("parameters", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("capture_form", T.StringType()),
    ]
)
CORRUPT = "corrupt_record"
_LINE = T.StructType([*LANDED.fields, T.StructField(CORRUPT, T.StringType())])
_DAY = 86_400_000_000
#: Days of receipt in a folder of the ledger, counted from the epoch; part of the layout, so a ledger is read with the number it was written with.
FOLDER_DAYS = 128
#: A folder is dealt over one task for each so many bytes of payload, and one more.
PIECE = 128 << 20
_FOLDER = f"date_from_unix_date(unix_date({{0}}) - pmod(unix_date({{0}}), {FOLDER_DAYS}))"
NEEDED = ("capture_id", "attempt_id", "run_id", "source", "source_version", "request_started", "received", "http_status", "payload", "capture_form")


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """The landed lines by the schema LANDED, and what couldn't be read of a line in corrupt_record; nothing is inferred."""
    return spark.read.schema(_LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_landing(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """read_landing as a stream of the folder's files."""
    reader = spark.readStream.schema(_LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def landing_faults(landed: DataFrame) -> DataFrame:
    """landed with code: corrupt_record, missing_<field> for the first needed field that is null, received_before_request, or null."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in NEEDED]
    early = F.when(F.col("received") < F.col("request_started"), "received_before_request")
    return landed.withColumn("code", F.coalesce(F.when(F.col(CORRUPT).isNotNull(), "corrupt_record"), *missing, early))


def as_captures(landed: DataFrame) -> DataFrame:
    """Valid landed rows as captures: their own columns, the payload's checksum and size, how long the request took, and the day of receipt."""
    good = landing_faults(landed).where("code is null").drop("code", CORRUPT)
    return good.select(
        "*", F.sha2(F.col("payload").cast("binary"), 256).alias("checksum"), F.octet_length("payload").cast("bigint").alias("n_bytes"), (F.col("received") - F.col("request_started")).alias("took"),
        F.expr(f"date_add(DATE'1970-01-01', cast(floor(received / {_DAY}) AS int))").alias("received_day"),
    )


def _folders(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with received_days, the first day of a row's folder. What that is of received_day is a filter, by which one day's filter becomes its folder's."""
    return spark.read.parquet(path).where(F.col("received_days") == F.expr(_FOLDER.format("received_day")))


def read_ledger(spark: SparkSession, path: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """The ledger's captures, those received from the day `since` to the day `until`, where given.

    Filters on source, batch and one received_day prune its folders, and so do since and until; another filter on received_day skips row groups only.
    """
    rows = _folders(spark, path)
    if since is not None:
        rows = rows.where((F.col("received_day") >= F.lit(since)) & (F.col("received_days") > F.date_sub(F.lit(since), FOLDER_DAYS)))
    if until is not None:
        rows = rows.where((F.col("received_day") <= F.lit(until)) & (F.col("received_days") <= F.lit(until)))
    return rows.drop("received_days")


def ingest_captures(landed: DataFrame, path: str, batch: str) -> DataFrame:
    """Appends the valid landed rows to the ledger at path, each capture_id once, and returns the batch's rows as they stand there.

    Of several rows of one capture_id in a batch the one received first stays (ties: the smaller checksum). A capture that
    another batch brought on a day and from a source of this one isn't taken again: only the ids of those folders are read.
    """
    spark = landed.sparkSession
    valid = as_captures(landed).withColumn("received_days", F.expr(_FOLDER.format("received_day")))
    order = lambda r: F.struct(*(f"{r}{c}" for c in ("received", "checksum", *(c for c in valid.columns if c not in ("received", "checksum", "capture_id", "payload", "parameters", "received_days")))))
    folder = ["received_days", "source"]
    parts = valid.groupBy(*folder).agg((F.expr(f"sum(n_bytes) div {PIECE}") + 1).alias("pieces"))  # a row for each folder, never more than days and sources
    kept = valid.groupBy("capture_id").agg(F.min_by(F.struct(*folder, "received_day"), order("")).alias("r")).select("capture_id", "r.*")
    try:
        known = _folders(spark, path).where(F.col("batch") != batch).select("capture_id", "received_day", *folder)
    except Exception as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    if known is not None:
        known = known.join(F.broadcast(parts), folder, "left_semi").drop("received_days")
        kept = kept.join(known, ["capture_id", "source", "received_day"], "left_anti")
    # What stays is told without payloads, which are shuffled once, to their folders; there a capture's rows meet the mark that it stays.
    marked = valid.select(*folder, "capture_id", F.struct(*valid.columns).alias("r")).unionByName(kept.select(*folder, "capture_id", F.lit(True).alias("kept")), allowMissingColumns=True)
    marked = marked.join(F.broadcast(parts), folder, "left").withColumn("piece", F.pmod(F.xxhash64("capture_id"), F.coalesce("pieces", F.lit(1)))).repartition(*folder, "piece")
    first = F.min_by("r", F.when(F.col("r").isNotNull(), order("r.")))
    out = marked.groupBy(*folder, "piece", "capture_id").agg(first.alias("r"), F.bool_or("kept").alias("kept")).where("kept").select("r.*").withColumn("batch", F.lit(batch))
    out = out.sortWithinPartitions("received_days", "source", "batch", "received_day", "capture_id")  # so that row groups hold few days
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("received_days", "source", "batch").option("maxRecordsPerFile", 1_000_000).option("compression", "zstd").parquet(path)
    return read_ledger(spark, path).where(F.col("batch") == batch)
