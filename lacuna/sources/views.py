"""Canonical views over the driver's tables: a ledger of observations in the shape that the operators take.

Times are microseconds since the epoch, so that both engines agree to the last digit.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed instants of the sample data (UTC): when "now" is, and the history window.
AS_OF = 1_706_659_200_000_000
START, END = 1_705_276_800_000_000, 1_706_486_400_000_000
DAY = 86_400_000_000
HOUR = 3_600_000_000
#: A sample holds for two intervals at most, and no interval is over a day.
REACH = 2 * DAY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.selectExpr("event_id", "user_id + 1 AS app_id", "unix_micros(cast(ts AS timestamp)) AS t", "event_type", "value", "cast(get_json_object(props, '$.k') AS bigint) AS k")


def player_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')").selectExpr("event_id AS capture_id", "app_id", "t", "cast(round(value * 100) AS bigint) AS player_count")


def tracking_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup'").selectExpr("event_id AS id", "app_id", "t AS started", "3600 * (1 + k % 24) AS interval_seconds")


def request_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = "CASE WHEN event_type IN ('view', 'click', 'error') THEN 'webapi' ELSE 'store' END AS host_group"
    return events(spark, sf_dir).selectExpr("event_id AS attempt_id", "app_id", "event_type AS source", host, "t AS dispatched", "app_id * 100 + (t - 1704067200000000) div 86400000000 AS run_id")


def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status"
    code = "CASE WHEN event_type <> 'error' THEN 200 WHEN k % 2 = 0 THEN 429 ELSE 503 END AS http_status"
    return events(spark, sf_dir).where("event_id % 10 <> 0").selectExpr("event_id AS attempt_id", "t + 1000000 AS completed", failed, code, "CASE WHEN event_type = 'error' THEN k END AS retry_after")


def source_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'error' AND k % 5 = 0").selectExpr("event_id AS cooldown_id", "'webapi' AS host_group", "t AS recorded", "t + k * 60000000 AS expires")


def collection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_attempts(spark, sf_dir).groupBy("run_id", "app_id").agg(F.min("dispatched").alias("started"), F.max("dispatched").alias("last"))


def run_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = "CASE run_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'partial' ELSE 'failed' END AS status"
    return collection_runs(spark, sf_dir).where("run_id % 7 <> 0").selectExpr("run_id", "app_id", "last + 2000000 AS finished", state)


def chart_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    shown = li.groupBy(F.col("l_returnflag").alias("source"), F.expr("cast(date_format(l_shipdate, 'yyyyMM') AS bigint) AS month"), (F.col("l_partkey") + 1).alias("app_id"))
    shown = shown.agg(F.sum(F.col("l_quantity").cast("bigint")).alias("players"))
    ranked = shown.withColumn("rank", F.expr("row_number() OVER (PARTITION BY source, month ORDER BY players DESC, app_id)"))
    return ranked.where("rank <= 100").select("source", "month", "app_id", "players", F.col("rank").cast("bigint").alias("rank"))


def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    first = part.selectExpr("p_partkey + 1 AS app_id", "788918400000000 AS t", "'catalog' AS source", "p_name AS name")
    later = read(spark, sf_dir, "lineitem").join(part, F.expr("l_partkey = p_partkey"))
    return first.unionByName(later.selectExpr("l_partkey + 1 AS app_id", "unix_micros(cast(l_shipdate AS timestamp)) AS t", "l_returnflag AS source", "concat(p_name, ' ', cast(l_linenumber AS string)) AS name"))


def review_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return both.groupBy("lang", "source").agg(F.sum(F.col("quality").cast("bigint")).alias("positive"), F.count(F.lit(1)).alias("total"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey + 1 AS app_id", "l_returnflag AS currency", "unix_micros(cast(l_shipdate AS timestamp)) AS t", "l_orderkey * 10 + l_linenumber AS id",
        "cast(round(l_extendedprice * 100) AS bigint) AS initial", "cast(round(l_discount * 100) AS bigint) AS discount",
    )
    shown = F.expr("id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0")
    li = li.withColumn("country", F.expr("CASE id % 2 WHEN 0 THEN 'us' ELSE 'de' END")).withColumn("is_free", F.expr("CASE WHEN id % 17 <> 0 THEN id % 11 = 0 END"))
    return li.withColumn("final", F.when(shown, F.expr("initial * (100 - discount) div 100"))).withColumn("initial", F.when(shown, F.col("initial")))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    damaged = F.when(F.col("doc_id") % 97 == 0, F.lit("x")).otherwise(F.lit(""))
    return d.select(F.col("doc_id").alias("capture_id"), F.col("source"), F.col("text").cast("binary").alias("payload"), F.concat(damaged, F.sha2(F.col("text").cast("binary"), 256)).alias("checksum"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "cast(player_count AS string)"
    bad = {1: f"concat('\"', {n}, '\"')", 2: "'true'", 3: f"concat({n}, '.5')", 4: f"concat('-', {n})"}
    count = "CASE capture_id % 11 " + " ".join(f"WHEN {k} THEN {v}" for k, v in bad.items()) + f" ELSE {n} END"
    body = f"concat('{{\"response\":{{\"result\":', CASE WHEN capture_id % 11 = 5 THEN '2' ELSE '1' END, ',\"player_count\":', {count}, CASE WHEN capture_id % 11 = 6 THEN '' ELSE '}}}}' END)"
    return player_samples(spark, sf_dir).selectExpr("capture_id", "app_id", "t", f"{body} AS payload")



#: The same views for DuckDB, as common table expressions.
SQL = """
WITH ev AS (SELECT event_id, user_id + 1 AS app_id, epoch_us(ts) AS t, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
player_sample AS (SELECT event_id AS capture_id, app_id, t, CAST(round(value * 100) AS BIGINT) AS player_count FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
tracking_interval AS (SELECT event_id AS id, app_id, t AS started, 3600 * (1 + k % 24) AS interval_seconds FROM ev WHERE event_type = 'signup'),
request_attempt AS (SELECT event_id AS attempt_id, app_id, event_type AS source, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'webapi' ELSE 'store' END AS host_group, t AS dispatched,
  app_id * 100 + (t - 1704067200000000) // 86400000000 AS run_id FROM ev),
request_result AS (SELECT event_id AS attempt_id, t + 1000000 AS completed, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN event_type <> 'error' THEN 200 WHEN k % 2 = 0 THEN 429 ELSE 503 END AS http_status, CASE WHEN event_type = 'error' THEN k END AS retry_after FROM ev WHERE event_id % 10 <> 0),
source_cooldown AS (SELECT event_id AS cooldown_id, 'webapi' AS host_group, t AS recorded, t + k * 60000000 AS expires FROM ev WHERE event_type = 'error' AND k % 5 = 0),
collection_run AS (SELECT run_id, app_id, min(dispatched) AS started, max(dispatched) AS last FROM request_attempt GROUP BY ALL),
run_completion AS (SELECT run_id, app_id, last + 2000000 AS finished, CASE run_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'partial' ELSE 'failed' END AS status FROM collection_run WHERE run_id % 7 <> 0),
chart_all AS (SELECT l_returnflag AS source, CAST(strftime(l_shipdate, '%Y%m') AS BIGINT) AS month, l_partkey + 1 AS app_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS players FROM lineitem GROUP BY ALL),
chart_item AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, month ORDER BY players DESC, app_id) AS rank FROM chart_all) WHERE rank <= 100),
name_history AS (SELECT p_partkey + 1 AS app_id, 788918400000000 AS t, 'catalog' AS source, p_name AS name FROM part
  UNION ALL SELECT l_partkey + 1, epoch_us(l_shipdate), l_returnflag, p_name || ' ' || l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
review_summary AS (SELECT lang, source, CAST(sum(quality) AS BIGINT) AS positive, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
price AS (SELECT * REPLACE (CASE WHEN shown THEN initial END AS initial), CASE WHEN shown THEN initial * (100 - discount) // 100 END AS final, CASE id % 2 WHEN 0 THEN 'us' ELSE 'de' END AS country, CASE WHEN id % 17 <> 0 THEN id % 11 = 0 END AS is_free
  FROM (SELECT id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AS shown, * FROM (SELECT l_partkey + 1 AS app_id, l_returnflag AS currency, epoch_us(l_shipdate) AS t, l_orderkey * 10 + l_linenumber AS id,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS initial, CAST(round(l_discount * 100) AS BIGINT) AS discount FROM lineitem))),
capture AS (SELECT doc_id AS capture_id, source, text AS payload, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE '' END || sha256(text) AS checksum FROM documents),
raw_response AS (SELECT capture_id, app_id, t, '{"response":{"result":' || CASE WHEN capture_id % 11 = 5 THEN '2' ELSE '1' END || ',"player_count":' ||
  CASE capture_id % 11 WHEN 1 THEN '"' || player_count || '"' WHEN 2 THEN 'true' WHEN 3 THEN player_count || '.5' WHEN 4 THEN '-' || player_count ELSE player_count::VARCHAR END ||
  CASE WHEN capture_id % 11 = 6 THEN '' ELSE '}}' END AS payload FROM player_sample)
"""
