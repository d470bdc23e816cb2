"""Queries of landing, snapshots, replay and parity over the captures of all sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import constraints as Q
from lacuna.operators import documents as D
from lacuna.operators import history as H
from lacuna.operators import ledger as L
from lacuna.operators import profiles as R
from lacuna.operators import readmodel as M
from lacuna.operators import snapshots as N
from lacuna.operators import state as C
from lacuna.plans.documents import _CATALOG, catalog_captures, chart_pages, details_captures, news_captures, review_captures, search_pages, store_captures
from lacuna.plans.registry import _APPS, _COVERAGE, _OUTCOME, _SUMMARY, apps, history_inputs, query, summary
from lacuna.sources import landing, views as V
from lacuna.streaming.ledger import shared_folder

DAY = V.DAY


# Landing.


def landing_folder(spark: SparkSession, d: str) -> str:
    """Lines of JSON, one for each document; some are cut off, some lack a field, some end before they began, and some come twice."""
    path = shared_folder(spark, "landing")
    docs = V.read(spark, d, "documents").selectExpr(
        "cast(doc_id AS string) AS capture_id", "doc_id AS attempt_id", "doc_id div 10 AS run_id", "CASE WHEN doc_id % 5 > 0 THEN doc_id + 1 END AS app_id", "CASE WHEN doc_id % 29 <> 3 THEN source END AS source", "'1' AS source_version",
        f"doc_id * {DAY // 50} AS request_started", f"doc_id * {DAY // 50} + CASE WHEN doc_id % 31 = 5 THEN -1 ELSE doc_id % 1000 END AS received", "200 AS http_status", "to_json(named_struct('appid', doc_id + 1)) AS parameters", "coalesce(text, '') AS payload", "'raw_response' AS capture_form", "doc_id",
    )
    line = "CASE WHEN doc_id % 37 = 7 THEN left(j, 40) ELSE j END"
    lines = docs.withColumn("j", F.to_json(F.struct(*[c for c in docs.columns if c != "doc_id"]))).selectExpr("doc_id", f"{line} AS value")
    lines.unionByName(lines.where("doc_id % 10 = 0")).select("value").write.text(path, compression="gzip")
    return path


_LANDED = f""", landed AS (SELECT doc_id, doc_id::VARCHAR AS capture_id, source, doc_id * {DAY // 50} AS started, doc_id % 1000 AS took, coalesce(text, '') AS payload FROM documents WHERE doc_id % 37 <> 7 AND doc_id % 29 <> 3 AND doc_id % 31 <> 5)"""


@query("a01_ingest_landed", _LANDED + f""" SELECT capture_id, doc_id AS attempt_id, doc_id // 10 AS run_id, CASE WHEN doc_id % 5 > 0 THEN doc_id + 1 END AS app_id, source, started + took AS received, took, 200 AS http_status, octet_length(encode(payload)) AS n_bytes,
  sha256(payload) AS checksum, strftime(make_timestamp((started + took) // {DAY} * {DAY}), '%Y-%m-%d') AS received_day, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS batch FROM landed""")
def _(spark, d):
    """Two batches, the second of which repeats some of the first, and the first taken in again."""
    landed, path = landing.read_landing(spark, landing_folder(spark, d)), shared_folder(spark, "ledger")
    third = F.col("attempt_id") % 3 == 0
    for batch, rows in (("first", landed.where(F.coalesce(~third, F.lit(True)))), ("second", landed.where(third | (F.col("attempt_id") % 7 == 0))), ("first", landed.where(F.coalesce(~third, F.lit(True))))):
        landing.ingest_captures(rows, path, batch)
    got = landing.read_ledger(spark, path)
    return got.select("capture_id", "attempt_id", "run_id", "app_id", "source", "received", "took", "http_status", "n_bytes", "checksum", F.col("received_day").cast("string").alias("received_day"), "batch")


@query("a01_landing_faults", """ SELECT code, count(*) AS n FROM (SELECT CASE WHEN doc_id % 37 = 7 THEN 'corrupt_record' WHEN doc_id % 29 = 3 THEN 'missing_source' WHEN doc_id % 31 = 5 THEN 'received_before_request' END AS code FROM
  (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 0)) WHERE code IS NOT NULL GROUP BY code""")
def _(spark, d):
    return landing.landing_faults(landing.read_landing(spark, landing_folder(spark, d))).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# Snapshots and replay.


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Captures of all sources, written by source and read again; by the number in capture_id, some have another version or a wrong checksum."""
    month = "month * 86400000000 AS t"
    pages = lambda made, source, app="cast(null AS bigint)": made.selectExpr(f"concat('{source}:', source, month) AS capture_id", f"'{source}' AS source", f"{app} AS app_id", month, "html AS payload", "month AS k")
    own = lambda made, source, app="cast(null AS bigint)": made.selectExpr(f"concat('{source}:', capture_id) AS capture_id", f"'{source}' AS source", f"{app} AS app_id", "t", "payload", "capture_id AS k")
    parts = [
        own(V.raw_responses(spark, d), "players", "app_id"), own(store_captures(spark, d), "store_name", "app_id"), pages(chart_pages(spark, d), "chart_played"), pages(search_pages(spark, d), "search"),
        own(catalog_captures(spark, d), "catalog"), own(details_captures(spark, d), "details"), own(review_captures(spark, d), "reviews"), own(news_captures(spark, d), "news"),
        own(V.raw_responses(spark, d).selectExpr("capture_id", "t", "to_json(named_struct('app_id', app_id, 'body', payload)) AS payload"), "current"),
        own(V.read(spark, d, "nation").selectExpr("n_nationkey AS capture_id", "n_nationkey AS t", "n_name AS payload"), "elsewhere"),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("source_version", F.expr("CASE WHEN k % 41 = 9 THEN '0' ELSE '1' END")).withColumn("checksum", F.expr("concat(sha2(cast(payload AS binary), 256), CASE WHEN k % 43 = 11 THEN 'x' ELSE '' END)"))
    path = shared_folder(spark, "captures")
    rows.write.partitionBy("source").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def derived(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's derivation, stored."""
    got, path = N.derive(ledger(spark, d)), shared_folder(spark, "derived")
    got.write.partitionBy("source").parquet(path)
    return spark.read.schema(got.schema).parquet(path)


_BROKEN = "CASE WHEN k % 43 = 11 THEN 'capture_checksum_mismatch' WHEN k % 41 = 9 THEN 'unknown_parser_version'"
_CHARTED = ", charted AS (SELECT source || month AS id, month, source, string_agg('{\"app_id\":' || app_id || ',\"name\":\"Game & ' || app_id || '\",\"peak_today\":' || (players + 1) || ',\"players\":' || players || ',\"rank\":' || rank || '}', ',' ORDER BY rank) FILTER (WHERE app_id % 9 <> 0) AS items, string_agg('{\"app_id\":' || app_id || ',\"name\":\"Game ' || app_id || '\"}', ',' ORDER BY rank) FILTER (WHERE app_id % 9 <> 0) AS found FROM chart_item GROUP BY source, month)"
_EXPECTED = _CATALOG + _CHARTED + f""", listed AS (SELECT page.*, items FROM page JOIN (SELECT capture_id, string_agg('{{"app_id":' || app_id || ',"name":"' || name || '"}}', ',' ORDER BY app_id) AS items FROM page_item GROUP BY capture_id) USING (capture_id)),
counted AS (SELECT capture_id AS k, app_id, t, player_count, CASE capture_id % 11 WHEN 1 THEN 'invalid_player_count' WHEN 2 THEN 'invalid_player_count' WHEN 3 THEN 'invalid_player_count' WHEN 4 THEN CASE WHEN player_count > 0 THEN 'invalid_player_count' END WHEN 5 THEN 'provider_result' WHEN 6 THEN 'invalid_json' END AS fault FROM player_sample),
reviewed AS (SELECT doc_id AS k, doc_id % 91 AS p, n_chars % 53 AS n, source, CASE WHEN doc_id % 7 = 1 OR doc_id % 11 = 1 OR doc_id % 13 = 1 THEN 'invalid_schema' WHEN doc_id % 17 = 1 THEN 'invalid_json' END AS fault FROM documents),
made AS (
  SELECT 'players:' || k AS capture_id, 'players' AS source, k, app_id, t, fault, '{{"player_count":' || player_count || '}}' AS value FROM counted
  UNION ALL SELECT 'current:' || k, 'current', k, NULL, t, fault, '{{"app_id":' || app_id || ',"player_count":' || player_count || '}}' FROM counted
  UNION ALL SELECT 'store_name:' || p_partkey, 'store_name', p_partkey, p_partkey + 1, p_partkey * 1000000, CASE p_partkey % 8 WHEN 1 THEN 'invalid_store_identity' WHEN 2 THEN 'invalid_store_name' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'invalid_store_name' END, '{{"name":"' || p_name || '"}}' FROM part
  UNION ALL SELECT 'chart_played:' || id, 'chart_played', month, NULL, month * 86400000000, CASE WHEN items IS NULL THEN 'invalid_schema' END, '{{"items":[' || items || ']}}' FROM charted
  UNION ALL SELECT 'search:' || id, 'search', month, NULL, month * 86400000000, CASE WHEN month % 5 = 0 THEN 'invalid_schema' END, '{{"items":[' || coalesce(found, '') || ']}}' FROM charted
  UNION ALL SELECT 'catalog:' || capture_id, 'catalog', capture_id, NULL, capture_id * 1000000, code, '{{"have_more_results":' || have_more || ',"items":[' || items || '],"last_appid":' || last_appid || '}}' FROM listed
  UNION ALL SELECT 'reviews:' || k, 'reviews', k, NULL, k, fault, '{{"app_id":' || (k + 1) || ',"description":"' || source || ' & more",' || CASE WHEN p + n > 0 THEN '"hundredths":' || (20000 * p + p + n) // (2 * (p + n)) ELSE '"hundredths":null' END || ',"total_negative":' || n || ',"total_positive":' || p || ',"total_reviews":' || (p + n) || '}}' FROM reviewed
  UNION ALL SELECT 'elsewhere:' || n_nationkey, 'elsewhere', n_nationkey, NULL, n_nationkey, 'unknown_parser_version', NULL FROM nation),
snap AS (SELECT capture_id, source, k, app_id, t, CASE WHEN k % 41 = 9 OR source = 'elsewhere' AND k % 41 = 9 THEN '0' ELSE '1' END AS parser_version, {_BROKEN} ELSE fault END AS code, value FROM made)"""


@query("c03_snapshot_values", _EXPECTED + " SELECT capture_id, source, app_id, t, parser_version, code, CASE WHEN code IS NULL THEN value END AS value FROM snap")
def _(spark, d):
    got = derived(spark, d).where("source not in ('details', 'news')")
    return got.select("capture_id", "source", "app_id", "t", "parser_version", "code", F.to_json("value").alias("value"))


@query("h01_rebuild_snapshots", _EXPECTED + " SELECT capture_id, source, app_id, t, parser_version FROM snap WHERE code IS NULL AND k % 13 = 0")
def _(spark, d):
    found = derived(spark, d).where("source not in ('details', 'news')")
    return N.project(found, found.where("code is null AND pmod(cast(regexp_extract(capture_id, '[0-9]+$', 0) AS bigint), 13) <> 0")).drop("value")


@query("h02_verify_snapshots", _EXPECTED + """ SELECT capture_id, CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 17 = 0 THEN 'different_time' WHEN k % 19 = 0 THEN 'different_version' ELSE 'different_value' END AS fault
FROM snap WHERE code IS NULL AND (k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0) UNION ALL SELECT 'none:' || p_partkey, 'extra' FROM part""")
def _(spark, d):
    found = derived(spark, d).where("source not in ('details', 'news')")
    k = "cast(regexp_extract(capture_id, '[0-9]+$', 0) AS bigint)"
    kept = found.where(f"code is null AND {k} % 13 <> 0").drop("code").withColumns({
        "t": F.expr(f"t + CASE WHEN {k} % 17 = 0 THEN 1 ELSE 0 END"), "parser_version": F.expr(f"CASE WHEN {k} % 19 = 0 THEN 'x' ELSE parser_version END"),
        "value": F.expr(f"CASE WHEN {k} % 23 = 0 THEN parse_json('{{}}') ELSE value END"),
    })
    more = V.read(spark, d, "part").selectExpr("concat('none:', p_partkey) AS capture_id", "'none' AS source", "cast(null AS bigint) AS app_id", "0L AS t", "'1' AS parser_version", "cast(null AS variant) AS value")
    return N.verify(kept.unionByName(more), found)


@query("h03_snapshot_parity", _EXPECTED + """, news_made AS (SELECT 'news' AS source, doc_id AS k, CASE WHEN doc_id % 11 = 3 THEN 'x' END AS fault FROM documents),
details_made AS (SELECT 'details' AS source, p_partkey + 1 AS k, CASE WHEN (p_partkey + 1) % 11 = 0 OR (p_partkey + 1) % 13 = 0 THEN 'x' END AS fault FROM part),
every AS (SELECT source, k, code FROM snap UNION ALL SELECT source, k, CASE WHEN k % 43 = 11 OR k % 41 = 9 THEN 'x' ELSE fault END FROM (SELECT * FROM news_made UNION ALL SELECT * FROM details_made))
SELECT source, count(*) AS captures, count(code) AS rejected, count(*) FILTER (WHERE code IS NULL AND NOT (source = 'reviews' AND k % 2 = 0)) AS projected, count(*) FILTER (WHERE code IS NULL AND source = 'reviews' AND k % 2 = 0) = 0 AS equal FROM every GROUP BY source""")
def _(spark, d):
    found = derived(spark, d)
    kept = found.where("code is null AND NOT (source = 'reviews' AND pmod(cast(regexp_extract(capture_id, '[0-9]+$', 0) AS bigint), 2) = 0)")
    return N.parity(found, kept)


# Constraints over the ledger's tables.


def odd_ledger(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The ledger's tables with ids out of range, unknown states, lost references, missing fields, and keys that come twice."""
    apps = V.events(spark, d).select("app_id").distinct().selectExpr("CASE WHEN app_id % 31 = 0 THEN -app_id ELSE app_id END AS app_id")
    intervals = V.tracking_intervals(spark, d).selectExpr("id", "app_id", "CASE WHEN id % 17 <> 2 THEN started END AS started", "CASE id % 13 WHEN 0 THEN 299 WHEN 1 THEN 604801 ELSE interval_seconds END AS interval_seconds")
    runs = V.collection_runs(spark, d).where("run_id % 19 <> 4").select("run_id", "started")
    done = V.run_completions(spark, d).selectExpr("run_id", "finished", "CASE WHEN run_id % 11 = 3 THEN 'odd' ELSE status END AS status")
    tries = V.request_attempts(spark, d).selectExpr("CASE WHEN attempt_id % 23 = 5 THEN attempt_id - 1 ELSE attempt_id END AS attempt_id", "run_id", "app_id", "source", "CASE WHEN attempt_id % 29 = 7 THEN 'mail' ELSE host_group END AS host_group", "dispatched")
    results = V.request_results(spark, d).select("attempt_id", "completed", "status", "http_status")
    return {"app": apps, "tracking_interval": intervals, "collection_run": runs, "run_completion": done, "request_attempt": tries, "request_result": results.unionByName(results.where("attempt_id % 50 = 1"))}


@query("a05_ledger_constraints", """, oapp AS (SELECT DISTINCT CASE WHEN app_id % 31 = 0 THEN -app_id ELSE app_id END AS app_id FROM ev),
orun AS (SELECT run_id, started FROM collection_run WHERE run_id % 19 <> 4),
otry AS (SELECT CASE WHEN attempt_id % 23 = 5 THEN attempt_id - 1 ELSE attempt_id END AS attempt_id, run_id, app_id, source, CASE WHEN attempt_id % 29 = 7 THEN 'mail' ELSE host_group END AS host_group, dispatched FROM request_attempt),
ores AS (SELECT attempt_id, completed, status, http_status FROM request_result UNION ALL SELECT attempt_id, completed, status, http_status FROM request_result WHERE attempt_id % 50 = 1),
r1 AS (SELECT 'app' AS tbl, app_id AS id, CASE WHEN app_id < 1 THEN 'app_id_range' ELSE '' END AS why FROM oapp),
r2 AS (SELECT 'tracking_interval', id, concat_ws(',', CASE WHEN id % 17 = 2 THEN 'null_started' END, CASE WHEN id % 13 < 2 THEN 'interval_range' END, CASE WHEN app_id % 31 = 0 THEN 'unreferenced_app_id' END) FROM tracking_interval),
r3 AS (SELECT 'collection_run', run_id, '' FROM orun),
r4 AS (SELECT 'run_completion', run_id, concat_ws(',', CASE WHEN run_id % 11 = 3 THEN 'unknown_status' END, CASE WHEN run_id % 19 = 4 THEN 'unreferenced_run_id' END) FROM run_completion),
t5 AS (SELECT *, concat_ws(',', CASE WHEN host_group = 'mail' THEN 'unknown_host_group' END, CASE WHEN run_id % 19 = 4 THEN 'unreferenced_run_id' END, CASE WHEN app_id % 31 = 0 THEN 'unreferenced_app_id' END) AS why0 FROM otry),
t6 AS (SELECT *, CASE WHEN why0 = '' AND row_number() OVER (PARTITION BY attempt_id, why0 = '' ORDER BY dispatched) > 1 THEN 'repeated_attempt_id' ELSE why0 END AS why FROM t5),
t7 AS (SELECT o.*, CASE WHEN g.attempt_id IS NULL THEN 'unreferenced_attempt_id' ELSE '' END AS why0 FROM ores o LEFT JOIN (SELECT DISTINCT attempt_id FROM t6 WHERE why = '') g USING (attempt_id)),
t8 AS (SELECT *, CASE WHEN why0 = '' AND row_number() OVER (PARTITION BY attempt_id, why0 = '' ORDER BY completed) > 1 THEN 'repeated_attempt_id' ELSE why0 END AS why FROM t7)
SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT 'request_attempt', attempt_id, why FROM t6 UNION ALL SELECT 'request_result', attempt_id, why FROM t8""")
def _(spark, d):
    """Good rows (no reason) and rejected ones of all tables."""
    found = []
    for name, (good, rejected) in Q.enforce_schema(odd_ledger(spark, d), shared_folder(spark, "judged")).items():
        key = F.col(Q.LEDGER_RULES[name].unique[0][0]).alias("id")
        found += [good.select(F.lit(name).alias("tbl"), key, F.lit("").alias("why")), rejected.select(F.lit(name).alias("tbl"), key, F.array_join("reasons", ",").alias("why"))]
    return reduce(DataFrame.unionByName, found)


# The read model.

_STATUS = """, tried AS (SELECT source, dispatched, coalesce(status, 'uncertain') AS status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dispatched DESC, attempt_id DESC) AS rn FROM request_attempt) LEFT JOIN request_result USING (attempt_id) WHERE rn = 1),
ended AS (SELECT source, finished, ok FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY finished DESC, run_id DESC) AS rn FROM outcome JOIN (SELECT run_id, finished FROM run_completion) USING (run_id)) WHERE rn = 1),
status AS (SELECT source, CASE WHEN NOT ok AND finished >= dispatched THEN 'failed' ELSE status END AS status FROM tried LEFT JOIN ended USING (source)),
newest AS (SELECT * FROM chart_item WHERE month = (SELECT max(month) FROM chart_item c WHERE c.source = chart_item.source))"""


@query("a04_read_model_documents", _COVERAGE + _SUMMARY[len(_APPS):] + _OUTCOME + _STATUS + """ SELECT 'app' AS kind, app_id::VARCHAR AS key, name || ':' || availability AS name, samples AS n, player_count AS total, coalesce(interval_seconds, -1)::BIGINT AS third FROM summary
UNION ALL SELECT 'history', app_id::VARCHAR, 'capped-step-v1', CASE WHEN points > 18 THEN -1 ELSE points END, covered, CASE WHEN points > 18 THEN -1 ELSE (SELECT count(*) FROM gap WHERE gap.app_id = coverage.app_id) END FROM coverage
UNION ALL SELECT 'dashboard', 'dashboard', (SELECT string_agg(source || '=' || status, ',' ORDER BY source) FROM status), (SELECT count(DISTINCT app_id) FROM (SELECT app_id FROM name_history UNION SELECT app_id FROM tracking_interval)),
  (SELECT count(DISTINCT app_id) FROM tracking_interval), (SELECT sum(rank * players)::BIGINT FROM newest)""")
def _(spark, d):
    """Two versions are written, the second whole, a third without its commits; what is read is the second."""
    history = H.history(*history_inputs(spark, d), apps(spark, d), V.START, V.END, max_points=18, reach=V.REACH)
    attempts, results = V.request_attempts(spark, d), V.request_results(spark, d)
    runs = L.final_outcome(attempts, results).join(V.run_completions(spark, d).select("run_id", "finished"), "run_id")
    charts = C.chart_view(V.chart_items(spark, d), D.chart_artwork(chart_pages(spark, d)), V.AS_OF)
    known = V.name_history(spark, d).select("app_id").union(V.tracking_intervals(spark, d).select("app_id"))
    board = M.dashboard_document(known, V.tracking_intervals(spark, d), R.source_status(attempts, results, runs), charts)
    own, path = M.app_documents(summary(spark, d)), shared_folder(spark, "read-model")
    M.write_read_model(own, path, 1)
    M.write_read_model(own.unionByName(M.history_documents(history, V.START, V.END)).unionByName(board), path, 2)
    own.limit(1).write.partitionBy("kind").json(f"{path}/documents/version=3")
    shape = (
        "app_id bigint, name string, availability string, sample_count bigint, latest struct<player_count:bigint>, tracking struct<interval_seconds:bigint>, estimator_version string, points array<struct<observed_at_micros:bigint>>, "
        "coverage struct<covered:bigint>, gaps array<struct<gap_from:bigint>>, catalog_apps bigint, tracked_apps bigint, sources array<struct<source:string,status:string>>, charts array<struct<items:array<struct<rank:bigint,players:bigint>>>>"
    )
    got = M.read_read_model(spark, path).withColumn("j", F.from_json("document", shape))
    return got.selectExpr(
        "kind", "key", "CASE kind WHEN 'app' THEN concat(j.name, ':', j.availability) WHEN 'history' THEN j.estimator_version ELSE array_join(transform(j.sources, s -> concat(s.source, '=', s.status)), ',') END AS name",
        "CASE kind WHEN 'app' THEN j.sample_count WHEN 'history' THEN coalesce(size(j.points), -1) ELSE j.catalog_apps END AS n", "CASE kind WHEN 'app' THEN j.latest.player_count WHEN 'history' THEN j.coverage.covered ELSE j.tracked_apps END AS total",
        "CASE kind WHEN 'app' THEN coalesce(j.tracking.interval_seconds, -1) WHEN 'history' THEN coalesce(size(j.gaps), -1) ELSE aggregate(flatten(j.charts.items), 0L, (s, i) -> s + i.rank * i.players) END AS third",
    )


# Whole profiles.


@query("c15_whole_profile", _EXPECTED + """, ln AS (SELECT app_id, name FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY t DESC, source, name) AS rn FROM name_history) WHERE rn = 1),
cur AS (SELECT c.app_id, max(c.t) AS at, arg_max(c.player_count, c.t) AS n, count(*) AS seen FROM counted c JOIN snap s ON s.source = 'current' AND s.k = c.k WHERE s.code IS NULL GROUP BY c.app_id),
own AS (SELECT app_id, max(t) AS at, arg_max(player_count, t) AS n, count(*) AS samples FROM player_sample GROUP BY app_id),
rev AS (SELECT r.k + 1 AS app_id, r.p, r.p + r.n AS total FROM reviewed r JOIN snap s ON s.source = 'reviews' AND s.k = r.k WHERE s.code IS NULL),
det AS (SELECT p_partkey + 1 AS app_id, p_name || ':' || p_type AS metadata FROM part WHERE (p_partkey + 1) % 11 <> 0 AND (p_partkey + 1) % 13 <> 0 AND (p_partkey + 1) % 43 <> 11 AND (p_partkey + 1) % 41 <> 9),
art AS (SELECT doc_id + 1 AS app_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS gid, 1 AS has FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 43 <> 11 AND doc_id % 41 <> 9),
pr AS (SELECT app_id, min(final) AS lowest_price, count(final) AS prices FROM price GROUP BY app_id)
SELECT app_id, ln.name, metadata, rev.p AS positive, rev.total, art.gid AS news, CASE WHEN cur.at IS NULL OR own.at > cur.at THEN NULL ELSE cur.n END AS current, CASE WHEN cur.at IS NULL OR own.at > cur.at THEN own.n ELSE cur.n END AS player_count,
  coalesce(samples, 0) AS samples, lowest_price, coalesce(prices, 0) AS prices,
  least(20, coalesce(cur.seen, 0) + (metadata IS NOT NULL)::INT + (rev.p IS NOT NULL)::INT + coalesce(art.has, 0))::BIGINT AS updates
FROM ln LEFT JOIN det USING (app_id) LEFT JOIN rev USING (app_id) LEFT JOIN art USING (app_id) LEFT JOIN cur USING (app_id) LEFT JOIN own USING (app_id) LEFT JOIN pr USING (app_id)""")
def _(spark, d):
    got = R.game_profiles(C.latest_names(V.name_history(spark, d)), derived(spark, d).where("code is null"), V.player_samples(spark, d), V.chart_items(spark, d), V.prices(spark, d))
    read = lambda c, path, kind: f"try_variant_get({c}, '{path}', '{kind}')"
    return got.selectExpr(
        "app_id", "name", f"concat({read('metadata', '$.name', 'string')}, ':', {read('metadata', '$.type', 'string')}) AS metadata", f"{read('reviews', '$.total_positive', 'bigint')} AS positive", f"{read('reviews', '$.total_reviews', 'bigint')} AS total",
        f"{read('news', '$.articles[0].gid', 'string')} AS news", f"{read('current', '$.player_count', 'bigint')} AS current", "player_count", "samples", "lowest_price", "prices", "cast(size(updates) AS bigint) AS updates",
    )
