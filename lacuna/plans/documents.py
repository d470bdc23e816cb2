"""Queries of the document parsers, projections, profiles and streams, with their DuckDB text.

The captured documents are made from the driver's tables in Spark; the SQL says what parsing them must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import documents as D
from lacuna.operators import history as H
from lacuna.operators import ledger as L
from lacuna.operators import parse as P
from lacuna.operators import profiles as R
from lacuna.operators import state as C
from lacuna.plans.registry import _APPS, _CADENCE, _COVERAGE, _OUTCOME, _PARSED, _spans, apps, history_inputs, query
from lacuna.sources import views as V
from lacuna.streaming import ledger as K

START, END, AS_OF, DAY, HOUR = V.START, V.END, V.AS_OF, V.DAY, V.HOUR


# Captured documents.


def store_captures(spark: SparkSession, d: str) -> DataFrame:
    """Names in the store's envelope; by p_partkey: another app's, blank, cut off, with a control character."""
    body = "to_json(named_struct('app_id', CASE p_partkey % 8 WHEN 1 THEN p_partkey ELSE p_partkey + 1 END, 'name', CASE p_partkey % 8 WHEN 2 THEN '  ' WHEN 4 THEN concat(p_name, '\\t') ELSE p_name END))"
    return V.read(spark, d, "part").selectExpr("p_partkey AS capture_id", "p_partkey + 1 AS app_id", "p_partkey * 1000000 AS t", f"CASE WHEN p_partkey % 8 = 3 THEN left({body}, length({body}) - 2) ELSE {body} END AS payload")


def catalog_captures(spark: SparkSession, d: str) -> DataFrame:
    """Pages of ten apps; some with a flag of the wrong type, some whose cursor stays."""
    part = V.read(spark, d, "part").selectExpr("p_partkey div 10 AS capture_id", "p_partkey + 1 AS appid", "CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS name")
    pages = part.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("appid", "name"))).alias("apps"), F.max("appid").alias("last"))
    body = "to_json(named_struct('response', named_struct('apps', apps, 'have_more_results', capture_id % 4 <> 3, 'last_appid', CASE WHEN capture_id % 5 = 2 THEN capture_id * 10 ELSE last END)))"
    return pages.selectExpr("capture_id", "capture_id * 1000000 AS t", f"CASE WHEN capture_id % 7 = 6 THEN regexp_replace({body}, '\"have_more_results\":(true|false)', '\"have_more_results\":\"yes\"') ELSE {body} END AS payload")


_CATALOG = """, page_item AS (SELECT p_partkey // 10 AS capture_id, p_partkey + 1 AS app_id, CASE WHEN p_partkey % 9 = 0 THEN 'Steam app ' || (p_partkey + 1) ELSE p_name END AS name FROM part),
page AS (SELECT capture_id, count(*) AS n, capture_id % 7 <> 6 AND capture_id % 4 <> 3 AS have_more, CASE WHEN capture_id % 5 = 2 THEN capture_id * 10 ELSE max(app_id) END AS last_appid, CASE WHEN capture_id % 7 = 6 THEN 'invalid_schema' END AS code FROM page_item GROUP BY capture_id)"""


def chart_pages(spark: SparkSession, d: str) -> DataFrame:
    """source, month, html of the charts' tables: every ninth app's row has no app link, odd apps' images come from elsewhere."""
    link = "CASE WHEN app_id % 9 = 0 THEN '/package/' ELSE concat('https://store.steampowered.com/app/', app_id, '/x') END"
    image = "CASE WHEN app_id % 2 = 0 THEN 'https://cdn.akamai.steamstatic.com/' ELSE 'https://other.example/' END"
    row = f"concat('<tr><td><img src=\"', {image}, app_id, '.jpg\"></td><td>', rank, '</td><td><a href=\"', {link}, '\">Game &amp; ', app_id, '</a></td><td></td><td>', format_number(players, 0), '</td><td>', format_number(players + 1, 0), '</td></tr>')"
    rows = V.chart_items(spark, d).selectExpr("source", "month", "rank", f"{row} AS tr")
    rows = rows.groupBy("source", "month").agg(F.array_sort(F.collect_list(F.struct("rank", "tr"))).alias("rows"))  # 100 rows at most
    return rows.selectExpr("source", "month", "concat('<table><thead><tr><td>x</td></tr></thead><tbody>', array_join(rows.tr, ''), '</tbody></table>') AS html")


def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """source, month, html of search results; every fifth month has no container, every ninth app is a package."""
    item = "concat('<a class=\"x search_result_row\" data-ds-appid=\"', app_id, '\" data-ds-itemkey=\"', CASE WHEN app_id % 9 = 0 THEN 'Sub_' ELSE 'App_' END, app_id, '\"><span class=\"title\"> Game ', app_id, ' </span></a>')"
    rows = V.chart_items(spark, d).selectExpr("source", "month", "rank", f"{item} AS a").groupBy("source", "month").agg(F.array_sort(F.collect_list(F.struct("rank", "a"))).alias("rows"))
    return rows.selectExpr("source", "month", "concat('<div id=\"', CASE WHEN month % 5 = 0 THEN 'other' ELSE 'search_resultsRows' END, '\">', array_join(rows.a, ''), '</div>') AS html")


def details_captures(spark: SparkSession, d: str) -> DataFrame:
    """Store details in their envelope."""
    data = """named_struct('steam_appid', id + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END, 'name', p_name, 'type', p_type, 'short_description', concat('<b>', p_brand, '</b><br>', p_name, ' &amp; more'), 'is_free', p_size % 2 = 0,
      'website', CASE WHEN id % 3 = 0 THEN 'ftp://a.example/x' ELSE 'https://a.example/x' END, 'platforms', named_struct('windows', true, 'mac', p_size % 3 = 0, 'linux', false),
      'publishers', array(concat(p_brand, ' &amp; Co'), concat('<i>', p_type, '</i>')), 'about_the_game', concat('<p>', p_name, '</p><script>x</script><p>', p_brand, '</p>'), 'drm_notice', CASE WHEN id % 2 = 0 THEN p_brand END,
      'pc_requirements', named_struct('minimum', concat('<b>', p_size, ' GB</b>')), 'mac_requirements', CASE WHEN p_size % 3 = 0 THEN named_struct('recommended', p_brand) END,
      'demos', array(named_struct('appid', id + 2, 'description', concat(p_name, '<br>')), named_struct('appid', 0L, 'description', 'none')), 'fullgame', CASE WHEN id % 4 = 0 THEN named_struct('appid', CASE WHEN id % 8 = 0 THEN 'x' ELSE cast(id + 3 AS string) END, 'name', p_name) END,
      'achievements', named_struct('total', p_size - 10, 'highlighted', array(named_struct('localized_name', CASE WHEN id % 2 = 0 THEN '' ELSE '<b>won</b>' END, 'name', p_brand, 'icon', 'https://cdn.akamai.steamstatic.com/i.jpg'))),
      'genres', array(named_struct('description', p_brand), named_struct('description', p_type)), 'dlc', array(id + 1, 0L),
      'price_overview', CASE WHEN p_size % 2 = 1 THEN named_struct('currency', 'USD', 'initial', cents, 'final', cents - CASE WHEN id % 7 = 0 THEN cents + 1 ELSE 1 END, 'discount_percent', 1, 'final_formatted', concat('$', cents)) END,
      'screenshots', array(named_struct('path_thumbnail', 'https://cdn.akamai.steamstatic.com/t.jpg', 'path_full', CASE WHEN id % 5 = 0 THEN 'http://cdn.akamai.steamstatic.com/f.jpg' ELSE 'https://cdn.akamai.steamstatic.com/f.jpg' END)),
      'package_groups', array(named_struct('subs', array(named_struct('packageid', id, 'option_text', p_name))), named_struct('subs', array(named_struct('packageid', id + 1, 'option_text', p_name), named_struct('packageid', 0L, 'option_text', 'none')))))"""
    part = V.read(spark, d, "part").selectExpr("*", "p_partkey + 1 AS id", "cast(round(p_retailprice * 100) AS bigint) AS cents")
    return part.selectExpr("id AS capture_id", "id AS t", f"to_json(named_struct('app_id', id, 'body', to_json(map(cast(id AS string), named_struct('success', id % 13 <> 0, 'data', {data}))))) AS payload")


def news_captures(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a news item in its envelope, and beside it one of another feed."""
    item = lambda feed: f"named_struct('gid', CASE WHEN doc_id % 5 = 0 THEN concat('x', doc_id) ELSE cast(doc_id AS string) END, 'date', CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id * 86400 END, 'title', source, 'contents', coalesce(text, ''), 'feedname', '{feed}')"
    body = f"to_json(named_struct('appnews', named_struct('appid', CASE WHEN doc_id % 11 = 3 THEN doc_id ELSE doc_id + 1 END, 'newsitems', array({item(D.NEWS_FEED)}, {item('elsewhere')}))))"
    return V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", "doc_id AS t", f"to_json(named_struct('app_id', doc_id + 1, 'body', {body})) AS payload")


def review_captures(spark: SparkSession, d: str) -> DataFrame:
    """A review summary for each document; of some the sum is wrong, the request failed, a count is text, or the body is cut off."""
    counts = "'total_negative', n_chars % 53, 'total_reviews', doc_id % 91 + n_chars % 53 + if(doc_id % 7 = 1, 1, 0), 'review_score_desc', concat(source, ' &amp; <b>more</b><br>')"
    body = lambda p: f"to_json(named_struct('success', if(doc_id % 11 = 1, 2, 1), 'query_summary', named_struct('total_positive', {p}, {counts})))"
    whole = f"CASE WHEN doc_id % 13 = 1 THEN {body('string(doc_id % 91)')} ELSE {body('doc_id % 91')} END"
    cut = f"CASE WHEN doc_id % 17 = 1 AND doc_id % 7 <> 1 AND doc_id % 11 <> 1 AND doc_id % 13 <> 1 THEN left({whole}, 30) ELSE {whole} END"
    return V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", "doc_id AS t", f"to_json(named_struct('app_id', doc_id + 1, 'body', {cut})) AS payload")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return V.request_attempts(spark, d).selectExpr("app_id", "source", "dispatched AS t", "attempt_id AS capture_id")


# Parsers.


@query("b01_json_object_fault", " SELECT capture_id, CASE WHEN NOT json_valid(payload) THEN 'invalid_json' END AS fault FROM raw_response")
def _(spark, d):
    return V.raw_responses(spark, d).select("capture_id", D.json_object_fault(F.col("payload")).alias("fault"))


_STORE = """, stored AS (SELECT p_partkey AS capture_id, p_partkey + 1 AS app_id, p_partkey * 1000000 AS t, CASE p_partkey % 8 WHEN 1 THEN 'invalid_store_identity' WHEN 2 THEN 'invalid_store_name' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'invalid_store_name' END AS code,
  CASE WHEN p_partkey % 8 NOT IN (1, 2, 3, 4) THEN p_name END AS name FROM part)"""


@query("b04_parse_store_names", _STORE + " SELECT capture_id, app_id, t, name, code FROM stored")
def _(spark, d):
    return D.parse_store_names(store_captures(spark, d))


@query("b05_parse_chart_pages", " SELECT source, month, app_id, 'Game & ' || app_id AS name, rank, players, players + 1 AS peak_today FROM chart_item WHERE app_id % 9 <> 0")
def _(spark, d):
    return D.parse_chart_pages(chart_pages(spark, d)).where("code is null").select("source", "month", F.explode("items").alias("i")).select("source", "month", "i.*")


@query("b06_parse_search_pages", " SELECT source, month, app_id, 'Game ' || app_id AS name FROM chart_item WHERE app_id % 9 <> 0 AND month % 5 <> 0")
def _(spark, d):
    return D.parse_search_pages(search_pages(spark, d)).where("code is null").select("source", "month", F.explode("items").alias("i")).select("source", "month", "i.*")


@query("b07_parse_catalog_pages", _CATALOG + " SELECT * FROM page")
def _(spark, d):
    return D.parse_catalog_pages(catalog_captures(spark, d)).selectExpr("capture_id", "cast(size(items) AS bigint) AS n", "have_more", "last_appid", "code")


@query("b08_validate_snapshot", " SELECT source, month, month % 4 <> 0 AS valid FROM chart_item GROUP BY source, month")
def _(spark, d):
    items = V.chart_items(spark, d).withColumn("name", F.lit("x")).groupBy("source", "month").agg(F.collect_list(F.struct("app_id", "name", "rank", "players")).alias("items"))
    spoiled = F.when(F.col("month") % 4 == 0, F.concat("items", F.slice("items", 1, 1))).otherwise(F.col("items"))
    return items.select("source", "month", D.valid_snapshot(spoiled, counts=("players",)).alias("valid"))


@query(
    "b09_flatten_store_details",
    """, p AS (SELECT *, p_partkey + 1 AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)
SELECT id AS app_id, p_name AS name, p_type AS type, p_brand || chr(10) || p_name || ' & more' AS short_description, p_size % 2 = 0 AS is_free, CASE WHEN id % 3 <> 0 THEN 'https://a.example/x' END AS website,
  CASE WHEN p_size % 3 = 0 THEN 'mac,windows' ELSE 'windows' END AS platforms, p_brand || ',' || p_type AS genres, (id + 1)::VARCHAR AS dlc, CASE WHEN p_size % 2 = 1 AND id % 7 <> 0 THEN cents - 1 END AS final,
  CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS screenshots, id || ':' || p_name || ',' || (id + 1) || ':' || p_name AS options,
  p_brand || ' & Co,' || p_type AS publishers, p_name || chr(10) || p_brand AS about_the_game, CASE WHEN id % 2 = 0 THEN p_brand ELSE '' END AS drm_notice, p_size || ' GB' AS pc_minimum, CASE WHEN p_size % 3 = 0 THEN p_brand END AS mac_recommended,
  (id + 2) || ':' || p_name AS demos, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN id + 3 END AS full_game, CASE WHEN p_size % 2 = 1 AND id % 7 <> 0 THEN '$' || cents END AS final_formatted,
  CASE WHEN p_size >= 10 THEN (p_size - 10) || ':' || CASE WHEN id % 2 = 0 THEN p_brand ELSE 'won' END || ':https://cdn.akamai.steamstatic.com/i.jpg' END AS achievements FROM p WHERE id % 11 <> 0 AND id % 13 <> 0""",
)
def _(spark, d):
    got = D.flatten_store_details(details_captures(spark, d)).where("code is null")
    return got.selectExpr(
        "app_id", "name", "type", "short_description", "is_free", "website", "array_join(platforms, ',') AS platforms", "array_join(genres, ',') AS genres", "array_join(cast(dlc AS array<string>), ',') AS dlc",
        "price.final AS final", "size(screenshots) AS screenshots", "array_join(transform(purchase_options, o -> concat(o.packageid, ':', o.description)), ',') AS options",
        "array_join(publishers, ',') AS publishers", "about_the_game", "drm_notice", "requirements['pc'].minimum AS pc_minimum", "try_element_at(requirements, 'mac').recommended AS mac_recommended",
        "array_join(transform(demos, x -> concat(x.app_id, ':', x.description)), ',') AS demos", "fullgame.app_id AS full_game", "price.final_formatted AS final_formatted",
        "concat(achievements.total, ':', achievements.highlighted[0].name, ':', achievements.highlighted[0].image) AS achievements",
    )


@query("b10_review_summaries", """, r AS (SELECT doc_id AS capture_id, doc_id + 1 AS app_id, doc_id % 91 AS positive, n_chars % 53 AS negative, doc_id % 91 + n_chars % 53 AS total, source || ' & more' AS description,
  CASE WHEN doc_id % 7 = 1 OR doc_id % 11 = 1 OR doc_id % 13 = 1 THEN 'invalid_schema' WHEN doc_id % 17 = 1 THEN 'invalid_json' END AS code FROM documents)
SELECT capture_id, app_id, CASE WHEN code IS NULL THEN positive END AS positive, CASE WHEN code IS NULL THEN negative END AS negative, CASE WHEN code IS NULL THEN total END AS total,
  CASE WHEN code IS NULL THEN description END AS description, code, CASE WHEN code IS NULL AND total > 0 THEN (20000 * positive + total) // (2 * total) END AS hundredths FROM r""")
def _(spark, d):
    return D.parse_review_summaries(review_captures(spark, d))


@query("b11_parse_news", """ SELECT doc_id + 1 AS app_id, doc_id::VARCHAR AS gid, doc_id * 86400 AS date, source AS title, md5(coalesce(text, '')) AS contents_md5, 'https://store.steampowered.com/news/app/' || (doc_id + 1) || '/view/' || doc_id AS url, NULL::VARCHAR AS code
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 3 UNION ALL SELECT doc_id + 1, NULL, NULL, NULL, NULL, NULL, 'invalid_schema' FROM documents WHERE doc_id % 11 = 3""")
def _(spark, d):
    return D.parse_news(news_captures(spark, d)).select("app_id", "gid", "date", "title", F.md5(F.col("contents").cast("binary")).alias("contents_md5"), "url", "code")


@query("b12_parse_current_snapshots", _PARSED + " SELECT capture_id, app_id, t, player_count, code FROM parsed")
def _(spark, d):
    return D.parse_current_snapshots(V.raw_responses(spark, d).selectExpr("capture_id", "t", "to_json(named_struct('app_id', app_id, 'body', payload)) AS payload"))


@query("b13_html_to_text")
def _(spark, d):
    return V.read(spark, d, "pages").select("page_id", D.html_to_text(F.col("html")).alias("body"))


@query("b14_safe_url", " SELECT page_id, CASE WHEN page_id % 4 NOT IN (1, 2) THEN url END AS safe FROM pages")
def _(spark, d):
    url = "CASE page_id % 4 WHEN 1 THEN replace(url, '://', '://user:word@') WHEN 2 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END AS url"
    return V.read(spark, d, "pages").selectExpr("page_id", url).select("page_id", P.safe_url(F.col("url")).alias("safe"))


_WRAP = "CASE {c} % 3 WHEN 0 THEN '[h2]' || {x} || '[/h2]' WHEN 1 THEN {x} || '[img]a' || chr(10) || 'b[/img] ' ELSE '[url=http://a.example]{{STEAM_CLAN_IMAGE}}/1/2.png ' || {x} || '[/URL]' END"
_TAGS = P.NEWS_TAGS.replace("'", "''")


@query("b15_clean_news_markup", f""", n AS (SELECT doc_id AS capture_id, {_WRAP.format(c='doc_id', x="coalesce(text, '')")} AS x FROM documents)
SELECT capture_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)\\[img\\].*?\\[/img\\]', '', 'g'), '\\{{STEAM_CLAN_IMAGE\\}}[^ \\t\\n\\r\\f\\[]*', '', 'g'), '{_TAGS}', '', 'g'), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS body_md5 FROM n""")
def _(spark, d):
    x = F.expr(_WRAP.format(c="doc_id", x="coalesce(text, '')"))
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("capture_id"), F.md5(P.clean_news_markup(x).cast("binary")).alias("body_md5"))


@query("b16_chart_artwork", " SELECT source, month, app_id, 'https://cdn.akamai.steamstatic.com/' || app_id || '.jpg' AS image FROM chart_item WHERE app_id % 9 <> 0 AND app_id % 2 = 0")
def _(spark, d):
    return D.chart_artwork(chart_pages(spark, d))


@query("e18_chart_view", f" SELECT source, app_id, rank, players, CASE WHEN app_id % 9 <> 0 AND app_id % 2 = 0 THEN 'https://cdn.akamai.steamstatic.com/' || app_id || '.jpg' END AS image, greatest(0, ({AS_OF} - epoch_us(strptime(month::VARCHAR || '01', '%Y%m%d'))) // 1000000) AS age_seconds FROM chart_item WHERE month = (SELECT max(month) FROM chart_item c WHERE c.source = chart_item.source)")
def _(spark, d):
    return C.chart_view(V.chart_items(spark, d), D.chart_artwork(chart_pages(spark, d)), AS_OF)


@query("b18_route_by_parser", " SELECT capture_id, CASE WHEN capture_id % 5 <> 0 THEN 'player_counts' END AS parser, CASE WHEN capture_id % 5 = 0 THEN 'unknown_parser_version' END AS code FROM raw_response")
def _(spark, d):
    got = V.raw_responses(spark, d).selectExpr("capture_id", "'players' AS source", "CASE WHEN capture_id % 5 = 0 THEN '9' ELSE '1' END AS source_version")
    return D.route_by_parser(got, [("players", "1", "player_counts"), ("store", "1", "store_names")]).select("capture_id", "parser", "code")


@query("b19_retry_after_seconds", f" SELECT attempt_id, CASE attempt_id % 3 WHEN 0 THEN retry_after WHEN 1 THEN greatest(0, completed // 1000000 - {START // 1_000_000}) END AS seconds FROM request_result")
def _(spark, d):
    header = "CASE attempt_id % 3 WHEN 0 THEN cast(retry_after AS string) WHEN 1 THEN date_format(timestamp_micros(completed), \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\") ELSE 'soon' END AS header"
    return V.request_results(spark, d).selectExpr("attempt_id", header).select("attempt_id", D.retry_after_seconds(F.col("header"), START).alias("seconds"))


@query("b20_allowed_source", " SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL ELSE 'source_not_allowed' END AS code FROM pages")
def _(spark, d):
    url = "CASE page_id % 4 WHEN 0 THEN 'https://api.example/x' WHEN 1 THEN 'http://api.example/x' WHEN 2 THEN url ELSE 'https://api.example:8443/x' END AS url"
    return V.read(spark, d, "pages").selectExpr("page_id", url).select("page_id", D.allowed_source(F.col("url"), ["api.example"]).alias("code"))


# Projections.


@query("c01_project_player_samples", _PARSED + f" SELECT capture_id, app_id, t, player_count FROM parsed WHERE code IS NULL AND t >= {START}")
def _(spark, d):
    rows = P.parse_player_counts(V.raw_responses(spark, d)).where("code is null").drop("code")
    return L.append_if_absent(V.player_samples(spark, d).where(F.col("t") < START), rows, "capture_id")


@query("c02_project_app_names", _STORE + " SELECT capture_id, app_id, t, name FROM stored WHERE code IS NULL AND capture_id % 10 <> 0")
def _(spark, d):
    rows = D.parse_store_names(store_captures(spark, d)).where("code is null").drop("code")
    return L.append_if_absent(V.read(spark, d, "part").where("p_partkey % 10 = 0").selectExpr("p_partkey AS capture_id"), rows, "capture_id")


@query("c03_project_snapshots", _CATALOG + """ SELECT 'chart' AS kind, source || month AS snapshot, count(*) FILTER (WHERE app_id % 9 <> 0) AS n FROM chart_item GROUP BY source, month HAVING n > 0
UNION ALL SELECT 'search', source || month, count(*) FILTER (WHERE app_id % 9 <> 0) FROM chart_item WHERE month % 5 <> 0 GROUP BY source, month UNION ALL SELECT 'catalog', capture_id::VARCHAR, n FROM page WHERE code IS NULL""")
def _(spark, d):
    charts = D.parse_chart_pages(chart_pages(spark, d)).where("code is null").selectExpr("'chart' AS kind", "concat(source, month) AS snapshot", "cast(size(items) AS bigint) AS n")
    found = D.parse_search_pages(search_pages(spark, d)).where("code is null").selectExpr("'search' AS kind", "concat(source, month) AS snapshot", "cast(size(items) AS bigint) AS n")
    pages = D.parse_catalog_pages(catalog_captures(spark, d)).where("code is null").selectExpr("'catalog' AS kind", "cast(capture_id AS string) AS snapshot", "cast(size(items) AS bigint) AS n")
    return charts.unionByName(found).unionByName(pages)


@query("c04_explode_catalog", _CATALOG + " SELECT capture_id, app_id, name FROM page_item WHERE capture_id % 7 <> 6")
def _(spark, d):
    return D.explode_catalog(D.parse_catalog_pages(catalog_captures(spark, d)))


@query("e21_catalog_scan_state", _CATALOG + " SELECT capture_id, last_appid AS cursor, NOT have_more AS complete FROM page WHERE code IS NULL ORDER BY capture_id DESC LIMIT 1")
def _(spark, d):
    return D.catalog_scan_state(D.parse_catalog_pages(catalog_captures(spark, d)))


@query("e22_cursor_audit", _CATALOG + " SELECT capture_id, capture_id * 10 AS asked_appid, last_appid FROM page WHERE code IS NULL AND have_more AND last_appid <= capture_id * 10")
def _(spark, d):
    pages = catalog_captures(spark, d)
    return D.cursor_faults(D.parse_catalog_pages(pages), pages.selectExpr("capture_id", "capture_id * 10 AS asked_appid"))


# Profiles.

_SNAP = ", snap AS (SELECT app_id, source, dispatched AS t, attempt_id AS capture_id FROM request_attempt)"


@query("e03_carry_in", f" SELECT app_id, t, capture_id, player_count FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY t DESC, capture_id DESC) AS rn FROM player_sample WHERE t < {START}) WHERE rn = 1")
def _(spark, d):
    return R.carry_in(V.player_samples(spark, d), START)


@query("c10_recent_updates", _SNAP + " SELECT app_id, source, t, capture_id FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY t DESC, capture_id DESC) AS rn FROM snap WHERE source IN ('view', 'click', 'purchase', 'signup')) WHERE rn <= 20")
def _(spark, d):
    return R.recent_updates(snapshots(spark, d), ["view", "click", "purchase", "signup"])


@query("c11_latest_snapshot_per_source", _SNAP + " SELECT app_id, source, t, capture_id FROM (SELECT *, row_number() OVER (PARTITION BY app_id, source ORDER BY t DESC, capture_id DESC) AS rn FROM snap) WHERE rn = 1")
def _(spark, d):
    return R.latest_snapshot_per_source(snapshots(spark, d))


_DISCOVERED = """, ln AS (SELECT app_id, name, t, source FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY t DESC, source, name) AS rn FROM name_history) WHERE rn = 1),
places AS (SELECT app_id, string_agg(source || ':' || rank || ':' || players, ',' ORDER BY source, rank) AS charts FROM chart_item WHERE month = (SELECT max(month) FROM chart_item c WHERE c.source = chart_item.source) GROUP BY app_id)"""


@query("c14_discovered_app", _DISCOVERED + " SELECT app_id, name, t, source, coalesce(charts, '') AS charts FROM ln LEFT JOIN places USING (app_id)")
def _(spark, d):
    got = R.discovered_apps(C.latest_names(V.name_history(spark, d)), V.chart_items(spark, d))
    return got.withColumn("charts", F.expr("array_join(transform(charts, c -> concat_ws(':', c.source, cast(c.rank AS string), cast(c.players AS string))), ',')"))


@query(
    "c15_game_profile",
    _DISCOVERED + f""", pr AS (SELECT app_id, min(final) AS lowest_price, count(*) AS prices FROM price GROUP BY app_id), re AS (SELECT app_id, max(finished) AS refreshed FROM run_completion GROUP BY app_id),
tot AS (SELECT app_id, count(*) AS samples, max(player_count) AS highest FROM player_sample GROUP BY app_id), up AS (SELECT app_id, least(count(*), 20) AS updates FROM request_attempt GROUP BY app_id)
SELECT app_id, ln.name, coalesce(charts, '') AS charts, lowest_price, coalesce(prices, 0) AS prices, refreshed, coalesce(samples, 0) AS samples, highest, coalesce(updates, 0) AS updates
FROM ln LEFT JOIN places USING (app_id) LEFT JOIN pr USING (app_id) LEFT JOIN re USING (app_id) LEFT JOIN tot USING (app_id) LEFT JOIN up USING (app_id)""",
)
def _(spark, d):
    found = R.discovered_apps(C.latest_names(V.name_history(spark, d)), V.chart_items(spark, d))
    found = found.withColumn("charts", F.expr("array_join(transform(charts, c -> concat_ws(':', c.source, cast(c.rank AS string), cast(c.players AS string))), ',')"))
    price = V.prices(spark, d).groupBy("app_id").agg(F.min("final").alias("lowest_price"), F.count(F.lit(1)).alias("prices"))
    run = V.run_completions(spark, d).groupBy("app_id").agg(F.max("finished").alias("refreshed"))
    total = C.app_totals(V.player_samples(spark, d), AS_OF, DAY).select("app_id", "samples", "highest")
    recent = R.recent_updates(snapshots(spark, d), ["view", "click", "purchase", "signup", "error"]).groupBy("app_id").agg(F.count(F.lit(1)).alias("updates"))
    for part in (price, run, total, recent):
        found = found.join(part, "app_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return found.select("app_id", "name", "charts", "lowest_price", zero("prices"), "refreshed", zero("samples"), "highest", zero("updates"))


@query("e16_source_status", _OUTCOME + """, tried AS (SELECT source, dispatched, coalesce(status, 'uncertain') AS status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dispatched DESC, attempt_id DESC) AS rn FROM request_attempt) LEFT JOIN request_result USING (attempt_id) WHERE rn = 1),
ended AS (SELECT source, finished, ok FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY finished DESC, run_id DESC) AS rn FROM outcome JOIN (SELECT run_id, finished FROM run_completion) USING (run_id)) WHERE rn = 1)
SELECT source, CASE WHEN NOT ok AND finished >= dispatched THEN finished ELSE dispatched END AS at, CASE WHEN NOT ok AND finished >= dispatched THEN 'failed' ELSE status END AS status FROM tried LEFT JOIN ended USING (source)""")
def _(spark, d):
    attempts, results = V.request_attempts(spark, d), V.request_results(spark, d)
    runs = L.final_outcome(attempts, results).join(V.run_completions(spark, d).select("run_id", "finished"), "run_id")
    return R.source_status(attempts, results, runs)


@query("e19_newest_count_across_sources", """, l AS (SELECT app_id, capture_id % 2 AS k, max(t) AS at, arg_max(player_count, t) AS player_count, max(player_count) AS peak FROM player_sample GROUP BY ALL)
SELECT app_id, CASE WHEN b.at IS NULL OR a.at > b.at THEN a.player_count ELSE b.player_count END AS player_count, CASE WHEN b.at IS NULL OR a.at > b.at THEN a.at ELSE b.at END AS at, greatest(a.peak, b.peak) AS peak
FROM (SELECT * FROM l WHERE k = 0) a FULL JOIN (SELECT * FROM l WHERE k = 1) b USING (app_id)""")
def _(spark, d):
    side = lambda k: V.player_samples(spark, d).where(f"capture_id % 2 = {k}").groupBy("app_id").agg(F.max("t").alias("at"), F.max_by("player_count", "t").alias("player_count"), F.max("player_count").alias("peak"))
    return R.newest_count_across_sources(side(0), side(1))


@query("i05_review_delta", " SELECT lang, source, positive, total, positive - lag(positive) OVER w AS change_positive, total - lag(total) OVER w AS change_total FROM review_summary WINDOW w AS (PARTITION BY lang ORDER BY source)")
def _(spark, d):
    return R.review_deltas(V.review_summaries(spark, d), ["lang"], "source")


_FRESH = _APPS + _CADENCE + _spans(START, END) + f""", enabled AS (SELECT app_id, interval_seconds * 1000000 AS step, greatest(started, {START}) AS s, least(coalesce(lead(started) OVER (PARTITION BY app_id ORDER BY started, id), {END}), {END}) AS e, id FROM tracking_interval),
used AS (SELECT app_id, s, e, step FROM enabled WHERE id % 2 = 1 AND e > s), f AS (SELECT app_id, sum(least(b, e) - greatest(a, s))::BIGINT AS fresh FROM spans JOIN used USING (app_id) WHERE least(b, e) > greatest(a, s) GROUP BY app_id),
fresh_app AS (SELECT app_id, coalesce(fresh, 0) AS fresh, tracked FROM (SELECT app_id, sum(e - s)::BIGINT AS tracked FROM used GROUP BY app_id) LEFT JOIN f USING (app_id)),
met AS (SELECT app_id, count(DISTINCT s + (t - s) // step * step) AS observed FROM used JOIN player_sample USING (app_id) WHERE t >= s AND t < e GROUP BY app_id),
occurred AS (SELECT app_id, expected, coalesce(observed, 0) AS observed FROM (SELECT app_id, sum((e - s + step - 1) // step)::BIGINT AS expected FROM used GROUP BY app_id) LEFT JOIN met USING (app_id))"""


def enabled_periods(spark: SparkSession, d: str) -> DataFrame:
    """app_id, interval_seconds, s, e: policies with an odd id enable collection until the next policy, those with an even id disable it."""
    until = f"least(coalesce(lead(started) OVER (PARTITION BY app_id ORDER BY started, id), {END}), {END}) AS e"
    return V.tracking_intervals(spark, d).selectExpr("app_id", "id", "interval_seconds", f"greatest(started, {START}) AS s", until).where("id % 2 = 1")


def fresh_apps(spark: SparkSession, d: str) -> DataFrame:
    return R.freshness_coverage(H.capped_spans(*history_inputs(spark, d), START, END, reach=V.REACH), enabled_periods(spark, d), DAY)


@query("i08_freshness_coverage", _FRESH + " SELECT * FROM fresh_app")
def _(spark, d):
    return fresh_apps(spark, d)


@query("i08_occurrences", _FRESH + " SELECT * FROM occurred")
def _(spark, d):
    return H.occurrences(V.player_samples(spark, d), enabled_periods(spark, d), START, END)


@query("i08_freshness_report", _FRESH + """ SELECT count(*) AS apps, sum(tracked)::BIGINT AS tracked, sum(fresh)::BIGINT AS fresh, sum(tracked - fresh)::BIGINT AS stale, sum(fresh)::DOUBLE / sum(tracked)::DOUBLE AS ratio,
  sum(fresh) * 100 >= sum(tracked) * 95 AS passes, sum(expected)::BIGINT AS expected, sum(observed)::BIGINT AS observed FROM fresh_app JOIN occurred USING (app_id)""")
def _(spark, d):
    return R.freshness_report(fresh_apps(spark, d), H.occurrences(V.player_samples(spark, d), enabled_periods(spark, d), START, END))


@query("i10_achievement_join", """, m AS (SELECT l_partkey AS key, sum(l_quantity::BIGINT)::BIGINT % 120 AS percent FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1), n AS (SELECT p_partkey AS key, p_name AS name FROM part WHERE p_partkey % 3 <> 0)
SELECT key, name, CASE WHEN n.name IS NOT NULL AND percent BETWEEN 0 AND 100 THEN percent END AS percent, CASE WHEN percent IS NULL THEN 'unsupported' WHEN n.name IS NULL THEN 'unknown_key' WHEN percent <= 100 THEN 'ok' ELSE 'invalid' END AS state FROM n FULL JOIN m USING (key)""")
def _(spark, d):
    shares = V.read(spark, d, "lineitem").where("l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("key")).agg((F.sum(F.col("l_quantity").cast("bigint")) % 120).alias("percent"))
    return R.achievement_join(V.read(spark, d, "part").where("p_partkey % 3 <> 0").selectExpr("p_partkey AS key", "p_name AS name"), shares)


# Sinks and streams.


@query("a01_ingest_captures", " SELECT doc_id AS capture_id, sha256(coalesce(text, '')) AS checksum FROM documents")
def _(spark, d):
    return K.stream_captures(V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", "coalesce(text, '') AS payload")).select("capture_id", "checksum")


@query("a02_stream_captures", " SELECT doc_id AS capture_id, sha256(coalesce(text, '')) AS checksum FROM documents")
def _(spark, d):
    landed = K.stream_table(spark, f"{d}/documents.parquet").selectExpr("doc_id AS capture_id", "coalesce(text, '') AS payload")
    return K.drained(K.stream_captures(landed).select("capture_id", "checksum"), "captures")


@query("a04_write_read_model", " SELECT app_id, count(*) AS samples, max(player_count) AS highest FROM player_sample GROUP BY app_id")
def _(spark, d):
    path = K.shared_folder(spark, "read-model")
    C.app_totals(V.player_samples(spark, d), AS_OF, DAY).select("app_id", "samples", "highest").write.json(path)
    return spark.read.schema("app_id bigint, samples bigint, highest bigint").json(path)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    e = K.stream_table(spark, f"{d}/events.parquet")
    host = "CASE WHEN event_type IN ('view', 'click', 'error') THEN 'webapi' ELSE 'store' END AS host_group"
    return e.selectExpr("event_id AS capture_id", "user_id + 1 AS app_id", "cast(ts AS timestamp) AS at", "event_type", host)


@query("k01_stream_project", " SELECT event_id AS capture_id, app_id, t FROM ev")
def _(spark, d):
    once = event_stream(spark, d).select("capture_id", "app_id", "at")
    return K.stream_project(once.unionByName(once), "capture_id", "at", "40 days").selectExpr("capture_id", "app_id", "unix_micros(at) AS t")


@query(
    "k02_stream_sessions",
    f""", s AS (SELECT app_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY app_id ORDER BY t) < {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM ev), g AS (SELECT *, sum(fresh) OVER (PARTITION BY app_id ORDER BY t) AS run FROM s)
SELECT app_id, min(t) AS first, max(t) + {6 * HOUR} AS last_end, count(*) AS n FROM g GROUP BY app_id, run HAVING max(t) + {6 * HOUR} <= (SELECT max(t) - {HOUR} FROM ev)""",
)
def _(spark, d):
    got = K.drained(K.stream_sessions(event_stream(spark, d), "at", "6 hours", "1 hour"), "sessions")
    return got.selectExpr("app_id", "unix_micros(first) AS first", "unix_micros(last_end) AS last_end", "n")


@query(
    "k02_stream_paced_sessions",
    f""", s AS (SELECT app_id, t, capture_id AS id, 1 AS kind, NULL::BIGINT AS iv FROM player_sample UNION ALL SELECT app_id, started, id, 0, interval_seconds FROM tracking_interval),
p AS (SELECT *, last_value(iv IGNORE NULLS) OVER (PARTITION BY app_id ORDER BY t, kind, id ROWS UNBOUNDED PRECEDING) AS interval_seconds FROM s),
e AS (SELECT app_id, t, id, t + interval_seconds * 2000000 AS ends FROM p WHERE kind = 1 AND interval_seconds IS NOT NULL),
f AS (SELECT *, CASE WHEN t < max(ends) OVER (PARTITION BY app_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY app_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT app_id, min(t) AS first, max(ends) AS last_end, count(*) AS n FROM g GROUP BY app_id, run HAVING max(ends) <= (SELECT max(t) - {HOUR} FROM player_sample)""",
)
def _(spark, d):
    samples = event_stream(spark, d).where("event_type in ('view', 'click', 'purchase')").withColumn("t", F.unix_micros("at"))
    got = K.drained(K.stream_paced_sessions(samples, V.tracking_intervals(spark, d), "at", "1 hour"), "paced")
    return got.selectExpr("app_id", "unix_micros(first) AS first", "unix_micros(last_end) AS last_end", "n")


def sample_stream(spark: SparkSession, d: str) -> DataFrame:
    """Samples and policies in one stream, as stream_capped_spans takes them."""
    kind = "CASE event_type WHEN 'signup' THEN 0 ELSE 1 END AS kind"
    amount = "CASE event_type WHEN 'signup' THEN 3600 * (1 + cast(get_json_object(props, '$.k') AS bigint) % 24) ELSE cast(round(value * 100) AS bigint) END AS amount"
    e = K.stream_table(spark, f"{d}/events.parquet").where("event_type in ('signup', 'view', 'click', 'purchase')")
    return e.selectExpr("user_id + 1 AS app_id", "unix_micros(cast(ts AS timestamp)) AS t", kind, "event_id AS id", amount, "cast(ts AS timestamp) AS at")


_STREAMED = f""", kept AS (SELECT max(t) // 1000 - {HOUR // 1000} AS mark FROM ev WHERE event_type IN ('signup', 'view', 'click', 'purchase')),
both_s AS (SELECT app_id, t, capture_id AS id, player_count, NULL::BIGINT AS iv, 1 AS kind FROM player_sample UNION ALL SELECT app_id, started, id, NULL, interval_seconds, 0 FROM tracking_interval),
held_s AS (SELECT *, last_value(iv IGNORE NULLS) OVER (PARTITION BY app_id ORDER BY t, kind, id ROWS UNBOUNDED PRECEDING) AS interval_seconds FROM both_s, kept WHERE t // 1000 < mark),
step_s AS (SELECT app_id, mark, t AS a, t + interval_seconds * 2000000 AS cap, lead(t) OVER (PARTITION BY app_id ORDER BY t, id) AS following, player_count FROM held_s WHERE kind = 1),
ended AS (SELECT app_id, a, least(cap, coalesce(following, cap)) AS b, player_count, coalesce(following > cap, true) AS expired FROM step_s WHERE cap IS NOT NULL AND (following IS NOT NULL OR cap // 1000 < mark))"""


@query("k03_stream_capped_spans", _STREAMED + " SELECT * FROM ended WHERE b > a")
def _(spark, d):
    return K.drained(K.stream_capped_spans(sample_stream(spark, d), "at", "1 hour"), "spans")


@query("k04_stream_freshness", _STREAMED + " SELECT app_id, b AS stale_at FROM ended WHERE b > a AND expired")
def _(spark, d):
    return K.drained(K.stream_freshness(sample_stream(spark, d), "at", "1 hour"), "freshness")


@query(
    "k05_stream_quota",
    f""", w AS (SELECT host_group, (dispatched // {HOUR} + unnest(range(1, 25))) * {HOUR} AS window_end FROM request_attempt)
SELECT host_group, window_end, count(*) AS attempts FROM w WHERE window_end <= (SELECT max(t) - {HOUR} FROM ev) GROUP BY ALL""",
)
def _(spark, d):
    return K.drained(K.stream_quota(event_stream(spark, d), "at", "1 hour"), "quota").selectExpr("host_group", "unix_micros(window_end) AS window_end", "attempts")


@query("k06_touched_rollup", f" SELECT app_id, t // {DAY} * {DAY} AS bucket, count(*) AS n, max(player_count) AS highest FROM player_sample GROUP BY 1, 2 HAVING bool_or(capture_id % 50 = 0)")
def _(spark, d):
    samples = V.player_samples(spark, d)
    return K.touched_rollup(samples.where("capture_id % 50 <> 0"), samples.where("capture_id % 50 = 0"), DAY)


@query("k06_late_rollup", f""" SELECT app_id, t // {DAY} AS day, count(*) AS n, max(player_count) AS highest,
  count(*) FILTER (WHERE capture_id % 50 = 0 AND t < (SELECT max(t) FROM player_sample WHERE capture_id % 50 <> 0) - {6 * HOUR}) AS n_late FROM player_sample GROUP BY 1, 2""")
def _(spark, d):
    """Two runs of one stream; the second brings rows of all days."""
    samples, path = V.player_samples(spark, d), K.shared_folder(spark, "late-rollup")
    for k, part in enumerate(("capture_id % 50 <> 0", "capture_id % 50 = 0")):
        samples.where(part).write.parquet(f"{path}/input/{k}")
        rollup = K.stream_rollup(spark.readStream.schema(samples.schema).parquet(f"{path}/input/*"), path, 6 * HOUR, DAY, buckets=1)
    return rollup.select("app_id", F.col("day").cast("bigint").alias("day"), "n", "highest", "n_late")


@query("h01_rebuild_projections", _PARSED + ", done AS (SELECT capture_id FROM player_sample WHERE capture_id % 13 <> 0) SELECT capture_id, app_id, t, player_count FROM parsed WHERE code IS NULL AND capture_id NOT IN (SELECT capture_id FROM done)")
def _(spark, d):
    routed = D.route_by_parser(V.raw_responses(spark, d).selectExpr("*", "'players' AS source", "'1' AS source_version"), [("players", "1", "player_counts")])
    rows = P.parse_player_counts(routed.where("parser = 'player_counts'")).where("code is null").drop("code")
    return L.append_if_absent(V.player_samples(spark, d).where("capture_id % 13 <> 0"), rows, "capture_id")


def derived_names(spark: SparkSession, d: str) -> DataFrame:
    return D.parse_store_names(store_captures(spark, d)).where("code is null").drop("code").withColumn("parser_version", F.lit("1"))


def derived_entries(spark: SparkSession, d: str) -> DataFrame:
    return D.explode_catalog(D.parse_catalog_pages(catalog_captures(spark, d)))


@query("h01_rebuild_names", _STORE + " SELECT capture_id, app_id, t, name, '1' AS parser_version FROM stored WHERE code IS NULL AND capture_id % 13 = 0")
def _(spark, d):
    rows = derived_names(spark, d)
    return L.append_if_absent(rows.where("capture_id % 13 <> 0"), rows, "capture_id")


@query("h01_rebuild_catalog", _CATALOG + " SELECT capture_id, app_id, name FROM page_item WHERE capture_id % 7 <> 6 AND app_id % 13 = 0")
def _(spark, d):
    rows = derived_entries(spark, d)
    return L.append_if_absent(rows.where("app_id % 13 <> 0"), rows, "capture_id", "app_id")


@query("h02_verify_names", _STORE + " SELECT capture_id, CASE WHEN capture_id % 13 = 0 THEN 'missing' ELSE 'different' END AS fault FROM stored WHERE code IS NULL AND (capture_id % 13 = 0 OR capture_id % 17 = 0 OR capture_id % 19 = 0)")
def _(spark, d):
    rows = derived_names(spark, d)
    kept = rows.where("capture_id % 13 <> 0").withColumn("name", F.expr("CASE WHEN capture_id % 17 = 0 THEN 'other' ELSE name END"))
    return L.verify_projections(kept.withColumn("parser_version", F.expr("CASE WHEN capture_id % 19 = 0 THEN '0' ELSE parser_version END")), rows, "capture_id")


@query("h02_verify_catalog", _CATALOG + """ SELECT capture_id, app_id, CASE WHEN app_id % 13 = 0 THEN 'missing' ELSE 'different' END AS fault FROM page_item WHERE capture_id % 7 <> 6 AND (app_id % 13 = 0 OR app_id % 17 = 0)
UNION ALL SELECT p_partkey, -p_partkey, 'extra' FROM part WHERE p_partkey % 50 = 0""")
def _(spark, d):
    rows = derived_entries(spark, d)
    kept = rows.where("app_id % 13 <> 0").withColumn("name", F.expr("CASE WHEN app_id % 17 = 0 THEN 'other' ELSE name END"))
    more = V.read(spark, d, "part").where("p_partkey % 50 = 0").selectExpr("p_partkey AS capture_id", "-p_partkey AS app_id", "p_name AS name")
    return L.verify_projections(kept.unionByName(more), rows, "capture_id", "app_id")


@query("i03_compare", _APPS + _CADENCE + _spans(START, END) + f", n AS (SELECT app_id, count(*) AS points FROM player_sample WHERE t >= {START} AND t < {END} GROUP BY app_id) SELECT app_id, coalesce(points, 0) AS points, coalesce(covered, 0) AS covered, integral::DOUBLE / covered::DOUBLE AS average FROM apps LEFT JOIN spans_sums USING (app_id) LEFT JOIN n USING (app_id)")
def _(spark, d):
    return H.coverage(*history_inputs(spark, d), apps(spark, d), START, END, reach=V.REACH).select("app_id", "points", "covered", "average")


_CHOSEN = f""", chosen AS (SELECT app_id FROM (SELECT app_id, count(*) AS n FROM player_sample WHERE t >= {START} AND t < {END} GROUP BY app_id ORDER BY n DESC, app_id LIMIT 9) UNION ALL SELECT -1)"""


def chosen_apps(spark: SparkSession, d: str) -> DataFrame:
    """What a user might compare: the nine apps with most samples in the window, and one that isn't known."""
    counted = H.history_slice(V.player_samples(spark, d), START, END).groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "app_id").limit(9).select("app_id").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("app_id")))


@query("i03_compare_chosen", _COVERAGE + _CHOSEN + f""", began AS (SELECT app_id, min(started) AS tracked_from FROM tracking_interval WHERE started < {END} GROUP BY app_id)
SELECT app_id, CASE WHEN ratio IS NULL THEN 'unsupported' WHEN tracked_from IS NULL THEN 'untracked' WHEN covered = 0 THEN 'no_data' WHEN covered < requested THEN 'partial' ELSE 'available' END AS availability,
  tracked_from, coalesce(points, 0) AS points, coalesce(covered, 0) AS covered, coalesce(ratio, 0.0) AS ratio, coalesce(longest_gap, {END - START}) AS longest_gap, average, peak
FROM chosen LEFT JOIN coverage USING (app_id) LEFT JOIN began USING (app_id)""")
def _(spark, d):
    return H.compare(*history_inputs(spark, d), apps(spark, d), chosen_apps(spark, d), START, END, reach=V.REACH)


@query("i03_compare_series", _APPS + _CADENCE + _spans(START, END) + _CHOSEN + f""", grid AS (SELECT app_id, unnest(range({START // DAY}, {(END - 1) // DAY + 1})) * {DAY} AS bucket FROM chosen),
cut AS (SELECT app_id, bucket, least(b, bucket + {DAY}) - greatest(a, bucket) AS held, player_count FROM grid JOIN spans USING (app_id) WHERE a < bucket + {DAY} AND b > bucket),
sums AS (SELECT app_id, bucket, sum(held)::BIGINT AS covered, sum(player_count::HUGEINT * held) AS integral FROM cut GROUP BY ALL)
SELECT app_id, bucket, coalesce(covered, 0) AS covered, integral::DOUBLE / covered::DOUBLE AS average FROM grid LEFT JOIN sums USING (app_id, bucket)""")
def _(spark, d):
    return H.compared_series(*history_inputs(spark, d), chosen_apps(spark, d), START, END, DAY, reach=V.REACH)
