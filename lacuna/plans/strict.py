"""Queries of the strict parsers: captures with odd types, odd elements and text behind the object, and what must come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import documents as D
from lacuna.operators import parse as P
from lacuna.plans.documents import chart_pages
from lacuna.plans.registry import query
from lacuna.sources import views as V


def _by(key: str, n: int, *cases: str) -> str:
    """A CASE over key % n; each case is SQL for one remainder, the last for all others."""
    return f"CASE {key} % {n} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases[:-1])) + f" ELSE {cases[-1]} END"


@query("b01_faults_of_odd_texts", """ SELECT doc_id AS capture_id, CASE doc_id % 9 WHEN 0 THEN 'invalid_schema' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'invalid_schema'
  WHEN 5 THEN 'invalid_json' WHEN 6 THEN 'invalid_json' END AS fault FROM documents""")
def _(spark, d):
    own = "concat('{\"a\":', doc_id, '}')"
    payload = _by("doc_id", 9, f"concat('[', {own}, ']')", f"concat({own}, ' x')", f"concat({own}, ']')", f"concat({own}, ',', {own})", "concat('\"', doc_id, '\"')", "''", f"concat({own}, '}}')", f"concat(' \\n', {own}, '\\t ')", own)
    return V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", f"{payload} AS payload").select("capture_id", P.json_object_fault(F.col("payload")).alias("fault"))


@query("b03_odd_player_counts", """ SELECT doc_id AS capture_id, CASE WHEN doc_id % 8 IN (0, 7) THEN doc_id END AS player_count, CASE doc_id % 8 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'provider_result' WHEN 3 THEN 'provider_result'
  WHEN 4 THEN 'invalid_player_count' WHEN 5 THEN 'invalid_player_count' WHEN 6 THEN 'provider_result' END AS code FROM documents""")
def _(spark, d):
    body = lambda result, count: f"concat('{{\"response\":{{\"result\":', {result}, ',\"player_count\":', {count}, '}}}}')"
    good = body("1", "doc_id")
    payload = _by("doc_id", 8, good, f"concat({good}, ' x')", body("'true'", "doc_id"), body("'1.0'", "doc_id"), body("1", "concat(doc_id, 'e0')"), body("1", "'9223372036854775808'"), "'{\"response\":[1]}'", f"concat('\\n', {good})")
    got = V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", "doc_id AS app_id", "doc_id AS t", f"{payload} AS payload")
    return P.parse_player_counts(got).select("capture_id", "player_count", "code")


@query("b04_odd_store_names", """ SELECT p_partkey AS capture_id, CASE WHEN p_partkey % 9 IN (7, 8) THEN p_name END AS name, CASE WHEN p_partkey % 9 < 5 THEN 'invalid_store_name' WHEN p_partkey % 9 = 5 THEN 'invalid_json' WHEN p_partkey % 9 = 6 THEN 'invalid_store_identity' END AS code FROM part""")
def _(spark, d):
    made = lambda name, own="p_partkey": f"concat('{{\"app_id\":', {own}, ',\"name\":', {name}, '}}')"
    text = "concat('\"', p_name, '\"')"
    payload = _by("p_partkey", 9, made("5"), made("'true'"), made("'{\"a\":1}'"), made("'\" 　\"'"), made("concat('\"', repeat('x', 501), '\"')"), f"concat({made(text)}, ' x')", made(text, "concat('\"', p_partkey, '\"')"), made(text), f"concat({made(text)}, '\\n')")
    got = V.read(spark, d, "part").selectExpr("p_partkey AS capture_id", "p_partkey AS app_id", "p_partkey AS t", f"{payload} AS payload")
    return D.parse_store_names(got).select("capture_id", "name", "code")


@query("b05_parse_sales_charts", " SELECT source, month, app_id, 'Game & ' || app_id AS name, rank FROM chart_item WHERE app_id % 9 <> 0")
def _(spark, d):
    """The charts' cells of counts hold text, as charts of sales do."""
    pages = chart_pages(spark, d).withColumn("html", F.regexp_replace("html", r"<td>([0-9,]+)</td><td>([0-9,]+)</td></tr>", r"<td>up</td><td>$1 weeks</td></tr>"))
    return D.parse_chart_pages(pages, counted=F.lit(False)).where("code is null").select("source", "month", F.explode("items").alias("i")).select("source", "month", "i.app_id", "i.name", "i.rank")


@query("b07_odd_catalog_pages", """ SELECT p_partkey AS capture_id, CASE p_partkey % 8 WHEN 0 THEN 'Steam app ' || (p_partkey + 1) WHEN 7 THEN p_name END AS name, CASE WHEN p_partkey % 8 BETWEEN 1 AND 6 THEN 'invalid_schema' END AS code FROM part""")
def _(spark, d):
    made = lambda name, more="", own="p_partkey + 1": f"concat('{{\"response\":{{\"apps\":[{{\"appid\":', {own}, ',\"name\":', {name}, '}}]{more}}}}}')"
    text = "concat('\"', p_name, '\"')"
    payload = _by(
        "p_partkey", 8, made("'\"　\"'"), made("7"), made(text, ',"have_more_results":null'), made(text, ',"last_appid":1.0'), made(text, own="concat(p_partkey + 1, '.0')"),
        "'{\"response\":{\"apps\":[1]}}'", "'{\"response\":{\"apps\":{\"appid\":1}}}'", made(text, ',"have_more_results":false,"last_appid":0'),
    )
    got = V.read(spark, d, "part").selectExpr("p_partkey AS capture_id", "p_partkey AS t", f"{payload} AS payload")
    return D.parse_catalog_pages(got).select("capture_id", F.when(F.col("code").isNull(), F.get("items", F.lit(0))["name"]).alias("name"), "code")


def odd_details(spark: SparkSession, d: str) -> DataFrame:
    """Details whose lists mix types and whose fields have odd ones; by p_partkey the name is a number, or the whole is followed by text."""
    fields = (
        '"type":9,"developers":["<b>', "p_brand", '</b>",5,null,{"x":1}],"publishers":"none","dlc":[', "p_partkey + 2", ',"x",2.0,0,true],"packages":{"a":1},"genres":["q",{"description":"', "p_type",
        '"},{"description":3},{}],"platforms":{"windows":true,"mac":1,"linux":"yes"},"is_free":"no","release_date":{"date":5,"coming_soon":1},"website":7,"price_overview":{"currency":"USD","initial":5,"final":"4","discount_percent":1},',
        '"screenshots":[1,{"path_thumbnail":"https://cdn.akamai.steamstatic.com/t","path_full":2}],"pc_requirements":{"minimum":"<li>', "p_size", '</li>","recommended":7,"other":"x"},"mac_requirements":[],',
        '"demos":[{"appid":"5"},{"appid":', "p_partkey + 3", ',"description":[1]},null],"package_groups":[{"subs":[2,{"packageid":', "p_partkey + 4", ',"option_text":"a&amp;b"}]},{"subs":{}},"x"],',
        '"fullgame":{"appid":', "p_partkey + 5", ',"name":null},"achievements":{"total":3,"highlighted":["x",{"localized_name":0,"name":"n","icon":5},{"localized_name":5,"name":"n"}]}',
    )
    said = ", ".join(x if x.startswith("p_") else "'" + x.replace("'", "''") + "'" for x in fields)
    body = f"concat('{{\"', p_partkey + 1, '\":{{\"success\":true,\"data\":{{\"steam_appid\":', p_partkey + 1, ',\"name\":', CASE WHEN p_partkey % 5 = 1 THEN '9' ELSE concat('\"', p_name, '\"') END, ',', {said}, '}}}}}}', CASE WHEN p_partkey % 5 = 2 THEN ' x' ELSE '' END)"
    return V.read(spark, d, "part").selectExpr("p_partkey AS capture_id", "p_partkey AS t", f"to_json(named_struct('app_id', p_partkey + 1, 'body', {body})) AS payload")


@query("b09_odd_store_details", """, odd AS (SELECT *, CASE p_partkey % 5 WHEN 1 THEN 'invalid_schema' WHEN 2 THEN 'invalid_json' END AS code FROM part)
SELECT p_partkey AS capture_id, code, p_name AS name, '' AS type, p_brand AS developers, 0 AS publishers, (p_partkey + 2)::VARCHAR AS dlc, 0 AS packages, p_type AS genres, 'windows' AS platforms, NULL::BOOLEAN AS is_free, '' AS release_date, false AS coming_soon,
  true AS unpriced, 0 AS screenshots, p_size::VARCHAR AS minimum, true AS no_recommended, 'pc' AS systems, (p_partkey + 3) || ':' AS demos, (p_partkey + 4) || ':a&b' AS options, p_partkey + 5 AS full_game, '3:n,' AS achievements FROM odd WHERE code IS NULL
UNION ALL SELECT p_partkey, code, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM odd WHERE code IS NOT NULL""")
def _(spark, d):
    got = D.flatten_store_details(odd_details(spark, d))
    columns = {
        "name": "name", "type": "type", "developers": "array_join(developers, ',')", "publishers": "size(publishers)", "dlc": "array_join(cast(dlc AS array<string>), ',')", "packages": "size(packages)", "genres": "array_join(genres, ',')",
        "platforms": "array_join(platforms, ',')", "is_free": "is_free", "release_date": "release_date", "coming_soon": "coming_soon", "unpriced": "price is null and website is null", "screenshots": "size(screenshots)",
        "minimum": "try_element_at(requirements, 'pc').minimum", "no_recommended": "try_element_at(requirements, 'pc').recommended is null", "systems": "array_join(map_keys(requirements), ',')",
        "demos": "array_join(transform(demos, x -> concat(x.app_id, ':', x.description)), ',')", "options": "array_join(transform(purchase_options, x -> concat(x.packageid, ':', x.description)), ',')", "full_game": "fullgame.app_id",
        "achievements": "concat(achievements.total, ':', array_join(achievements.highlighted.name, ','))",
    }
    return got.selectExpr("capture_id", "code", *(f"CASE WHEN code IS NULL THEN {e} END AS {k}" for k, e in columns.items()))


@query("b10_odd_review_summaries", """ SELECT doc_id AS capture_id, CASE WHEN doc_id % 6 IN (0, 5) THEN doc_id END AS positive, CASE WHEN doc_id % 6 BETWEEN 1 AND 3 THEN 'invalid_schema' WHEN doc_id % 6 = 4 THEN 'invalid_json' END AS code FROM documents""")
def _(spark, d):
    made = lambda p, success="1": f"concat('{{\"success\":', {success}, ',\"query_summary\":{{\"total_positive\":', {p}, ',\"total_negative\":2,\"total_reviews\":', doc_id + 2, ',\"review_score_desc\":5}}}}')"
    body = _by("doc_id", 6, made("doc_id", "'true'"), made("concat(doc_id, '.0')"), made("concat('\"', doc_id, '\"')"), made("doc_id", "'\"1\"'"), f"concat({made('doc_id')}, ']')", made("doc_id", "'1.0'"))
    got = V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", "doc_id AS t", f"to_json(named_struct('app_id', doc_id + 1, 'body', {body})) AS payload")
    return D.parse_review_summaries(got).select("capture_id", "positive", "code")


@query("b11_odd_news", """ SELECT doc_id AS capture_id, doc_id::VARCHAR AS gid, source AS title, 'one' || chr(10) || 'two & three' AS contents, NULL::VARCHAR AS code FROM documents WHERE doc_id % 3 <> 1
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'invalid_schema' FROM documents WHERE doc_id % 3 = 1""")
def _(spark, d):
    item = lambda gid, date: f"'{{\"gid\":', {gid}, ',\"date\":', {date}, ',\"title\":\"', source, '\",\"contents\":\"<p>one</p><br>two &amp; three<script>no</script>\",\"feedname\":\"{D.NEWS_FEED}\"}}'"
    items = f"concat('[5,\"x\",null,', {item('doc_id', '7')}, ',', {item('doc_id', chr(39) + '7.0' + chr(39))}, ',', {item(chr(39) + '-1' + chr(39), '7')}, ',{{\"gid\":[]}}]')"
    body = f"concat('{{\"appnews\":{{\"appid\":', doc_id + 1, ',\"newsitems\":', CASE WHEN doc_id % 3 = 1 THEN '{{}}' ELSE {items} END, '}}}}')"
    got = V.read(spark, d, "documents").selectExpr("doc_id AS capture_id", "doc_id AS t", f"to_json(named_struct('app_id', doc_id + 1, 'body', {body})) AS payload")
    return D.parse_news(got).select("capture_id", "gid", "title", "contents", "code")
