"""All sources' captures as one table of snapshots with VARIANT values, their replay and their verification.

Each source has its parser; a ledger that is partitioned by source is read once, each parser reading its own folders.
Values are compared as JSON, in which a VARIANT's keys are in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import documents as D
from lacuna.operators.parse import parse_player_counts


@dataclass(frozen=True)
class Parser:
    """parse: captures (capture_id, app_id, t, payload) -> capture_id, value (VARIANT), code; version: that of the captures it reads."""

    version: str
    parse: Callable[[DataFrame], DataFrame]
    own_app: bool = False  # whether a capture is of one enrolled app, not of a catalog, a chart or a search


def _valued(df: DataFrame, **fields: Column | str) -> DataFrame:
    value = F.to_variant_object(F.struct(*(c.alias(k) if isinstance(c, Column) else F.col(c).alias(k) for k, c in fields.items())))
    return df.select("capture_id", F.when(F.col("code").isNull(), value).alias("value"), "code")


def _charts(counted: bool) -> Callable[[DataFrame], DataFrame]:
    def parse(captures: DataFrame) -> DataFrame:
        got = D.parse_chart_pages(captures.select("capture_id", "payload"), "payload", F.lit(counted))
        return _valued(got, items=F.col("items") if counted else F.transform("items", lambda i: F.struct(i["app_id"], i["name"], i["rank"])))

    return parse


def _details(captures: DataFrame) -> DataFrame:
    got = D.flatten_store_details(captures)
    return _valued(got, **{c: c for c in got.columns if c not in ("capture_id", "t", "code")})


PARSERS = {
    "players": Parser("1", lambda c: _valued(parse_player_counts(c), player_count="player_count"), True),
    "store_name": Parser("1", lambda c: _valued(D.parse_store_names(c), name="name"), True),
    "chart_played": Parser("1", _charts(True)),
    "chart_selling": Parser("1", _charts(False)),
    "search": Parser("1", lambda c: _valued(D.parse_search_pages(c.select("capture_id", "payload"), "payload"), items="items")),
    "catalog": Parser("1", lambda c: _valued(D.parse_catalog_pages(c), items="items", have_more_results="have_more", last_appid="last_appid")),
    "details": Parser("1", _details),
    "reviews": Parser("1", lambda c: _valued(D.parse_review_summaries(c), app_id="app_id", total_positive="positive", total_negative="negative", total_reviews="total", description="description", hundredths="hundredths")),
    "news": Parser("1", lambda c: _valued(D.news_articles(c), app_id="app_id", articles="articles")),
    "current": Parser("1", lambda c: _valued(D.parse_current_snapshots(c), app_id="app_id", player_count="player_count")),
}


def derive(ledger: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """capture_id, source, app_id, t, parser_version, value, code of every capture: what its parser makes of it, or why there is nothing.

    ledger: capture_id, source, source_version, app_id, t, payload, checksum. A payload that isn't its checksum's is
    capture_checksum_mismatch, a source or version without a parser unknown_parser_version; neither is parsed.
    """
    sound = F.sha2(F.col("payload").cast("binary"), 256).eqNullSafe(F.col("checksum"))
    fault = F.when(~sound, "capture_checksum_mismatch")
    keys = ["capture_id", "source", "app_id", "t"]
    nothing = F.lit(None).cast("variant").alias("value")
    branches = []
    for name, parser in parsers.items():
        own = ledger.where(F.col("source") == name)
        known = own.where(F.col("source_version") == parser.version).withColumn("fault", fault)
        read = parser.parse(known.where("fault is null").select(F.struct(*keys).alias("capture_id"), "app_id", "t", "payload"))  # the parser hands on what it takes for an id
        read = read.select("capture_id.*", F.lit(parser.version).alias("parser_version"), "value", "code")
        broken = known.where("fault is not null").select(*keys, F.lit(parser.version).alias("parser_version"), nothing, F.col("fault").alias("code"))
        other = own.where(~F.col("source_version").eqNullSafe(F.lit(parser.version))).select(*keys, F.col("source_version").alias("parser_version"), nothing, F.coalesce(fault, F.lit("unknown_parser_version")).alias("code"))
        branches += [read, broken, other]
    strange = ledger.where(~F.coalesce(F.col("source").isin(*parsers), F.lit(False)))
    branches.append(strange.select(*keys, F.col("source_version").alias("parser_version"), nothing, F.coalesce(fault, F.lit("unknown_parser_version")).alias("code")))
    return reduce(DataFrame.unionByName, branches)


def project(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """The derived snapshots without a fault that aren't stored yet, by capture_id."""
    return derived.where("code is null").drop("code").join(stored.select("capture_id"), "capture_id", "left_anti")


def verify(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """capture_id, fault: missing, extra, or which of source, app, time, version and value of a stored snapshot differs first from its derivation."""
    columns = {"source": "source", "app_id": "app", "t": "time", "parser_version": "version", "value": "value"}
    read = lambda df, side: df.select("capture_id", F.struct(*((F.to_json(c) if c == "value" else F.col(c)).alias(c) for c in columns)).alias(side))
    both = read(stored, "s").join(read(derived.where("code is null"), "d"), "capture_id", "full_outer")
    differs = [F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")), F.lit(f"different_{what}")) for c, what in columns.items()]
    fault = F.when(F.col("s").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise(F.coalesce(*differs))
    return both.select("capture_id", fault.alias("fault")).where("fault is not null")


def parity(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """source, captures, rejected, projected, equal: whether each source's stored snapshots and rejected captures make up its captures."""
    kept = stored.groupBy("source").agg(F.count(F.lit(1)).alias("projected"))
    seen = derived.groupBy("source").agg(F.count(F.lit(1)).alias("captures"), F.count("code").alias("rejected"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    both = seen.join(kept, "source", "full_outer").select("source", zero("captures"), zero("rejected"), zero("projected"))
    return both.withColumn("equal", F.col("captures") == F.col("rejected") + F.col("projected"))
