"""Latest state, snapshots and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order columns per key, by one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select(*keys, "r.*")


def latest_names(names: DataFrame) -> DataFrame:
    """app_id, name: newest, ties by source, then name, ascending."""
    w = Window.partitionBy("app_id").orderBy(F.desc("t"), "source", "name")
    return names.withColumn("n", F.row_number().over(w)).where("n = 1").select("app_id", "name", "source", "t")


def latest_n(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The n first rows per key; the limit reaches below the shuffle."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("n") <= n)


def price_history(prices: DataFrame, most: int = 100) -> DataFrame:
    """app_id, t, id, is_free, currency, initial, final: the newest observations of each app."""
    w = Window.partitionBy("app_id").orderBy(F.desc("t"), F.desc("id"))
    return prices.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("app_id", "t", "id", "is_free", "currency", "initial", "final")


def lowest_price(prices: DataFrame) -> DataFrame:
    """country, currency, app_id, lowest, at: the first time of the lowest final price of each series; observations without a price don't count."""
    return prices.where("final IS NOT NULL").groupBy("country", "currency", "app_id").agg(F.min("final").alias("lowest"), F.min_by("t", F.struct("final", "t")).alias("at"))


def price_state(is_free: Column, final: Column) -> Column:
    """free by the flag or a price of 0, priced with a price, unavailable if not free but without one, else unknown."""
    return F.when(is_free | (final == 0), "free").when(final.isNotNull(), "priced").when(~is_free, "unavailable").otherwise("unknown")


def last_run(runs: DataFrame, completions: DataFrame) -> DataFrame:
    """Per app, the newest run with its status, `unfinished` without a completion."""
    newest = latest_per_key(runs.select("app_id", "run_id", "started"), ["app_id"], ["started", "run_id"])
    return newest.join(completions.select("run_id", "finished", "status"), "run_id", "left").withColumn("status", F.coalesce("status", F.lit("unfinished")))


def app_totals(samples: DataFrame, as_of: int, day: int) -> DataFrame:
    """app_id, samples, highest, highest_24h (inclusive lower bound)."""
    return samples.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("player_count").alias("highest"), F.max(F.when(F.col("t") >= as_of - day, F.col("player_count"))).alias("highest_24h")
    )


def availability(observed: Column, interval_seconds: Column, as_of: int, multiplier: int = 2) -> Column:
    """not_tracked, no_observations, fresh or stale."""
    return (
        F.when(interval_seconds.isNull(), "not_tracked").when(observed.isNull(), "no_observations").when(F.lit(as_of) - observed <= interval_seconds * multiplier * 1_000_000, "fresh").otherwise("stale")
    )


def last_attempt(attempts: DataFrame, results: DataFrame, sources: list[str]) -> DataFrame:
    """app_id, attempt_id, dispatched, status: newest attempt of the sources; without a result it is `uncertain`."""
    newest = latest_per_key(attempts.where(F.col("source").isin(sources)).select("app_id", "attempt_id", "dispatched"), ["app_id"], ["dispatched", "attempt_id"])
    return newest.join(results.select("attempt_id", "status"), "attempt_id", "left").withColumn("status", F.coalesce("status", F.lit("uncertain")))


def app_summary(apps: DataFrame, samples: DataFrame, policies: DataFrame, attempts: DataFrame, results: DataFrame, names: DataFrame, as_of: int, day: int, sources: list[str]) -> DataFrame:
    """One row per app: name (with a fallback), totals, newest sample, cadence, availability, last attempt."""
    newest = latest_per_key(samples.select("app_id", F.col("t").alias("observed"), "capture_id", "player_count"), ["app_id"], ["observed", "capture_id"]).drop("capture_id")
    policy = latest_per_key(policies.select("app_id", "started", "id", "interval_seconds"), ["app_id"], ["started", "id"]).select("app_id", "interval_seconds")
    tried = last_attempt(attempts, results, sources).select("app_id", F.col("status").alias("last_status"))
    out = apps.select("app_id")
    for part in (latest_names(names).select("app_id", "name"), app_totals(samples, as_of, day), newest, policy, tried):
        out = out.join(part, "app_id", "left")
    return out.select(
        "app_id", F.coalesce("name", F.concat(F.lit("Steam app "), F.col("app_id").cast("string"))).alias("name"), F.coalesce("samples", F.lit(0).cast("bigint")).alias("samples"),
        "highest", "highest_24h", "observed", "player_count", "interval_seconds", availability(F.col("observed"), F.col("interval_seconds"), as_of).alias("availability"), "last_status",
    )


def availability_counts(summary: DataFrame) -> DataFrame:
    """One row: apps, tracked, fresh, stale, without observations, samples."""
    is_ = lambda s: F.count_if(F.col("availability") == s)
    return summary.agg(
        F.count(F.lit(1)).alias("apps"), F.count("interval_seconds").alias("tracked"), is_("fresh").alias("fresh"), is_("stale").alias("stale"),
        is_("no_observations").alias("without_observations"), F.sum("samples").alias("samples"),
    )


def chart_view(items: DataFrame, artwork: DataFrame, as_of: int) -> DataFrame:
    """source, app_id, rank, players, image, age_seconds of each source's newest chart; image is null without artwork (source, month, app_id, image), an age is never negative."""
    newest = items.groupBy("source").agg(F.max("month").alias("month"))
    began = F.unix_micros(F.to_timestamp(F.concat(F.col("month").cast("string"), F.lit("01")), "yyyyMMdd"))
    age = F.greatest(F.lit(0).cast("bigint"), F.floor((F.lit(as_of) - began) / 1_000_000))
    shown = items.join(newest, ["source", "month"]).join(artwork.select("source", "month", "app_id", "image"), ["source", "month", "app_id"], "left")
    return shown.select("source", "app_id", "rank", "players", "image", age.alias("age_seconds"))


def refresh_due(apps: DataFrame, completions: DataFrame, as_of: int, wait: int) -> DataFrame:
    """app_id, finished of apps that no run has finished within the wait, or ever."""
    done = completions.groupBy("app_id").agg(F.max("finished").alias("finished"))
    return apps.select("app_id").join(done, "app_id", "left").where(F.col("finished").isNull() | (F.lit(as_of) - F.col("finished") >= wait))


def instance_counts(**tables: DataFrame) -> DataFrame:
    """One row of counts, a column per table."""
    rows = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias(name))
        rows = n if rows is None else rows.crossJoin(n)
    return rows


def known_apps(*ids: DataFrame) -> DataFrame:
    """One row: distinct app ids over all tables."""
    every = ids[0]
    for x in ids[1:]:
        every = every.union(x)
    return every.agg(F.count_distinct("app_id").alias("known"))


def trending(items: DataFrame, most: int = 12) -> DataFrame:
    """source, app_id, before, after, change, tenths of a percent: the newest two snapshots of each source, gains only."""
    months = items.select("source", "month").distinct().withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("month")))).where("n <= 2")
    two = items.join(months, ["source", "month"])
    now, then = two.where("n = 1"), two.where("n = 2")
    both = now.select("source", "app_id", F.col("players").alias("after")).join(then.select("source", "app_id", F.col("players").alias("before")), ["source", "app_id"])
    gains = both.withColumn("change", F.col("after") - F.col("before")).where("change > 0").withColumn("tenths", F.expr("CASE WHEN before > 0 THEN (2000 * change + before) div (2 * before) END"))
    w = Window.partitionBy("source").orderBy(F.desc("change"), "app_id")
    return gains.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most)


def review_percent(reviews: DataFrame) -> DataFrame:
    """lang, source, positive, negative, total, hundredths of a percent (null without reviews)."""
    return reviews.select("lang", "source", "positive", (F.col("total") - F.col("positive")).alias("negative"), "total", F.expr("CASE WHEN total > 0 THEN (20000 * positive + total) div (2 * total) END").alias("hundredths"))
