"""What is known of an app across sources: carried samples, source status, updates, profiles, changes between summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.state import latest_per_key


def carry_in(samples: DataFrame, start: int) -> DataFrame:
    """app_id, t, capture_id, player_count: the last sample before start."""
    return latest_per_key(samples.where(F.col("t") < start).select("app_id", "t", "capture_id", "player_count"), ["app_id"], ["t", "capture_id"])


def recent_updates(snapshots: DataFrame, sources: list[str], most: int = 20) -> DataFrame:
    """app_id, source, t, capture_id: the newest snapshots of each app over the sources."""
    newest = Window.partitionBy("app_id").orderBy(F.desc("t"), F.desc("capture_id"))
    return snapshots.where(F.col("source").isin(sources)).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most).select("app_id", "source", "t", "capture_id")


def latest_snapshot_per_source(snapshots: DataFrame) -> DataFrame:
    """app_id, source, t, capture_id: the newest snapshot of each app and source."""
    return latest_per_key(snapshots.select("app_id", "source", "t", "capture_id"), ["app_id", "source"], ["t", "capture_id"])


def source_status(attempts: DataFrame, results: DataFrame, run_outcomes: DataFrame) -> DataFrame:
    """source, at, status: of the newest attempt, unless a run (source, run_id, finished, ok) that ended no earlier failed for it.

    An attempt without a result is uncertain. Sources that only runs name are shown if they failed.
    """
    tried = latest_per_key(attempts.select("source", "dispatched", "attempt_id"), ["source"], ["dispatched", "attempt_id"])
    tried = tried.join(results.select("attempt_id", "status"), "attempt_id", "left").select("source", "dispatched", F.coalesce("status", F.lit("uncertain")).alias("status"))
    ended = latest_per_key(run_outcomes.select("source", "finished", "run_id", "ok"), ["source"], ["finished", "run_id"])
    both = tried.join(ended, "source", "full")
    failed = F.coalesce(~F.col("ok") & (F.col("dispatched").isNull() | (F.col("finished") >= F.col("dispatched"))), F.lit(False))
    both = both.select("source", F.when(failed, F.col("finished")).otherwise(F.col("dispatched")).alias("at"), F.when(failed, "failed").otherwise(F.col("status")).alias("status"))
    return both.where("at is not null")


def newest_count_across_sources(tracked: DataFrame, detail: DataFrame) -> DataFrame:
    """app_id, player_count, at, peak from two tables of (app_id, at, player_count, peak): the detail's count goes if the tracked one is newer, peaks are the larger of both."""
    a = tracked.select("app_id", F.col("at").alias("at_a"), F.col("player_count").alias("count_a"), F.col("peak").alias("peak_a"))
    b = detail.select("app_id", F.col("at").alias("at_b"), F.col("player_count").alias("count_b"), F.col("peak").alias("peak_b"))
    use_a = F.col("at_b").isNull() | F.coalesce(F.col("at_a") > F.col("at_b"), F.lit(False))
    pick = lambda x, y: F.when(use_a, F.col(x)).otherwise(F.col(y))
    return a.join(b, "app_id", "full").select("app_id", pick("count_a", "count_b").alias("player_count"), pick("at_a", "at_b").alias("at"), F.greatest("peak_a", "peak_b").alias("peak"))


def discovered_apps(entries: DataFrame, charts: DataFrame) -> DataFrame:
    """app_id, name, t, source of the newest catalog entry, and charts: the app's places (source, rank, players) in the newest charts."""
    newest = charts.groupBy("source").agg(F.max("month").alias("month"))
    places = charts.join(newest, ["source", "month"]).groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("source", "rank", "players"))).alias("charts"))
    return entries.join(places, "app_id", "left").withColumn("charts", F.coalesce("charts", F.array().cast("array<struct<source:string,rank:bigint,players:bigint>>")))


def review_deltas(summaries: DataFrame, identity: list[str], order: str) -> DataFrame:
    """summaries with change_positive and change_total against the one before of the same query identity; negative changes are kept."""
    before = Window.partitionBy(*identity).orderBy(order)
    change = lambda c: (F.col(c) - F.lag(c).over(before)).alias(f"change_{c}")
    return summaries.select(*identity, order, "positive", "total", change("positive"), change("total"))


def freshness_coverage(spans: DataFrame, enabled: DataFrame, block: int) -> DataFrame:
    """app_id, fresh, tracked: microseconds that spans (app_id, a, b) cover within the enabled intervals (app_id, s, e), and all of those.

    Both sides are cut at the bounds of time blocks and met by app and block, so no app with a long history is one task's work.
    """

    def cut(df: DataFrame, lo: str, hi: str) -> DataFrame:
        parts = df.where(F.col(hi) > F.col(lo)).withColumn("block", F.explode(F.sequence(F.expr(f"{lo} div {block}"), F.expr(f"({hi} - 1) div {block}"))))
        return parts.select("app_id", "block", F.greatest(lo, F.col("block") * block).alias(lo), F.least(hi, (F.col("block") + 1) * block).alias(hi))

    both = cut(spans.select("app_id", "a", "b"), "a", "b").join(cut(enabled.select("app_id", "s", "e"), "s", "e"), ["app_id", "block"])
    fresh = both.withColumn("shared", F.least("b", "e") - F.greatest("a", "s")).where("shared > 0").groupBy("app_id").agg(F.sum("shared").alias("fresh"))
    tracked = enabled.where("e > s").groupBy("app_id").agg(F.sum(F.col("e") - F.col("s")).alias("tracked"))
    return tracked.join(fresh, "app_id", "left").select("app_id", F.coalesce("fresh", F.lit(0).cast("bigint")).alias("fresh"), "tracked")


def freshness_report(fresh: DataFrame, occurred: DataFrame, target_percent: int = 95) -> DataFrame:
    """One row: apps, tracked, fresh, stale (microseconds), ratio, passes, expected and observed occurrences, over freshness_coverage() and history.occurrences().

    Apps without any sample are in every denominator. Without tracked time ratio and passes are null.
    """
    both = fresh.join(occurred, "app_id", "full").agg(
        F.count("tracked").alias("apps"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tracked", "fresh", "expected", "observed"))
    )
    passes = F.when(F.col("tracked") > 0, F.col("fresh").cast("decimal(38,0)") * 100 >= F.col("tracked").cast("decimal(38,0)") * target_percent)
    return both.select("apps", "tracked", "fresh", (F.col("tracked") - F.col("fresh")).alias("stale"), F.try_divide(F.col("fresh").cast("double"), F.col("tracked").cast("double")).alias("ratio"), passes.alias("passes"), "expected", "observed")


def achievement_join(definitions: DataFrame, percentages: DataFrame) -> DataFrame:
    """key, name, percent, state from definitions (key, name) and percentages (key, percent): unsupported where no percentage is known, unknown_key without a definition, invalid outside 0 to 100."""
    both = definitions.withColumn("defined", F.lit(True)).join(percentages.withColumn("measured", F.lit(True)), "key", "full")
    state = F.when(F.col("measured").isNull(), "unsupported").when(F.col("defined").isNull(), "unknown_key").when(F.coalesce(F.col("percent").between(0, 100), F.lit(False)), "ok").otherwise("invalid")
    return both.select("key", "name", F.when(state == "ok", F.col("percent")).alias("percent"), state.alias("state"))


#: The sources whose snapshots are of one game.
GAME_SOURCES = ("details", "reviews", "news", "current")


def game_profiles(names: DataFrame, snapshots: DataFrame, samples: DataFrame, charts: DataFrame, prices: DataFrame, updates: int = 20) -> DataFrame:
    """One row for each app of names: name, charts, metadata, reviews, news and current (VARIANT values of the newest snapshots), when each was seen, newest count, prices, updates.

    names: app_id, name, t, source; snapshots: capture_id, source, app_id, t, value (the app is the value's own where app_id is null); samples:
    app_id, t, capture_id, player_count; charts as discovered_apps takes them; prices: app_id, final. current is null where the app's own sample is
    newer; player_count is that of the newer of both. All of an app's sources come from one aggregation with partial sums; no array but the
    newest chart places and `updates` update times grows with the data.
    """
    own = F.coalesce("app_id", F.try_variant_get("value", "$.app_id", "bigint"))
    seen = snapshots.where(F.col("source").isin(*GAME_SOURCES) & F.col("value").isNotNull()).withColumn("app_id", own)
    of = lambda s: F.col("source") == s
    newest = [F.max_by(F.when(of(s), F.struct("t", "value")), F.when(of(s), F.struct("t", "capture_id"))).alias(s) for s in GAME_SOURCES]
    latest = seen.groupBy("app_id").agg(*newest)
    sampled = samples.groupBy("app_id").agg(F.max_by(F.struct("t", "player_count"), F.struct("t", "capture_id")).alias("sample"), F.count(F.lit(1)).alias("samples"), F.max("player_count").alias("highest"))
    priced = prices.groupBy("app_id").agg(F.min("final").alias("lowest_price"), F.count("final").alias("prices"))
    recent = recent_updates(seen.select("app_id", "source", "t", "capture_id"), list(GAME_SOURCES), updates).groupBy("app_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("t", "source")))).alias("updates"))
    found = discovered_apps(names, charts)
    for part in (latest, sampled, priced, recent):
        found = found.join(part, "app_id", "left")
    older = F.coalesce(F.col("sample.t") > F.col("current.t"), F.lit(False))
    found = found.withColumn("current", F.when(~older, F.col("current")))
    count = F.coalesce(F.try_variant_get("current.value", "$.player_count", "bigint"), F.col("sample.player_count"))
    values = [c for s, name in zip(GAME_SOURCES, ("metadata", "reviews", "news", "current")) for c in (F.col(f"{s}.value").alias(name), F.col(f"{s}.t").alias(f"{name}_at"))]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return found.select("app_id", "name", "charts", *values, count.alias("player_count"), zero("samples"), "highest", "lowest_price", zero("prices"), F.coalesce("updates", F.array().cast("array<struct<t:bigint,source:string>>")).alias("updates"))
