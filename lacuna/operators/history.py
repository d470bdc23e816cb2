"""Irregular time series: capped spans, coverage, gaps, averages; all apps at once, sorted by app and time block.

Times are microseconds (LONG), ends are exclusive, windows are half-open. Sums stay exact integers (DECIMAL where counts
are multiplied by durations) and are divided once, last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
VERSION = "capped-step-v1"
#: Width of the time blocks within which an app's samples are sorted, so that no app's history is one task.
BLOCK = 24 * 3600 * MICROS


def history_slice(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Samples with start <= t < end; the range reaches the scan."""
    return samples.where((F.col("t") >= start) & (F.col("t") < end))


def guard_history(samples: DataFrame, start: int, end: int, max_points: int, apps: DataFrame | None = None, max_days: int = 366) -> DataFrame:
    """app_id, points, rejected: an app with more points in the window than allowed is rejected, never cut.

    The window is of whole hours, 1 to max_days * 24. With apps, each of those has its row, without samples too, and no other app has one.
    """
    hours, rest = divmod(end - start, 3600 * MICROS)
    if rest or not 1 <= hours <= 24 * max_days or max_points < 1:
        raise ValueError("not a window of whole hours within the bound, or no points allowed")
    counted = history_slice(samples, start, end).groupBy("app_id").agg(F.count(F.lit(1)).alias("points"))
    if apps is not None:
        counted = apps.select("app_id").join(counted, "app_id", "left").withColumn("points", F.coalesce("points", F.lit(0).cast("bigint")))
    return counted.withColumn("rejected", F.col("points") > max_points)


def window_inputs(samples: DataFrame, start: int, end: int, reach: int | None = None) -> DataFrame:
    """The samples that a window can depend on: those within, and each app's last one before, found by partial aggregation.

    reach, if known, is how many microseconds a sample holds at most; then the scan stops that far before the window.
    """
    own = samples.select("app_id", "t", "capture_id", "player_count")
    before = own.where(F.col("t") < start)
    if reach is not None:
        before = before.where(F.col("t") >= start - reach)
    last = before.groupBy("app_id").agg(F.max(F.struct("t", "capture_id", "player_count")).alias("p")).select("app_id", "p.*")
    return history_slice(own, start, end).unionByName(last)


def _placed(samples: DataFrame, policies: DataFrame, block: int) -> DataFrame:
    """app_id, t, id, player_count, interval_seconds as of the sample, following: the t of the app's next sample.

    Samples are sorted within an app's time blocks only. What a block takes from others, the policy before and the
    sample after, comes from a table of one row per app and block.
    """
    s = samples.select("app_id", "t", F.col("capture_id").alias("id"), "player_count", F.lit(None).cast("bigint").alias("interval_seconds"), F.lit(1).alias("kind"))
    p = policies.select("app_id", F.col("started").alias("t"), "id", F.lit(None).cast("bigint").alias("player_count"), F.col("interval_seconds").cast("bigint"), F.lit(0).alias("kind"))
    both = s.unionByName(p).withColumn("block", F.expr(f"t div {block}"))
    ends = both.groupBy("app_id", "block").agg(
        F.min(F.when(F.col("kind") == 1, F.col("t"))).alias("first"),
        F.max(F.when(F.col("interval_seconds").isNotNull(), F.struct("t", "id", "interval_seconds"))).alias("latest"),
    )
    by_app = Window.partitionBy("app_id")
    earlier, later = (by_app.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("block"), F.desc("block")))
    ends = ends.select("app_id", "block", F.max("latest").over(earlier)["interval_seconds"].alias("carried"), F.min("first").over(later).alias("next_first"))
    w = Window.partitionBy("app_id", "block").orderBy("t", "kind", "id")
    known = F.last("interval_seconds", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = both.join(ends, ["app_id", "block"]).withColumn("interval_seconds", F.coalesce(known, "carried")).where("kind = 1")
    return held.withColumn("following", F.coalesce(F.lead("t").over(w), "next_first"))


def as_of_cadence(samples: DataFrame, policies: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each sample with interval_seconds of the last policy started at or before it; null before any."""
    return _placed(samples, policies, block).select("app_id", "t", F.col("id").alias("capture_id"), "player_count", "interval_seconds")


def capped_spans(samples: DataFrame, policies: DataFrame, start: int, end: int, multiplier: int = 2, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """app_id, a, b, player_count: a sample holds until the next, for `multiplier` intervals at most, clipped to the window."""
    held = _placed(window_inputs(samples, start, end, reach), policies.where(F.col("started") < end), block)
    a = F.greatest(F.lit(start), F.col("t"))
    b = F.least(F.lit(end), F.col("t") + F.col("interval_seconds") * multiplier * MICROS, F.coalesce("following", F.lit(end)))
    return held.where("interval_seconds is not null").select("app_id", a.alias("a"), b.alias("b"), "player_count").where("b > a")


def time_weighted_average(spans: DataFrame) -> DataFrame:
    """app_id, covered, integral, average (null where nothing is covered)."""
    held = F.col("b") - F.col("a")
    sums = spans.groupBy("app_id").agg(F.sum(held).alias("covered"), F.sum((F.col("player_count").cast("decimal(20,0)") * held.cast("decimal(18,0)"))).cast("decimal(38,0)").alias("integral"))
    return sums.withColumn("average", F.try_divide(F.col("integral").cast("double"), F.col("covered").cast("double")))


def _with_gaps(spans: DataFrame, apps: DataFrame, start: int, end: int, block: int = BLOCK) -> DataFrame:
    """The spans and an empty one at the window's end for each app, with gap_from: how far all before reach. Sorted within blocks, as in _placed."""
    marks = spans.select("app_id", "a", "b", "player_count").unionByName(apps.select("app_id", F.lit(end).alias("a"), F.lit(end).alias("b")), allowMissingColumns=True)
    marks = marks.withColumn("block", F.expr(f"a div {block}"))
    earlier = Window.partitionBy("app_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reached = marks.groupBy("app_id", "block").agg(F.max("b").alias("reached")).select("app_id", "block", F.max("reached").over(earlier).alias("reached"))
    before = F.max("b").over(Window.partitionBy("app_id", "block").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    return marks.join(reached, ["app_id", "block"]).select("app_id", "a", "b", "player_count", F.coalesce(F.greatest(before, "reached"), F.lit(start)).alias("gap_from"))


def gaps(spans: DataFrame, apps: DataFrame, start: int, end: int) -> DataFrame:
    """app_id, gap_from, gap_to: what no span covers, with the beginning and the end of the window."""
    return _with_gaps(spans, apps, start, end).where("a > gap_from").select("app_id", "gap_from", F.col("a").alias("gap_to"))


def expected_samples(policies: DataFrame, start: int, end: int) -> DataFrame:
    """app_id, expected, tracked: slots of each policy's period within the window, rounded up; tracked microseconds."""
    nxt = F.lead("started").over(Window.partitionBy("app_id").orderBy("started", "id"))
    p = policies.withColumn("s", F.greatest("started", F.lit(start))).withColumn("e", F.least(F.coalesce(nxt, F.lit(end)), F.lit(end))).where("e > s")
    step = F.col("interval_seconds") * MICROS
    slots = F.expr(f"(e - s + interval_seconds * {MICROS} - 1) div (interval_seconds * {MICROS})")
    return p.where(step > 0).groupBy("app_id").agg(F.sum(slots).alias("expected"), F.sum(F.col("e") - F.col("s")).alias("tracked"))


def observed_peak(samples: DataFrame, start: int, end: int) -> DataFrame:
    """app_id, points, peak over samples in the window alone."""
    return history_slice(samples, start, end).groupBy("app_id").agg(F.count(F.lit(1)).alias("points"), F.max("player_count").alias("peak"))


def coverage(samples: DataFrame, policies: DataFrame, apps: DataFrame, start: int, end: int, multiplier: int = 2, reach: int | None = None) -> DataFrame:
    """One row per app: points, covered, requested, tracked, expected, ratio, longest gap (0 if none), average, peak."""
    return _summed(_with_gaps(capped_spans(samples, policies, start, end, multiplier, reach), apps, start, end), samples, policies, apps, start, end)


def _summed(marked: DataFrame, samples: DataFrame, policies: DataFrame, apps: DataFrame, start: int, end: int, *more: Column) -> DataFrame:
    """coverage() of marked spans, and what more is aggregated from them: one pass over them for all."""
    held = F.col("b") - F.col("a")
    sums = marked.groupBy("app_id").agg(
        F.sum(held).alias("covered"), F.sum(F.col("player_count").cast("decimal(20,0)") * held.cast("decimal(18,0)")).cast("decimal(38,0)").alias("integral"),
        F.max(F.when(F.col("a") > F.col("gap_from"), F.col("a") - F.col("gap_from"))).alias("longest_gap"), *more,
    )
    sums = sums.withColumn("average", F.try_divide(F.col("integral").cast("double"), F.col("covered").cast("double"))).drop("integral")
    joined = apps.select("app_id")
    for part in (sums, observed_peak(samples, start, end), expected_samples(policies, start, end)):
        joined = joined.join(part, "app_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(
        "app_id", zero("points"), zero("covered"), F.lit(end - start).cast("bigint").alias("requested"), zero("tracked"), zero("expected"),
        (F.coalesce("covered", F.lit(0)) / F.lit(end - start)).alias("ratio"), zero("longest_gap"), "average", "peak", *(c for c in joined.columns if c == "gaps"),
    )


def history(samples: DataFrame, policies: DataFrame, apps: DataFrame, start: int, end: int, multiplier: int = 2, max_points: int = 100_000, reach: int | None = None) -> DataFrame:
    """coverage() with the points and gaps as arrays, rejected, and the estimator's version.

    An app with more than max_points in the window is rejected: it keeps its figures, and has no arrays. So no array grows with the data.
    """
    known = guard_history(samples, start, end, max_points, apps)
    short = known.where(~F.col("rejected")).select("app_id", F.lit(True).alias("short"))
    points = history_slice(samples, start, end).join(short, "app_id", "left_semi").groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("t", "capture_id", "player_count"))).alias("series"))
    marked = _with_gaps(capped_spans(samples, policies, start, end, multiplier, reach), apps, start, end).join(short, "app_id", "left")
    hole = F.when(F.col("short") & (F.col("a") > F.col("gap_from")), F.struct("gap_from", F.col("a").alias("gap_to")))
    summed = _summed(marked, samples, policies, apps, start, end, F.array_sort(F.collect_list(hole)).alias("gaps"))
    summed = summed.withColumn("rejected", F.col("points") > max_points).withColumn("gaps", F.when(~F.col("rejected"), F.col("gaps")))
    return summed.join(points, "app_id", "left").withColumn("estimator", F.lit(VERSION))


def segment_series(samples: DataFrame, policies: DataFrame, holes: DataFrame, start: int, end: int, multiplier: int = 2, block: int = BLOCK) -> DataFrame:
    """app_id, segment, first_t, last_t, points: a series breaks where a gap overlaps the step, or the step exceeds the latest interval's cap.

    In two levels: within an app's time blocks, and over a table of one row per app and block, which carries the last point, the gaps'
    last end and the number of breaks from block to block. So no app's samples are one task.
    """
    latest = policies.groupBy("app_id").agg(F.max_by("interval_seconds", F.struct("started", "id")).alias("interval_seconds"))
    points = history_slice(samples, start, end).select("app_id", "t", "capture_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("gap_to"))
    marks = holes.select("app_id", F.col("gap_from").alias("t"), F.lit(None).cast("bigint").alias("capture_id"), F.lit(2).alias("kind"), "gap_to")
    both = points.unionByName(marks).withColumn("block", F.expr(f"t div {block}"))
    by_app = Window.partitionBy("app_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("app_id", "block").agg(F.max("gap_to").alias("gap"), F.max(F.when(F.col("kind") == 1, F.col("t"))).alias("point"))
    ends = ends.select("app_id", "block", F.max("gap").over(by_app).alias("gap_before"), F.max("point").over(by_app).alias("point_before"))
    # A gap overlaps the step if it begins before this point and ends after the one before, which may lie in it, as points before any policy do.
    w = Window.partitionBy("app_id", "block").orderBy("t", "kind", "capture_id")
    seen = both.withColumn("last_gap", F.max("gap_to").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("kind = 1")
    seen = seen.withColumn("prev", F.lag("t").over(w)).join(ends, ["app_id", "block"]).join(latest, "app_id", "left")
    seen = seen.withColumn("last_gap", F.greatest("last_gap", "gap_before")).withColumn("prev", F.coalesce("prev", "point_before"))
    cut = (F.col("last_gap") > F.col("prev")) | (F.col("t") - F.col("prev") > F.col("interval_seconds") * multiplier * MICROS)
    placed = seen.select("app_id", "block", "t", "capture_id", F.when(cut, 1).otherwise(0).alias("cut"))
    within = placed.withColumn("k", F.sum("cut").over(Window.partitionBy("app_id", "block").orderBy("t", "capture_id")))
    pieces = within.groupBy("app_id", "block", "k").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("points"), F.sum("cut").alias("cuts"))
    carried = pieces.groupBy("app_id", "block").agg(F.sum("cuts").alias("cuts")).select("app_id", "block", F.coalesce(F.sum("cuts").over(by_app), F.lit(0)).alias("before"))
    joined = pieces.join(carried, ["app_id", "block"]).groupBy("app_id", (F.col("k") + F.col("before")).alias("segment"))
    return joined.agg(F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.sum("points").alias("points"))


def growth(samples: DataFrame, policies: DataFrame, apps: DataFrame, start: int, end: int, multiplier: int = 2, least_percent: int = 30, reach: int | None = None) -> DataFrame:
    """app_id, older, newer, change, note over two adjacent windows of equal length; both need coverage; a zero baseline has no percent."""
    middle = (start + end) // 2
    halves = []
    for name, a, b in (("older", start, middle), ("newer", middle, end)):
        got = time_weighted_average(capped_spans(samples, policies, a, b, multiplier, reach)).where(F.col("covered") * 100 >= (b - a) * least_percent)
        halves.append(got.select("app_id", F.col("average").alias(name)))
    both = apps.select("app_id").join(halves[0], "app_id").join(halves[1], "app_id")
    note = F.when(F.col("older") == 0, "zero_baseline").otherwise("ok")
    return both.select("app_id", "older", "newer", (F.col("newer") - F.col("older")).alias("change"), F.try_divide((F.col("newer") - F.col("older")) * 100, F.col("older")).alias("percent"), note.alias("note"))


def cut_at(spans: DataFrame, width: int) -> DataFrame:
    """The spans cut at the bounds of buckets of that width, with bucket: where theirs begins."""
    parts = spans.withColumn("k", F.explode(F.sequence(F.expr(f"a div {width}"), F.expr(f"(b - 1) div {width}")))).withColumn("bucket", F.col("k") * width)
    return parts.withColumn("a", F.greatest("a", "bucket")).withColumn("b", F.least("b", F.col("bucket") + width)).drop("k")


def player_rollup(samples: DataFrame, policies: DataFrame, start: int, end: int, width: int, multiplier: int = 2, reach: int | None = None) -> DataFrame:
    """One row per app and bucket of the window with samples or a span: parts that merge, never averages of averages.

    n, lowest, lowest_t, highest, highest_t, first_t, first_count, last_t, last_count of the samples (null without any),
    covered and integral of the capped spans, what is carried over a bucket's bounds included. Of equal extrema the first time counts.
    """
    key, tie = F.expr(f"t div {width} * {width}").alias("bucket"), F.struct("t", "capture_id")
    seen = history_slice(samples, start, end).groupBy("app_id", key).agg(
        F.count(F.lit(1)).alias("n"), F.min("player_count").alias("lowest"), F.min_by("t", F.struct("player_count", "t")).alias("lowest_t"),
        F.max("player_count").alias("highest"), F.max_by("t", F.struct("player_count", -F.col("t"))).alias("highest_t"),
        F.min("t").alias("first_t"), F.min_by("player_count", tie).alias("first_count"), F.max("t").alias("last_t"), F.max_by("player_count", tie).alias("last_count"),
    )
    held = (F.col("b") - F.col("a")).cast("decimal(18,0)")
    spans = cut_at(capped_spans(samples, policies, start, end, multiplier, reach), width)
    sums = spans.groupBy("app_id", "bucket").agg(F.sum(F.col("b") - F.col("a")).alias("covered"), F.sum(F.col("player_count").cast("decimal(20,0)") * held).cast("decimal(38,0)").alias("integral"))
    return seen.join(sums, ["app_id", "bucket"], "full").fillna(0, ["n", "covered", "integral"])


def merged_rollups(rollups: DataFrame, width: int) -> DataFrame:
    """Rollups of narrower buckets, whose width divides this one, as rollups of this width."""
    first, last = F.when(F.col("n") > 0, F.col("first_t")), F.when(F.col("n") > 0, F.col("last_t"))
    return rollups.groupBy("app_id", F.expr(f"bucket div {width} * {width}").alias("bucket")).agg(
        F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.min_by("lowest_t", F.when(F.col("n") > 0, F.struct("lowest", "lowest_t"))).alias("lowest_t"),
        F.max("highest").alias("highest"), F.max_by("highest_t", F.when(F.col("n") > 0, F.struct(F.col("highest"), -F.col("highest_t")))).alias("highest_t"),
        F.min("first_t").alias("first_t"), F.min_by("first_count", first).alias("first_count"), F.max("last_t").alias("last_t"), F.max_by("last_count", last).alias("last_count"),
        F.sum("covered").alias("covered"), F.sum("integral").cast("decimal(38,0)").alias("integral"),
    )


def policy_periods(policies: DataFrame, start: int, end: int) -> DataFrame:
    """app_id, interval_seconds, s, e: when each policy holds within the window."""
    nxt = F.lead("started").over(Window.partitionBy("app_id").orderBy("started", "id"))
    p = policies.where(F.col("started") < end).withColumn("s", F.greatest("started", F.lit(start))).withColumn("e", F.least(F.coalesce(nxt, F.lit(end)), F.lit(end)))
    return p.where("e > s AND interval_seconds > 0").select("app_id", F.col("interval_seconds").cast("bigint").alias("interval_seconds"), "s", "e")


def _met_slots(samples: DataFrame, periods: DataFrame, start: int, end: int, block: int) -> DataFrame:
    """app_id, slot: the slots of the periods (app_id, s, e, step) in which a sample lies, each once. Samples meet their period by app and time block, then a range within."""
    there = periods.withColumn("block", F.explode(F.sequence(F.expr(f"s div {block}"), F.expr(f"(e - 1) div {block}"))))
    met = history_slice(samples, start, end).select("app_id", "t").withColumn("block", F.expr(f"t div {block}")).join(there, ["app_id", "block"]).where("s <= t AND t < e")
    return met.select("app_id", F.expr("s + (t - s) div step * step").alias("slot")).distinct()


def missed_occurrences(samples: DataFrame, policies: DataFrame, start: int, end: int, block: int = BLOCK) -> DataFrame:
    """app_id, slot: slots of the policies' intervals, each counted from its policy's beginning in the window, without a sample before the next slot or policy."""
    periods = policy_periods(policies, start, end).withColumn("step", F.col("interval_seconds") * MICROS)
    slots = periods.select("app_id", F.explode(F.sequence(F.col("s"), F.col("e") - 1, F.col("step"))).alias("slot"))
    return slots.join(_met_slots(samples, periods, start, end, block), ["app_id", "slot"], "left_anti")


def occurrences(samples: DataFrame, periods: DataFrame, start: int, end: int, block: int = BLOCK) -> DataFrame:
    """app_id, expected, observed: the slots of the periods (app_id, interval_seconds, s, e), and those in which a sample lies.

    Periods of an app don't overlap. Slots are counted by division and never made; expired ones, and those without any attempt, are expected too.
    """
    held = periods.where("e > s AND interval_seconds > 0").select("app_id", "s", "e", (F.col("interval_seconds").cast("bigint") * MICROS).alias("step"))
    expected = held.groupBy("app_id").agg(F.sum(F.expr("(e - s + step - 1) div step")).alias("expected"))
    observed = _met_slots(samples, held, start, end, block).groupBy("app_id").agg(F.count(F.lit(1)).alias("observed"))
    return expected.join(observed, "app_id", "left").select("app_id", "expected", F.coalesce("observed", F.lit(0).cast("bigint")).alias("observed"))


def compare(samples: DataFrame, policies: DataFrame, apps: DataFrame, chosen: DataFrame, start: int, end: int, most: int = 10, multiplier: int = 2, reach: int | None = None) -> DataFrame:
    """One row per chosen app (app_id) over one window: availability, tracked_from, points, covered, ratio, longest_gap, average, peak.

    availability: unsupported (not among apps), untracked (no policy begins before the end), no_data, partial, available; no chosen app is left
    out. More than `most` different apps are refused, none is cut off; so the chosen side is small and narrows every scan.
    """
    own = _chosen(chosen, most)
    samples, policies = (x.join(F.broadcast(own), "app_id", "left_semi") for x in (samples, policies))
    known = apps.join(F.broadcast(own), "app_id", "left_semi").select("app_id").distinct().withColumn("known", F.lit(True))
    began = policies.where(F.col("started") < end).groupBy("app_id").agg(F.min("started").alias("tracked_from"))
    figures = coverage(samples, policies, own, start, end, multiplier, reach).join(began, "app_id", "left").join(known, "app_id", "left")
    state = F.when(F.col("known").isNull(), "unsupported").when(F.col("tracked_from").isNull(), "untracked").when(F.col("covered") == 0, "no_data")
    state = state.when(F.col("covered") < F.col("requested"), "partial").otherwise("available")
    return figures.select("app_id", state.alias("availability"), "tracked_from", "points", "covered", "ratio", "longest_gap", "average", "peak")


def compared_series(samples: DataFrame, policies: DataFrame, chosen: DataFrame, start: int, end: int, width: int, most: int = 10, multiplier: int = 2, reach: int | None = None) -> DataFrame:
    """app_id, bucket, covered, average: every chosen app on the same buckets of the window; average is null where nothing is covered, and nothing is interpolated."""
    own = _chosen(chosen, most)
    grid = own.select("app_id", F.explode(F.sequence(*(F.lit(x // width).cast("bigint") for x in (start, end - 1)))).alias("k")).select("app_id", (F.col("k") * width).alias("bucket"))
    samples, policies = (x.join(F.broadcast(own), "app_id", "left_semi") for x in (samples, policies))
    spans = cut_at(capped_spans(samples, policies, start, end, multiplier, reach), width)
    held = F.col("b") - F.col("a")
    sums = spans.groupBy("app_id", "bucket").agg(F.sum(held).alias("covered"), F.sum(F.col("player_count").cast("decimal(20,0)") * held.cast("decimal(18,0)")).cast("decimal(38,0)").alias("integral"))
    average = F.try_divide(F.col("integral").cast("double"), F.col("covered").cast("double"))
    return grid.join(sums, ["app_id", "bucket"], "left").select("app_id", "bucket", F.coalesce("covered", F.lit(0).cast("bigint")).alias("covered"), average.alias("average"))


def _chosen(chosen: DataFrame, most: int) -> DataFrame:
    """The different app_ids of chosen; more than `most` are refused."""
    own = chosen.select("app_id").where("app_id IS NOT NULL").distinct()
    if own.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} apps to compare")
    return own


def downsample(samples: DataFrame, holes: DataFrame, start: int, end: int, buckets: int) -> DataFrame:
    """At most two points per app and bucket, its lowest and its highest sample, earliest on ties; and a point without a count where a gap (app_id, gap_from) begins, so that no line is drawn across."""
    width = -(-(end - start) // buckets)
    b = F.expr(f"(t - {start}) div {width}")
    point = F.struct("t", "capture_id", "player_count")
    low = F.min_by(point, F.struct("player_count", "t", "capture_id"))
    high = F.max_by(point, F.struct(F.col("player_count"), -F.col("t"), -F.col("capture_id")))
    kept = history_slice(samples, start, end).groupBy("app_id", b.alias("bucket")).agg(F.array_distinct(F.array(low, high)).alias("p"))
    kept = kept.select("app_id", F.explode("p").alias("p")).select("app_id", "p.*")
    return kept.unionByName(holes.select("app_id", F.col("gap_from").alias("t")), allowMissingColumns=True)
