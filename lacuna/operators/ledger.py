"""The request ledger: constraints, outcomes, quotas, pacing, cooldowns, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_if_absent(target: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The rows that an insert which ignores known keys would add: one per new key, of several the one that is smallest in its other columns, in their order."""
    others = [c for c in rows.columns if c not in key]
    once = rows.groupBy(*key).agg(F.min(F.struct(*others)).alias("_row")).select(*(c if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns)) if others else rows.distinct()
    return once.join(target.select(*key), list(key), "left_anti")


def enforce_constraints(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with the reason of the first rule that isn't met); a rule that is null isn't met."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    checked = df.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def enroll(policies: DataFrame) -> DataFrame:
    """Policy changes alone: a row stays if its interval differs from the one before."""
    before = F.lag("interval_seconds").over(Window.partitionBy("app_id").orderBy("started", "id"))
    return policies.withColumn("before", before).where("NOT (before <=> interval_seconds)").drop("before")


def enrolled_apps(policies: DataFrame) -> DataFrame:
    """app_id, enrolled: each app once, from its first policy on."""
    return policies.groupBy("app_id").agg(F.min("started").alias("enrolled"))


def attempts_24h(attempts: DataFrame, as_of: int, day: int, hosts: list[str]) -> DataFrame:
    """host_group, attempts after as_of - 24 h (exclusive), 0 for hosts without any."""
    spark = attempts.sparkSession
    every = spark.createDataFrame([(h,) for h in hosts], "host_group string")
    n = attempts.where((F.col("dispatched") > as_of - day) & (F.col("dispatched") <= as_of)).groupBy("host_group").agg(F.count(F.lit(1)).alias("attempts"))
    return every.join(n, "host_group", "left").select("host_group", F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"))


def active_cooldowns(cooldowns: DataFrame, as_of: int) -> DataFrame:
    return cooldowns.where(F.col("expires") > as_of).groupBy("host_group").agg(F.max("expires").alias("expires"))


def uncertain_attempts(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Attempts without a result."""
    return attempts.join(results.select("attempt_id"), "attempt_id", "left_anti")


def final_outcome(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, app_id, source, ok, requests, last_code: any success succeeds; the code is that of the last failure, null on success."""
    joined = attempts.join(results, "attempt_id", "left")
    failed = F.col("status") == "failed"
    rolled = joined.groupBy("run_id", "app_id", "source").agg(
        F.coalesce(F.bool_or(F.col("status") == "succeeded"), F.lit(False)).alias("ok"),
        F.count(F.lit(1)).alias("requests"),
        F.max_by(F.when(failed, F.col("http_status")), F.when(failed, F.struct("dispatched", "attempt_id"))).alias("code"),
    )
    return rolled.select("run_id", "app_id", "source", "ok", "requests", F.when(~F.col("ok"), F.col("code")).alias("last_code"))


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    """run_id, app_id, status: all ok succeeded, some partial, none failed."""
    state = F.when(F.bool_and("ok"), "succeeded").when(F.bool_or("ok"), "partial").otherwise("failed")
    return outcomes.groupBy("run_id", "app_id").agg(state.alias("status"))


def quota_usage(attempts: DataFrame, day: int, block: int, quotas: dict[str, int]) -> DataFrame:
    """attempt_id, host_group, dispatched, used: other attempts of the host in the 24 h up to this one, all those of its own instant with them; over: at or over the host's quota, null without one.

    Exact in two levels, so no host is one task: each attempt counts +1 from its time on and -1 from 24 h later; sums
    run within a block of time, and what earlier blocks add is a running total over blocks. Attempts without a time count among themselves alone.
    """
    plus = attempts.select("attempt_id", "host_group", F.col("dispatched").alias("at"), F.lit(1).alias("d"))
    minus = attempts.where("dispatched IS NOT NULL").select(F.lit(None).cast("bigint").alias("attempt_id"), "host_group", (F.col("dispatched") + day).alias("at"), F.lit(-1).alias("d"))
    marks = plus.unionByName(minus).withColumn("block", F.expr(f"at div {block}"))
    totals = marks.where("block IS NOT NULL").groupBy("host_group", "block").agg(F.sum("d").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("host_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("host_group").alias("_host"), F.col("block").alias("_block"), earlier.alias("before"))
    within = F.sum("d").over(Window.partitionBy("host_group", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    used = F.coalesce("before", F.lit(0).cast("bigint")) + F.col("own") - 1
    most = F.coalesce(*(F.when(F.col("host_group") == h, F.lit(n)) for h, n in quotas.items()), F.lit(None).cast("int"))
    summed = marks.withColumn("own", within).where("d > 0")
    same = F.col("host_group").eqNullSafe(F.col("_host")) & (F.col("block") == F.col("_block"))
    return summed.join(totals, same, "left").select("attempt_id", "host_group", F.col("at").alias("dispatched"), used.alias("used"), (used >= most).alias("over"))


def pacing_violations(attempts: DataFrame, spacing: dict[str, int], block: int) -> DataFrame:
    """attempt_id, host_group, dispatched, since: closer to the host's attempt before than its spacing (microseconds).

    The one before is sought within a block of time; the first of a block takes the last of an earlier one.
    """
    a = attempts.select("attempt_id", "host_group", "dispatched").withColumn("block", F.expr(f"dispatched div {block}"))
    lasts = a.groupBy("host_group", "block").agg(F.max("dispatched").alias("last"))
    lasts = lasts.select("host_group", "block", F.lag("last").over(Window.partitionBy("host_group").orderBy("block")).alias("carried"))
    own = F.lag("dispatched").over(Window.partitionBy("host_group", "block").orderBy("dispatched", "attempt_id"))
    stepped = a.withColumn("own", own).join(lasts, ["host_group", "block"]).withColumn("since", F.col("dispatched") - F.coalesce("own", "carried"))
    least = F.coalesce(*(F.when(F.col("host_group") == h, F.lit(s)) for h, s in spacing.items()))
    return stepped.where(F.col("since") < least).select("attempt_id", "host_group", "dispatched", "since")


def cooldown_violations(attempts: DataFrame, cooldowns: DataFrame, width: int) -> DataFrame:
    """attempt_id, host_group, dispatched of attempts made while a cooldown of the host was active: a range join by time buckets."""
    c = cooldowns.select("host_group", "recorded", "expires", F.explode(F.sequence(F.expr(f"recorded div {width}"), F.expr(f"expires div {width}"))).alias("bucket"))
    a = attempts.select("attempt_id", "host_group", "dispatched").withColumn("bucket", F.expr(f"dispatched div {width}"))
    return a.join(c.where("expires > recorded"), ["host_group", "bucket"]).where("recorded <= dispatched AND dispatched < expires").select("attempt_id", "host_group", "dispatched").distinct()


def cooldowns_from_failures(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """attempt_id, host_group, recorded, expires for failures that name a positive wait."""
    return results.where("status = 'failed' AND retry_after > 0").join(attempts.select("attempt_id", "host_group"), "attempt_id").select("attempt_id", "host_group", F.col("completed").alias("recorded"), (F.col("completed") + F.col("retry_after") * 1_000_000).alias("expires"))


def classify_http(code: Column) -> Column:
    return F.when(code == 200, "ok").when(code.isin(429, 500, 502, 503, 504), "retryable").otherwise("final")


def verify_checksums(captures: DataFrame) -> DataFrame:
    """capture_id of captures whose payload hasn't its checksum."""
    return captures.where(~F.sha2("payload", 256).eqNullSafe(F.col("checksum"))).select("capture_id")


def bound_payload(captures: DataFrame, most: int) -> DataFrame:
    """capture_id, n_bytes of payloads that are too large."""
    return captures.select("capture_id", F.octet_length("payload").cast("bigint").alias("n_bytes")).where(F.col("n_bytes") > most)


def capture_manifest(captures: DataFrame, blocks: int) -> DataFrame:
    """block, n, digest over id:checksum lines in order of id within each block of ids."""
    lines = captures.select(F.expr(f"capture_id div {blocks}").alias("block"), F.struct("capture_id", F.concat_ws(":", F.col("capture_id").cast("string"), "checksum").alias("line")).alias("l"))
    return lines.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n"), 256).alias("digest"))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One row, n and digest over all blocks of a capture_manifest, in their order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    return manifest.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


def verify_projections(stored: DataFrame, derived: DataFrame, *key: str) -> DataFrame:
    """The key and what is wrong with a stored row against its re-derivation: missing, extra or different in any other column; nothing for equal rows."""
    columns = [c for c in stored.columns if c not in key]
    s, d = stored.select(*key, F.struct(*columns).alias("s")), derived.select(*key, F.struct(*columns).alias("d"))
    fault = F.when(F.col("s").isNull(), "missing").when(F.col("d").isNull(), "extra").when(~F.col("s").eqNullSafe(F.col("d")), "different")
    return s.join(d, list(key), "full_outer").select(*key, fault.alias("fault")).where("fault is not null")


def capacity_plan(policies: DataFrame, quota: int) -> DataFrame:
    """interval_seconds, apps, calls per day, and whether the calls of all tiers together fit: a tier is an interval; an app is in that of its latest policy."""
    latest = policies.groupBy("app_id").agg(F.max_by("interval_seconds", F.struct("started", "id")).alias("interval_seconds"))
    tiers = latest.groupBy("interval_seconds").agg(F.count(F.lit(1)).alias("apps")).withColumn("calls", F.expr("apps * 86400 div interval_seconds"))
    together = tiers.agg((F.sum("calls") <= quota).alias("within_quota"))  # one row
    return tiers.crossJoin(F.broadcast(together))


def count_parity(parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """captures, projected, rejected, equal: whether what is stored and what was rejected make up the captures."""
    captures = parsed.agg(F.count(F.lit(1)).alias("captures"), F.count("code").alias("rejected"))
    both = captures.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("projected"))))  # one row each
    return both.select("captures", "projected", "rejected", (F.col("captures") == F.col("projected") + F.col("rejected")).alias("equal"))
