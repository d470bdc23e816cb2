"""The ledger's constraints over several tables, all reasons of a row at once.

Each table has not-null columns, checks, enumerations, unique keys and references. Tables are judged in the order of
their references: a row may only refer to a row that is itself good. Of rows with one unique key the first by the
table's order is good, as an insert in that order has it. Nulls are as in SQL: a check that isn't false holds, a null
reference refers to nothing, null keys are never equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """order: the columns by which rows come in, the key's among them; checks are SQL; references: own column -> (table, its column)."""

    order: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


_SNAPSHOT = Rules(("observed", "capture_id"), ("capture_id", "observed", "parser_version"), {}, {}, (("capture_id",),), {"capture_id": ("capture", "capture_id")})

#: What the ledger's tables must hold.
LEDGER_RULES = {
    "app": Rules(("app_id",), ("app_id",), {"app_id_range": "app_id BETWEEN 1 AND 4294967295"}, {}, (("app_id",),)),
    "tracking_interval": Rules(("id",), ("id", "app_id", "started", "interval_seconds"), {"interval_range": "interval_seconds BETWEEN 300 AND 604800"}, {}, (("id",),), {"app_id": ("app", "app_id")}),
    "collection_run": Rules(("started", "run_id"), ("run_id", "started"), {}, {}, (("run_id",),)),
    "run_completion": Rules(("finished", "run_id"), ("run_id", "finished", "status"), {}, {"status": ("succeeded", "partial", "failed")}, (("run_id",),), {"run_id": ("collection_run", "run_id")}),
    "request_attempt": Rules(
        ("dispatched", "attempt_id"), ("attempt_id", "run_id", "source", "host_group", "dispatched"), {}, {"host_group": ("webapi", "store")}, (("attempt_id",),), {"run_id": ("collection_run", "run_id"), "app_id": ("app", "app_id")}
    ),
    "request_result": Rules(("completed", "attempt_id"), ("attempt_id", "completed", "status"), {}, {"status": ("succeeded", "failed")}, (("attempt_id",),), {"attempt_id": ("request_attempt", "attempt_id")}),
    "source_cooldown": Rules(
        ("recorded", "cooldown_id"), ("cooldown_id", "attempt_id", "host_group", "recorded", "expires"), {}, {"host_group": ("webapi", "store")}, (("cooldown_id",), ("attempt_id",)), {"attempt_id": ("request_attempt", "attempt_id")}
    ),
    "capture": Rules(
        ("received", "capture_id"), ("capture_id", "attempt_id", "run_id", "source", "source_version", "request_started", "received", "http_status", "payload", "checksum"), {"checksum_length": "length(checksum) = 64"}, {},
        (("capture_id",), ("attempt_id",)), {"attempt_id": ("request_attempt", "attempt_id"), "run_id": ("collection_run", "run_id"), "app_id": ("app", "app_id")},
    ),
    "player_sample": Rules(
        ("observed", "capture_id"), ("capture_id", "app_id", "observed", "player_count", "parser_version"), {"player_count_range": "player_count >= 0"}, {}, (("capture_id",),), {"capture_id": ("capture", "capture_id"), "app_id": ("app", "app_id")}
    ),
    "app_name": Rules(("observed", "capture_id"), ("capture_id", "app_id", "observed", "name", "parser_version"), {}, {}, (("capture_id",),), {"capture_id": ("capture", "capture_id"), "app_id": ("app", "app_id")}),
    "discovery_snapshot": _SNAPSHOT,
    "catalog_entry": Rules(("capture_id", "app_id"), ("capture_id", "app_id", "name"), {"app_id_range": "app_id BETWEEN 1 AND 4294967295"}, {}, (("capture_id", "app_id"),), {"capture_id": ("discovery_snapshot", "capture_id")}),
}


def _own_reasons(rules: Rules) -> Column:
    """What a row shows by itself, in one projection."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"null_{c}")) for c in rules.not_null]
    broken = [F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(name)) for name, sql in rules.checks.items()]
    strange = [F.when(~F.coalesce(F.col(c).isin(*values), F.lit(True)), F.lit(f"unknown_{c}")) for c, values in rules.enums.items()]
    return F.array_compact(F.array(*missing, *broken, *strange, F.lit(None).cast("string")))


def judged(rows: DataFrame, rules: Rules, good: dict[str, DataFrame]) -> DataFrame:
    """rows with reasons, in order: null_<column>, checks by name, unknown_<column>, unreferenced_<column>, repeated_<key>; empty for a good row.

    good: the good rows of the tables that are referred to. A repeated key counts among rows that have no other reason, so a bad
    row takes no key. Each reference and each key is one equi-join or aggregation; Spark broadcasts the small ones by size.
    """
    out = rows.withColumn("reasons", _own_reasons(rules))
    for column, (table, other) in rules.references.items():
        known = good[table].select(F.col(other).alias(column), F.lit(True).alias("_known")).where(F.col(column).isNotNull()).distinct()
        out = out.join(known, column, "left")
        lost = F.when(F.col(column).isNotNull() & F.col("_known").isNull(), F.array(F.lit(f"unreferenced_{column}"))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn("reasons", F.concat("reasons", lost)).drop("_known")
    for key in rules.unique:
        place = F.struct(*(F.col(c) for c in rules.order), F.xxhash64(*(c for c in rows.columns)))
        whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in key))
        taken = out.where(whole & (F.size("reasons") == 0)).groupBy(*key).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        out = out.join(taken, list(key), "left")
        said, none = F.array(F.lit("repeated_" + "_".join(key))), F.array().cast("array<string>")
        among = F.coalesce((F.size("reasons") == 0) & F.col("_first").isNotNull(), F.lit(False))
        out = out.withColumn("_first", F.when(among, place == F.col("_first")))  # null: the key isn't repeated
        other = out.where(F.coalesce(~F.col("_first"), F.lit(True))).withColumn("reasons", F.concat("reasons", F.when(F.col("_first").isNull(), none).otherwise(said)))
        same = out.where("_first").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))  # equal in every column: one of them stays
        same = same.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).withColumn("reasons", F.when(F.col("_k") == 1, none).otherwise(said))
        out = other.select(*rows.columns, "reasons").unionByName(same.select(*rows.columns, "reasons"))
    return out.select(*rows.columns, "reasons")


def enforce_schema(tables: dict[str, DataFrame], folder: str, rules: dict[str, Rules] = LEDGER_RULES) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each given table (good rows, rejected rows with reasons). A reference to a table that isn't given is an error.

    Each judged table is written once below folder, which all executors share, and read from there by the tables that refer to it.
    """
    found: dict[str, tuple[DataFrame, DataFrame]] = {}
    good: dict[str, DataFrame] = {}
    for name, own in rules.items():
        if name in tables:
            rows = judged(tables[name], own, good)
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")
            good[name] = rows.where(F.size("reasons") == 0).drop("reasons")
            found[name] = good[name], rows.where(F.size("reasons") > 0)
    return found
