"""Landing, the ledger's batches, snapshots of several sources, constraints, and the read model's commits, on small tables."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import constraints as Q
from lacuna.operators import ledger as L
from lacuna.operators import readmodel as M
from lacuna.operators import snapshots as N
from lacuna.sources import landing

DAY = 86_400_000_000


def line(k, source="a", day=0, payload="p", **more):
    return json.dumps({"capture_id": f"c{k}", "attempt_id": k, "run_id": 1, "app_id": 5, "source": source, "source_version": "1", "request_started": day * DAY + k, "received": day * DAY + k + 3, "http_status": 200, "parameters": "{}", "payload": payload, "capture_form": "raw"} | more)


def landed(spark, path, lines):
    path.mkdir()
    (path / "x.json").write_text("\n".join(lines))
    return landing.read_landing(spark, str(path))


def test_batches_are_taken_in_once(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    first = landed(spark, tmp_path / "one", [line(1), line(2, "b", 3), line(1, payload="later", received=9), "{", '{"capture_id": 5', line(3, received=-1), line(4, payload=None), "[]", ""])
    for _ in range(2):
        got = {r.capture_id: r for r in landing.ingest_captures(first, ledger, "one").collect()}
        assert set(got) == {"c1", "c2"} and got["c1"].payload == "p" and got["c1"].took == 3 and got["c1"].checksum == hashlib.sha256(b"p").hexdigest()
    second = landed(spark, tmp_path / "two", [line(1), line(6), line(7, "b", 3, payload="é")])
    assert {r.capture_id: r.n_bytes for r in landing.ingest_captures(second, ledger, "two").collect()} == {"c6": 1, "c7": 2}
    landing.ingest_captures(first, ledger, "one")
    rows = landing.read_ledger(spark, ledger)
    assert sorted(r.capture_id for r in rows.collect()) == ["c1", "c2", "c6", "c7"]
    plan = rows.where("source = 'b' AND received_day = DATE'1970-01-04'")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in pruned and "received_day" in pruned
    codes = {r.code: r.n for r in landing.landing_faults(first).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert codes[None] == 3 and codes["received_before_request"] == 1 and codes["missing_payload"] == 1 and codes["corrupt_record"] >= 2


def test_derivation_of_unsound_captures(spark):
    good = '{"response":{"result":1,"player_count":3}}'
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [
        ("a", "players", "1", 5, 1, good, sha(good)), ("b", "players", "1", 5, 1, good, "x"), ("c", "players", "2", 5, 1, good, sha(good)), ("d", "odd", "1", 5, 1, good, sha(good)), ("e", None, None, None, None, None, None),
        ("f", "news", "1", None, 1, "[", sha("[")), ("g", "players", None, 5, 1, good, sha(good)),
    ]
    ledger = spark.createDataFrame(rows, "capture_id string, source string, source_version string, app_id long, t long, payload string, checksum string")
    derived = N.derive(ledger)
    got = {r.capture_id: (r.code, r.v) for r in derived.select("capture_id", "code", F.to_json("value").alias("v")).collect()}
    assert got == {
        "a": (None, '{"player_count":3}'), "b": ("capture_checksum_mismatch", None), "c": ("unknown_parser_version", None), "d": ("unknown_parser_version", None), "e": ("unknown_parser_version", None),
        "f": ("invalid_json", None), "g": ("unknown_parser_version", None),
    }
    assert N.verify(N.project(derived, derived.limit(0)), derived).count() == 0
    assert [r.capture_id for r in N.project(derived, derived.limit(0)).collect()] == ["a"]


def test_all_reasons_of_a_row(spark, tmp_path):
    apps = spark.createDataFrame([(1,), (0,), (1,), (None,)], "app_id long")
    intervals = spark.createDataFrame([(1, 1, 5, 300), (1, 1, 4, 300), (2, 0, None, 9), (3, None, 1, None), (4, 9, 1, 604800)], "id long, app_id long, started long, interval_seconds int")
    found = Q.enforce_schema({"app": apps, "tracking_interval": intervals}, str(tmp_path))
    assert [r.app_id for r in found["app"][0].collect()] == [1]
    assert sorted((str(r.app_id), r.reasons) for r in found["app"][1].collect()) == [("0", ["app_id_range"]), ("1", ["repeated_app_id"]), ("None", ["null_app_id"])]
    good, rejected = found["tracking_interval"]
    assert good.count() == 1
    assert sorted((r.id, r.reasons) for r in rejected.collect()) == [
        (1, ["repeated_id"]), (2, ["null_started", "interval_range", "unreferenced_app_id"]), (3, ["null_app_id", "null_interval_seconds"]), (4, ["unreferenced_app_id"])
    ]


def test_append_keeps_one_row_whatever_the_order(spark):
    rows = [(1, "b"), (1, "a"), (2, "c"), (3, None), (3, "x")]
    known = spark.createDataFrame([(2,)], "k long")
    for some in (rows, rows[::-1]):
        got = L.append_if_absent(known, spark.createDataFrame(some, "k long, v string"), "k").collect()
        assert sorted((r.k, r.v) for r in got) == [(1, "a"), (3, None)] or sorted((r.k, str(r.v)) for r in got) == [(1, "a"), (3, "None")]


def test_only_committed_versions_are_read(spark, tmp_path):
    docs = lambda n: spark.createDataFrame([("app", str(k), "{}") for k in range(n)], "kind string, key string, document string")
    path = f"{tmp_path}/model"
    M.write_read_model(docs(3), path, 1)
    M.write_read_model(docs(5), path, 2)
    docs(9).write.partitionBy("kind").json(f"{path}/documents/version=3")
    assert M.read_read_model(spark, path).count() == 5 and M.read_read_model(spark, path, 1).count() == 3
    with pytest.raises(ValueError, match="committed"):
        M.read_read_model(spark, path, 3)


def test_days_share_folders_and_a_day_reads_its_own(spark, tmp_path):
    days = [-300, -129, -128, -1, 0, 1, 127, 128, 255, 700]
    some = landed(spark, tmp_path / "days", [line(k, "ab"[k % 2], day) for k, day in enumerate(d for d in days for _ in range(6))])
    path = f"{tmp_path}/ledger"
    landing.ingest_captures(some, path, "one")
    files = list((tmp_path / "ledger").rglob("*.parquet"))
    assert len(files) == 2 * 6  # two sources, six folders of 128 days
    rows, epoch = landing.read_ledger(spark, path), datetime.date(1970, 1, 1)
    assert rows.count() == 60 and "received_days" not in rows.columns
    scanned = lambda df: {f.split("received_days=")[1].split("/")[0] for f in (r[0] for r in df.select(F.input_file_name()).distinct().collect())}
    for d in days:
        day = epoch + datetime.timedelta(d)
        own = rows.where(F.col("received_day") == F.lit(day))
        assert own.count() == 6 and scanned(own) == {str(epoch + datetime.timedelta(d // 128 * 128))}
        pruned = own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "received_days" in pruned and str(epoch + datetime.timedelta(d // 128 * 128)) in pruned
    for since, until in ((-129, 127), (0, None), (None, -1), (1, 1), (128, 200)):
        bounds = [None if x is None else epoch + datetime.timedelta(x) for x in (since, until)]
        got = landing.read_ledger(spark, path, *bounds)
        want = sorted(d for d in days if (since is None or d >= since) and (until is None or d <= until))
        assert sorted({(r[0] - epoch).days for r in got.select("received_day").collect()}) == want and got.count() == 6 * len(want)
        assert "received_days" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    landing.ingest_captures(some.where("attempt_id < 30"), path, "two")  # all of them are known
    assert rows.count() == 60 and landing.read_ledger(spark, path).count() == 60


def test_a_large_folder_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "PIECE", 1000)
    some = landed(spark, tmp_path / "much", [line(k, payload="x" * 100) for k in range(200)] + [line(1000, "b")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        landing.ingest_captures(some, f"{tmp_path}/ledger", "one")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [str(f) for f in (tmp_path / "ledger").rglob("*.parquet")]
    assert sum("source=a" in f for f in files) > 1 and sum("source=b" in f for f in files) == 1
    assert landing.read_ledger(spark, f"{tmp_path}/ledger").count() == 201


def test_repeats_across_folders_and_batches_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    some = lambda: [(rng.randrange(40), rng.choice("ab"), rng.choice((-1, 0, 5, 127, 128, 300)), rng.choice(("p", "q"))) for _ in range(120)]
    ledger, want = f"{tmp_path}/ledger", {}
    batches = {b: some() for b in ("one", "two")}
    batches["two"] += batches["one"][:30]
    read = {b: landed(spark, tmp_path / b, [line(*x) for x in rows]) for b, rows in batches.items()}
    for batch in ("one", "two", "one"):
        first = {}
        for k, source, day, payload in batches[batch]:
            at = (day * DAY + k + 3, hashlib.sha256(payload.encode()).hexdigest(), source, day)
            first[k] = min(first.get(k, at), at)
        others = {(k, source, day) for b, rows in want.items() if b != batch for k, (_, _, source, day) in rows.items()}
        want[batch] = {k: x for k, x in first.items() if (k, x[2], x[3]) not in others}
        landing.ingest_captures(read[batch], ledger, batch)
    got = landing.read_ledger(spark, ledger).collect()
    assert sorted((r.batch, int(r.capture_id[1:]), r.received, r.checksum, r.source, (r.received_day - datetime.date(1970, 1, 1)).days) for r in got) == sorted((b, k, *x) for b, rows in want.items() for k, x in rows.items())
    assert all(hashlib.sha256(r.payload.encode()).hexdigest() == r.checksum for r in got) and 0 < len(want["two"]) < 40
