"""Stateful streams give the same rows however the input is dealt over batches."""

import datetime as dt

from lacuna.streaming import ledger as K

SCHEMA = "app_id long, t long, kind int, id long, amount long, at timestamp"


def row(app, second, kind, number, amount):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)
    return (app, int(at.timestamp()) * 1_000_000, kind, number, amount, at)


def test_spans_in_one_and_in_many_batches(spark, tmp_path):
    # App 1: each sample is held until the next or for two intervals; app 2 has no policy before its first sample.
    rows = [row(1, 0, 0, 0, 60), row(1, 10, 1, 1, 5), row(1, 70, 1, 2, 6), row(1, 400, 1, 3, 7), row(2, 20, 1, 4, 8), row(2, 30, 0, 5, 60), row(2, 50, 1, 6, 9), row(1, 430, 1, 7, 3)]
    last = [row(3, 5000, 1, 8, 1)]  # moves the watermark past all others
    found = []
    for name, parts in (("one", [rows + last]), ("many", [[rows[1], rows[0]], [rows[4], rows[2], rows[5]], [rows[7], rows[3], rows[6]], last])):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
        got = K.drained(K.stream_capped_spans(stream, "at", "1000 seconds"), name).collect()
        start = rows[0][1]
        found.append(sorted((r.app_id, (r.a - start) // 1_000_000, (r.b - start) // 1_000_000, r.player_count, r.expired) for r in got))
    assert found[0] == found[1] == [(1, 10, 70, 5, False), (1, 70, 190, 6, True), (1, 400, 430, 7, False), (1, 430, 550, 3, True), (2, 50, 170, 9, True)]


def test_a_backlog_in_one_batch(spark, tmp_path):
    """Some hundreds of rows of one app wait at once, each as its own entry of the state; spans are as by definition."""
    rows = [row(1, 0, 0, 0, 60)] + [row(1, 7 * k, 1, k + 1, k) for k in range(300)] + [row(2, 90_000, 1, 999, 1)]
    spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    got = sorted(K.drained(K.stream_capped_spans(stream, "at", "10 seconds"), "backlog").collect(), key=lambda r: r.a)
    start = rows[0][1]
    assert [((r.a - start) // 1_000_000, (r.b - start) // 1_000_000, r.player_count, r.expired) for r in got] == [(7 * k, 7 * k + 7, k, False) for k in range(299)] + [(2093, 2213, 299, True)]


def test_late_rows_change_only_their_folders(spark, tmp_path):
    import pathlib

    day, schema, path = 100, "capture_id long, app_id long, t long, player_count long", f"{tmp_path}/roll"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = lambda: {str(f.relative_to(path)) for f in pathlib.Path(path, "rollup").rglob("*.parquet")}
    put(0, [(1, 7, 10, 5), (2, 7, 110, 6), (3, 8, 10, 7), (4, 7, 950, 1)])
    assert K.stream_rollup(stream(), path, 50, day).count() == 4
    before = files()
    put(1, [(5, 7, 20, 9), (6, 7, 940, 2)])  # the first is behind the mark of 900, the second is not
    got = {(r.app_id, r.day): (r.n, r.highest, r.n_late) for r in K.stream_rollup(stream(), path, 50, day).collect()}
    assert got == {(7, 0): (2, 9, 1), (7, 1): (1, 6, 0), (8, 0): (1, 7, 0), (7, 9): (2, 2, 0)}
    changed = {f.rsplit("/", 1)[0] for f in before ^ files()}
    assert {f.split("day=")[1].split("/")[0] for f in changed} == {"0", "9"} and len(changed) == 2
    assert [r.capture_id for r in spark.read.parquet(f"{path}/late").collect()] == [5]
    batch = spark.createDataFrame([(5, 7, 20, 9), (6, 7, 940, 2)], schema)
    K.rewrite_touched(batch, 1, path, 50, day)  # a repeated batch
    assert {(r.app_id, r.day): (r.n, r.highest, r.n_late) for r in spark.read.parquet(f"{path}/rollup").collect()} == got
