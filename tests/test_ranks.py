"""Ranks over ranges, pages that read only their partitions, and the digest tree however rows are dealt."""

import random

from pyspark.sql import functions as F

from lacuna.operators import history as H
from lacuna.operators import ranks as O


def test_ranks_and_pages(spark, tmp_path):
    rows = [(k, f"name {k % 7}" if k % 11 else None) for k in range(500)]
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    path = f"{tmp_path}/ranked"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        O.write_ranked(spark.createDataFrame(rows, "app_id long, name string"), path, F.col("name"), F.col("app_id"), partitions=6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = O.read_ranked(spark, path).orderBy("rank").collect()
    assert [(r.app_id, r.name) for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))
    assert O.total(spark, path).first()[0] == 500
    for offset, size in ((0, 10), (95, 40), (490, 100), (500, 5), (2**39, 100)):
        page = O.read_page(spark, path, offset, size)
        assert [(r.app_id, r.name) for r in page.orderBy("rank").collect()] == want[offset : offset + size]
    plan = O.read_page(spark, path, 95, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan.replace("isnotnull(_part", "_part").replace("PartitionFilters: [(_part", "PartitionFilters: [_part") or "PartitionFilters: [_part#" in plan
    assert "SinglePartition" not in O.read_ranked(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_digest_tree_in_any_order(spark, tmp_path):
    rows = [(k, f"c{k}", (k * 7919) % 1000) for k in range(700)] + [(5000, "late", 2500)]
    trees = []
    for run, parts in enumerate((1, 7)):
        random.Random(run).shuffle(rows)
        df = spark.createDataFrame(rows, "capture_id long, checksum string, received long").repartition(parts)
        trees.append(sorted(tuple(-1 if x is None else x for x in r) for r in O.digest_tree(df, f"{tmp_path}/{run}", 100, 4).collect()))
    assert trees[0] == trees[1]
    tops = [r for r in trees[0] if r[0] == max(x[0] for x in trees[0])]
    assert len(tops) == 1 and tops[0][3] == len(rows)
    assert O.digest_tree(spark.createDataFrame([], "capture_id long, checksum string, received long"), f"{tmp_path}/none", 100, 4).count() == 0


def test_segments_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    samples = [(1 + k % 3, rng.randrange(0, 10_000) * 1_000_000, k, k) for k in range(400)]
    df = spark.createDataFrame(samples, "app_id long, t long, capture_id long, player_count long")
    policies = spark.createDataFrame([(1, 1, 0, 20), (2, 2, 0, 60)], "id long, app_id long, started long, interval_seconds int")
    apps = df.select("app_id").distinct()
    end = 10_000 * 1_000_000
    holes = H.gaps(H.capped_spans(df, policies, 0, end), apps, 0, end)
    found = [sorted(map(tuple, H.segment_series(df, policies, holes, 0, end, block=b).collect())) for b in (end * 2, 500_000_000, 37_000_000)]
    assert found[0] == found[1] == found[2] and sum(r[4] for r in found[0]) == 400
