"""The golden histories: samples and policies in seconds from a start, multiplier 2."""

import pytest

from lacuna.operators import history as H
from lacuna.operators import profiles as R

S = 1_000_000
CASES = [
    # samples, policies, window, expected
    ([(0, 10), (300, 20), (1500, 100)], [(0, 300)], (0, 1800), {"average": 37.5, "covered": 1200, "longest_gap": 600, "peak": 100}),
    ([(-120, 40), (300, 100)], [(-1000, 300)], (0, 600), {"average": 70.0, "points": 1, "covered": 600, "peak": 100}),
    ([], [(1800, 300)], (0, 3600), {"average": None, "peak": None, "expected": 6, "tracked": 1800, "longest_gap": 3600, "ratio": 0.0}),
    ([(0, 0)], [(0, 300)], (0, 600), {"average": 0.0, "peak": 0, "covered": 600}),
    ([(1800, 50)], [(1800, 300)], (0, 3600), {"covered": 600, "ratio": 1 / 6, "tracked": 1800}),
    ([(0, 10), (600, 20)], [(0, 300), (600, 600)], (0, 1800), {"expected": 4, "covered": 1800, "average": 50 / 3}),
    ([(600, 10)], [(0, 300)], (0, 600), {"average": None, "covered": 0, "points": 0, "peak": None}),
    ([(600, 10)], [(0, 300)], (600, 1200), {"points": 1, "peak": 10}),
]
MICROS = {"covered", "longest_gap", "tracked"}


@pytest.mark.parametrize("case", CASES)
def test_golden(spark, case):
    samples, policies, (start, end), want = case
    s = spark.createDataFrame([(i, 1, t * S, n) for i, (t, n) in enumerate(samples)], "capture_id long, app_id long, t long, player_count long")
    p = spark.createDataFrame([(i, 1, t * S, n) for i, (t, n) in enumerate(policies)], "id long, app_id long, started long, interval_seconds long")
    apps = spark.createDataFrame([(1,)], "app_id long")
    got = H.coverage(s, p, apps, start * S, end * S).first().asDict()
    for name, value in want.items():
        assert got[name] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value * S if name in MICROS else value), name


def test_covered_and_gaps_fill_the_window(spark):
    s = spark.createDataFrame([(i, i % 3, (i * 7919 % 5000) * S, i) for i in range(60)], "capture_id long, app_id long, t long, player_count long")
    p = spark.createDataFrame([(i, i % 3, i * 100 * S, 60 * (1 + i % 4)) for i in range(9)], "id long, app_id long, started long, interval_seconds long")
    apps = spark.createDataFrame([(i,) for i in range(4)], "app_id long")
    spans = H.capped_spans(s, p, 100 * S, 4000 * S)
    total = {r.app_id: 0 for r in apps.collect()}
    for r in spans.collect():
        total[r.app_id] += r.b - r.a
    for r in H.gaps(spans, apps, 100 * S, 4000 * S).collect():
        total[r.app_id] += r.gap_to - r.gap_from
    assert set(total.values()) == {3900 * S}


def irregular(spark):
    s = spark.createDataFrame([(i, i % 3, (i * 7919 % 5000) * S, i * 37 % 101) for i in range(90)], "capture_id long, app_id long, t long, player_count long")
    p = spark.createDataFrame([(i, i % 3, i * 400 * S, 60 * (1 + i % 4)) for i in range(9)], "id long, app_id long, started long, interval_seconds long")
    return s, p, spark.createDataFrame([(i,) for i in range(4)], "app_id long")


def test_time_blocks_change_nothing(spark):
    s, p, apps = irregular(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    spans = [H.capped_spans(s, p, 300 * S, 4500 * S, block=b * S) for b in (130, 10**6)]
    assert rows(spans[0]) == rows(spans[1])
    assert rows(H.as_of_cadence(s, p, 130 * S)) == rows(H.as_of_cadence(s, p, 10**6 * S))
    holes = [H._with_gaps(spans[1], apps, 300 * S, 4500 * S, b * S) for b in (130, 10**6)]
    assert rows(holes[0]) == rows(holes[1])


def test_rollups_merge(spark):
    s, p, apps = irregular(spark)
    narrow, wide = (H.player_rollup(s, p, 0, 6000 * S, w * S) for w in (500, 3000))
    rows = lambda df: sorted(map(tuple, df.select(wide.columns).collect()), key=repr)
    assert rows(H.merged_rollups(narrow, 3000 * S)) == rows(wide)


def test_history_has_no_arrays_beyond_the_bound(spark):
    s, p, apps = irregular(spark)
    got = {r.app_id: r for r in H.history(s.where("app_id = 0 OR capture_id < 9"), p, apps, 0, 7200 * S, max_points=10).collect()}
    assert got[0].rejected and got[0].series is None and got[0].gaps is None and got[0].points == 30
    assert not got[1].rejected and len(got[1].series) == 3 and got[3].series is None and len(got[3].gaps) == 1


def test_occurrences_of_enabled_periods(spark):
    s = spark.createDataFrame([(i, a, t * S, 1) for i, (a, t) in enumerate([(1, 0), (1, 10), (1, 299), (1, 300), (1, 950), (1, 2000), (3, 5)])], "capture_id long, app_id long, t long, player_count long")
    p = spark.createDataFrame([(1, 300, 0, 1000 * S), (1, 600, 1500 * S, 3000 * S), (2, 300, 0, 900 * S), (2, 300, 5 * S, 5 * S)], "app_id long, interval_seconds long, s long, e long")
    for block in (70, 10**5):  # 4 slots of 300 s, the last cut short, and 3 of 600 s; samples outside the periods count for none
        got = {r.app_id: (r.expected, r.observed) for r in H.occurrences(s, p, 0, 3600 * S, block * S).collect()}
        assert got == {1: (7, 4), 2: (3, 0)}


def test_freshness_report_counts_apps_without_samples(spark):
    fresh = spark.createDataFrame([(1, 90, 100), (2, 0, 100)], "app_id long, fresh long, tracked long")
    occurred = spark.createDataFrame([(1, 10, 9), (2, 10, 0)], "app_id long, expected long, observed long")
    assert tuple(R.freshness_report(fresh, occurred).first()) == (2, 200, 90, 110, 0.45, False, 20, 9)
    assert R.freshness_report(fresh, occurred, 45).first().passes
    nothing = R.freshness_report(fresh.limit(0), occurred.limit(0)).first()
    assert nothing.apps == 0 and nothing.ratio is None and nothing.passes is None


def test_compare_keeps_every_chosen_app(spark):
    s, p, apps = irregular(spark)
    apps = apps.unionByName(spark.createDataFrame([(7,)], "app_id long"))
    p = p.unionByName(spark.createDataFrame([(99, 3, 0, 60)], "id long, app_id long, started long, interval_seconds long"))
    chosen = spark.createDataFrame([(0,), (0,), (3,), (7,), (8,), (None,)], "app_id long")
    got = {r.app_id: r for r in H.compare(s, p, apps, chosen, 0, 3600 * S).collect()}
    assert {a: r.availability for a, r in got.items()} == {0: "partial", 3: "no_data", 7: "untracked", 8: "unsupported"}
    one = H.coverage(s, p, apps, 0, 3600 * S).where("app_id = 0").first()
    assert all(got[0][c] == one[c] for c in ("points", "covered", "ratio", "longest_gap", "average", "peak")) and got[0].tracked_from == 0
    series = H.compared_series(s, p, chosen, 0, 3600 * S, 900 * S).collect()
    assert sorted((r.app_id, r.bucket // S) for r in series) == [(a, k * 900) for a in (0, 3, 7, 8) for k in range(4)]
    assert sum(r.covered for r in series) == one.covered and all((r.average is None) == (r.covered == 0) for r in series)
    with pytest.raises(ValueError):
        H.compare(s, p, apps, chosen, 0, 3600 * S, most=3)
