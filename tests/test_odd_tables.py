"""Queries against their SQL on small made-up tables that hold what the sample tables don't."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lacuna.plans import ORACLES, QUERIES
from tests.test_queries import rows

START = datetime.datetime(2024, 1, 15)
EVENTS = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])


def same(spark, folder, name, **tables):
    """The rows of a query, equal to those of its SQL."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t, table in tables.items():
        pq.write_table(table, f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert sorted(got.columns) == sorted(want.columns) and found == rows(want.columns, want.fetchall())
    return got.columns, found


def events(*of):
    """Events of (hours from the window's start, user, type)."""
    made = [(k, None if h is None else START + datetime.timedelta(hours=h), user, kind, 1.5 + k, '{"k": 3}') for k, (h, user, kind) in enumerate(of)]
    return pa.Table.from_pylist([dict(zip(EVENTS.names, r, strict=True)) for r in made], EVENTS)


def test_segments_of_samples_within_a_gap(spark, tmp_path):
    before = [(h, 1, "view") for h in (1, 2, 2, 5, 25, 26, 49)]  # no policy yet, so one gap holds them all
    after = [(50, 1, "signup"), (51, 1, "click"), (52, 1, "click"), (75, 1, "view"), (76, 1, "view")]
    never = [(h, 2, "view") for h in (1, 2, 30)]
    columns, found = same(spark, tmp_path, "e12_segment_series", events=events(*before, *after, *never, (-9, 3, "signup"), (1, 3, "view"), (2, 3, "view")))
    app, segment, points = (sorted(columns).index(c) for c in ("app_id", "segment", "points"))
    sizes = {a: [r[points] for r in sorted(found, key=lambda r: r[segment]) if r[app] == a] for a in (2, 3, 4)}
    assert sizes == {2: [1] * 7 + [2, 2], 3: [1] * 3, 4: [2]}


def test_attempts_of_one_instant_count_together(spark, tmp_path):
    tied = [(0, 1, "view")] * 40 + [(0, 2, "click"), (9, 1, "signup"), (9, 2, "purchase"), (9, 2, "signup")]
    later = [(24, 1, "view"), (24, 3, "error"), (33, 1, "signup"), (33, 1, "signup"), (33 + 1e-9 * 3600, 4, "signup"), (47.99, 1, "view"), (48, 1, "view")]
    columns, found = same(spark, tmp_path, "g01_quota_usage", events=events(*tied, *later, (None, 1, "view"), (None, 2, "click"), (None, 3, "signup")))
    at = [sorted(columns).index(c) for c in ("attempt_id", "used", "over")]
    got = {r[at[0]]: (r[at[1]], r[at[2]]) for r in found}
    assert len(got) == 54 and {got[k] for k in range(41)} == {(40, True)} and {got[k] for k in (41, 42, 43)} == {(2, False)}
    assert got[44] == got[45] == (1, False) and got[51] == got[52] == (1, False) and got[53] == (0, False)


@pytest.mark.parametrize("ids", [[50 * k for k in range(300)], [k for k in range(0, 20_000, 3)], [3, 7, 8], [50 * k for k in range(16)], []], ids=["300 days", "400 days", "3", "16 days", "none"])
def test_digest_trees_of_many_and_few_days(spark, tmp_path, ids):
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([None if k % 7 == 3 else f"text {k}" for k in ids], pa.string()), "source": pa.array(["s"] * len(ids), pa.string())})
    columns, found = same(spark, tmp_path, "h04_digest_tree", documents=docs)
    level, n = (sorted(columns).index(c) for c in ("level", "n"))
    assert {r[level] for r in found} == ({0, 1, 2, 3} if len(ids) > 16 else {0, 1, 2} if ids else set())
    assert all(sum(r[n] for r in found if r[level] == k) == len(ids) for k in {r[level] for r in found})
