"""Registered queries cover every row of their tables, counted by hand."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidewatch import scratch
from tidewatch.operators import stats
from tidewatch.plans import catalog, reader_queries, recorder_queries


def event_table(spark, folder, rows):
    """rows: user_id, event_id, ts, event_type, value."""
    spark.createDataFrame([(*r, "{}") for r in rows], "user_id long, event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_every_event_is_a_poll(spark, tmp_path):
    kinds = ["view", "error", "purchase", "purchase", "view", "click", "error", "view", "view", "click", "view"]
    rows = [(i % 3, i + 1, datetime(2024, 1, 1, i), kind, 1.0) for i, kind in enumerate(kinds)]
    found = {r["job_id"]: (r["final_status"], r["final_seq"], r["polls"]) for r in recorder_queries.clip_poll_outcome(spark, event_table(spark, tmp_path, rows)).collect()}
    expected = {}
    for job in range(3):
        said = [(seq, {"purchase": "done", "error": "error"}.get(kind)) for user, seq, _, kind, _ in rows if user == job]
        ends = [(status, seq) for seq, status in said if status]
        expected[job] = (*(ends[0] if ends else (None, None)), len(said))
    assert found == expected
    assert found[1] == ("error", 2, 4)


def test_every_window_meets_the_segments_of_its_own_camera(spark, tmp_path):
    rows, n = [], 0
    for cam in (3, 10, 11, 20):
        for day in range(1, 9):
            for hour in (1, 2, 9 + cam % 4, 20):
                n += 1
                rows.append((cam, n, datetime(2024, 1, day, hour), "view", 90.0 if (day * cam + hour) % 5 < 3 else 1.0))
    folder = event_table(spark, tmp_path, rows)
    parts = [(r["cam_id"], r["start_ms"], r["end_ms"]) for r in recorder_queries.segment_parse(spark, folder).collect()]
    windows = {(r["cam_id"], r["clip_start_ms"], r["clip_stop_ms"]): 0 for r in recorder_queries.clip_windows(spark, folder).collect()}
    expected = set()
    for cam, start, stop in windows:
        met = [(a, b) for c, a, b in parts if c == cam and a < stop and b > start]
        if met:
            expected.add((cam, start, stop, len(met), min(a for a, _ in met), max(b for _, b in met)))
    found = [tuple(r) for r in recorder_queries.segment_overlap(spark, folder).collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert {r[0] for r in found} == {3, 10, 11, 20}


def rank(x):
    return float(np.sort(x)[int(np.floor(0.95 * (len(x) - 1)))])


@pytest.mark.parametrize("rows", [None, 20])
def test_loop_windows_are_as_long_as_the_readers(spark, tmp_path, rows):
    """None: the registered queries, whose windows are the operators' own 1000 and 512; 20: the short window."""
    value = np.random.default_rng(3).uniform(0, 100, 1040).round(3)
    folder = event_table(spark, tmp_path, [(1, i, datetime(2024, 1, 1) + timedelta(minutes=i), "view", float(v)) for i, v in enumerate(value)])
    loops = reader_queries._loops(spark, folder)
    for query, operator, window, p95 in (
        (reader_queries.loop_stats_linear_p95, stats.loop_stats_linear, 1000, lambda x: float(np.quantile(x, 0.95))),
        (reader_queries.loop_stats_rank_p95, stats.loop_stats_rank, 512, rank),
    ):
        found = {r["frame_id"]: r for r in (query(spark, folder) if rows is None else operator(loops, rows=rows)).collect()}
        assert len(found) == len(value)
        for i in range(len(value)):
            last = np.minimum(1.0, value[max(0, i + 1 - (rows or window)) : i + 1] / 100) * 1000
            assert (found[i]["loop_us_mean"], found[i]["loop_us_p95"]) == pytest.approx((last.mean(), p95(last)), abs=2e-6)


def test_dumps_of_many_cameras_take_few_files(spark, tmp_path):
    """Not a folder for each; frames without a camera, time or number leave the others' slots where they are."""
    rows = [((i * 5003) ** 3, i, datetime(2024, 1, 1) + timedelta(seconds=i), "view", 1.0) for i in range(1, 301)]
    rows[10], rows[20], rows[30] = (None, *rows[10][1:]), (*rows[20][:2], None, *rows[20][3:]), (rows[30][0], None, *rows[30][2:])
    folder, before = event_table(spark, tmp_path, rows), scratch.standing(spark)
    found = {tuple(r) for r in reader_queries.ring_dump_scan(spark, folder).collect()}
    start = 1_704_067_200
    assert found == {(user, i, ts and (start + i) * 10**9, 2, 8, str(i).rjust(8, "x")) for user, i, ts, *_ in rows if i is not None and i % 9}
    (path,) = scratch.standing(spark) - before
    assert sum(p.suffix == ".txt" for p in Path(path.removeprefix("file://")).rglob("*")) <= 8


@pytest.mark.parametrize("name", ["log_scan", "segment_parse", "segments_last_n", "segments_last_n_by_camera", "ring_header_decode"])
def test_large_camera_numbers_agree_with_sql(spark, tmp_path, name):
    cams = (3, 14, 9_999, 10_000, 10_003, 65_534, 65_535, 89_999, 1_000_006)
    rows = [(cam, 1000 * n + i, datetime(2024, 1, 5 + i // 2, cam % 11, n, i), "view", 1.0) for n, cam in enumerate(cams) for i in range(14)]
    folder = event_table(spark, tmp_path, rows)
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, folder)
    expected = duck.execute(f"select {', '.join(found.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert len(expected) >= 45


def test_last_segments_come_in_the_order_of_their_sql(spark, tmp_path):
    """Copies of cameras start together: index and path place them, also where there is no index."""
    rows = [(cam + 1500 * k, 100 * k + i, datetime(2024, 1, 5 + i // 2, 3, cam, i), "view", 1.0) for k in range(30) for cam in (7, 8) for i in range(4)]
    folder = event_table(spark, tmp_path, rows)
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    expected = duck.execute(catalog.ORACLE_SQL["segments_last_n"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["segments_last_n"](spark, folder).collect()] == expected
    assert len(expected) == 50 and sum(r[0] == "-" for r in expected) > 2


def test_last_segments_of_cameras_are_not_sorted_as_a_whole(spark, tmp_path):
    """Its SQL has no order."""
    folder = event_table(spark, tmp_path, [(cam, 10 * cam + i, datetime(2024, 1, 5 + i), "view", 1.0) for cam in range(20) for i in range(8)])
    found = catalog.QUERIES["segments_last_n_by_camera"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "rangepartitioning" not in plan
    assert found.count() == 100
