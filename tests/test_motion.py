from __future__ import annotations

import math
import time

import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.config import ClipConfig, EventConfig
from tidewatch.functions.timebase import Timebase
from tidewatch.operators import chunked, clips, fold, motion, stride
from tidewatch.operators.fold import Frame
from tidewatch.streaming.motion import motion_event_stream, run_available

#: (min_event, min_gap, merge_gap), frames (t, score), events (start, stop), traced by hand.
VECTORS = {
    "basic": ((0, 0, 0), [(0, 0), (100, 0.1), (200, 0.6), (300, 0.7), (400, 0.4), (500, 0.2)], [(200, 300)]),
    "merge": ((0, 0, 500), [(0, 0), (100, 0.6), (200, 0.6), (300, 0.2), (450, 0.6), (550, 0.6), (650, 0.2), (1000, 0)], [(100, 550)]),
    "emitted while the next is active": ((0, 0, 500), [(0, 0.6), (100, 0.6), (200, 0.2), (300, 0.6), (400, 0.6), (500, 0.6), (600, 0.6), (700, 0.2)], [(0, 100), (300, 600)]),
    "gap equal to merge_gap": ((0, 0, 500), [(0, 0.6), (100, 0.2), (500, 0.6), (600, 0.2)], [(0, 0), (500, 500)]),
    "one off frame is enough": ((0, 400, 0), [(0, 0.6), (100, 0.4), (200, 0.2), (300, 0.4), (400, 0.4), (500, 0.2)], [(0, 0)]),
    "the middle band never closes": ((0, 0, 0), [(0, 0.6), (10000, 0.4), (20000, 0.6), (20100, 0.2)], [(0, 20000)]),
    "short bursts do not bridge": ((500, 0, 1000), [(0, 0.6), (600, 0.6), (700, 0.2), (800, 0.6), (900, 0.2), (1000, 0.6), (1550, 0.6), (1600, 0.2)], [(0, 1550)]),
    "filter before merge": ((500, 0, 1000), [(0, 0.6), (300, 0.6), (400, 0.2), (500, 0.6), (800, 0.6), (900, 0.2)], []),
    "flush": ((0, 400, 2000), [(0, 0.6), (100, 0.7)], [(0, 100)]),
    "single": ((0, 0, 0), [(5, 0.9)], [(5, 5)]),
    "never on": ((0, 0, 0), [(0, 0.1), (1, 0.4)], []),
    "not a number": ((0, 0, 0), [(0, 0.6), (1, math.nan), (2, 0.7), (3, 0.1)], [(0, 2)]),
}
SCHEMA = "cam_id string, frame_id long, pts_ms double, score double"


def config(times):
    return EventConfig(0.5, 0.3, *map(float, times))


def test_vectors_in_windows_and_fold(spark):
    for name, (times, frames, expected) in VECTORS.items():
        rows = [(name, i, float(t), float(s)) for i, (t, s) in enumerate(frames)]
        found = motion.motion_events(spark.createDataFrame(rows, SCHEMA), config(times)).orderBy("start_ms").collect()
        assert [(r["start_ms"], r["stop_ms"]) for r in found] == expected, name
        spans = list(fold.fold([Frame(float(t), float(s)) for t, s in frames], config(times)))
        assert [(s.start, s.stop) for s in spans] == expected, name


def test_telemetry_of_closing_frames_counts_and_of_idle_frames_does_not(spark):
    schema = SCHEMA + ", wind_like boolean, real_override boolean, foliage_motion_frac double, wind_idx double, wind_state string, zones_active_frac double"
    say = lambda t, s, idx, state="": ("c", int(t), float(t), s, False, idx > 0.5, 0.0, idx, state, 0.0)
    closing = spark.createDataFrame([say(0, 0.6, 0.1, "Calm"), say(100, 0.2, 0.9)], schema)
    event = motion.motion_events(closing, config((0, 0, 0)), telemetry=True).first()
    assert (event["wind_idx"], event["wind_state"], event["real_override"]) == (0.9, "Calm", True)
    idle = spark.createDataFrame([say(0, 0.6, 0.1), say(50, 0.2, 0.1), say(100, 0.2, 0.9), say(200, 0.6, 0.2), say(300, 0.2, 0.1)], schema)
    event = motion.motion_events(idle, config((0, 0, 500)), telemetry=True).first()
    assert (event["n_activations"], event["wind_idx"], event["wind_state"]) == (2, 0.2, "")


@st.composite
def streams(draw):
    steps = draw(st.lists(st.tuples(st.sampled_from([0, 1, 1, 2, 5, 9]), st.sampled_from([0.0, 0.2, 0.3, 0.4, 0.5, 0.8, math.nan])), min_size=1, max_size=25))
    t, frames = 0, []
    for gap, score in steps:
        t += gap
        frames.append((float(t), score))
    return frames


def as_sets(found, expected):
    return sorted((r["start_ms"], r["stop_ms"], r["max_score"]) for r in found) == sorted((s.start, s.stop, s.max_score) for s in expected)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(cases=st.lists(streams(), min_size=30, max_size=60), times=st.tuples(*[st.sampled_from([0, 1, 3, 8])] * 3))
def test_windows_equal_fold_on_random_streams(spark, cases, times):
    rows = [(str(k), i, t, s) for k, frames in enumerate(cases) for i, (t, s) in enumerate(frames)]
    found = motion.motion_events(spark.createDataFrame(rows, SCHEMA), config(times)).collect()
    cut = chunked.motion_events(spark.createDataFrame(rows, SCHEMA), config(times), chunk_ms=4.0).collect()
    for k, frames in enumerate(cases):
        expected = list(fold.fold([Frame(*f) for f in frames], config(times)))
        for rows in (found, cut):
            assert as_sets([r for r in rows if r["cam_id"] == str(k)], expected), (frames, times)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(cases=st.lists(streams(), min_size=30, max_size=60), times=st.tuples(*[st.sampled_from([0, 1, 3, 8])] * 3))
def test_emission_is_the_first_frame_that_lets_an_event_go(spark, cases, times):
    cfg = config(times)
    frames = spark.createDataFrame([(str(k), i, t, s) for k, rows in enumerate(cases) for i, (t, s) in enumerate(rows)], SCHEMA)
    events = motion.motion_events(frames, cfg)
    for chunk_ms in (None, 4.0):
        found = sorted((int(r["cam_id"]), r["start_ms"], r["stop_ms"], r["emit_ms"] or math.inf) for r in motion.with_emission(events, frames, cfg, chunk_ms=chunk_ms).collect())
        expected = []
        for k, rows in enumerate(cases):
            state = fold.State()
            for frame in rows:
                state, out = fold.step(state, Frame(*frame), cfg)
                expected += [(k, s.start, s.stop, frame[0] or math.inf) for s in out]
            expected += [(k, s.start, s.stop, math.inf) for s in fold.flush(state, cfg)]
        for x, y in zip(found, sorted(expected), strict=True):
            assert x == y, (cases[x[0]], times)


def test_one_camera_of_many_frames_is_linear(spark):
    """A scan ahead of every row would take minutes here."""
    frames = spark.range(200_000).selectExpr("'c' as cam_id", "id as frame_id", "id * 40.0D as pts_ms", "case when id % 100 < 30 then 0.9D else 0.1D end as score")
    cfg = EventConfig(0.5, 0.3, 100, 200, 500)
    began = time.monotonic()
    found = motion.with_emission(motion.motion_events(frames, cfg), frames, cfg).agg(F.count("*"), F.sum(F.col("emit_ms") - F.col("stop_ms"))).first()
    assert tuple(found) == (2000, 2000 * 520.0)
    assert time.monotonic() - began < 60


def test_chunks_take_two_scans(spark, tmp_path):
    spark.createDataFrame([("c", 0, 0.0, 0.5)], SCHEMA).write.parquet(str(tmp_path / "f"))
    plan = chunked.motion_events(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2 and plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") <= 6


def test_settings_without_a_closed_form_are_refused(spark):
    frames = spark.createDataFrame([("c", 0, 0.0, 0.5)], SCHEMA)
    with pytest.raises(ValueError):
        motion.motion_events(frames, EventConfig(0.5, 0.5))
    assert fold.motion_events_fold(frames, EventConfig(0.5, 0.5, 0, 0, 0)).count() == 1


def test_empty_input_gives_no_events(spark):
    assert motion.motion_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_exchange_and_one_sort_up_to_the_activations(spark):
    frames = spark.createDataFrame([("c", 0, 0.0, 0.5)], SCHEMA)
    plan = motion.member_frames(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 3, 7]])
def test_stream_equals_batch_for_any_micro_batches(spark, tmp_path, cuts):
    times, frames, _ = VECTORS["short bursts do not bridge"]
    edges = [0, *cuts, len(frames)]
    schema = SCHEMA + ", ends boolean"
    for low, high in zip(edges, edges[1:]):
        rows = [(c, i, float(frames[i][0]), float(frames[i][1]), False) for i in range(low, high) for c in "ab"]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(c, None, None, None, True) for c in "ab"], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_available(motion_event_stream(arriving, config(times)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["cam_id"], r["start_ms"], r["stop_ms"]) for r in found) == [("a", 0, 1550), ("b", 0, 1550)]


def test_stride_counts_arrivals_and_holds_nulls(spark):
    rows = [("c", 10 * i, float(i), s) for i, s in enumerate([0.1, 0.2, 0.3, None, 0.5, 0.6, 0.7])]
    held = stride.stride_hold(spark.createDataFrame(rows, SCHEMA), 3, ["score"]).orderBy("pts_ms").collect()
    assert [r["score"] for r in held] == [0.1, 0.1, 0.1, None, None, None, 0.7]


def test_clip_windows_and_requests(spark):
    schema = "start_ms double, stop_ms double"
    window = lambda a, b, cfg: tuple(clips.clip_windows(spark.createDataFrame([(float(a), float(b))], schema), cfg).select("clip_start_ms", "clip_stop_ms").first())
    assert window(1000, 1000, ClipConfig()) == (0, 4000)
    assert window(0, 200000, ClipConfig()) == (0, 120000)
    assert window(500, 600, ClipConfig(0, 0)) == (500, 3500)
    assert window(0, 100, ClipConfig(0, 0, 5000, 4000)) == (0, 4000)
    event = spark.createDataFrame([(10000.0, 12000.0)], schema)
    request = clips.clip_requests(event, ClipConfig(1000, 2000, 0, 60000, out_dir="/clips"), Timebase(0, 0, "epoch_ms")).first()
    assert (request["start_pts_ns"], request["stop_pts_ns"], request["start_epoch_ms"], request["label"], request["out_dir"]) == (9000, 14000, None, "motion", "/clips")
    request = clips.clip_requests(spark.createDataFrame([(5000.0, 7000.0)], schema), ClipConfig(0, 0, 0)).first()
    assert (request["start_pts_ns"], request["start_epoch_ms"], request["stop_epoch_ms"]) == (None, 5000.0, 7000.0)
    pair = spark.createDataFrame([(1000.0, 2000.0), (2300.0, 2600.0)], schema)
    assert clips.clip_requests(pair, ClipConfig(0, 0, 0)).count() == 2


def test_fold_takes_pandas_rows_without_telemetry():
    rows = pd.DataFrame({"pts_ms": [0.0, 1.0], "score": [0.9, None]})
    assert [f.wind_state for f in fold.frames_of(rows)] == ["Unknown", "Unknown"]
