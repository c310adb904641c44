from __future__ import annotations

import json
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch import cli
from tidewatch.config import ClipConfig, EventConfig, MotionConfig, RecorderConfig
from tidewatch.functions.timebase import Timebase, now_ms
from tidewatch.operators import fold, frames, motion, stats
from tidewatch.plans.pipeline import deliver, motion_pipeline, scored_frames
from tidewatch.sinks.recorder import send_requests
from tidewatch.sinks.sidecar import motion_event_records
from tidewatch.sources import discovery


def images(spark):
    """Ten seconds of frames; a square moves in seconds 4 to 6."""
    rows = []
    for i in range(100):
        image = np.zeros((16, 16, 3), np.uint8)
        if 40 <= i < 60:
            image[4:12, 4 + i % 4 : 12] = 200
        rows.append(("c", i, 1.7e12 + 100.0 * i, 16, 16, image.tobytes()))
    return spark.createDataFrame(rows, "cam_id string, frame_id long, pts_ms double, width int, height int, img binary")


class Service:
    def post(self, url, json=None, timeout=None):
        return SimpleNamespace(status_code=200, json=lambda: {"id": "1"})

    def get(self, url, timeout=None):
        return SimpleNamespace(status_code=200, json=lambda: {"status": "done", "path": "/c.mp4"})


@pytest.mark.parametrize("variant", ["windows", "chunks", "fold"])
def test_from_pixels_to_clips(spark, tmp_path, variant):
    scored = scored_frames(images(spark), MotionConfig(score_scale=5.0), frames.RunningGaussian)
    cfg = EventConfig(0.5, 0.3 if variant != "fold" else 0.5, 100, 200, 1000)
    out = motion_pipeline(scored, Timebase(1.7e12, 0, "ns"), cfg, ClipConfig(500, 500, 0), RecorderConfig("http://r", poll_interval_ms=1), 700.0 if variant == "chunks" else None)
    (event,) = out.events.collect()
    assert 1.7e12 + 3900 <= event["start_ms"] <= 1.7e12 + 4200 and event["stop_ms"] <= 1.7e12 + 6000
    service = RecorderConfig("http://r", poll_interval_ms=1)
    deliver(out, str(tmp_path / "side"), lambda asked: send_requests(asked, service, Service, sleep=lambda s: None), str(tmp_path / "clips"))
    (line,) = [x for p in (tmp_path / "side").glob("*.json") for x in p.read_text().splitlines()]
    record = json.loads(line)
    assert record["type"] == "motion_event" and record["start_pts_ns"] == event["start_pts_ns"] and len(record) == 12
    (sent,) = spark.read.parquet(str(tmp_path / "clips")).collect()
    assert (sent["status"], sent["path"], sent["error_kind"]) == ("done", "/c.mp4", None)


def test_records_carry_telemetry_whatever_the_form(spark):
    """Windows, chunks and the fold give the same records."""
    schema = "cam_id string, frame_id long, pts_ms double, score double, wind_like boolean, real_override boolean, foliage_motion_frac double, wind_state string, zones_active_frac double"
    rows = []
    for cam in "ab":
        for i in range(60):
            on = i % 20 in (3, 4, 5, 6, 11, 12) or cam == "b" and i % 20 == 8
            rows.append((cam, i, 100.0 * i, 0.9 if on else 0.1, i % 7 == 0, i % 5 == 0, None if i % 9 == 0 else i / 100, (None, "", "Calm", "Gusty")[i % 4], math.nan if i % 6 == 0 else i / 60))
    frames_ = spark.createDataFrame(rows, schema)
    cfg = EventConfig(0.5, 0.3, 0, 150, 300)
    order = lambda r: tuple(map(str, r))
    tb = Timebase(0.0, 0, "ns")
    plain = motion_pipeline(frames_, tb, cfg).records
    found = sorted(map(tuple, plain.collect()), key=order)
    assert len(found) >= 4 and any(r[plain.columns.index("wind_state")] == "Gusty" for r in found) and any(r[plain.columns.index("real_override")] for r in found)
    assert sorted(map(tuple, motion_pipeline(frames_, tb, cfg, chunk_ms=700.0).records.collect()), key=order) == found
    by_fold = fold.motion_events_fold(motion.with_telemetry(frames_), cfg)
    by_fold = by_fold.withColumn("start_pts_ns", (F.col("start_ms") * 1e6).cast("long")).withColumn("stop_pts_ns", (F.col("stop_ms") * 1e6).cast("long"))
    assert sorted(map(tuple, motion_event_records(by_fold).collect()), key=order) == found
    bare = motion_pipeline(frames_.select("cam_id", "frame_id", "pts_ms", "score"), tb, cfg).records.first()
    assert (bare["wind_state"], bare["wind_idx"], bare["real_override"]) == ("Unknown", 0.0, False)


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "p.log"
    log.write_text("[clip] indexed segment: start=100 end=200 ms location=/a/seg_7.mp4\n")
    assert cli.main(["horizon", "--log", str(log), "--event-start-ms", "0", "--event-stop-ms", "50"]) == 0
    said = capsys.readouterr().out
    assert "1 segments" in said and "COMPLETELY BEFORE horizon by 50.000 ms" in said
    assert cli.main(["sync-report", "-o", str(tmp_path / "r.md")]) == 0
    assert (tmp_path / "r.md").read_text().startswith("# Sync Report")
    spark.createDataFrame([("c", 0, 0.0, 0.9), ("c", 1, 900.0, 0.9)], "cam_id string, frame_id long, pts_ms double, score double").write.parquet(str(tmp_path / "f"))
    assert cli.main(["events", "--frames", str(tmp_path / "f"), "--sidecar", str(tmp_path / "s")]) == 0
    assert spark.read.json(str(tmp_path / "s")).first()["stop_ms"] == 900.0


def test_reader_report_by_command(spark, tmp_path, capsys):
    rows = [("c", i, 100.0 * i, True, i == 2, i != 2, 10.0 * i, '{"encoder_fps": 15, "latest-frame-id": 9}') for i in range(5)]
    spark.createDataFrame(rows, "cam_id string, frame_id long, pts_ms double, enqueued boolean, dropped boolean, emitted boolean, loop_us double, stats string").write.parquet(str(tmp_path / "r"))
    assert cli.main(["reader-report", "--reads", str(tmp_path / "r"), "--seconds", "2", "--now-ms", "1000"]) == 0
    said = capsys.readouterr().out
    assert "c: in=5 out=4 (~2.00 fps) drops=1 last_age_ms=600.0" in said and "mean=20 p95=38" in said and "encoder_fps=15" in said and "lag_fids=5" in said


def test_observed_frames_report(spark):
    seen = Observation("reader")
    rows = spark.createDataFrame([("c", 10.0), ("c", 30.0)], "cam_id string, pts_ms double")
    assert stats.observed(rows, seen, F.lit(50.0)).count() == 2
    assert seen.get == {"frames": 2, "last_frame_age_ms": 20.0}
    assert spark.range(1).select(now_ms()).first()[0] > 1.7e12


def test_ring_geometry():
    told = {"slot_count": 3, "slot_bytes": 100, "width": 4, "height": 2, "stride": 16, "fmt": "BGRx"}
    assert discovery.ring_geometry(told)["slot_bytes"] == 100
    with pytest.raises(ValueError):
        discovery.ring_geometry({"slot_count": 3})
