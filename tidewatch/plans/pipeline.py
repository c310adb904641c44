"""The motion pipeline end to end: frames with pixels or scores to events, sidecar records and clip payloads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import ClipConfig, EventConfig, MotionConfig, RecorderConfig
from ..functions.scoring import with_motion
from ..functions.timebase import Timebase
from ..operators import chunked, fold, frames, motion, recorder
from ..operators.clips import clip_requests
from ..sinks.sidecar import motion_event_records, write_sidecar


@dataclass
class Outcome:
    events: DataFrame
    records: DataFrame
    requests: DataFrame


def scored_frames(images: DataFrame, cfg: MotionConfig = MotionConfig(), background: Callable = frames.opencv_background) -> DataFrame:
    """Packed BGR frames to scored frames. The stride's held frames repeat the last count, hence its score."""
    return with_motion(frames.motion_counts(images, cfg, background), cfg=cfg)


def motion_pipeline(
    scored: DataFrame,
    timebase: Timebase | None,
    events: EventConfig = EventConfig(),
    clips: ClipConfig = ClipConfig(),
    service: RecorderConfig | None = None,
    chunk_ms: float | None = None,
) -> Outcome:
    """Scored frames (cam_id, frame_id, pts_ms in epoch milliseconds, score, whatever telemetry there is) to events,
    records that carry their frames' telemetry, and clip requests.

    ``chunk_ms`` cuts cameras that are too large for a task; settings without a closed form go to the fold.
    Requests carry a key, their payload and what is wrong with them; ``sinks.recorder.send_requests`` sends them.
    """
    scored = motion.with_telemetry(scored)
    if not events.closed_form():
        found = fold.motion_events_fold(scored, events)
        to_pts = timebase.to_pts if timebase else (lambda ms: ms)
        found = found.withColumn("start_pts_ns", to_pts(found["start_ms"]).cast("long")).withColumn("stop_pts_ns", to_pts(found["stop_ms"]).cast("long"))
    elif chunk_ms:
        found = chunked.motion_events(scored, events, chunk_ms, timebase=timebase, telemetry=True)
    else:
        found = motion.motion_events(scored, events, timebase=timebase, telemetry=True)
    service = service or RecorderConfig("http://127.0.0.1:8080")
    asked = recorder.payloads(recorder.normalise_requests(clip_requests(found, clips, timebase), timebase), service)
    key = recorder.request_key("cam_id", "win_start_pts", "win_stop_pts", "win_start_ms", "win_stop_ms")
    return Outcome(found, motion_event_records(found), asked.withColumn("request_key", key))


def deliver(outcome: Outcome, sidecar: str, send: Callable[[DataFrame], DataFrame] | None = None, results: str | None = None) -> None:
    """Writes the sidecar first, then sends the clip requests once and keeps what came of them at ``results``."""
    write_sidecar(outcome.records, sidecar)
    if send is not None:
        send(outcome.requests).write.mode("append").parquet(results)
