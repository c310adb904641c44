"""Events to padded clip windows and clip requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClipConfig
from ..functions.timebase import Timebase, truncated


def clip_windows(events: DataFrame, cfg: ClipConfig = ClipConfig(), start: str = "start_ms", stop: str = "stop_ms") -> DataFrame:
    """Adds clip_start_ms and clip_stop_ms: padded, the start not below 0, then lengthened to the least and cut to
    the greatest duration at the tail; where the two contradict, the greatest holds."""
    begin = F.greatest(F.lit(0.0), F.col(start) - cfg.preroll_ms)
    end = F.greatest(F.col(stop) + cfg.postroll_ms, F.col("clip_start_ms") + cfg.min_duration_ms)
    if cfg.max_duration_ms > 0:
        end = F.least(end, F.col("clip_start_ms") + cfg.max_duration_ms)
    return events.withColumn("clip_start_ms", begin).withColumn("clip_stop_ms", end)


def clip_requests(events: DataFrame, cfg: ClipConfig = ClipConfig(), timebase: Timebase | None = None) -> DataFrame:
    """One request for each event, never merged: a PTS pair with a timebase, else an epoch pair.

    Padding has been applied, so the request itself carries none.
    """
    windows = clip_windows(events, cfg)
    none_long, none_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    pts = [truncated(timebase.to_pts(F.col(c))) if timebase else none_long for c in ("clip_start_ms", "clip_stop_ms")]
    epoch = [none_double if timebase else F.col(c) for c in ("clip_start_ms", "clip_stop_ms")]
    kept = [c for c in events.columns if c in ("cam_id",)]
    return windows.select(
        *kept,
        pts[0].alias("start_pts_ns"),
        pts[1].alias("stop_pts_ns"),
        epoch[0].alias("start_epoch_ms"),
        epoch[1].alias("stop_epoch_ms"),
        F.lit(cfg.label).cast("string").alias("label"),
        F.lit(cfg.out_dir).cast("string").alias("out_dir"),
        none_long.alias("preroll_ms"),
        none_long.alias("postroll_ms"),
        F.lit(cfg.max_wait_ms).cast("long").alias("max_wait_ms"),
    )
