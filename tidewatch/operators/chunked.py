"""Motion events of cameras that are too large for one task.

The window form of ``operators.motion`` needs a camera's frames in one partition. Here a camera is cut into
chunks of time, in two passes. The first sums each chunk up: when it is on first and last, how late it is low
before its first and after its last on-frame, and how many activations open in between, which no other chunk
can change. A scan over these few rows tells each chunk what it begins with: the last on-frame, whether an
activation is open, how many there have been. The second pass gives that to the chunk's frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EventConfig
from ..functions.timebase import Timebase
from . import motion


def _marked(frames: DataFrame, cfg: EventConfig, chunk_ms: float, t: str) -> DataFrame:
    score = F.col("score")
    rows = frames.withColumn("_chunk", F.floor(F.col(t) / chunk_ms)).withColumn("_s", F.when(~F.isnan(score), score))
    return rows.withColumn("_on", F.coalesce(F.col("_s") >= cfg.score_on, F.lit(False))).withColumn("_low", F.coalesce(F.col("_s") <= cfg.score_off, F.lit(False)))


def _summaries(rows: DataFrame, cfg: EventConfig, key: str, t: str, order: str) -> DataFrame:
    """One row for each chunk: _last_t, _ons, _on_t (its last on-frame), _low_before, _low_after (latest low frame before
    the first and after the last on-frame), _opened (activations that open at any on-frame but the first)."""
    inside = Window.partitionBy(key, "_chunk").orderBy(t, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        rows.select(key, "_chunk", t, order, "_on", "_low")
        .withColumn("_n", F.count_if("_on").over(so_far))
        .withColumn("_on_so_far", F.last(F.when(F.col("_on"), F.col(t)), ignorenulls=True).over(so_far))
        .withColumn("_shuts", F.coalesce(F.col("_low") & (F.col(t) - F.col("_on_so_far") >= cfg.min_gap_ms), F.lit(False)))
        .withColumn("_shut", F.coalesce(F.count_if("_shuts").over(earlier), F.lit(0)))
        .withColumn("_shut_at_on", F.last(F.when(F.col("_on"), F.col("_shut")), ignorenulls=True).over(earlier))
    )
    low = F.max(F.when(F.col("_low") & (F.col("_n") > 0), F.struct("_n", t)))
    found = seen.groupBy(key, "_chunk").agg(
        F.max(t).alias("_last_t"),
        F.max("_n").alias("_ons"),
        F.max("_on_so_far").alias("_on_t"),
        F.max(F.when(F.col("_low") & (F.col("_n") == 0), F.col(t))).alias("_low_before"),
        low.alias("_latest"),
        F.count_if(F.col("_on") & (F.col("_shut") > F.col("_shut_at_on"))).alias("_opened"),
    )
    return found.withColumn("_low_after", F.when(F.col("_latest._n") == F.col("_ons"), F.col(f"_latest.{t}"))).drop("_latest")


def _begins(chunks: DataFrame, cfg: EventConfig, key: str) -> DataFrame:
    """What each chunk begins with: _t_0, _on_0 (times of the last frame and on-frame before), _active_0, _acts_0 and
    _opens_0 (whether its first on-frame opens an activation)."""
    by_time = Window.partitionBy(key).orderBy("_chunk")
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("_on_0", F.last("_on_t", ignorenulls=True).over(before)).withColumn("_t_0", F.lag("_last_t").over(by_time))
    # chunks between two that have on-frames, the first of these with them
    rows = rows.withColumn("_run", F.count_if(F.col("_ons") > 0).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    since = Window.partitionBy(key, "_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_low_since", F.max(F.when(F.col("_ons") > 0, F.col("_low_after")).otherwise(F.col("_low_before"))).over(since))
    rows = rows.withColumn("_low_0", F.lag("_low_since").over(by_time))
    shut = lambda low: F.coalesce(low - F.col("_on_0") >= cfg.min_gap_ms, F.lit(False))
    rows = rows.withColumn("_active_0", F.col("_on_0").isNotNull() & ~shut(F.col("_low_0")))
    rows = rows.withColumn("_opens_0", F.col("_on_0").isNull() | shut(F.greatest("_low_0", "_low_before")))
    opened = F.when(F.col("_ons") > 0, F.col("_opened") + F.col("_opens_0").cast("int")).otherwise(0)
    rows = rows.withColumn("_acts_0", F.coalesce(F.sum(opened).over(before), F.lit(0)))
    return rows.select(key, "_chunk", "_t_0", "_on_0", "_active_0", "_opens_0", "_acts_0")


def member_frames(frames: DataFrame, cfg: EventConfig = EventConfig(), chunk_ms: float = 3_600_000.0, key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id") -> DataFrame:
    """As ``motion.member_frames``, with at most a chunk of a camera in one task. Frames are scanned and exchanged twice,
    the first time without their telemetry."""
    if not cfg.closed_form():
        raise ValueError("score_off must be below score_on; use operators.fold for other settings")
    rows = _marked(frames, cfg, chunk_ms, t)
    # as many rows as there are chunks; they grow with the frames, so they are never broadcast
    rows = rows.join(_begins(_summaries(rows, cfg, key, t, order), cfg, key).hint("merge"), [key, "_chunk"])
    inside = Window.partitionBy(key, "_chunk").orderBy(t, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_last_on", F.coalesce(F.last(F.when(F.col("_on"), F.col(t)), ignorenulls=True).over(so_far), F.col("_on_0")))
        .withColumn("t_before", F.coalesce(F.lag(t).over(inside), F.col("_t_0")))
        .withColumn("closes", F.coalesce(F.col("_low") & (F.col(t) - F.col("_last_on") >= cfg.min_gap_ms), F.lit(False)))
        .withColumn("_closed", F.coalesce(F.count_if("closes").over(earlier), F.lit(0)))
        .withColumn("_closed_at_on", F.last(F.when(F.col("_on"), F.col("_closed")), ignorenulls=True).over(earlier))
        .withColumn("_opens", F.col("_on") & F.coalesce(F.col("_closed") > F.col("_closed_at_on"), F.col("_opens_0")))
        .withColumn("act_id", F.col("_acts_0") + F.count_if("_opens").over(so_far))
        # an activation that was open before has no closing in this chunk yet
        .withColumn("_closed_at_open", F.coalesce(F.last(F.when(F.col("_opens"), F.col("_closed")), ignorenulls=True).over(so_far), F.when(F.col("_active_0"), 0)))
    )
    return rows.where(F.col("_closed") == F.col("_closed_at_open"))


def motion_events(frames: DataFrame, cfg: EventConfig = EventConfig(), chunk_ms: float = 3_600_000.0, key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", timebase: Timebase | None = None, telemetry: bool = False) -> DataFrame:
    """As ``motion.motion_events``: what differs is only how frames are dealt out. Activations are few, and merged as there."""
    acts = motion.grouped(member_frames(frames, cfg, chunk_ms, key, t, order), key, t, order, telemetry)
    acts = acts.where(F.col("stop_ms") - F.col("start_ms") >= cfg.min_event_ms)
    return motion.merged(acts, cfg, key, timebase, telemetry)
