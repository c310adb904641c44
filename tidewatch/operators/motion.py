"""Hysteresis activations and merged motion events, as window functions over one ordering.

Frames are ordered by (t, frame_id) within a camera. Everything up to the activations uses windows of that one
specification, so Spark plans one exchange and one sort; what follows works on activations, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EventConfig
from ..functions.timebase import Timebase, truncated

TELEMETRY = ("wind_like", "real_override", "foliage_motion_frac", "wind_idx", "wind_state", "zones_active_frac")


def _number(x: Column) -> Column:
    """NaN compares false in the state machine, so it counts as missing."""
    return F.when(~F.isnan(x), x)


def member_frames(frames: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id") -> DataFrame:
    """The frames of all activations with act_id, closes (this frame ends it), t_before (the frame before's time).

    A frame is on at ``score >= score_on``. The off test needs only the last on-frame's time: inside an
    activation that is the camera's last on-frame, and outside it changes nothing. An on-frame opens an
    activation if an eligible off-frame stands between it and the on-frame before.
    """
    if not cfg.closed_form():
        raise ValueError("score_off must be below score_on; use operators.fold for other settings")
    ordered = Window.partitionBy(key).orderBy(t, order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    s = _number(F.col("score"))
    on = F.coalesce(s >= cfg.score_on, F.lit(False))
    rows = (
        frames.withColumn("_s", s)
        .withColumn("_on", on)
        .withColumn("_last_on", F.last(F.when(F.col("_on"), F.col(t)), ignorenulls=True).over(so_far))
        .withColumn("t_before", F.lag(t).over(ordered))
        .withColumn("closes", F.coalesce((F.col("_s") <= cfg.score_off) & (F.col(t) - F.col("_last_on") >= cfg.min_gap_ms), F.lit(False)))
        .withColumn("_closed", F.coalesce(F.count_if("closes").over(earlier), F.lit(0)))
        .withColumn("_closed_at_on", F.last(F.when(F.col("_on"), F.col("_closed")), ignorenulls=True).over(earlier))
        .withColumn("_opens", F.col("_on") & (F.col("_closed_at_on").isNull() | (F.col("_closed") > F.col("_closed_at_on"))))
        .withColumn("act_id", F.count_if("_opens").over(so_far))
        .withColumn("_closed_at_open", F.last(F.when(F.col("_opens"), F.col("_closed")), ignorenulls=True).over(so_far))
    )
    return rows.where((F.col("act_id") >= 1) & (F.col("_closed") == F.col("_closed_at_open")))


def grouped(members: DataFrame, key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", telemetry: bool = False) -> DataFrame:
    """Member frames to one row for each activation: key, act_id, start_ms, stop_ms, max_score, close_ms (null if
    only the end of the stream closes it), watched_ms (the frame before that)."""
    aggregates = [
        F.min(t).alias("start_ms"),
        F.max(F.when(F.col("_on"), F.col(t))).alias("stop_ms"),
        F.max("_s").alias("max_score"),
        F.max(F.when(F.col("closes"), F.col(t))).alias("close_ms"),
        # an activation that nothing closes reaches to the camera's last frame
        F.coalesce(F.max(F.when(F.col("closes"), F.col("t_before"))), F.max(t)).alias("watched_ms"),
    ]
    if telemetry:
        said = F.col("wind_state").isNotNull() & (F.col("wind_state") != "")
        place = F.struct(t, order)
        aggregates += [
            F.bool_or("wind_like").alias("wind_like"),
            F.bool_or("real_override").alias("real_override"),
            *[F.max(_number(F.col(c))).alias(c) for c in ("foliage_motion_frac", "wind_idx", "zones_active_frac")],
            F.coalesce(F.max_by("wind_state", F.when(said, place)), F.min_by("wind_state", place)).alias("wind_state"),
        ]
    return members.groupBy(key, "act_id").agg(*aggregates)


def activations(frames: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", telemetry: bool = False, all_lengths: bool = False) -> DataFrame:
    """The activations that last ``min_event_ms``, or all of them."""
    found = grouped(member_frames(frames, cfg, key, t, order), key, t, order, telemetry)
    return found if all_lengths else found.where(F.col("stop_ms") - F.col("start_ms") >= cfg.min_event_ms)


def merged(acts: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", timebase: Timebase | None = None, telemetry: bool = False) -> DataFrame:
    """Activations merged into events.

    An activation joins the one before if no frame up to its own closing frame's predecessor lies
    ``merge_gap_ms`` or more after that one's stop: until then the earlier event was still pending.
    """
    by_start = Window.partitionBy(key).orderBy("act_id")
    joins = F.coalesce(F.col("watched_ms") - F.lag("stop_ms").over(by_start) < cfg.merge_gap_ms, F.lit(False))
    grouped = acts.withColumn("_new", ~joins).withColumn("_group", F.count_if("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    aggregates = [
        F.min("start_ms").alias("start_ms"),
        F.max("stop_ms").alias("stop_ms"),
        F.max("max_score").alias("max_score"),
        F.count("*").alias("n_activations"),
        F.max_by("close_ms", "act_id").alias("close_ms"),
    ]
    if telemetry:
        said = F.col("wind_state").isNotNull() & (F.col("wind_state") != "")
        aggregates += [
            F.bool_or("wind_like").alias("wind_like"),
            F.bool_or("real_override").alias("real_override"),
            *[F.max(c).alias(c) for c in ("foliage_motion_frac", "wind_idx", "zones_active_frac")],
            F.coalesce(F.max_by("wind_state", F.when(said, F.col("act_id"))), F.min_by("wind_state", "act_id")).alias("wind_state"),
        ]
    events = grouped.groupBy(key, "_group").agg(*aggregates).drop("_group")
    to_pts = (lambda ms: truncated(timebase.to_pts(ms))) if timebase else truncated
    return events.withColumn("start_pts_ns", to_pts(F.col("start_ms"))).withColumn("stop_pts_ns", to_pts(F.col("stop_ms")))


def motion_events(frames: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", timebase: Timebase | None = None, telemetry: bool = False) -> DataFrame:
    """Frames to events, the end of the stream flushed."""
    return merged(activations(frames, cfg, key, t, order, telemetry), cfg, key, timebase, telemetry)


def with_emission(events: DataFrame, frames: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", t: str = "pts_ms", chunk_ms: float | None = None) -> DataFrame:
    """Adds emit_ms: the first frame's time at or after the close that lies ``merge_gap_ms`` past the stop; null
    where only the end of the stream emits the event. An as-of join: events and frames in one ordering, from the
    last to the first, in which the nearest frame ahead is what has been seen latest.

    ``chunk_ms`` cuts cameras that are too large for one task; a chunk's events then look on to the first frame of the
    chunks after it.
    """
    due = F.when(F.col("close_ms").isNotNull(), F.greatest("close_ms", F.col("stop_ms") + cfg.merge_gap_ms))
    marks = events.select(F.col(key), due.alias("_at"), F.lit(0).alias("_kind"), F.struct(*[c for c in events.columns if c != key]).alias("_event"))
    times = frames.select(F.col(key), F.col(t).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_event"].dataType).alias("_event"))
    both = marks.where("_at is not null").unionByName(times).withColumn("_frame", F.when(F.col("_kind") == 1, F.col("_at")))
    keys = [key]
    if chunk_ms:
        both, keys = both.withColumn("_chunk", F.floor(F.col("_at") / chunk_ms)), [key, "_chunk"]
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("emit_ms", F.last("_frame", ignorenulls=True).over(back)).where("_kind = 0")
    if chunk_ms:
        chunks = both.groupBy(*keys).agg(F.min("_frame").alias("_first"))
        later = Window.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.select(*keys, F.last("_first", ignorenulls=True).over(later).alias("_next"))
        found = found.join(chunks.hint("merge"), keys).withColumn("emit_ms", F.coalesce("emit_ms", "_next"))
    never = marks.where("_at is null").withColumn("emit_ms", F.lit(None).cast("double"))
    columns = [F.col(key), "_event.*", F.col("emit_ms")]
    return found.select(*columns).unionByName(never.select(*columns))


def with_telemetry(frames: DataFrame) -> DataFrame:
    """``frames`` with all columns of ``TELEMETRY``: a column that is missing has the motion result's default, a null or
    NaN in one that is given tells nothing (false, 0, no wind state)."""
    unset = {"wind_like": False, "real_override": False, "wind_state": "Unknown"}
    out = frames
    for name in TELEMETRY:
        if name not in frames.columns:
            out = out.withColumn(name, F.lit(unset.get(name, 0.0)))
        elif name in ("wind_like", "real_override"):
            out = out.withColumn(name, F.coalesce(name, F.lit(False)))
        elif name == "wind_state":
            out = out.withColumn(name, F.coalesce(name, F.lit("")))
        else:
            out = out.withColumn(name, F.coalesce(_number(F.col(name).cast("double")), F.lit(0.0)))
    return out
