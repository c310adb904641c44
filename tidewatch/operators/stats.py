"""Reader health: loop timings, counters, ages, clock skew and unit calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rolling(key: str, order: tuple[str, ...], rows: int):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)


def loop_stats_linear(loops: DataFrame, us: str = "loop_us", key: str = "cam_id", order: tuple[str, ...] = ("pts_ms", "frame_id"), rows: int = 1000) -> DataFrame:
    """Mean and linearly interpolated 95th percentile of the last ``rows`` loop timings."""
    w = _rolling(key, order, rows)
    return loops.withColumn("loop_us_mean", F.avg(us).over(w)).withColumn("loop_us_p95", F.percentile(us, F.lit(0.95)).over(w))


def loop_stats_rank(loops: DataFrame, us: str = "loop_us", key: str = "cam_id", order: tuple[str, ...] = ("pts_ms", "frame_id"), rows: int = 512) -> DataFrame:
    """Mean and the value of rank floor(0.95 * (n - 1)) of the last ``rows`` loop timings."""
    w = _rolling(key, order, rows)
    kept = loops.withColumn("loop_us_mean", F.avg(us).over(w)).withColumn("_last", F.sort_array(F.collect_list(us).over(w)))
    place = F.floor(F.lit(0.95) * (F.size("_last") - 1)).cast("int") + 1
    return kept.withColumn("loop_us_p95", F.element_at("_last", place)).drop("_last")


def frame_age(now: Column, pts_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), now - pts_ms)


def stale_frames(frames: DataFrame, now: Column, t: str = "pts_ms", limit_ms: float = 1500.0) -> DataFrame:
    """The frames older than ``limit_ms``."""
    return frames.withColumn("age_ms", frame_age(now, F.col(t))).where(F.col("age_ms") > limit_ms)


def counters(reads: DataFrame, key: str = "cam_id", enqueued: str = "enqueued", dropped: str = "dropped", emitted: str = "emitted") -> DataFrame:
    """frames_in, frames_out and drops of a log of booleans."""
    return reads.groupBy(key).agg(F.count_if(enqueued).alias("frames_in"), F.count_if(emitted).alias("frames_out"), F.count_if(dropped).alias("drops"))


def observed(frames: DataFrame, name: str, now: Column, t: str = "pts_ms") -> DataFrame:
    """``frames`` that report, under ``name``, their number and the freshest frame's age to listeners; batch or stream."""
    return frames.observe(name, F.count(F.lit(1)).alias("frames"), F.min(frame_age(now, F.col(t))).alias("last_frame_age_ms"))


def frames_per_second(frames: DataFrame, seconds: Column, key: str = "cam_id") -> DataFrame:
    """Frames over the span asked for; a span below one second counts as one."""
    return frames.groupBy(key).agg((F.count("*") / F.greatest(F.max(seconds), F.lit(1))).alias("fps"))


def skew_latched(frames: DataFrame, now: str = "now_ms", t: str = "pts_ms", key: str = "cam_id", order: tuple[str, ...] = ("now_ms", "frame_id")) -> DataFrame:
    """Adds skew_ms and corrected_ms.

    Frames 50 to 5000 ms in the future are samples of a producer's clock being ahead; from the fifth one on,
    that frame included, the median of the first five is taken off every time.
    """
    ordered = Window.partitionBy(key).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    age = F.col(now) - F.col(t)
    sample = (age > -5000.0) & (age < -50.0)
    rows = frames.withColumn("_sample", F.when(sample, -age)).withColumn("_n", F.count("_sample").over(so_far))
    # no more than five samples are ever gathered: later ones are not collected
    rows = rows.withColumn("_five", F.collect_list(F.when(F.col("_n") <= 5, F.col("_sample"))).over(so_far))
    skew = F.when(F.col("_n") >= 5, F.element_at(F.sort_array("_five"), 3)).otherwise(F.lit(0.0))
    return rows.withColumn("skew_ms", skew).withColumn("corrected_ms", F.col(t) - F.col("skew_ms")).drop("_sample", "_n", "_five")


def calibrated_unit(raw: Column, now_ms: Column, base_epoch_ms: Column | None = None, base_pts: Column | None = None) -> Column:
    """The name of the reading of a raw time that fits best, for mappers that are not authoritative.

    Readings in order: epoch_ms, epoch_s and, with a nanosecond anchor, health_ns, health_us, health_ms. An
    age of 0 to 120 s wins over a best age above it, any other if it is nearer to 0; the order decides, so it
    is a fold over the readings.
    """
    ages = [("epoch_ms", now_ms - raw), ("epoch_s", now_ms - raw * 1000.0)]
    if base_epoch_ms is not None:
        mapped = lambda factor: base_epoch_ms + (raw * factor - base_pts) * 1e-6
        ages += [("health_ns", now_ms - mapped(1.0)), ("health_us", now_ms - mapped(1000.0)), ("health_ms", now_ms - mapped(1_000_000.0))]
    tried = F.array(*[F.struct(F.lit(n).alias("name"), a.cast("double").alias("age")) for n, a in ages])

    def better(best: Column, new: Column) -> Column:
        fits = (new["age"] >= 0) & (new["age"] <= 120_000)
        wins = best["name"].isNull() | F.when(fits, new["age"] < best["age"]).otherwise(F.abs(new["age"]) < F.abs(best["age"]))
        return F.when(wins, new).otherwise(best)

    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("age"))
    return F.aggregate(tried, start, better)["name"]


def producer_lag(stats: DataFrame, latest: list[str], last: str) -> DataFrame:
    """Adds lag_fids: the first given name of the producer's latest id minus ours; null where either is no number."""
    newest = F.coalesce(*[F.col(f"`{c}`").try_cast("long") for c in latest])
    return stats.withColumn("lag_fids", newest - F.col(last).try_cast("long"))


#: What producers call their figures; the first name that is there counts.
PRODUCER = {
    "encoder_fps": ("encoder_fps", "encoder-fps"),
    "segment_count": ("segment_count", "segments", "segment-count"),
    "last_segment": ("last_segment", "last-segment"),
    "latest_id": ("latest_frame_id", "latest-frame-id"),
}


def reader_report(reads: DataFrame, seconds: Column, now: Column, producer: Column | None = None, key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", us: str = "loop_us", rows: int = 1000) -> DataFrame:
    """One row for each camera of a log of reads (key, t, order, enqueued, dropped, emitted, ``us``): frames_in, frames_out,
    drops, fps over ``seconds``, the age of its last frame, mean and 95th percentile of its last ``rows`` loops, and, of
    the map ``producer`` (see ``parse_producer_stats``), the producer's figures and how many ids it is ahead.

    Only a camera's last ``rows`` reads are exchanged for the percentiles.
    """
    back = Window.partitionBy(key).orderBy(F.desc(t), F.desc(order))
    last = reads.withColumn("_nth", F.row_number().over(back)).where(F.col("_nth") <= rows)
    loops = last.groupBy(key).agg(F.avg(us).alias("loop_us_mean"), F.percentile(us, F.lit(0.95)).alias("loop_us_p95"))
    place = F.struct(t, order)
    aggregates = [
        F.count_if("enqueued").alias("frames_in"),
        F.count_if("emitted").alias("frames_out"),
        F.count_if("dropped").alias("drops"),
        (F.count_if("emitted") / F.greatest(F.max(seconds), F.lit(1))).alias("fps"),
        F.max_by(frame_age(now, F.col(t)), place).alias("last_age_ms"),
        F.max_by(order, place).alias("last_id"),
    ]
    if producer is not None:
        told = F.max_by(producer, place)
        aggregates += [F.coalesce(*[told[n] for n in names]).alias(name) for name, names in PRODUCER.items()]
    out = reads.groupBy(key).agg(*aggregates)
    if producer is not None:
        out = out.withColumn("lag_fids", F.col("latest_id").try_cast("long") - F.col("last_id").try_cast("long"))
    return out.join(loops, key)
