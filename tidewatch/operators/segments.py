"""Recorded segments: the log's lines to a table, its horizon, and where events lie against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed formats of the producer's log and of segment file names.
LINE = r"\[clip\]\s+indexed segment:\s+start=(\d+(?:\.\d+)?)\s+end=(\d+(?:\.\d+)?)\s+ms\s+location=(\S+)"
INDEX = r"(?i)seg_(\d+)\.mp4$"


def parse_segments(lines: DataFrame, line: str = "line") -> DataFrame:
    """start_ms, end_ms, path, index (null without a number in the file's name), duration_ms; other lines drop out."""
    part = lambda i: F.regexp_extract(F.col(line), LINE, i)
    kept = [c for c in lines.columns if c != line]
    return (
        lines.where(F.col(line).rlike(LINE))
        .select(*kept, part(1).cast("double").alias("start_ms"), part(2).cast("double").alias("end_ms"), part(3).alias("path"))
        .withColumn("index", F.regexp_extract("path", INDEX, 1).try_cast("long"))
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    )


def _order() -> list[Column]:
    """By start and index; paths and ends leave no tie open, whatever partitions the rows come in."""
    return [F.col("start_ms"), F.coalesce("index", F.lit(-1)), F.col("path"), F.col("end_ms")]


def latest_first() -> list[Column]:
    """The order from which the last n are taken."""
    return [c.desc() for c in _order()]


def ordered(segments: DataFrame) -> DataFrame:
    return segments.orderBy(*_order())


def horizon(segments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """earliest_ms, latest_ms, n_segments: one row, or one for each value of ``keys`` (the cameras, say)."""
    return segments.groupBy(*keys).agg(F.min("start_ms").alias("earliest_ms"), F.max("end_ms").alias("latest_ms"), F.count("*").alias("n_segments"))


def last_n(segments: DataFrame, n: int = 50, keys: tuple[str, ...] = (), sort: bool = True) -> DataFrame:
    """The last n (one at least) of all, or of each value of ``keys``; idx is the index or ``-``. Shown in ascending order, or,
    without ``sort``, in any: a sort of all keys' rows is one more pass."""
    back, n = latest_first(), max(1, n)
    if keys:
        # Spark drops rows beyond n before it exchanges them
        tail = segments.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*back))).where(F.col("_place") <= n).drop("_place")
    else:
        tail = segments.orderBy(*back).limit(n)
    tail = tail.withColumn("idx", F.coalesce(F.col("index").cast("string"), F.lit("-")))
    return tail.orderBy(*keys, *_order()) if sort else tail


def against_horizon(start: Column, stop: Column, earliest: Column, latest: Column) -> Column:
    """The fixed four classifications; touching a bound is neither before nor after."""
    by = lambda text, delta: F.format_string(f"event is {text} horizon by %.3f ms", delta)
    return (
        F.when(stop < earliest, by("COMPLETELY BEFORE", earliest - stop))
        .when(start > latest, by("COMPLETELY AFTER", start - latest))
        .when((start >= earliest) & (stop <= latest), F.lit("event window is FULLY CONTAINED within horizon"))
        .otherwise(F.lit("event window PARTIALLY OVERLAPS horizon"))
    )


def classify_events(events: DataFrame, segments: DataFrame, start: str = "start_ms", stop: str = "stop_ms", keys: tuple[str, ...] = ()) -> DataFrame:
    """Each event against the horizon of all segments, one row that every task gets, or, with ``keys``, against that of the
    segments that agree on them. Null where there are no segments."""
    bounds = horizon(segments, keys).select(*keys, "earliest_ms", "latest_ms")
    joined = events.join(bounds, list(keys), "left") if keys else events.join(F.broadcast(bounds))
    relation = against_horizon(F.col(start), F.col(stop), F.col("earliest_ms"), F.col("latest_ms"))
    return joined.withColumn("classification", F.when(F.col("earliest_ms").isNotNull(), relation))


def overlapping_segments(windows: DataFrame, segments: DataFrame, start: str = "clip_start_ms", stop: str = "clip_stop_ms", bucket_ms: float = 86_400_000.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Extension: window and segment pairs that overlap (open bounds) and agree on ``keys``, columns of both.

    A range join by time buckets: both sides go to each bucket that they meet, join on it, and a pair counts
    in the first bucket that both meet.
    """
    floor = lambda c: F.floor(F.col(c) / bucket_ms)
    w = windows.withColumn("_first", floor(start)).withColumn("_bucket", F.explode(F.sequence(floor(start), floor(stop))))
    s = segments.withColumn("_seg_first", floor("start_ms")).withColumn("_bucket", F.explode(F.sequence(floor("start_ms"), floor("end_ms"))))
    s = s.select("_bucket", *keys, "_seg_first", F.col("start_ms").alias("seg_start_ms"), F.col("end_ms").alias("seg_end_ms"), F.col("path").alias("seg_path"))
    both = w.join(s, ["_bucket", *keys]).where((F.col("seg_start_ms") < F.col(stop)) & (F.col("seg_end_ms") > F.col(start)) & (F.col("_bucket") == F.greatest("_first", "_seg_first")))
    return both.drop("_bucket", "_first", "_seg_first")
