"""Stride hold: only every n-th frame is computed, the others repeat the last result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stride_hold(frames: DataFrame, n: int, columns: list[str], key: str = "cam_id", order: tuple[str, ...] = ("pts_ms", "frame_id")) -> DataFrame:
    """Keeps ``columns`` of frames 1, 1 + n, ... in order of arrival; each other frame takes those of the last such one."""
    if n <= 1:
        return frames
    ordered = Window.partitionBy(key).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = frames.withColumn("_computed", (F.row_number().over(ordered) - 1) % n == 0)
    held = F.struct(*columns)
    last = F.last(F.when(F.col("_computed"), held), ignorenulls=True).over(so_far)
    kept = [c for c in frames.columns if c not in columns]
    return numbered.withColumn("_held", last).select(*kept, *[F.col("_held")[c].alias(c) for c in columns]).select(*frames.columns)
