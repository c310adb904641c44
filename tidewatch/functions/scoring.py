"""Motion score of a foreground pixel count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MotionConfig


def area_fraction(pixels: Column, total: Column) -> Column:
    return F.when(total > 0, pixels.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def score(area: Column, cfg: MotionConfig = MotionConfig()) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(cfg.score_cap)), area * float(cfg.score_scale)))


def with_motion(frames: DataFrame, pixels: str = "fg_pixels", total: str = "total_pixels", cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """Adds area_frac, score, is_motion, real_override and wind_like. A failed mask (null pixels) scores 0."""
    area = area_fraction(F.coalesce(F.col(pixels), F.lit(0)), F.coalesce(F.col(total), F.lit(0)))
    value = score(F.col("area_frac"), cfg)
    moves = (F.col("area_frac") >= cfg.min_motion_area_frac) & (F.col("score") > 0)
    return (
        frames.withColumn("area_frac", area)
        .withColumn("score", value)
        .withColumn("is_motion", moves)
        .withColumn("real_override", F.col("is_motion"))
        .withColumn("wind_like", F.lit(False))
    )
