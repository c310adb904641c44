"""Timebase, scoring, stride and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MotionConfig
from ..functions import scoring, timebase
from ..functions.timebase import Timebase
from ..operators import chunked, fold, motion, stride
from ..operators.detect import detect, detection
from ..operators.frames import motion_counts
from ..scratch import scratch_path
from ..sinks import sidecar
from ..sources.files import read_sidecar
from ..streaming.motion import motion_event_stream, run_available
from . import pipeline
from .adapter import EVENTS, FRAMES_SQL, TIMEBASE, frames
from .state_machine_sql import activations_sql, events_sql

BASE_MS = TIMEBASE.base_epoch_ms
#: How a frame's time in microseconds is written in each unit, and the base in that unit: (Spark, DuckDB, base).
RAW = {
    "ns": ("pts_us * 1000", "pts_us * 1000", 1.0e13),
    "us": ("pts_us", "pts_us", 1.0e10),
    "ms": ("pts_us / 1000.0D", "pts_us / 1000.0::DOUBLE", 1.0e7),
    "epoch_ms": ("pts_us / 1000.0D", "pts_us / 1000.0::DOUBLE", 0.0),
    "epoch_s": ("pts_us / 1000000.0D", "pts_us / 1000000.0::DOUBLE", 0.0),
}
_SCALE = {"ns": "1e-6", "us": "1e-3", "ms": "1e0"}


def _timebase(units: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tb = Timebase(BASE_MS, RAW[units][2], units)
        return frames(spark, sf_dir).select("frame_id", tb.to_epoch_ms(F.expr(RAW[units][0])).alias("epoch_ms"))

    return query


def _timebase_sql(units: str) -> str:
    _, raw, base = RAW[units]
    raw = f"CAST({raw} AS DOUBLE)"
    value = {"epoch_ms": raw, "epoch_s": f"{raw} * 1000.0::DOUBLE"}.get(units) or f"{BASE_MS}::DOUBLE + ({raw} - {base}::DOUBLE) * {_SCALE[units]}::DOUBLE"
    return f"WITH {FRAMES_SQL} SELECT frame_id, {value} AS epoch_ms FROM frames"


def timebase_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = TIMEBASE.to_pts(F.col("pts_ms"))
    return frames(spark, sf_dir).select("frame_id", pts.alias("pts"), timebase.truncated(pts).alias("pts_whole"), TIMEBASE.to_epoch_ms(pts).alias("back_ms"))


def frame_iso_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", timebase.iso_utc(F.col("pts_ms")).alias("iso"))


def pts_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By each camera's stored health document: nested, flat, other units, or none that can be used."""
    doc = F.expr(
        "CASE cam_id % 5 WHEN 0 THEN '{\"timebase\":{\"base_epoch_ms\":1000,\"base_pts_ns\":1e9,\"pts_units\":\"NS\"}}' WHEN 1 THEN '{\"base_epoch_ms\":2000,\"base_pts\":1000,\"pts_units\":\"us\"}'"
        " WHEN 2 THEN '{\"timebase\":{},\"base_epoch_ms\":3000,\"base_pts\":1000,\"pts_units\":\"ms\"}' WHEN 3 THEN '{}' ELSE 'broken' END"
    )
    return frames(spark, sf_dir).select("frame_id", timebase.mapped_pts(F.col("frame_id") * 1000, doc).alias("mapped_ms"))


def frame_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tuples to frames: a missing PTS takes the wall clock (a fixed one here)."""
    raw = F.when(F.col("frame_id") % 9 != 0, (F.col("pts_ms") - BASE_MS) * 1e6 + 0.75)
    return frames(spark, sf_dir).select("cam_id", "frame_id", F.coalesce(TIMEBASE.to_epoch_ms(timebase.truncated(raw)), F.lit(BASE_MS)).alias("pts_ms"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = frames(spark, sf_dir).withColumn("fg_pixels", F.when(F.col("frame_id") % 50 != 0, F.floor(F.col("score") * 1000) - 4)).withColumn("total_pixels", F.when(F.col("frame_id") % 33 == 0, 0).otherwise(2000))
    return scoring.with_motion(counted.drop("score"), cfg=MotionConfig(score_scale=3.0, score_cap=0.9, min_motion_area_frac=0.01))


_SCORED_SQL = f"""WITH {FRAMES_SQL}, counted AS (
  SELECT cam_id, frame_id, CASE WHEN frame_id % 33 = 0 THEN 0 ELSE coalesce(CASE WHEN frame_id % 50 <> 0 THEN floor(score * 1000) - 4 END, 0) / 2000.0::DOUBLE END::DOUBLE AS area_frac FROM frames
), scored AS (
  SELECT cam_id, frame_id, area_frac, greatest(0.0::DOUBLE, least(0.9::DOUBLE, area_frac * 3.0::DOUBLE)) AS score FROM counted
), gated AS (SELECT *, area_frac >= 0.01::DOUBLE AND score > 0 AS is_motion FROM scored)
"""


def motion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("frame_id", "area_frac", "score", "is_motion", "real_override", "wind_like")


def motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("cam_id").agg(F.count_if("is_motion").alias("moving"), F.count("*").alias("frames"), F.max("score").alias("max_score"))


def stride_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stride.stride_hold(frames(spark, sf_dir), 3, ["score"]).select("cam_id", "frame_id", "pts_ms", "score")


def motion_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.activations(frames(spark, sf_dir), EVENTS).select("cam_id", "start_ms", "stop_ms", "max_score")


EVENT = ("cam_id", "start_ms", "stop_ms", "max_score", "n_activations", "start_pts_ns", "stop_pts_ns")
TELEMETRY = ("cam_id", "start_ms", "stop_ms", "max_score", *motion.TELEMETRY)
_PTS_SQL = "CAST(trunc({b}::DOUBLE + ({c} - {e}::DOUBLE) / 1e-6::DOUBLE) AS BIGINT)"


def pts_sql(column: str) -> str:
    return _PTS_SQL.format(b=TIMEBASE.base_pts, c=column, e=BASE_MS)


EVENT_SQL = f"cam_id, start_ms, stop_ms, max_score, n_activations, {pts_sql('start_ms')} AS start_pts_ns, {pts_sql('stop_ms')} AS stop_pts_ns"


def events(spark: SparkSession, sf_dir: str, telemetry: bool = False) -> DataFrame:
    return motion.motion_events(frames(spark, sf_dir, telemetry), EVENTS, timebase=TIMEBASE, telemetry=telemetry)


def motion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(*EVENT)


def motion_events_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, True).select(*TELEMETRY)


def motion_events_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return motion.with_emission(motion.motion_events(f, EVENTS), f, EVENTS).select("cam_id", "start_ms", "stop_ms", "emit_ms")


def motion_events_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.motion_events_fold(frames(spark, sf_dir, True), EVENTS).select(*TELEMETRY)


def motion_events_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras cut into chunks of three days, as for cameras that no single task can hold."""
    found = chunked.motion_events(frames(spark, sf_dir, True), EVENTS, 3 * 86_400_000.0, telemetry=True)
    return found.select(*TELEMETRY)


def motion_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming twin over four micro-batches, the last of which ends every camera."""
    path = scratch_path(spark, "stream")
    f = frames(spark, sf_dir, True).withColumn("ends", F.lit(False))
    edges = [0.0, *(BASE_MS + d * 86_400_000.0 for d in (9, 17)), 1e18]
    for low, high in zip(edges, edges[1:]):
        f.where((F.col("pts_ms") >= low) & (F.col("pts_ms") < high)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    ends = f.select("cam_id").distinct().withColumn("ends", F.lit(True))
    ends.select(*[F.col(c) if c in ends.columns else F.lit(None).cast(f.schema[c].dataType).alias(c) for c in f.columns]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run_available(motion_event_stream(arriving, EVENTS), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select(*TELEMETRY)


def motion_event_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to sidecar lines, written, read again and compared as records."""
    path = scratch_path(spark, "sidecar")
    records = sidecar.motion_event_records(events(spark, sf_dir, True))
    sidecar.write_sidecar(records, path)
    return read_sidecar(spark, path, records.schema)


def pipeline_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline as it is delivered, cameras cut into chunks: the sidecar that it writes, read again."""
    path = scratch_path(spark, "delivered")
    outcome = pipeline.motion_pipeline(frames(spark, sf_dir, True), TIMEBASE, EVENTS, chunk_ms=5 * 86_400_000.0)
    pipeline.deliver(outcome, path)
    return read_sidecar(spark, path, outcome.records.schema)


def buffered_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffered transport's times: nanoseconds always, divided."""
    return frames(spark, sf_dir).select("frame_id", timebase.buffered_pts_to_epoch_ms(F.col("pts_us") * 1000, F.lit(BASE_MS), F.lit(1.0e13)).alias("epoch_ms"))


class _Bright:
    """A background model that takes every bright pixel for foreground."""

    def __init__(self, cfg: MotionConfig):
        pass

    def apply(self, frame):
        return frame.max(axis=2)


def foreground_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pixels to counts: every second frame reaches the model, and a frame without pixels counts as none."""
    n = F.col("frame_id") % 17
    pixels = F.unhex(F.concat(F.repeat(F.lit("00ff40"), n.cast("int")), F.repeat(F.lit("001020"), (16 - n).cast("int"))))
    rows = frames(spark, sf_dir).select("cam_id", "frame_id", "pts_ms", F.lit(4).alias("width"), F.lit(4).alias("height"), F.when(F.col("frame_id") % 13 != 0, pixels).alias("img"))
    return motion_counts(rows, MotionConfig(stride=2, morph_kernel=1), _Bright).select("cam_id", "frame_id", "fg_pixels", "total_pixels")


def _one_box():
    return lambda frame: [detection((frame.shape[1], frame.shape[0], frame[0, 0, 0], 9.9), frame[0, 0, 1] / 4, frame[0, 0, 2])] if frame[0, 0, 2] else []


def frame_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that is passed in, over packed frames of two by one pixels."""
    img = F.unhex(F.concat(F.lpad(F.hex(F.col("frame_id") % 200), 2, "0"), F.lpad(F.hex(F.col("cam_id") % 4), 2, "0"), F.lpad(F.hex(F.col("frame_id") % 3), 2, "0"), F.lit("000000")))
    rows = frames(spark, sf_dir).select("frame_id", img.alias("img"), F.lit(2).alias("width"), F.lit(1).alias("height"))
    found = detect(rows, _one_box).select("frame_id", F.explode("detections").alias("d"))
    corner = lambda i: F.element_at("d.xyxy", i + 1).cast("long")
    return found.select("frame_id", *[corner(i).alias(f"x{i}") for i in range(4)], F.col("d.conf").alias("conf"), F.col("d.cls_id").cast("long").alias("cls_id"), F.col("d.cls_name").alias("cls_name"))


_SIDECAR_SQL = f"'motion_event' AS type, {pts_sql('start_ms')} AS start_pts_ns, {pts_sql('stop_ms')} AS stop_pts_ns, start_ms, stop_ms, max_score, {', '.join(motion.TELEMETRY)}"

QUERIES = {f"timebase_{u}": _timebase(u) for u in RAW} | {
    f.__name__: f
    for f in (
        timebase_roundtrip,
        frame_iso_utc,
        pts_mapper,
        frame_from_raw,
        motion_score,
        motion_gate,
        stride_hold,
        motion_activations,
        motion_events,
        motion_events_telemetry,
        motion_events_emit,
        motion_events_fold,
        motion_events_chunked,
        motion_events_stream,
        motion_event_sidecar,
        pipeline_sidecar,
        buffered_pts,
        foreground_counts,
        frame_detections,
    )
}

_TELEMETRY_SQL = events_sql(", ".join(TELEMETRY))
ORACLE_SQL = {f"timebase_{u}": _timebase_sql(u) for u in RAW} | {
    "timebase_roundtrip": f"""WITH {FRAMES_SQL}, there AS (SELECT frame_id, 1e13::DOUBLE + (pts_ms - {BASE_MS}::DOUBLE) / 1e-6::DOUBLE AS pts FROM frames)
SELECT frame_id, pts, CAST(trunc(pts) AS BIGINT) AS pts_whole, {BASE_MS}::DOUBLE + (pts - 1e13::DOUBLE) * 1e-6::DOUBLE AS back_ms FROM there""",
    "frame_iso_utc": """SELECT event_id AS frame_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso FROM events""",
    "pts_mapper": """SELECT event_id AS frame_id, CASE user_id % 5 WHEN 0 THEN 1000.0::DOUBLE + (event_id * 1000.0::DOUBLE - 1e9) * 1e-6 WHEN 1 THEN 2000.0::DOUBLE + (event_id * 1000.0::DOUBLE - 1000) * 1e-3
WHEN 2 THEN 3000.0::DOUBLE + (event_id * 1000.0::DOUBLE - 1000) * 1e0 ELSE event_id * 1000.0::DOUBLE END AS mapped_ms FROM events""",
    "frame_from_raw": f"""WITH {FRAMES_SQL} SELECT cam_id, frame_id, CASE WHEN frame_id % 9 <> 0 THEN {BASE_MS}::DOUBLE + (trunc((pts_ms - {BASE_MS}::DOUBLE) * 1e6 + 0.75::DOUBLE) - 1e13) * 1e-6 ELSE {BASE_MS}::DOUBLE END AS pts_ms FROM frames""",
    "motion_score": _SCORED_SQL + "SELECT frame_id, area_frac, score, is_motion, is_motion AS real_override, FALSE AS wind_like FROM gated",
    "motion_gate": _SCORED_SQL + "SELECT cam_id, count(*) FILTER (is_motion) AS moving, count(*) AS frames, max(score) AS max_score FROM gated GROUP BY cam_id",
    "stride_hold": f"""WITH {FRAMES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY pts_ms, frame_id) - 1 AS n FROM frames)
SELECT a.cam_id, a.frame_id, a.pts_ms, b.score FROM numbered a JOIN numbered b ON a.cam_id = b.cam_id AND b.n = a.n - a.n % 3""",
    "motion_activations": activations_sql(),
    "motion_events": events_sql(EVENT_SQL),
    "motion_events_telemetry": _TELEMETRY_SQL,
    "motion_events_emit": events_sql("cam_id, start_ms, stop_ms, emit_ms"),
    "motion_events_fold": _TELEMETRY_SQL,
    "motion_events_chunked": _TELEMETRY_SQL,
    "motion_events_stream": _TELEMETRY_SQL,
    "motion_event_sidecar": events_sql(_SIDECAR_SQL),
    "pipeline_sidecar": events_sql(_SIDECAR_SQL),
    "buffered_pts": f"WITH {FRAMES_SQL} SELECT frame_id, {BASE_MS}::DOUBLE + (CAST(pts_us * 1000 AS DOUBLE) - 1e13::DOUBLE) / 1e6::DOUBLE AS epoch_ms FROM frames",
    "foreground_counts": f"""WITH {FRAMES_SQL}, numbered AS (
  SELECT cam_id, frame_id, row_number() OVER (PARTITION BY cam_id ORDER BY pts_ms, frame_id) - 1 AS n, CASE WHEN frame_id % 13 <> 0 THEN frame_id % 17 ELSE 0 END AS fg, CASE WHEN frame_id % 13 <> 0 THEN 16 ELSE 0 END AS total FROM frames
)
SELECT a.cam_id, a.frame_id, b.fg AS fg_pixels, CAST(b.total AS BIGINT) AS total_pixels FROM numbered a JOIN numbered b ON b.cam_id = a.cam_id AND b.n = a.n - a.n % 2""",
    "frame_detections": """SELECT event_id AS frame_id, 2::BIGINT AS x0, 1::BIGINT AS x1, event_id % 200 AS x2, 9::BIGINT AS x3, (user_id % 4) / 4.0::DOUBLE AS conf, event_id % 3 AS cls_id, CAST(event_id % 3 AS VARCHAR) AS cls_name
FROM events WHERE event_id % 3 <> 0""",
}
