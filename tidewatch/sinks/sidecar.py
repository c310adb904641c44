"""JSON-lines sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fixed fields of a motion event's record, in order, with their types.
MOTION_EVENT = (
    ("start_pts_ns", "bigint"),
    ("stop_pts_ns", "bigint"),
    ("start_ms", "double"),
    ("stop_ms", "double"),
    ("max_score", "double"),
    ("wind_like", "boolean"),
    ("real_override", "boolean"),
    ("foliage_motion_frac", "double"),
    ("wind_idx", "double"),
    ("wind_state", "string"),
    ("zones_active_frac", "double"),
)
DEFAULTS = {"wind_like": False, "real_override": False, "foliage_motion_frac": 0.0, "wind_idx": 0.0, "wind_state": "Unknown", "zones_active_frac": 0.0}


def write_sidecar(records: DataFrame, path: str, one_file: bool = False, order: list[str] | None = None) -> None:
    """Writes records as JSON lines and replaces what was there. Nulls are written, text is not escaped.

    ``path`` is a folder; ``one_file`` puts all lines, sorted by ``order``, into one part of it (for one camera's
    sidecar, not for many).
    """
    if one_file:
        records = records.coalesce(1)
        records = records.sortWithinPartitions(*order) if order else records
    records.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "none").json(path)


def motion_event_records(events: DataFrame) -> DataFrame:
    """Events as sidecar records: type and the eleven fields, missing telemetry at its default."""
    field = lambda name, kind: (F.col(name) if name in events.columns else F.lit(DEFAULTS.get(name))).cast(kind).alias(name)
    return events.select(F.lit("motion_event").alias("type"), *[field(*x) for x in MOTION_EVENT])


def as_line(records: DataFrame) -> Column:
    """A record as one JSON line, nulls written."""
    return F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})


def sync_report(generated: str) -> str:
    """The sample synchronisation report: constants and a time."""
    return f"# Sync Report (sample)\n\nGenerated: {generated}\n\n- video: demo.mp4\n- audio: demo.m4a\n- offset_ms: 12\n- drift_ppm: 2.3\n"
