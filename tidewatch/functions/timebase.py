"""Producer timestamps (PTS) to epoch milliseconds and back, as column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds for each unit of a PTS that counts from a base.
SCALES = {"ns": 1e-6, "us": 1e-3, "ms": 1.0}


@dataclass(frozen=True)
class Timebase:
    """An anchor: epoch milliseconds at a base PTS, and the PTS unit (ns, us, ms, epoch_ms or epoch_s; else ns)."""

    base_epoch_ms: float
    base_pts: float
    units: str = "ns"

    def to_epoch_ms(self, pts: Column) -> Column:
        return pts_to_epoch_ms(pts, F.lit(float(self.base_epoch_ms)), F.lit(float(self.base_pts)), F.lit(self.units))

    def to_pts(self, epoch_ms: Column) -> Column:
        return epoch_ms_to_pts(epoch_ms, F.lit(float(self.base_epoch_ms)), F.lit(float(self.base_pts)), F.lit(self.units))


def _scale(units: Column) -> Column:
    """Unknown units count as ns. Literals are folded when the plan is made."""
    return F.when(units == "us", F.lit(SCALES["us"])).when(units == "ms", F.lit(SCALES["ms"])).otherwise(F.lit(SCALES["ns"]))


def pts_to_epoch_ms(pts: Column, base_epoch_ms: Column, base_pts: Column, units: Column) -> Column:
    pts = pts.cast("double")
    return F.when(units == "epoch_ms", pts).when(units == "epoch_s", pts * 1000.0).otherwise(base_epoch_ms + (pts - base_pts) * _scale(units))


def epoch_ms_to_pts(epoch_ms: Column, base_epoch_ms: Column, base_pts: Column, units: Column) -> Column:
    ms = epoch_ms.cast("double")
    return F.when(units == "epoch_ms", ms).when(units == "epoch_s", ms / 1000.0).otherwise(base_pts + (ms - base_epoch_ms) / _scale(units))


def buffered_pts_to_epoch_ms(pts: Column, base_epoch_ms: Column, base_pts_ns: Column) -> Column:
    """The buffered transport's own form: always nanoseconds, and it divides."""
    return base_epoch_ms + (pts.cast("double") - base_pts_ns) / 1e6


def parse_timebase(document: str | dict) -> Timebase:
    """From a health document, or its ``timebase`` part. Raises ValueError if an anchor is missing."""
    if isinstance(document, str):
        document = json.loads(document)
    part = (document.get("timebase") or document) if isinstance(document, dict) else {}
    pts = part.get("base_pts_ns", part.get("base_pts"))
    if part.get("base_epoch_ms") is None or pts is None:
        raise ValueError("a timebase needs base_epoch_ms and base_pts_ns or base_pts")
    return Timebase(float(part["base_epoch_ms"]), float(pts), str(part.get("pts_units") or "ns").lower())


def timebase_columns(document: Column) -> Column:
    """Struct (base_epoch_ms, base_pts, units) of a JSON column; anchors are null where they are missing."""
    nested = F.get_json_object(document, "$.timebase")
    inside = nested.isNotNull() & (nested != "{}")
    where = lambda name: F.when(inside, F.get_json_object(nested, f"$.{name}")).otherwise(F.get_json_object(document, f"$.{name}"))
    return F.struct(
        where("base_epoch_ms").try_cast("double").alias("base_epoch_ms"),
        F.coalesce(where("base_pts_ns"), where("base_pts")).try_cast("double").alias("base_pts"),
        F.coalesce(F.lower(where("pts_units")), F.lit("ns")).alias("units"),
    )


def mapped_pts(pts: Column, document: Column) -> Column:
    """PTS by a health document; identity where the document has no usable timebase."""
    tb = timebase_columns(document)
    return F.coalesce(pts_to_epoch_ms(pts, tb["base_epoch_ms"], tb["base_pts"], tb["units"]), pts.cast("double"))


def now_ms() -> Column:
    """The wall clock in epoch milliseconds, one value for a whole query."""
    return F.unix_micros(F.current_timestamp()) / 1000.0


def truncated(x: Column) -> Column:
    """To a whole number, towards zero."""
    return x.cast("long")


def iso_utc(epoch_ms: Column) -> Column:
    """ISO 8601 with +00:00; microseconds only where there are any. Independent of the session's time zone."""
    micros = F.round(epoch_ms * 1000.0).cast("long")
    stamp = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))), F.lit("+00:00"))
