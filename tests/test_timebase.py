from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.timebase import Timebase, iso_utc, mapped_pts, parse_timebase, timebase_columns

BASE_MS, BASE_PTS = 1.7e12, 1e13


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("units", ["ns", "us", "ms", "epoch_ms", "epoch_s", "other"])
def test_round_trip(spark, units):
    tb = Timebase(BASE_MS, BASE_PTS, units)
    rows = spark.createDataFrame([(BASE_PTS + d,) for d in (-3.0, -1.0, 0.0, 1.0, 10.0, 100.0)], "pts double")
    for r in rows.select("pts", tb.to_pts(tb.to_epoch_ms(F.col("pts"))).alias("back")).collect():
        # a PTS in nanoseconds loses what a double near the epoch in milliseconds cannot hold
        assert r["back"] == pytest.approx(r["pts"], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize(
    ("document", "pts", "expected"),
    [
        ({"timebase": {"base_epoch_ms": 1000, "base_pts_ns": 1e9, "pts_units": "ns"}}, 1.5e9, 1500),
        ({"timebase": {"base_epoch_ms": 2000, "base_pts": 1e6, "pts_units": "US"}}, 1.5e6, 2500),
        ({"timebase": {}, "base_epoch_ms": 3000, "base_pts_ns": 1000, "pts_units": "ms"}, 1500, 3500),
        ({"base_epoch_ms": 0, "base_pts": 0, "pts_units": "epoch_ms"}, 12345, 12345),
        ({"base_epoch_ms": 0, "base_pts": 0, "pts_units": "epoch_s"}, 12.5, 12500),
        ({}, 123.4, 123.4),
    ],
)
def test_mapper_and_parser(spark, document, pts, expected):
    import json

    assert value(spark, mapped_pts(F.lit(float(pts)), F.lit(json.dumps(document)))) == pytest.approx(expected)
    if document:
        tb = parse_timebase(document)
        assert value(spark, tb.to_epoch_ms(F.lit(float(pts)))) == pytest.approx(expected)
        row = value(spark, timebase_columns(F.lit(json.dumps(document))))
        assert (row["base_epoch_ms"], row["base_pts"], row["units"]) == (tb.base_epoch_ms, tb.base_pts, tb.units)
    else:
        with pytest.raises(ValueError):
            parse_timebase(document)


def test_iso(spark):
    assert value(spark, iso_utc(F.lit(0.0))) == "1970-01-01T00:00:00+00:00"
    assert value(spark, iso_utc(F.lit(1700000000123.0))) == "2023-11-14T22:13:20.123000+00:00"
