"""Command line: ``python -m tidewatch.cli horizon | events | reader-report | sync-report``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from .config import EventConfig
from .sinks.sidecar import sync_report


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidewatch")
    commands = parser.add_subparsers(dest="command", required=True)
    horizon = commands.add_parser("horizon", help="the recorded segments in producer logs, and where an event lies against them")
    horizon.add_argument("--log", required=True)
    horizon.add_argument("--last-n", type=int, default=50)
    horizon.add_argument("--event-start-ms", type=float)
    horizon.add_argument("--event-stop-ms", type=float)
    events = commands.add_parser("events", help="motion events of a table of scored frames, as a JSON-lines sidecar")
    events.add_argument("--frames", required=True)
    events.add_argument("--sidecar", required=True)
    defaults = EventConfig()
    for name in ("score_on", "score_off", "min_event_ms", "min_gap_ms", "merge_gap_ms"):
        events.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(defaults, name))
    reader = commands.add_parser("reader-report", help="how each camera's reader did: counters, rate, ages, loop timings")
    reader.add_argument("--reads", required=True, help="parquet: cam_id, frame_id, pts_ms, enqueued, dropped, emitted, loop_us, and stats if the producer told any")
    reader.add_argument("--seconds", type=float, required=True)
    reader.add_argument("--now-ms", type=float)
    report = commands.add_parser("sync-report", help="a sample synchronisation report")
    report.add_argument("-o", "--output")
    return parser


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidewatch").getOrCreate()


def _horizon(args: argparse.Namespace) -> int:
    from .operators import segments
    from .sources.files import read_log_lines

    spark = _session()
    found = segments.parse_segments(read_log_lines(spark, args.log).select("line")).cache()
    span = segments.horizon(found).first()
    if not span["n_segments"]:
        print("no indexed segments")
        return 0
    print(f"{span['n_segments']} segments, horizon {span['earliest_ms']:.3f} to {span['latest_ms']:.3f}")
    for r in segments.last_n(found, args.last_n).collect():
        print(f"{r['idx']:>6}  {r['start_ms']:16.3f}  {r['end_ms']:16.3f}  {r['duration_ms']:12.3f}  {r['path']}")
    asked = (args.event_start_ms, args.event_stop_ms)
    if None not in asked:
        event = spark.createDataFrame([asked], "start_ms double, stop_ms double")
        print(segments.classify_events(event, found).first()["classification"])
    elif asked != (None, None):
        print("an event needs both a start and a stop", file=sys.stderr)
    return 0


def _events(args: argparse.Namespace) -> int:
    from .plans.pipeline import deliver, motion_pipeline

    frames = _session().read.parquet(args.frames)
    cfg = EventConfig(args.score_on, args.score_off, args.min_event_ms, args.min_gap_ms, args.merge_gap_ms)
    deliver(motion_pipeline(frames, None, cfg), args.sidecar)
    return 0


def _reader_report(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .functions.timebase import now_ms
    from .operators.stats import reader_report
    from .sources.files import parse_producer_stats

    reads = _session().read.parquet(args.reads)
    told = parse_producer_stats(F.col("stats")) if "stats" in reads.columns else None
    now = F.lit(args.now_ms) if args.now_ms is not None else now_ms()
    for r in reader_report(reads, F.lit(args.seconds), now, told).orderBy("cam_id").toLocalIterator():
        print(f"{r['cam_id']}: in={r['frames_in']} out={r['frames_out']} (~{r['fps']:.2f} fps) drops={r['drops']} last_age_ms={r['last_age_ms']:.1f}")
        print(f"  read_loop_us mean={r['loop_us_mean']:.0f} p95={r['loop_us_p95']:.0f}")
        if told is not None:
            print(f"  producer encoder_fps={r['encoder_fps']} segments={r['segment_count']} last_segment={r['last_segment']} latest_id={r['latest_id']} lag_fids={r['lag_fids']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "horizon":
        return _horizon(args)
    if args.command == "events":
        return _events(args)
    if args.command == "reader-report":
        return _reader_report(args)
    text = sync_report(datetime.now(timezone.utc).isoformat().replace("+00:00", "Z"))
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
