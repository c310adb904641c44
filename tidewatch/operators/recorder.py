"""Clip requests checked and written as payloads; stored responses read. No network here: see sinks.recorder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RecorderConfig
from ..functions.timebase import Timebase, truncated


def normalise_requests(requests: DataFrame, timebase: Timebase | None = None) -> DataFrame:
    """Adds mode (pts or epoch), the window in that mode, and error; a row is never dropped or thrown.

    A whole PTS pair wins; then a whole epoch pair, as PTS if there is a timebase. Errors: ``missing window``,
    ``negative pts`` (of a converted pair, before truncation) and ``stop not after start``.
    """
    has_pts = F.col("start_pts_ns").isNotNull() & F.col("stop_pts_ns").isNotNull()
    has_epoch = F.col("start_epoch_ms").isNotNull() & F.col("stop_epoch_ms").isNotNull()
    nothing = F.lit(None)
    if timebase:
        exact = [timebase.to_pts(F.col(c)) for c in ("start_epoch_ms", "stop_epoch_ms")]
        negative = ~has_pts & has_epoch & ((exact[0] < 0) | (exact[1] < 0))
        pts = [F.when(has_pts, F.col(c)).when(has_epoch, truncated(x)) for c, x in zip(("start_pts_ns", "stop_pts_ns"), exact)]
        epoch = [nothing.cast("double")] * 2
        mode = F.when(has_pts | has_epoch, "pts")
    else:
        negative = F.lit(False)
        pts = [F.when(has_pts, F.col(c)) for c in ("start_pts_ns", "stop_pts_ns")]
        epoch = [F.when(~has_pts & has_epoch, F.col(c).cast("double")) for c in ("start_epoch_ms", "stop_epoch_ms")]
        mode = F.when(has_pts, "pts").when(has_epoch, "epoch")
    rows = requests.withColumn("mode", mode)
    for name, x in zip(("win_start_pts", "win_stop_pts", "win_start_ms", "win_stop_ms"), (*pts, *epoch)):
        rows = rows.withColumn(name, x)
    backwards = F.coalesce(F.col("win_stop_pts") <= F.col("win_start_pts"), F.col("win_stop_ms") <= F.col("win_start_ms"))
    error = F.when(F.col("mode").isNull(), "missing window").when(F.coalesce(negative, F.lit(False)), "negative pts").when(backwards, "stop not after start")
    return rows.withColumn("error", error)


def payloads(normalised: DataFrame, cfg: RecorderConfig) -> DataFrame:
    """Adds payload, the JSON body: whole-number times, and only the keys that have a value."""
    column = lambda name: F.col(name) if name in normalised.columns else F.lit(None).cast("string")
    body = F.struct(
        F.when(F.col("mode") == "pts", truncated(F.col("win_start_pts"))).alias("start_pts_ns"),
        F.when(F.col("mode") == "pts", truncated(F.col("win_stop_pts"))).alias("stop_pts_ns"),
        F.when(F.col("mode") == "epoch", truncated(F.col("win_start_ms"))).alias("start_epoch_ms"),
        F.when(F.col("mode") == "epoch", truncated(F.col("win_stop_ms"))).alias("stop_epoch_ms"),
        truncated(column("preroll_ms")).alias("preroll_ms"),
        truncated(column("postroll_ms")).alias("postroll_ms"),
        F.coalesce(column("label"), F.lit(cfg.label).cast("string")).alias("label"),
        F.coalesce(column("out_dir"), F.lit(cfg.out_dir).cast("string")).alias("out_dir"),
        column("filename").alias("filename"),
        truncated(column("max_wait_ms")).alias("max_wait_ms"),
    )
    return normalised.withColumn("payload", F.when(F.col("error").isNull(), F.to_json(body)))


def request_key(*columns: str) -> Column:
    """A name for a request that a retried task makes again."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)


def job_id(response: Column) -> Column:
    some = lambda path: F.nullif(F.get_json_object(response, path), F.lit(""))
    return F.coalesce(some("$.id"), some("$.clip_id"))


def status_and_path(response: Column) -> tuple[Column, Column]:
    """(status, path) of a stored clip response. A nested status wins, even a null one (``None``); a path must be
    a string; ``ok`` is true with a path and no status means done; else the status is empty."""
    v = F.try_parse_json(response)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    nested = F.array_contains(F.json_object_keys(F.get_json_object(response, "$.clip")), "status")
    inner = F.when(nested, F.coalesce(F.get_json_object(response, "$.clip.status"), F.lit("None")))
    status = F.coalesce(inner, F.get_json_object(response, "$.status"))
    path = F.coalesce(text("$.clip.path"), text("$.path"))
    done = (kind("$.ok") == "BOOLEAN") & (F.get_json_object(response, "$.ok") == "true") & path.isNotNull()
    return F.coalesce(status, F.when(done, "done"), F.lit("")), path


def first_terminal(polls: DataFrame, job: str = "job_id", order: str = "seq", status: str = "status") -> DataFrame:
    """Of a log of polls, each job's first terminal status (done or error); jobs without one time out (null)."""
    over = F.when(F.col(status).isin("done", "error"), F.col(order))
    return polls.groupBy(job).agg(F.min_by(status, over).alias("final_status"), F.min(over).alias("final_seq"), F.count("*").alias("polls"))
