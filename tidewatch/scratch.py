"""A folder that the driver and all executors share, for what a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Of each application: the temporary folder made for it, if any, and the paths handed out that still stand.
_made: dict[str, str] = {}
_out: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, in local mode only, a temporary folder of our own, one for each application, which goes when the
    process ends. Core settings can't be changed in a running session, so the folder is remembered here.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _made:
        folder = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _made[context.applicationId] = f"file://{folder}"
    return _made[context.applicationId]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what stands at a path of the shared folder that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths = _out.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)


def standing(spark: SparkSession) -> set[str]:
    """The paths handed out by now and not removed."""
    return set(_out.get(spark.sparkContext.applicationId, []))


def remove_all(spark: SparkSession, paths: set[str], *but: str) -> None:
    """Deletes ``paths``, but for ``but``. DataFrames that read any of them can't be evaluated after that."""
    for path in paths - set(but):
        remove(spark, path)
