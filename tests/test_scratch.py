"""The shared folder: as the session names it, or one of our own where it names none."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tidewatch import scratch

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import os
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
queries = __spark_entry__.queries()
names = ["sidecar_roundtrip", *[n for n in queries if n.startswith("op9_")]]
for name in names:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
from tidewatch import scratch
print("folder", scratch.shared_dir(spark)[len("file://"):])
"""


def test_queries_run_where_no_folder_is_set(tmp_path):
    """A session with no settings at all: neither the machine's defaults nor the tests' own."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    (folder,) = [x.split(" ", 1)[1] for x in done.stdout.splitlines() if x.startswith("folder ")]
    assert folder.startswith(str(tmp_path)) and not os.path.exists(folder)


def test_what_was_written_goes(spark):
    before = scratch.standing(spark)
    paths = [scratch.scratch_path(spark, f"t{i}") for i in range(3)]
    for path in paths:
        spark.range(3).write.parquet(path)
    scratch.remove(spark, paths[0])
    scratch.remove_all(spark, scratch.standing(spark) - before, paths[2])
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, False, True]
    assert spark.read.parquet(paths[2]).count() == 3
    assert scratch.standing(spark) - before == {paths[2]}
