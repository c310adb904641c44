from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_without_the_optional_subpackage(tmp_path):
    """A copy without the subpackage and its pipeline imports, and offers all other queries."""
    for name in ("__spark_entry__.py", "tidewatch"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidewatch" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 40 and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "tidewatch").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
