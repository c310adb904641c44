"""The corpus pipeline: each stage calls one operator of tidewatch.llm and works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import langid, mixing, packing, quality_mil, simhash
from tidewatch.llm.common import table, written
from tidewatch.scratch import remove_all, standing

STAGES = [
    ("language ID", langid.stage),
    ("quality classifier", quality_mil.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing to target weights", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: Learned models and iterative components: no SQL form. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to ``documents``; each one's rows are written and read again before the next.

    What a stage wrote for itself, and the rows that it read, go once its own rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    before = standing(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        remove_all(spark, standing(spark) - before, docs._written_at)
    return docs
