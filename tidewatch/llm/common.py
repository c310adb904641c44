"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import remove, scratch_path
from .textblocks import Words, blocks

#: The words of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Short rows that a task reads, and a file of a table of such rows holds, about.
ROWS_A_TASK = 50_000


def tasks_for(rows: int) -> int:
    """No more tasks and files than so many short rows need; a large table keeps all partitions that it has."""
    return rows // ROWS_A_TASK + 1


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """``df`` cut from its lineage: written once as a table in the shared folder, and read from there.

    rows: how many rows the last step of ``df`` reads, if known; tasks and files are then no more than these need.
    """
    spark, schema = df.sparkSession, df.schema
    if rows is not None:
        df = df.coalesce(tasks_for(rows))
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_written_at", None)
    if path:
        remove(df.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df``, however it spells its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def passed_on(df: DataFrame, keep: list[str] | None, *new: str) -> list[int]:
    """Places of the columns of ``df`` that pass through an operator: all or ``keep``, but those that its ``new`` columns replace."""
    taken = {n.lower() for n in new}
    return [i for i, c in enumerate(df.columns) if c.lower() not in taken and (keep is None or c in keep)]


def crc_mod(column: str, n: int):
    """crc32 of a column as text, mod n; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def share_below(limit: float, *columns):
    """True for about ``limit`` (0 to 1, a number or a column) of the rows, always the same ones."""
    most = F.lit(int(limit * (1 << 24))) if isinstance(limit, (int, float)) else (limit * (1 << 24)).cast("long")
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 24)) < most


def bounded(sample: DataFrame, label: str, data: str, rows: int, size: int) -> DataFrame:
    """Of ``sample`` (columns whose values make a hash, cheap to read twice) at most ``rows`` rows and ``size`` bytes of the
    column ``data`` for each of few values of ``label``, in order of a hash, so that reruns agree. A row that is larger than
    what is left is passed over. Repeated rows count once."""
    (mark,) = unused(sample, "mark")
    marked = sample.withColumn(mark, F.xxhash64(*sample.columns))
    seen = marked.select(label, mark, F.octet_length(data).alias("n")).distinct()
    place = F.row_number().over(Window.partitionBy(label).orderBy(mark))
    first = seen.withColumn("place", place).where(F.col("place") <= 4 * rows).drop("place")  # numbers alone; at most 4 * rows a label
    left: dict = {}
    chosen = []
    for k, m, n in sorted(map(tuple, first.collect())):
        have = left.setdefault(k, [rows, size])
        if have[0] > 0 and n <= have[1]:
            have[0], have[1] = have[0] - 1, have[1] - n
            chosen.append((m,))
    picked = sample.sparkSession.createDataFrame(chosen, f"{mark} long")
    return marked.join(F.broadcast(picked), mark, "left_semi").dropDuplicates([mark]).drop(mark)


def word_counts(docs: DataFrame, text: str = "text", name: str = "size", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or just its columns ``keep``) with the number of words of each whole text; null: 0."""
    place, kept = docs.columns.index(text), passed_on(docs, keep, name)
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            counts += [Words(flat, at).counts for _, _, flat, at in blocks(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(np.concatenate(counts))], names=schema.names)

    return docs.mapInArrow(run, schema)


def matched(docs: DataFrame, decided: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``docs`` joined with ``decided``, which has rows for null-safe keys, each with the number ``count`` of rows of ``docs``
    that have its key; of rows that are repeated, one is joined."""

    def by_keys(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys and c != count])
        on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
        joined = left.join(right, on, how)
        return joined.drop(*[f"__{k}" for k in keys])

    repeated = decided.where(F.col(count) > 1)
    if repeated.isEmpty():
        return by_keys(docs, decided, "inner")
    few = by_keys(docs, repeated.select(*keys, count), "left_semi").dropDuplicates(keys)
    return by_keys(docs, decided.where(F.col(count) == 1), "inner").unionByName(by_keys(few, repeated, "inner"))


#: Copies of a row that are made at a time, from one array.
COPIES = 1 << 16


def copied(rows: DataFrame, copies: str, name: str, keys: list[str], most: int, at_once: int | None = None) -> DataFrame:
    """Each row as often as its column ``copies`` says, numbered from 0 in the column ``name``.

    Copies are made in runs of ``at_once``. Where some row has more than that (``most``: the largest number) the runs
    are dealt out by ``keys`` and run, so that one row that is repeated many times is no task of its own.
    """
    at_once = at_once or COPIES
    (run,) = unused(rows, "copy_run")

    def runs(x: DataFrame) -> DataFrame:
        return x.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {at_once}"))))

    def out(x: DataFrame) -> DataFrame:
        first = F.col(run) * at_once
        return x.withColumn(name, F.explode(F.sequence(first, F.least(first + at_once, F.col(copies)) - 1))).drop(run)

    if most <= at_once:
        return out(rows.withColumn(run, F.lit(0).cast("long")))
    many = runs(rows.where(F.col(copies) > at_once)).repartition(*[F.col(k) for k in keys], F.col(run))
    return out(rows.where(F.col(copies) <= at_once).withColumn(run, F.lit(0).cast("long"))).unionByName(out(many))


#: Rows of one key that a window over running totals sees at a time, about.
SPAN_BITS = 12


def carried(totals: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, str]], bits: int | None = None) -> DataFrame:
    """``totals`` (one row for each ``keys`` and whole number ``order``; cheap to read twice) with, for each name of ``values``,
    the ``sum`` or ``max`` of a column over the rows of the same keys before it in order: name -> (which, column). Of no
    rows, a sum is 0 and a maximum null.

    In two levels, spans of 2**``bits`` of the order and the rows inside a span, so that a key with any number of rows is
    in no task as a whole. Keys must not be null.
    """
    bits = SPAN_BITS if bits is None else bits
    (span, *own) = unused(totals, "span", *[f"span_{n}" for n in values])
    how = {"sum": F.sum, "max": F.max}
    rows = totals.withColumn(span, F.shiftright(order, bits))
    spans = rows.groupBy(*keys, span).agg(*[how[kind](column).alias(o) for o, (kind, column) in zip(own, values.values())])
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, span, *[how[kind](o).over(earlier).alias(o) for o, (kind, _) in zip(own, values.values())])
    inside = Window.partitionBy(*keys, span).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, column) in values.items():
        rows = rows.withColumn(name, how[kind](column).over(inside))
    # spans grow with the rows, so they are never broadcast
    rows = rows.join(spans.hint("merge"), [*keys, span])
    for o, (name, (kind, _)) in zip(own, values.items()):
        zero = F.lit(0)
        rows = rows.withColumn(name, F.coalesce(name, zero) + F.coalesce(o, zero) if kind == "sum" else F.greatest(name, o))
    return rows.drop(span, *own)


#: A filter of keys has at most 2**FILTER_BITS bits (16 MiB), and about ten for each key up to there.
FILTER_BITS = 27
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.view(np.uint64)
    return ((h ^ h >> np.uint64(32)) * _ODD[:, None]) >> np.uint64(64 - bits)


def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the 64-bit numbers in the only column of ``keys``, about ``count`` of them: bits in 64-bit words."""
    bits = min(FILTER_BITS, max(10, (10 * count).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy(), bits))
            word = place >> np.uint64(6)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(word) else word
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(ones.view(np.int64))], names=["word", "ones"])

    found = keys.mapInArrow(marked, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()  # at most 2**21 rows
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("ones").to_numpy().view(np.uint64)
    return out


def in_filter(spark: SparkSession, held: np.ndarray):
    """A column function: false for numbers that are surely not in the filter ``held``."""
    shared, bits = spark.sparkContext.broadcast(held), len(held).bit_length() + 5  # at most 16 MiB

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        place = _places(h.to_numpy(np.int64), bits)
        return pd.Series((shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).all(axis=0))

    return found
