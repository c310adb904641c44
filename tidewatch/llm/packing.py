"""Variable-capacity best-fit packing of documents into training sequences.

Documents differ, for packing, in their length alone, and no length is above the largest permitted one
(a longer document is cut into pieces of that size and a rest). So the whole problem is a histogram of
bounded size, and best fit decreasing runs exactly, over all documents, on the driver: bins of equal free
space are one class, held as runs of bin numbers, and a length with c documents is placed run by run.
Several opening rules are packed, each bin is downsized to the least permitted length that holds its
contents, and the rule whose bins then cost least is kept. The outcome is a table of runs (length, ranks -> bins,
offsets) whose size depends on the capacities only; documents look up their rank in it.

Ranks within a length: a count over hash buckets of about ``BUCKET_ROWS`` documents, summed up in two levels, plus a row
number inside each, so that a length that holds a third of all documents is not gathered in one task.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, copied, table, tasks_for, word_counts, written

#: Permitted sequence lengths, in words.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence: its length (padding included), attention that grows with its square, and a fixed part.
FIXED_COST, SQUARE_COST = 16.0, 1 / 16384
BUCKET_ROWS = 400


def cost(capacity: int) -> float:
    return capacity + FIXED_COST + SQUARE_COST * capacity * capacity


@dataclass
class Packing:
    """runs: (length, first rank, last rank, first bin, items in each bin, offset of the first, bins' final size)."""

    runs: list[tuple[int, int, int, int, int, int, int]]
    sizes: dict[int, int]
    cost: float


class _Bins:
    """Bins by free space. A class is a list of runs of bin numbers with the same opening size."""

    def __init__(self):
        self.free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # free -> (first bin, bins, capacity)
        self.order: list[int] = []

    def put(self, free: int, first: int, n: int, capacity: int) -> None:
        if not self.free[free]:
            bisect.insort(self.order, free)
        self.free[free].append((first, n, capacity))

    def best(self, length: int) -> int | None:
        i = bisect.bisect_left(self.order, length)
        return self.order[i] if i < len(self.order) else None

    def take(self, free: int, n: int) -> tuple[int, int, int]:
        """A run of at most n bins of the class."""
        first, have, capacity = self.free[free].pop()
        if have > n:
            self.free[free].append((first + n, have - n, capacity))
            have = n
        if not self.free[free]:
            self.order.remove(free)
        return first, have, capacity


def opened(length: int, capacities: tuple[int, ...], top: int, reuse: float) -> int:
    """The bin size to open for a length, among those up to ``top`` (or the least that holds it): the least
    cost for each word that the bin is expected to hold, if a share ``reuse`` of the space beside the
    document is filled later."""
    fits = [c for c in capacities if c >= length]
    return min([c for c in fits if c <= top] or fits[:1], key=lambda c: (cost(c) / (length + reuse * (c - length)), c))


def pack(histogram: dict[int, int], capacities: tuple[int, ...], top: int, reuse: float) -> Packing:
    """Best fit decreasing of all lengths, bins opened by ``opened``, each downsized to its contents."""
    bins, made, next_bin = _Bins(), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            free = bins.best(length)
            if free is None:  # no open bin has room: open as many as the rest needs
                capacity = opened(length, capacities, top, reuse)
                n = -(-left // (capacity // length))
                bins.put(capacity, next_bin, n, capacity)
                next_bin += n
                continue
            # best fit fills the tightest bin until its free space is below the length, then the next of its class
            each = free // length
            first, n, capacity = bins.take(free, max(1, left // each))
            if n * each > left:  # the last bin gets fewer
                each = left
            made.append((length, rank, rank + n * each - 1, first, each, capacity - free))
            bins.put(free - each * length, first, n, capacity)
            rank, left = rank + n * each, left - n * each
    # each class of free space at the end tells its bins' contents, hence their final size
    spans, total, sizes = [], 0.0, defaultdict(int)
    for free, runs in bins.free.items():
        for first, n, capacity in runs:
            final = min(c for c in capacities if c >= capacity - free)
            spans.append((first, first + n, final))
            sizes[final] += n
            total += n * cost(final)
    spans.sort()
    starts, runs = [s[0] for s in spans], []
    for length, a, b, first, each, offset in made:
        bin_, end = first, first + (b - a + 1) // each
        i = bisect.bisect_right(starts, bin_) - 1
        while bin_ < end:  # cut where the bins' final sizes change
            stop = min(end, spans[i][1])
            low = a + (bin_ - first) * each
            runs.append((length, low, low + (stop - bin_) * each - 1, bin_, each, offset, spans[i][2]))
            bin_, i = stop, i + 1
    return Packing(runs, dict(sizes), total)


def optimise(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> Packing:
    """The cheapest packing over the opening rules: the largest size to open freely, and the reuse expected."""
    capacities = tuple(sorted(set(capacities)))
    tries = (pack(histogram, capacities, top, reuse) for top in capacities for reuse in (0.0, 0.5, 0.9, 1.0))
    return min(tries, key=lambda x: x.cost)


def placed(sized: DataFrame, key: str = "doc_id", size: str = "size", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """For each piece of each row of ``sized`` (a table that is cheap to read twice): key, piece, start,
    length, bin_id, bin_size, bin_offset.

    A document of up to the largest capacity is one piece, which a bin holds whole; a longer one is cut
    into pieces of that capacity and a rest. A document without words has one row of length 0 and no bin.
    Repeated rows are packed as often as they come; a null key is a key like any other; an empty table
    gives an empty table. Words of a bin's pieces fill it from offset 0 without gaps.
    """
    spark, top = sized.sparkSession, max(capacities)
    rows = sized.groupBy(key, size).agg(F.count("*").alias("copies"))
    cut = F.when(F.col(size) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.expr(f"({size} - 1) div {top}")))
    pieces = rows.select(key, size, "copies", F.explode(cut).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.lit(top), F.col(size) - F.col("piece") * top))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.sum("copies").alias("n")).collect()}  # at most ``top`` + 1 rows
    plan = optimise({n: c for n, c in histogram.items() if n}, capacities)
    bits = [(n, max(0, math.ceil(math.log2(c / BUCKET_ROWS)))) for n, c in histogram.items()]
    pieces = pieces.join(spark.createDataFrame(bits, "length long, bits int"), "length")
    order = F.xxhash64(key, "piece", F.lit("packing"))
    pieces = pieces.withColumn("order", order).withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(order, 64 - bits)")).otherwise(F.lit(0).cast("long")))
    totals = written(pieces.groupBy("length", "bucket").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")), "pack-buckets")
    most = totals.agg(F.max("most")).first()[0] or 1
    bases = carried(totals.drop("most"), ["length"], "bucket", {"base": ("sum", "n")}).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("order", key, "piece", size).rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(bases.hint("merge"), ["length", "bucket"])
    ranked = copied(ranked, "copies", "copy", [key, "piece"], most).withColumn("rank", F.col("base") + F.col("ahead") + F.col("copy"))
    return _looked_up(ranked.coalesce(tasks_for(sum(histogram.values()))), plan, key, top)


def _looked_up(ranked: DataFrame, plan: Packing, key: str, top: int) -> DataFrame:
    """Bins of (length, rank). The runs are as many as the capacities allow (see the module), not the documents."""
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 7)
    shared = ranked.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        at = np.searchsorted(runs[:, 0], np.arange(top + 2))  # where each length's runs start
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            found = np.full((len(length), 3), -1, dtype=np.int64)
            for n in np.unique(length[length > 0]):
                own = np.flatnonzero(length == n)
                r = runs[at[n] : at[n + 1]]
                r = r[np.searchsorted(r[:, 1], rank[own], "right") - 1]
                step = rank[own] - r[:, 1]
                found[own] = np.stack([r[:, 3] + step // r[:, 4], r[:, 6], r[:, 5] + step % r[:, 4] * n], axis=1)
            none = length == 0
            ends = [pa.array(found[:, k], mask=none) for k in range(3)]
            start = pa.array(batch.column(1).to_numpy() * top)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), start, batch.column(2), *ends], names=schema.names)

    fields = [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "bin_id", "bin_size", "bin_offset")]
    schema = T.StructType([ranked.schema[key], *fields])
    return ranked.select(key, "piece", "length", "rank").mapInArrow(run, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return placed(written(word_counts(docs, keep=["doc_id"]), "pack-sizes"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document goes."""
    return placed(written(word_counts(docs.select("doc_id", "text"), keep=["doc_id"]), "pack-sizes"))
