"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a piecewise-linear weight schedule over training time 0..1.
The schedule's integral, scaled to the target, is the source's cumulative demand. A source's documents stand in a
(hashed) order, pass after pass; a document covers, in each pass, the words from those before it to its end.
What the demand reaches of that is what the mix takes, and the inverse of the demand at its middle is the
time at which it is trained on. Documents are then sorted by range of that position.

Words before a document: documents fall into buckets by their hash, as many for any source, so that no source is
gathered in one task; prefix sums over bucket totals, in two levels, and one inside each bucket add up. Sources are a
table like any other: ranked by range, their targets found by a few sums over all of them, and looked up for
a source's bucket totals, not for its documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, copied, matched, table, tasks_for, unused, word_counts, written

WEIGHTS = (5.0, 2.0, 1.0)
#: (time, factor) knots for each of the repeating weights: heavy sources early, light ones late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)
SHARE = 1.5
LIMIT = 2.0
BUCKET_ROWS = 500
@dataclass(frozen=True)
class Demand:
    """Cumulative share of a schedule, as segments (u0, u1, t0, t1, w0, w1) with linear weight between t0 and t1."""

    segments: tuple[tuple[float, ...], ...]

    @classmethod
    def of(cls, knots) -> Demand:
        area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, u, out = sum(area), 0.0, []
        for (t0, w0), (t1, w1), x in zip(knots, knots[1:], area):
            out.append((u, u + x / total, t0, t1, w0 / total, w1 / total))
            u += x / total
        return cls(tuple(out))


def fill(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Targets that share ``share`` times all sizes by weight; a target stops at ``limit`` times its size
    and what it can't take is shared again by weight, until none is above."""
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = limit * sizes[i]
        left -= sum(target[i] for i in over)
        shut = set(over)
        open_ = [i for i in open_ if i not in shut]
    return target


def plan(sized: DataFrame, source: str, size: str, share: float, limit: float) -> DataFrame:
    """A row for each source: plan_source, source_none (whether it is null; plan_source is empty then), source_rank (by code
    point, null last), source_size, target.

    As ``fill``, with sums over the table of sources in place of a list of them: a source is full if its limit is below
    its part of what is left, and that part only grows, so each round's sums follow from the last round's part.
    """
    spark = sized.sparkSession
    none = F.col(source).isNull()
    found = sized.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("plan_source"), none.alias("source_none")).agg(F.sum(size).alias("source_size"))
    # whole ranges of sources by code point stand in one partition, in the order of the partitions
    ranged = written(found.repartitionByRange("source_none", "plan_source").withColumn("part", F.spark_partition_id()), "mix-sources")
    starts, at = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, at))
        at += n
    inside = Window.partitionBy("part").orderBy("source_none", "plan_source")
    rows = ranged.join(F.broadcast(spark.createDataFrame(starts, "part int, first long")), "part")
    rows = rows.withColumn("source_rank", F.col("first") + F.row_number().over(inside) - 1).drop("part", "first")
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_rank") % len(WEIGHTS) + 1).cast("int")))
    rows = written(rows, "mix-ranks", at)
    most, part, before = F.col("source_size") * F.lit(limit), 0.0, None
    left = total = 0.0
    while part != before:  # part: words for a weight of 1
        full = F.col("weight") * part > most
        r = rows.agg(F.sum("source_size"), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        left, total = share * (r[0] or 0) - (r[1] or 0.0), r[2] or 0.0
        before, part = part, (max(part, left / total) if total else part)
    full = F.col("weight") * before > most
    return rows.select("plan_source", "source_none", "source_rank", "source_size", F.when(full, most).otherwise(F.lit(left) * F.col("weight") / F.lit(total or 1.0)).alias("target"))


def position_of(share: Column, segments: Column) -> Column:
    """The time by which ``share`` (0 to 1) of a source's demand is met: a quadratic in one segment, solved for t."""
    s = F.element_at(F.filter(segments, lambda x: x["u1"] >= F.least(share, F.element_at(segments, -1)["u1"])), 1)
    u, width = share - s["u0"], s["t1"] - s["t0"]
    slope = (s["w1"] - s["w0"]) / width
    root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * slope * u))
    ahead = F.coalesce(F.try_divide(2 * u, s["w0"] + root), F.lit(0.0))  # stable for slope 0 too; 0 / 0 is the start
    return F.least(s["t1"], s["t0"] + ahead)


def curve_of(rank: Column) -> Column:
    """The demand curve of a source, by its rank: an array of segments."""
    made = F.element_at(F.array(*[_literal(Demand.of(s)) for s in SCHEDULES]), (rank % len(SCHEDULES) + 1).cast("int"))
    return made


def _literal(curve: Demand) -> Column:
    names = ("u0", "u1", "t0", "t1", "w0", "w1")
    return F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, s)]) for s in curve.segments])


def mix(sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", share: float = SHARE, limit: float = LIMIT, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """One row for each group of equal rows of ``sized`` (a table that is cheap to read twice), and the largest such group.

    Columns: key, source, size, ``more``, copies (equal rows), before (words before the first copy in its
    source's order), source_rank, source_size, target. ``passes`` tells what the mix takes of each copy, and when.
    """
    plans = plan(sized, source, size, share, limit)
    (text, none) = ("plan_source", "source_none")
    bits = max(0, math.ceil(math.log2(max(1, sized.count() / BUCKET_ROWS))))
    distinct = sized.groupBy(source, key, size, *more).agg(F.count("*").alias("copies"))
    # the top bits of the order choose the bucket, so buckets are runs of the order
    rows = distinct.withColumn("order", F.xxhash64(F.col(key), F.lit("mixing"), *more)).withColumn("words", F.col(size) * F.col("copies"))
    rows = rows.withColumn("bucket", F.expr(f"shiftrightunsigned(order, {64 - bits})") if bits else F.lit(0).cast("long"))
    rows = rows.withColumn(text, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn(none, F.col(source).isNull())
    rows = written(rows, "mix-rows")
    totals = written(rows.groupBy(text, none, "bucket").agg(F.sum("words").alias("in_bucket"), F.max("copies").alias("most")), "mix-buckets")
    most = totals.agg(F.max("most")).first()[0] or 1
    bases = carried(totals.drop("most"), [text, none], "bucket", {"base": ("sum", "in_bucket")}).drop("in_bucket").join(plans, [text, none])
    inside = Window.partitionBy(text, none, "bucket").orderBy("order", key, size, *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    # bases grow with the documents, so they are never broadcast; the windows' partitioning serves the join too
    placed = placed.join(bases.hint("merge"), [text, none, "bucket"])
    return placed.select(key, source, size, *more, "copies", (F.col("base") + F.col("ahead")).alias("before"), "source_rank", "source_size", "target"), most


def passes(size: str, before: Column, limit: float = LIMIT) -> Column:
    """What the mix takes of a copy in each pass over its source: an array of (words, position), without passes that take nothing.

    ``before``: words before it in a pass. The demand of the whole schedule is the target, in whole words; position is
    the time by which the demand reaches the middle of the words taken.
    """
    goal, curve = F.bround("target").cast("long"), curve_of(F.col("source_rank"))

    def one(q: Column) -> Column:
        start = q * F.col("source_size") + before
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col(size), goal - start))
        return F.struct(words.alias("words"), position_of(F.least(F.lit(1.0), F.try_divide(start + words / 2.0, F.col("target"))), curve).alias("position"))

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(limit) - 1).cast("long")), one)
    return F.filter(every, lambda x: x["words"] > 0)


def mixture(sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """For each row of ``sized``: key, size, source_size, target, taken, position (of its first pass) and positions (of
    each pass); sorted by position.

    ``taken`` counts repeats; it is at most ``limit`` times the size, and adds up to the rounded target in
    each source: one document at the end of a source's last pass may be taken in part. Null keys and null
    sources are values like any other; a text without words has size 0 and is never taken; repeated rows
    are separate documents; an empty table gives an empty table. Reruns agree: the order is a hash.
    """
    groups, most = mix(sized, key, source, size, share, limit)
    copies = copied(groups, "copies", "copy", [key], most)
    taken = copies.withColumn("passes", passes(size, F.col("before") + F.col("copy") * F.col(size), limit))
    words = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = taken.select(F.col(key), F.col(size).alias("size"), "source_size", "target", words.alias("taken"), F.try_element_at("passes.position", F.lit(1)).alias("position"), F.col("passes.position").alias("positions"))
    # documents that are not taken stand behind all others, spread by hash so that no range holds them all
    late = 2 + F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return out.withColumn("at", F.coalesce("position", late)).orderBy("at", key).drop("at").coalesce(tasks_for(sized.count()))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(written(word_counts(docs, keep=["doc_id", "source"]), "mix-sizes"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix passes it, sorted by range of training position.

    The copy that the end of a source's demand cuts short is delivered whole. Documents that the mix does not take go.
    """
    sign, size, n, at = unused(docs, "text_hash", "mix_size", "mix_copies", "mix_position")
    signed = docs.withColumn(sign, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    sized = written(word_counts(signed.select("doc_id", "source", sign, "text"), name=size, keep=["doc_id", "source", sign]), "mix-sizes")
    groups, most = mix(sized, size=size, more=(sign,))
    each = copied(groups.where(F.col(size) > 0), "copies", "copy", ["doc_id", sign], most)
    positions = passes(size, F.col("before") + F.col("copy") * F.col(size))["position"]
    decided = each.select("doc_id", "source", sign, F.col("copies").alias(n), F.explode(positions).alias(at))
    rows = matched(signed, written(decided, "mix-taken"), ["doc_id", "source", sign], n)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, at).repartitionByRange(F.col(at), F.col("doc_id")).sortWithinPartitions(at, "doc_id").select(*columns)
