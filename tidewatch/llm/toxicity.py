"""Toxicity by cumulative-link ordinal regression.

A document is a sparse set of hashed words. One weight vector, shared by all thresholds, gives its latent
severity f; P(grade <= k) = sigmoid(threshold_k - f), with thresholds in order by construction. The
expected severity is the sum over k of P(grade > k).

Labels tell toxic from clean. Grades come from them: clean is 0; toxic documents with at most the median
number of telling words (found in surprisingly many toxic training documents) are 1, the others 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, drop_written, passed_on, share_below, table, written
from .textblocks import Words, blocks

BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?\"'()[]{}*_-")] = True


def word_columns(flat: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of each text of a block (A-Z lower-cased, punctuation at the edges taken
    off), and where each text's start."""
    words = Words(_LOWER[flat], at)
    for _ in range(3):
        trim = (words.end - words.start > 1) & _EDGE[flat[words.end - 1]] if len(words.end) else np.zeros(0, dtype=bool)
        words.end = words.end - trim
        trim = (words.end - words.start > 1) & _EDGE[flat[words.start]] if len(words.end) else trim
        words.start = words.start + trim
    column = words.hashes() >> np.uint64(64 - bits)
    keys = np.unique(words.doc.astype(np.uint64) << np.uint64(bits) | column)
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(keys >> np.uint64(bits), np.arange(len(at)))


@dataclass(frozen=True)
class OrdinalModel:
    """weights by column; thresholds in order, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, column: np.ndarray, where: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[column], dtype=np.float64)])
        f = total[where[1:]] - total[where[:-1]]
        return 1 / (1 + np.exp(np.clip(self.thresholds - f[:, None], -500, 500)))


def unlike(sets: list[np.ndarray], labels: list[int] | None = None, least: int = 4, alike: float = 0.8) -> list[int]:
    """Places of sets of which no earlier one of the same label is a copy or near copy: one with the same ``least``
    smallest columns that shares ``alike`` of all columns of both.

    A group of copies would otherwise vouch, document by document, for every word in it.
    """
    kept: dict[tuple, list[int]] = {}
    for i, x in enumerate(sets):
        group = kept.setdefault((labels[i] if labels is not None else None, x[:least].tobytes()), [])
        for j in group:
            y = sets[j]
            most = max(len(x), len(y))
            if min(len(x), len(y)) < alike * most:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= alike * (len(x) + len(y) - both):
                break
        else:
            group.append(i)
    return sorted(i for group in kept.values() for i in group)


def telling_columns(column: np.ndarray, where: np.ndarray, toxic: np.ndarray, width: int, chance: float = 3.0, share: float = 0.01, times: float = 3.0) -> np.ndarray:
    """True for each column that tells of toxicity.

    A telling word is in ``share`` of all toxic documents or more, in a share of them ``times`` as large as that of clean ones, and so many standard errors above it
    that, of all columns that three documents or more have, only about ``chance`` would be by chance.
    """
    doc = np.repeat(np.arange(len(toxic)), np.diff(where))
    n_bad = toxic.sum()
    n_good = len(toxic) - n_bad
    bad = np.bincount(column, weights=toxic[doc], minlength=width)
    good = np.bincount(column, minlength=width) - bad
    pooled = np.maximum((bad + good) / len(toxic), 1e-12)
    z = (bad / n_bad - good / n_good) / np.sqrt(pooled * np.maximum(1 - pooled, 1e-12) * (1 / n_bad + 1 / n_good))
    judged = np.count_nonzero(bad + good >= 3)
    surprise = NormalDist().inv_cdf(1 - chance / max(judged, 20 * chance))
    return (z >= surprise) & (bad + good >= 3) & (bad >= share * n_bad) & (bad / n_bad >= times * good / n_good)


def grades(column: np.ndarray, where: np.ndarray, toxic: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Clean: 0; toxic with at most their median of telling words: 1; with more: 2."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(where))
    hits = np.bincount(doc, weights=telling[column], minlength=len(toxic))
    return np.where(toxic == 0, 0, np.where(hits > np.median(hits[toxic == 1]), 2, 1))


def likelihood(w: np.ndarray, low: float, gap: float, column: np.ndarray, doc: np.ndarray, grade: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """The weighted log-likelihood of grades 0, 1, 2 under weights ``w`` and thresholds low and low + exp(gap), and its
    gradients by w, low and gap. ``column`` and ``doc``: which weight counts in which document."""
    f = np.bincount(doc, weights=w[column], minlength=len(grade))
    ends = np.array([low, low + np.exp(gap)])
    upto = 1 / (1 + np.exp(np.clip(f[:, None] - ends, -500, 500)))  # P(grade <= k)
    full = np.column_stack([np.zeros(len(f)), upto, np.ones(len(f))])
    slope = np.column_stack([np.zeros(len(f)), upto * (1 - upto), np.zeros(len(f))])
    rows = np.arange(len(f))
    p = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
    up, down = slope[rows, grade + 1] / p, slope[rows, grade] / p
    by_end = [(share * (up * (grade == k) - down * (grade == k + 1))).sum() for k in (0, 1)]
    by_weight = np.bincount(column, weights=(share * (down - up))[doc], minlength=len(w))
    return float((share * np.log(p)).sum()), by_weight, sum(by_end), by_end[1] * np.exp(gap)


def fit(column: np.ndarray, where: np.ndarray, toxic: np.ndarray, weight: np.ndarray, bits: int = BITS, steps: int = 300, rate: float = 0.3, ridge: float = 2e-4) -> OrdinalModel:
    """Gradient ascent with per-weight rates (AdaGrad) on the weighted likelihood of the grades.

    Columns that tell nothing (``telling_columns``) stay at 0. No documents, or one label only, give a
    model without weights that calls nothing toxic.
    """
    width = 1 << bits
    weights = np.zeros(width, dtype=np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return OrdinalModel(weights, np.array([20.0, 21.0]))
    telling = telling_columns(column, where, toxic, width)
    grade = grades(column, where, toxic, telling)
    index = np.cumsum(telling) - 1
    doc = np.repeat(np.arange(len(toxic)), np.diff(where))
    keep = telling[column]
    column, doc = index[column[keep]], doc[keep]
    n = int(index[-1]) + 1
    w, low, gap = np.zeros(n), 1.0, 0.0
    share = weight / weight.sum()
    squares = [np.full(n, 1e-8), 1e-8, 1e-8]
    for _ in range(steps):
        _, by_weight, by_low, by_gap = likelihood(w, low, gap, column, doc, grade, share)
        g = [by_weight - ridge * w / n**0.5, by_low, by_gap]
        squares = [s + x**2 for s, x in zip(squares, g)]
        w = w + rate * g[0] / np.sqrt(squares[0])
        low, gap = low + rate * g[1] / np.sqrt(squares[1]), gap + rate * g[2] / np.sqrt(squares[2])
    weights[telling] = w
    return OrdinalModel(weights, np.array([low, low + np.exp(gap)]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows_per_class: int = 3000, bytes_per_class: int = 64 << 20, bits: int = BITS) -> OrdinalModel:
    """Learns from labelled rows (labels 0 and 1; others and nulls are ignored).

    Bounds: about ``rows_per_class`` labelled keys of each class, picked by a hash of the key, at most 1.25 times as many
    documents, and ``bytes_per_class`` of their words, however often a key or a document comes. The copies among them are
    left out; the others of a class share its whole weight.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label")).distinct()
    found = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = F.lit(False)
    for k, n in found.items():
        picked = picked | ((F.col("label") == k) & share_below(min(1.0, rows_per_class / n), F.col(key), F.lit("toxicity")))
    # a row for each of about rows_per_class keys
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(known.where(picked)), key).select(key, "label", text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for _, _, flat, at in blocks(batch.column(2)):
                column, where = word_columns(flat, at, bits)
                sets += [column[a:b].astype(np.int32).tobytes() for a, b in zip(where, where[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=[key, "label", "words"])

    schema = T.StructType([sample.schema[key], T.StructField("label", T.IntegerType()), T.StructField("words", T.BinaryType())])
    kept = written(sample.mapInArrow(encode, schema), "toxicity-words")
    got = bounded(kept, "label", "words", rows_per_class * 5 // 4, bytes_per_class).toPandas().sort_values([key, "label", "words"])
    drop_written(kept)
    sets = [np.frombuffer(b, np.int32) for b in got["words"]]
    own = unlike(sets, got["label"].tolist())
    sets, got = [sets[i] for i in own], got.iloc[own]
    left = got["label"].value_counts()
    where = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    toxic = got["label"].to_numpy(dtype=float)
    return fit(np.concatenate([np.zeros(0, np.int32), *sets]).astype(np.int64), where, toxic, np.array([found[int(k)] / left[int(k)] for k in toxic]), bits)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows_per_class: int = 3000, bits: int = BITS) -> OrdinalModel:
    """Learns from labelled rows (labels 0 and 1; others and nulls are ignored); about ``rows_per_class`` of each,
    picked by a hash of the key. The copies among them are left out; the others of a class share its whole weight."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label"))
    found = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked, rates = F.lit(False), {}
    for k, n in found.items():
        rates[k] = min(1.0, rows_per_class / n)
        picked = picked | ((F.col("label") == k) & share_below(rates[k], F.col(key), F.lit("toxicity")))
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(known.where(picked)), key).select(key, "label", text)  # bounded by rows_per_class

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for _, _, flat, at in blocks(batch.column(2)):
                column, where = word_columns(flat, at, bits)
                sets += [column[a:b].astype(np.int32).tobytes() for a, b in zip(where, where[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=[key, "label", "words"])

    schema = T.StructType([sample.schema[key], T.StructField("label", T.IntegerType()), T.StructField("words", T.BinaryType())])
    got = sample.mapInArrow(encode, schema).toPandas().sort_values([key, "label", "words"])
    sets = [np.frombuffer(b, np.int32) for b in got["words"]]
    own = unlike(sets, got["label"].tolist())
    whole = got["label"].value_counts()
    sets, got = [sets[i] for i in own], got.iloc[own]
    left = got["label"].value_counts()
    where = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    toxic = got["label"].to_numpy(dtype=float)
    return fit(np.concatenate([np.zeros(0, np.int32), *sets]).astype(np.int64), where, toxic, np.array([whole[int(k)] / rates[int(k)] / left[int(k)] for k in toxic]), bits)


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or just its columns ``keep``) with score (P(grade > 0)), severity (expected grade), grade (likeliest) and toxic.

    All words of the whole text count. Null and word-less texts have latent severity 0, hence grade 0 unless
    the thresholds say otherwise; repeated rows get equal answers; an empty table stays empty. Columns of the new
    names are replaced.
    """
    new = [("score", T.DoubleType()), ("severity", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]
    place, kept = docs.columns.index(text), passed_on(docs, keep, *[n for n, _ in new])
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *(T.StructField(*x) for x in new)])
    # 2**BITS float32 at most, whatever the input; most are 0, so only the others travel
    full = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((full, model.weights[full], len(model.weights), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, weights, width, thresholds = shared.value
        every = np.zeros(width, dtype=np.float32)
        every[full] = weights
        model, bits = OrdinalModel(every, thresholds), int(width).bit_length() - 1
        for batch in batches:
            above = [np.zeros((0, len(thresholds)))]
            above += [model.above(*word_columns(flat, at, bits)) for _, _, flat, at in blocks(batch.column(place))]
            p = np.concatenate(above)
            each = -np.diff(np.column_stack([np.ones(len(p)), p, np.zeros(len(p))]), axis=1)
            columns = [pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
