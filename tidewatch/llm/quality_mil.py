"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded (shape
statistics and signed hashed words, then one tanh layer); gated attention weighs the passages, and the
weighted sum is scored. Encoder, attention and score are learned together from document labels only, in
numpy, on a bounded sample; the weights have a fixed size and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, crc_mod, drop_written, passed_on, share_below, table, unused, written
from .textblocks import Words, blocks

PASSAGE = 64
HASHED = 32
#: Byte classes that are counted for each passage.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b"#*$%&|<>",
    b"!?",
    b".,;:",
    b"\"'()[]{}-_/\\@+=~^`",
    bytes(range(0xC2, 0xF5)),
    b"\n",
]
WIDTH = len(CLASSES) + 9 + HASHED


def _class_luts() -> list[np.ndarray]:
    """Two classes to a table, in the halves of a 64-bit counter: one running sum counts both."""
    luts = []
    for i in range(0, len(CLASSES), 2):
        lut = np.zeros(256, dtype=np.uint64)
        lut[list(CLASSES[i])] = 1
        if i + 1 < len(CLASSES):
            lut[list(CLASSES[i + 1])] = 1 << 32
        luts.append(lut)
    return luts


_LUTS = _class_luts()
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b"#*$%&|<>!?")] = True


def passages(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, where each document's passages start). A text without words is one empty passage."""
    words = Words(flat, at)
    count = np.maximum(1, -(-words.counts // PASSAGE))
    where = np.r_[0, np.cumsum(count)]
    total = int(where[-1])
    out = np.zeros((total, WIDTH), dtype=np.float32)
    if not len(words.start):
        return out, where
    within = np.arange(len(words.doc)) - words.bounds[words.doc]
    passage = where[words.doc] + within // PASSAGE
    n = np.bincount(passage, minlength=total)
    size = words.end - words.start
    first = np.flatnonzero(within % PASSAGE == 0)  # each passage's first word
    real = passage[first]
    low = words.start[first]
    last = np.r_[first[1:], len(passage)] - 1
    high = words.end[last]
    length = np.maximum(1, high - low)
    counts = []
    for lut in _LUTS:
        running = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(lut[flat], out=running[1:], dtype=np.uint64)
        both = running[high] - running[low]
        counts += [both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)]
    for k in range(len(CLASSES)):
        out[real, k] = counts[k] / length
    k = len(CLASSES)
    words_in = n[real]
    h = words.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    ordered = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    distinct = np.bincount((ordered[fresh] >> np.uint64(40)).astype(np.int64), minlength=total)[real]
    letters = np.maximum(1, counts[0] + counts[1])
    weigh = lambda x: np.bincount(passage, weights=x, minlength=total)[real] / words_in
    mean = weigh(size)
    out[real, k : k + 9] = np.stack(
        [
            np.log1p(words_in),
            np.minimum(mean, 100) / 10,
            np.sqrt(np.minimum(np.maximum(0, weigh(size.astype(float) ** 2) - mean**2), 1e4)) / 10,
            counts[0] / letters,
            weigh(same),
            distinct / words_in,
            weigh(size <= 3),
            weigh(_ENDS[flat[words.end - 1]]),
            np.minimum(length / words_in, 100) / 10 - np.minimum(mean, 100) / 10,
        ],
        axis=1,
    )
    column = passage * HASHED + (h & np.uint64(HASHED - 1)).astype(np.int64)
    sign = ((h >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1
    out[:, k + 9 :] = np.bincount(column, weights=sign, minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(np.maximum(n, 1))[:, None]
    return out, where


@dataclass
class MilModel:
    """Weights by name: mean, scale; encode W b; gate V U w; score c c0."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, where: np.ndarray) -> dict[str, np.ndarray]:
        """All activations; where: the first passage of each bag, and the end. No bag is empty."""
        p = self.weights
        x = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(where) - 1), np.diff(where))
        e = np.exp(e - np.maximum.reduceat(e, where[:-1])[bag])
        a = e / np.add.reduceat(e, where[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, where[:-1], axis=0)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["c0"])))}

    def gradients(self, f: dict[str, np.ndarray], label: np.ndarray, weight: np.ndarray, where: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss."""
        p, bag, a, h = self.weights, f["bag"], f["a"], f["h"]
        dy = (f["y"] - label) * weight
        dz = dy[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, where[:-1])[bag])
        gate = f["v"] * f["u"]
        dgate = de[:, None] * p["w"]
        dv, du = dgate * f["u"] * (1 - f["v"] ** 2), dgate * f["v"] * f["u"] * (1 - f["u"])
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": gate.T @ de, "c": f["z"].T @ dy, "c0": dy.sum()}


def fit(bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 14, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> MilModel:
    """Adam over bags; no bags, or one label only, give a model that answers the (smoothed) share of label 1."""
    rng = np.random.default_rng(seed)
    prior = ((weight * label).sum() + 1) / (weight.sum() + 2)
    p = {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden)}
    p |= {"V": rng.normal(0, hidden**-0.5, (hidden, gates)), "U": rng.normal(0, hidden**-0.5, (hidden, gates)), "w": rng.normal(0, gates**-0.5, gates)}
    p |= {"c": np.zeros(hidden), "c0": np.array(np.log(prior / (1 - prior)))}
    model = MilModel(p)
    if len(bags) and 0 < label.mean() < 1:
        every = np.concatenate(bags).astype(np.float64)
        p["mean"], p["scale"] = every.mean(0), every.std(0) + 1e-3
        p["c"] = rng.normal(0, 0.1, hidden)
        learned = ["W", "b", "V", "U", "w", "c", "c0"]
        m1, m2, t = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
        weight = weight / weight.mean()
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                where = np.r_[0, np.cumsum([len(bags[j]) for j in own])]
                f = model.forward(np.concatenate([bags[j] for j in own]), where)
                g = model.gradients(f, label[own], weight[own] / len(own), where)
                t += 1
                step = rate * (1 - 0.9 * epoch / epochs)
                for k in learned:
                    grad = g[k] + decay * p[k] * (k in "WVU")
                    m1[k] = 0.9 * m1[k] + 0.1 * grad
                    m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                    p[k] = p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    model.weights = {k: np.asarray(v, dtype=np.float32) for k, v in p.items()}
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows_per_class: int = 2500, bytes_per_class: int = 64 << 20) -> MilModel:
    """Learns from labelled rows (labels 0 and 1; others and nulls are ignored).

    Bounds: about ``rows_per_class`` labelled keys of each class, picked by a hash of the key, at most 1.25 times as many
    documents, and ``bytes_per_class`` of their passages' features, however often a key or a document comes. Each document
    counts by the share of its class that was taken, so that scores stay calibrated.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("label")).distinct()
    found = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = F.lit(False)
    for k, n in found.items():
        picked = picked | ((F.col("label") == k) & share_below(min(1.0, rows_per_class / n), F.col(key), F.lit("mil")))
    few = known.where(picked)  # a row for each of about rows_per_class keys, hence small enough to broadcast
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(few), key).select(key, "label", text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags: list[bytes] = []
            for _, _, flat, at in blocks(batch.column(2)):
                x, where = passages(flat, at)
                bags += [x[a:b].tobytes() for a, b in zip(where, where[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=[key, "label", "bag"])

    schema = T.StructType([sample.schema[key], T.StructField("label", T.IntegerType()), T.StructField("bag", T.BinaryType())])
    kept = written(sample.mapInArrow(encode, schema), "mil-bags")
    got = bounded(kept, "label", "bag", rows_per_class * 5 // 4, bytes_per_class).toPandas().sort_values([key, "label", "bag"])
    drop_written(kept)
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["bag"]]
    y, taken = got["label"].to_numpy(dtype=float), got["label"].value_counts()
    return fit(bags, y, np.array([found[int(k)] / taken[int(k)] for k in y]))


def score(docs: DataFrame, model: MilModel, text: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or just its columns ``keep``) with the probability, 0 to 1, of label 1.

    Every passage of the whole text takes part. A null or word-less text is one empty passage and gets a
    score like any other; repeated rows get equal scores; an empty table stays empty. A column of
    the name ``score_col`` is replaced.
    """
    place, kept = docs.columns.index(text), passed_on(docs, keep, score_col)
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, flat, at in blocks(batch.column(place)):
                x, where = passages(flat, at)
                scores.append(model.forward(x, where)["y"].astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(np.concatenate(scores))], names=schema.names)

    return docs.mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that the contract lets a model learn from: crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(crc_mod("doc_id", 5) != 0)


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = score(docs.select("doc_id", held, "text"), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents that score below 0.3.

    Null and word-less texts are one empty passage, and go if that scores below. Every passage of a long text counts.
    Repeated rows stay or go together; columns of any name pass through. An empty table stays empty; without labels of
    both kinds every document has the same score, the smoothed share of label 1 (0.5 without any label), and stays.
    """
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    (name,) = unused(docs, "quality_score")
    return score(docs, model, score_col=name).where(F.col(name) >= 0.3).select(*[F.col(f"`{c}`") for c in docs.columns])
