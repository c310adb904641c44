"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1- to 3-grams (letters lower-cased, anything else a space) hash to ``2**bits`` columns. Training
adds up, inside the executors, a (language x column) count matrix; the log-probability matrix is kept sparse
and broadcast, and each block of documents is scored as a sparse product in numpy: its n-gram columns pick
rows of the matrix, which are summed document by document, for a few languages at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, passed_on, share_below, table, unused
from .textblocks import blocks, sums

ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Languages that are counted or scored at a time, and that a task holds counts of.
AT_ONCE, HELD = 16, 64


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    #: For each run of ``AT_ONCE`` languages: the places in its (2**bits, languages) matrix that were met in training, and their values.
    place: tuple[np.ndarray, ...]
    value: tuple[np.ndarray, ...]
    #: Of a column that a language was never met in.
    unmet: np.ndarray
    log_prior: np.ndarray
    bits: int
    temper: int = 60

    def log_prob(self, k: int) -> np.ndarray:
        """(2**bits + 1, languages) of the k-th run; the last row is zero and stands for n-grams without a letter."""
        unmet = self.unmet[k * AT_ONCE : (k + 1) * AT_ONCE]
        out = np.empty(((1 << self.bits) + 1, len(unmet)), dtype=np.float32)
        out[:-1], out[-1] = unmet, 0
        out.reshape(-1)[self.place[k]] = self.value[k]
        return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _valid(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """The block as valid UTF-8, where its texts start, and as a string. What is no UTF-8 becomes U+FFFD, text by text."""
    raw = flat.tobytes()
    begins = at[:-1][at[:-1] < at[1:]]
    try:
        if not ((flat[begins] & 0xC0) == 0x80).any():  # else a text could end the character that the one before began
            return flat, at, raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())]
    parts = [x.encode("utf-8") for x in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), "".join(texts)


def _columns(flat: np.ndarray, at: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the column of every n-gram of the block, and where each document's n-grams start.

    The last column, 2**bits, is that of n-grams without a letter or across two documents.
    """
    flat, at, decoded = _valid(flat, at)
    text = _letters()[np.frombuffer(decoded.encode("utf-32-le"), np.uint32)]
    chars = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum((flat & 0xC0) != 0x80, out=chars[1:])
    where = chars[at]
    n = len(text)
    letter = text != 32
    last = np.zeros(n, dtype=np.int64)  # chars from here to the document's end
    last[:] = np.repeat(where[1:], np.diff(where)) - np.arange(n)
    key, any_letter = text.astype(np.uint64), letter
    for order in ORDERS:
        if order > 1:
            k = order - 1
            key = key.copy()
            key[: n - k] = key[: n - k] * np.uint64(0x1F123BB5) + text[k:]
            more = np.zeros(n, dtype=bool)
            more[: n - k] = letter[k:]
            any_letter = any_letter | more
        column = ((key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
        column = column.astype(np.int64)
        column[~(any_letter & (last >= order))] = 1 << bits
        yield column, where


def _counting(languages: list[str], bits: int):
    index = {x: i for i, x in enumerate(languages)}
    width = 1 << bits

    def cells(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        full = [(i, np.flatnonzero(n[:width])) for i, n in held.items()]
        cell = np.concatenate([np.zeros(0, np.int64), *(i * width + c for i, c in full)])
        n = np.concatenate([np.zeros(0, np.int64), *(held[i][c] for i, c in full)])
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for i, j, flat, at in blocks(batch.column(0)):
                if not len(flat):
                    continue
                met, local = np.unique(lang[i:j], return_inverse=True)
                for column, where in _columns(flat, at, bits):
                    which = np.repeat(local, np.diff(where))
                    for first in range(0, len(met), AT_ONCE):
                        some = met[first : first + AT_ONCE]
                        here = slice(None) if len(met) <= AT_ONCE else (which >= first) & (which < first + AT_ONCE)
                        n = np.bincount((which[here] - first) * (width + 1) + column[here], minlength=len(some) * (width + 1))
                        for x, row in zip(some.tolist(), n.reshape(len(some), width + 1)):
                            held[x] = held[x] + row if x in held else row.copy()
                        if len(held) > HELD:
                            yield cells(held)
                            held = {}
        yield cells(held)

    return count


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    bits: int = 16,
    rows_per_language: int = 4000,
    smoothing: float = 0.5,
) -> LangModel:
    """Learns every language from rows whose language and text are not null.

    Bounds: about ``rows_per_language`` rows of each language (picked by a hash of the key, so that reruns
    agree) and 2**bits columns. The model grows with the languages, by the columns that each is met in. No
    labelled rows: a model without languages, which answers ``und`` for all.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = known.groupBy(F.col(lang).alias("l")).count().collect()
    found.sort(key=lambda r: r["l"])
    languages = [r["l"] for r in found]
    width = 1 << bits
    if not languages:
        return LangModel((), (), (), np.zeros(0, np.float32), np.zeros(0), bits)
    # Few languages have more rows than are picked; a join takes any number of them.
    large = [(r["l"], min(1.0, rows_per_language / r["count"])) for r in found if r["count"] > rows_per_language]
    rows = known.select(F.col(text), F.col(lang).alias("l"), F.col(key).alias("k"))
    if large:
        shares = spark.createDataFrame(large, "l string, share double")
        rows = rows.join(F.broadcast(shares), "l", "left").where(F.col("share").isNull() | share_below(F.col("share"), F.col("k"), F.lit("langid")))
    cells = rows.select(F.col(text), "l").mapInArrow(_counting(languages, bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    language, column = cell // width, cell % width
    total = np.bincount(language, n, minlength=len(languages)) + smoothing * width
    value = np.log((n + smoothing) / total[language]).astype(np.float32)
    unmet = np.log(smoothing / total).astype(np.float32)
    order = np.argsort(cell)
    runs = range(0, len(languages), AT_ONCE)
    bounds = np.searchsorted(language[order], [*runs, len(languages)])
    parts = [order[a:b] for a, b in zip(bounds, bounds[1:])]
    place = tuple((column[p] * min(AT_ONCE, len(languages) - first) + language[p] - first).astype(np.int32 if bits < 26 else np.int64) for first, p in zip(runs, parts))
    size = np.array([r["count"] for r in found], dtype=float)
    return LangModel(tuple(languages), place, tuple(value[p] for p in parts), unmet, np.log(size / size.sum()), bits)


def score_block(model: LangModel, flat: np.ndarray, at: np.ndarray, matrix: Callable[[int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language or -1, tempered posterior of it) for each text of a block.

    matrix: gives ``model.log_prob`` of a run, if the caller keeps one.
    """
    n = len(at) - 1
    if not model.languages or not len(flat):
        return np.full(n, -1), np.zeros(n)
    kind = np.int32 if model.bits < 31 else np.int64
    orders, grams = [(column.astype(kind), where) for column, where in _columns(flat, at, model.bits)], np.zeros(n, dtype=np.int64)
    for column, where in orders:
        grams += sums(column < 1 << model.bits, where)
    temper = np.minimum(1.0, model.temper / np.maximum(grams, 1))[:, None]
    best, top, mass = np.zeros(n, dtype=np.int64), np.full(n, -np.inf), np.zeros(n)
    for k, first in enumerate(range(0, len(model.languages), AT_ONCE)):
        log_prob = (matrix or model.log_prob)(k)
        total = np.zeros((n, log_prob.shape[1]))
        for column, where in orders:
            total += sums(log_prob[column], where)
        scaled = total * temper + model.log_prior[first : first + AT_ONCE]
        high = np.maximum(top, scaled.max(1))
        mass = mass * np.exp(top - high) + np.exp(scaled - high[:, None]).sum(1)
        best = np.where(high > top, first + scaled.argmax(1), best)
        top = high
    return np.where(grams > 0, best, -1), np.where(grams > 0, 1.0 / mass, 0.0)


def identify(
    docs: DataFrame, model: LangModel, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (or just its columns ``keep``, so that texts do not travel back) with the predicted language and its score.

    A text that is null or has no letter gets ``und`` and score 0; ties go to the language first by code
    point. The score is the posterior of the winner with the evidence tempered to ``model.temper`` n-grams,
    so that long texts do not all saturate. Bytes that are no UTF-8 count as U+FFFD, which is no letter. An empty table
    stays empty. Repeated rows get equal answers; other columns pass through, and
    columns of the same names as the new ones are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2**bits x languages places and values, however many rows
    place, kept = docs.columns.index(text), passed_on(docs, keep, lang_col, score_col)
    fields = [docs.schema.fields[i] for i in kept]
    schema = T.StructType([*fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        matrix = lru_cache(maxsize=1)(model.log_prob)
        for batch in batches:
            best, score = [], []
            for _, _, flat, at in blocks(batch.column(place)):
                b, s = score_block(model, flat, at, matrix)
                best.append(b)
                score.append(s)
            if best:
                pred = pa.array(names[np.concatenate(best)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pred, pa.array(np.concatenate(score))], names=schema.names)

    return docs.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that the contract lets a model learn from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(crc_mod("doc_id", 4) != 2)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(learnable(docs))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), model, keep=["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents of no known language, or whose language is a toss-up (score below 0.5).

    Null, empty and letterless texts have no known language and go. Bytes that are no UTF-8 count as U+FFFD. Repeated rows
    stay or go together, ties in score go to the language first by code point, and columns of any name pass through. An
    empty table stays empty; without any labelled row no language is known, and all documents go.
    """
    model = train(learnable(docs))
    pred, score = unused(docs, "lang_pred", "lang_score")
    scored = identify(docs, model, lang_col=pred, score_col=score)
    return scored.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= 0.5)).select(*[F.col(f"`{c}`") for c in docs.columns])
