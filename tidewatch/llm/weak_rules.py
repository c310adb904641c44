"""Quality rules under weak supervision.

Eleven rules look at each whole text and vote good (1), bad (-1) or abstain (0). None restates the base rules,
which decide by themselves. A vote pattern is one of 3**11, so the counts of all patterns over all documents
are a table of bounded size; on it, expectation-maximisation estimates the share of good documents and how
often each rule votes good, votes bad or abstains in either class. The posterior probability of a
document's pattern decides, in place of having to pass every rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passed_on, table, written
from .textblocks import BASE, SPACE, Words, blocks, mix, run_hashes, run_ids, sums

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: (name, bad at or beyond, good at or within, whether more is worse). In between, and where a rule's
#: denominator is 0, it abstains.
RULES = (
    ("mean word length, away from 6.5", 5.5, 3.5, True),
    ("symbols per word", 0.2, 0.02, True),
    ("words with a letter", 0.6, 0.8, False),
    ("repeated lines", 0.3, 0.05, True),
    ("capitals among letters", 0.5, 0.2, True),
    ("digits", 0.3, 0.1, True),
    ("words that repeat the last", 0.1, 0.02, True),
    ("words of three letters or less", 0.05, 0.15, False),
    ("words that end in two marks or a symbol", 0.2, 0.05, True),
    ("words to a sentence", 80.0, 40.0, True),
    ("share of the commonest word", 0.3, 0.15, True),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT = _lut(SYMBOLS), _lut(b"0123456789")
_UPPER, _LETTER = _lut(bytes(range(65, 91))), _lut(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))
_STOP, _MARK = _lut(b".!?"), _lut(SYMBOLS + b".!?,;:-_=~^+/@")


def _of_one_text(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 made equal only for equal ones of the same text."""
    return doc.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _repeats(h: np.ndarray) -> np.ndarray:
    """For each number: whether an equal one stands before it, and whether it has an equal at all."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    later, equal = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    later[order[1:][same]] = True
    equal[order[1:][same]] = True
    equal[order[:-1][same]] = True
    return np.stack([later, equal])


def _window_ids(ids: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each window of words that begins at ``first``: equal for equal windows of one text only."""
    h = mix(doc[first].astype(np.uint64))
    for k in range(WINDOW):
        h = mix(h * np.uint64(BASE) + ids[first + k].astype(np.uint64))
    _, at, out = np.unique(h, return_index=True, return_inverse=True)
    model = first[at[out]]
    if (doc[model] == doc[first]).all() and all((ids[model + k] == ids[first + k]).all() for k in range(WINDOW)):
        return out
    out = doc[first].astype(np.uint64)  # different windows with one hash: number pair by pair
    for k in range(WINDOW):
        out = np.unique(out << np.uint64(32) | ids[first + k].astype(np.uint64), return_inverse=True)[1].ravel().astype(np.uint64)
    return out


def statistics(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the five base statistics, the votes of the rules) of each text of a block."""
    n = len(at) - 1
    words = Words(flat, at)
    counts, bounds, doc = words.counts, words.bounds, words.doc
    of_bytes = lambda mask: sums(mask, at)
    solid, opens = ~SPACE[flat], (flat & 0xC0) != 0x80
    chars = of_bytes(solid & opens)
    symbols, digits, upper, letters = (of_bytes(lut[flat]) for lut in (_SYMBOL, _DIGIT, _UPPER, _LETTER))

    # lines: between \n and at the ends of texts
    breaks = np.flatnonzero(flat == 10)
    start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
    before = np.concatenate([[0], np.cumsum(solid)])
    full = before[end] > before[start]
    start, end = start[full], end[full]
    line_doc = np.searchsorted(at, start, "right") - 1
    line_ids = run_ids(flat, start, end, run_hashes(flat, start, end))
    lines = np.bincount(line_doc, minlength=n)
    dup_lines = np.bincount(line_doc, weights=_repeats(_of_one_text(line_ids, line_doc))[0], minlength=n).astype(np.int64)

    # windows of five words
    ids = words.ids()
    total = len(ids)
    inside = np.zeros(total, dtype=bool)
    if total >= WINDOW:
        inside[: total - WINDOW + 1] = doc[WINDOW - 1 :] == doc[: total - WINDOW + 1]
    first = np.flatnonzero(inside)
    found = first[_repeats(_window_ids(ids, first, doc))[1]]
    cover = np.zeros(total + 1, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    repeat = sums(np.cumsum(cover[:total]) > 0, bounds)

    # words by what they are made of
    running = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letter_before, char_before = running(_LETTER[flat] & opens), running(opens)
    own_letters = letter_before[words.end] - letter_before[words.start]
    own_chars = char_before[words.end] - char_before[words.start]
    spelled = own_letters > 0
    # letters alone, but for marks behind them
    short = spelled & (own_letters <= 3) & (own_chars <= own_letters + 1)
    last = flat[words.end - 1]
    second = flat[np.maximum(words.end - 2, words.start)]
    loud = spelled & (_SYMBOL[last] | _MARK[last] & _MARK[second] & (words.end - words.start > 1))
    stops = _STOP[last]
    again = np.zeros(total, dtype=bool)
    again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    key, often = np.unique(_of_one_text(ids, doc), return_counts=True)
    commonest = np.zeros(n, dtype=np.int64)
    np.maximum.at(commonest, (key >> np.uint64(32)).astype(np.int64), often)

    over = lambda a, b: np.divide(a, b, out=np.full(n, np.nan), where=b > 0)
    of_words = lambda mask: sums(mask, bounds).astype(float)
    with_letter, sentences = of_words(spelled), of_words(stops)
    values = (
        np.abs(over(chars.astype(float), counts) - 6.5),
        over(symbols.astype(float), counts),
        over(with_letter, counts),
        over(dup_lines.astype(float), lines),
        over(upper.astype(float), letters),
        over(digits.astype(float), chars),
        over(of_words(again), counts),
        over(of_words(short), with_letter),
        over(of_words(loud), with_letter),
        # without any end the text is a part of a sentence: it says nothing while it is short
        np.where(sentences > 0, over(counts.astype(float), sentences), np.where(counts >= RULES[9][1], np.inf, np.nan)),
        np.where(counts >= 20, over(commonest.astype(float), counts), np.nan),
    )
    votes = np.zeros((n, len(RULES)), dtype=np.int64)
    for k, ((_, bad, good, more), x) in enumerate(zip(RULES, values)):
        x, bad, good = (x, bad, good) if more else (-x, -bad, -good)
        votes[:, k] = np.where(x >= bad, -1, np.where(x <= good, 1, 0))  # NaN: neither
    return np.stack([counts, chars, symbols, dup_lines, repeat], axis=1), votes


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or just its columns ``keep``) with the base statistics and the vote pattern: base-3
    digits of votes + 1. Columns of the new names are replaced.

    Every word and line of the whole text counts; equal ones are equal byte for byte. Null and empty texts have no
    words: all statistics are 0. Repeated rows get equal answers, and an empty table stays empty. Texts are worked on in
    blocks of 128 KiB or one text, with some 100 bytes of memory for each byte of it.
    """
    place, kept = docs.columns.index(text), passed_on(docs, keep, *STATS, "pattern")
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *(T.StructField(x, T.LongType()) for x in (*STATS, "pattern"))])
    digits = 3 ** np.arange(len(RULES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, len(STATS) + 1), np.int64)]
            for _, _, flat, at in blocks(batch.column(place)):
                stats, votes = statistics(flat, at)
                found.append(np.column_stack([stats, (votes + 1) @ digits]))
            every = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(every[:, k]) for k in range(every.shape[1]))], names=schema.names)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; says: for each rule, class (bad, good) and vote (bad, abstain, good), how often."""

    prior: float
    says: np.ndarray

    def evidence(self) -> np.ndarray:
        """For each rule and vote, the log odds of good that it adds. A bad vote never speaks for good, nor a good one
        for bad, and an abstention, which is no vote, never speaks louder than ``MUTE``."""
        odds = np.log(self.says[:, 1] / self.says[:, 0])
        return np.column_stack([np.minimum(odds[:, 0], 0), np.clip(odds[:, 1], -MUTE, MUTE), np.maximum(odds[:, 2], 0)])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + self.evidence()[np.arange(votes.shape[1]), votes + 1].sum(1)
        return 1 / (1 + np.exp(-odds))


MUTE = 0.5
#: What rules are taken to say before any document is seen: in bad documents (a rule sees one defect of many) and
#: in good ones; as if this had been seen on ``STRENGTH`` of all documents, spread over both classes.
BEFORE = np.array([[0.3, 0.1, 0.6], [0.01, 0.09, 0.9]])
STRENGTH = 0.01
LEAST = 0.001


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 300) -> LabelModel:
    """EM over vote patterns that ``n`` documents have, started from the documents that no rule calls bad as good.

    A rule's three answers have Dirichlet priors in each class (``BEFORE``, ``STRENGTH``), which tell the classes apart,
    so that they cannot swap; no answer is rarer than ``LEAST``, so that one rule alone never decides for certain.
    No documents give the priors.
    """
    total, k = float(n.sum()), votes.shape[1]
    q = np.where((votes == -1).any(1), 0.3, 0.95)
    said = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    model = LabelModel(0.5, np.tile(BEFORE, (k, 1, 1)))
    for _ in range(rounds if total else 0):
        prior = float(np.clip((n * q).sum() / total, 0.02, 0.98))
        says = np.empty((k, 2, 3))
        for y, share in enumerate((1 - q, q)):
            seen = np.tensordot(n * share, said, 1) + STRENGTH * total / 2 * BEFORE[y]
            says[:, y] = np.maximum(seen / seen.sum(1, keepdims=True), LEAST)
        new = LabelModel(prior, says)
        done = np.abs(new.says - model.says).max() < 1e-9
        model, q = new, new.posterior(votes)
        if done:
            break
    return model


def judged(stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``stats`` (a table cheap to read twice, with the columns of ``measured``) with base_failed, quality and kept.

    quality is the posterior of the votes. kept is false where the base rules fail, else quality >= threshold.
    Null and empty texts have no words, so the base rules fail; an empty table stays empty.
    """
    spark = stats.sparkSession
    counted = stats.groupBy("pattern").count().toPandas()  # at most 3**11 rows
    pattern = counted["pattern"].to_numpy(dtype=np.int64)
    votes = votes_of(pattern)
    model = estimate(votes, counted["count"].to_numpy(dtype=float))
    rows = [(int(p), float(q)) for p, q in zip(pattern, model.posterior(votes))]
    quality = spark.createDataFrame(rows, "pattern long, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.join(quality, "pattern").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(written(measured(docs, keep=["doc_id"]), "rules")).select("doc_id", *STATS, "base_failed", "kept", "quality")
