"""The corpus pipeline's rows against stages written again in plain Python."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest

from tidewatch.llm import langid, mixing, packing, quality_mil
from tidewatch.llm.textblocks import utf8

from .test_plans import WORD, check_packing
from .test_simhash import brute_components, brute_fingerprint

WORDS = {"en": ["the", "house", "and", "of", "river", "stone", "with", "light", "morning", "field"], "de": ["der", "und", "haus", "fluß", "stein", "licht", "morgen", "feld", "nicht", "auch"]}


def prose(rng, lang, n):
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er", "."]) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two languages: clean, junk, copies, near copies, silent ones and a long one, with their labels."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(220):
        lang, junk = rng.choice(["en", "de"]), i % 6 == 0
        text = prose(rng, lang, 9000 if i == 7 else rng.randint(20, 300))
        if junk:
            text = " ".join(w + rng.choice(["###", "$$$", "***"]) for w in text.split())
        if i % 10 == 4:
            text = rows[-1][1] if i % 20 == 4 else (rows[-1][1] or "") + " end"  # a copy or near copy of the one before
        rows.append((i, text, lang, ("a", "b", None)[i % 3 if i % 4 else 0], len(text)))
        if i % 2 or junk:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(300, None, None, "a", 0), (301, "", "en", "b", 0), (302, "12 34 !!", "de", "b", 8), (303, rows[5][1], "de", "c", 9), (303, rows[5][1], "de", "c", 9)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def of(text):
    return utf8(pa.array([text], pa.string()))


def by_language(spark, rows):
    """Naive Bayes by counting, on the model's own hashed columns."""
    columns = lambda text: [c for column, _ in langid._columns(*of(text), 16) for c in column.tolist() if c < 1 << 16]
    counts, docs = defaultdict(Counter), Counter()
    for doc_id, text, lang, *_ in rows:
        if lang is not None and text is not None and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 != 2):
            docs[lang] += 1
            counts[lang].update(columns(text))
    kept = []
    for row in rows:
        grams = columns(row[1]) if row[1] else []
        if not grams:
            continue
        scaled = {x: sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * 2**16)) for g in grams) * min(1, 60 / len(grams)) + math.log(docs[x] / docs.total()) for x, c in counts.items()}
        top = max(scaled.values())
        if 1 / sum(math.exp(v - top) for v in scaled.values()) >= 0.5:
            kept.append(row)
    return kept


def by_quality(spark, rows, folder):
    """Scores one by one, with the model that the stage learns from the same rows (learning is seeded)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality_mil.train(docs, quality_mil.learnable(spark.read.parquet(f"{folder}/labels.parquet")))
    return [r for r in rows if model.forward(*quality_mil.passages(*of(r[1])))["y"][0] >= 0.3]


def one_of_each(rows):
    least: dict[int, tuple] = {}
    for row, c in zip(rows, brute_components([brute_fingerprint(r[1]) for r in rows]).tolist()):
        if c not in least or row[0] < least[c][0]:
            least[c] = row
    return list(least.values())


def mixed(rows):
    """How many copies of each document: whole passes, and part of one pass of each source, in the query's hashed order."""
    size = lambda r: len(WORD.findall(r[1] or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.fill([total[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    return size, total, goal


def test_run_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "quality classifier", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]

    def staged(name, docs, expected):
        out = stages[name](spark, docs, folder)
        found = [tuple(r) for r in out.collect()]
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(found, key=order) == sorted(expected, key=order)
        return spark.createDataFrame(found, docs.schema), found

    docs, left = staged("language ID", docs, by_language(spark, rows))
    assert len(rows) - 5 <= len(left) < len(rows)
    docs, left = staged("quality classifier", docs, by_quality(spark, left, folder))
    clean = [r for r in rows if r[0] < 300 and r[0] % 6 and r[0] % 10 != 4]
    assert sum(r in left for r in clean) >= 0.95 * len(clean) and len(left) <= len(rows) - 20
    docs, left = staged("SimHash near-dedup", docs, one_of_each(left))

    size, total, goal = mixed(left)
    copies = Counter(tuple(r) for r in stages["mixing to target weights"](spark, docs, folder).collect())
    for source in total:
        mine = {r: n for r, n in copies.items() if r[3] == source}
        words, longest = sum(size(r) * n for r, n in mine.items()), max(size(r) for r in left if r[3] == source)
        assert round(goal[source]) <= words <= round(goal[source]) + longest  # the last copy is delivered whole
        # all stand in as many passes but for those that the last pass does not reach
        whole = round(goal[source]) // total[source]
        assert all(whole <= mine.get(r, 0) <= min(2, whole + 1) for r in left if r[3] == source and size(r))
    assert set(copies) <= set(left)

    final = corpus_pipeline.run(spark, folder).collect()
    lengths = Counter()
    for r, n in copies.items():
        lengths[r[0]] += n * size(r)
    check_packing(final, lengths)
    by_hand = packing.optimise(Counter(r["length"] for r in final))
    used = {r["bin_id"]: r["bin_size"] for r in final if r["bin_id"] is not None}
    assert sum(packing.cost(x) for x in used.values()) == pytest.approx(by_hand.cost)
