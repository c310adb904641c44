"""Operators on corpora beyond what the driver's tables show: nothing is left out."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewatch.llm import langid, media, toxicity
from tidewatch.llm.textblocks import utf8

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def many_languages(n, rows=6):
    """(doc_id, text, lang): each language has words of its own; the first are the more frequent."""
    out = []
    for k in range(n):
        rng = random.Random(k)
        words = ["".join(rng.choices(LETTERS, k=7)) for _ in range(6)]
        out += [(len(out) + i, " ".join(rng.choices(words, k=40)), f"l{k:03}") for i in range(rows + (k < 64))]
    return out


def test_languages_past_the_64_most_frequent_are_learned(spark):
    rows = many_languages(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == tuple(f"l{k:03}" for k in range(150))
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows)
    assert [r for r in found if r["lang_pred"] != r["lang"]] == []
    kept = {r["doc_id"] for r in langid.stage(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows}


def test_runs_of_languages_score_as_one_matrix(spark):
    rows = many_languages(40, 3)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=3)
    flat, at = utf8(pa.array([r[1] for r in rows] + ["", "123", " ".join(r[1] for r in rows)]))
    whole = np.concatenate([model.log_prob(k) for k in range(3)], axis=1).astype(float)
    total, grams = np.zeros((len(at) - 1, 40)), np.zeros(len(at) - 1)
    for column, where in langid._columns(flat, at, model.bits):
        for d, (a, b) in enumerate(zip(where, where[1:])):
            total[d] += whole[column[a:b]].sum(0)
            grams[d] += (column[a:b] < 1 << model.bits).sum()
    scaled = total * np.minimum(1, model.temper / np.maximum(grams, 1))[:, None] + model.log_prior
    share = np.exp(scaled - scaled.max(1, keepdims=True))
    best, score = langid.score_block(model, flat, at)
    assert best.tolist() == np.where(grams > 0, scaled.argmax(1), -1).tolist()
    np.testing.assert_allclose(score, np.where(grams > 0, 1 / share.sum(1), 0), rtol=1e-9)
    assert np.exp(whole[:-1]).sum(0).round(2).tolist() == [1.0] * 40


def test_feature_covers_all_files_of_a_value(spark):
    """Two values that differ only behind their first file."""
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1024, 1024, 512))
    values = [[a, c], [a, b, c], [a], [a, b[:512]]]
    rows = spark.createDataFrame([(i, b"".join(map(media.stored, v))) for i, v in enumerate(values)], "i int, media binary")
    for grey in (True, False):
        found = {r["i"]: r for r in media.decode_media(rows, grey=grey).collect()}
        assert len({r["feature"] for r in found.values()}) == len(values)
        for i, v in enumerate(values):
            images = [np.frombuffer(x, np.uint8).reshape(-1, 512).astype(int) for x in v]
            flat = np.concatenate([x.ravel() for x in images])
            parts = np.array([x.sum() for x in np.split(flat, np.arange(1, 8) * len(flat) // 8)])
            dx, dy = (sum(np.abs(np.diff(x, axis=k)).sum() for x in images) for k in (1, 0))
            size = "+".join(f"512x{len(x)}" for x in images)
            hist = ",".join(str(x) for x in np.bincount(flat >> 5, minlength=8))
            cells = "".join("1" if 8 * x > parts.sum() else "0" for x in parts)
            assert found[i]["feature"] == f"{size};sum={flat.sum()};dx={dx};dy={dy};hist={hist};cells={cells}"


def test_profiles_are_dealt_evenly():
    """Each part of the format gets about a quarter of the payloads, not what is left beside the quickest."""
    dealt = Counter(media.PROFILES[zlib.crc32(media.payload(f"text {i}".encode())) % len(media.PROFILES)] for i in range(2000))
    assert len(dealt) == 4 and all(400 < n < 600 for n in dealt.values())


def test_only_copies_of_one_label_are_left_out():
    first = np.arange(40)
    other = np.concatenate([first[:4], np.arange(100, 136)])  # the same smallest columns, little else
    near = np.append(first[:-1], 99)
    sets = [first, other, near, first.copy(), other.copy()]
    assert toxicity.unlike(sets) == [0, 1]
    assert toxicity.unlike(sets, [0, 0, 1, 1, 0]) == [0, 1, 2]
