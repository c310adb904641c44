from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import langid, quality_mil, textblocks, toxicity
from tidewatch.llm.common import bounded, unused, word_counts, written
from tidewatch.llm.textblocks import Words, blocks, utf8

from .conftest import prose


def count_words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_words_of_blocks(odd_rows):
    texts = [r[1] for r in odd_rows]
    counts, spelled = [], {}
    for i, j, flat, at in blocks(pa.array(texts, pa.string()), 2000):
        words = Words(flat, at)
        counts += words.counts.tolist()
        for a, b, d, h in zip(words.start, words.end, words.doc, words.hashes()):
            word = flat[a:b].tobytes()
            assert at[d] <= a < b <= at[d + 1]
            assert spelled.setdefault(word, h) == h
    assert counts == [count_words(t) for t in texts]
    assert len(set(spelled.values())) == len(spelled)


def test_slices_of_arrays_and_large_blocks():
    column = pa.array(["ab", None, "", "cd", "e" * 10]).slice(1, 4)
    flat, at = utf8(column)
    assert flat.tobytes() == b"cd" + b"e" * 10 and at.tolist() == [0, 0, 0, 2, 12]
    assert [(i, j) for i, j, _, _ in blocks(column, 3)] == [(0, 3), (3, 4)]
    assert textblocks.powers(textblocks.BASE, 5)[4] == np.uint64(textblocks.BASE**4 % 2**64)


def test_word_counts_and_names(odd, odd_rows):
    (name,) = unused(odd, "size")
    assert name == "size_"
    found = sorted(r[name] for r in word_counts(odd, name=name).collect())
    assert found == sorted(count_words(r[1]) for r in odd_rows)


# --- language ----------------------------------------------------------------------------------------


def grams(text):
    text = "".join(c.lower() if len(c.lower()) == 1 else c for c in ((c if c.isalpha() else " ") for c in text))
    return [text[i : i + n] for n in langid.ORDERS for i in range(len(text) - n + 1) if text[i : i + n].strip()]


def test_naive_bayes_equals_counting_by_hand(spark):
    """With so many columns that n-grams hardly share one, the hashed model is the plain one."""
    rng = random.Random(1)
    words = {"en": ["the", "and", "that"], "de": ["der", "und", "daß"]}
    rows = [(i, prose(rng, 20, words[lang]), lang) for i in range(12) for lang in words]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=20, rows_per_language=1000)
    assert model.languages == ("de", "en")
    counts = {lang: Counter(g for _, t, x in rows if x == lang for g in grams(t)) for lang in words}
    for text in ("The man", "und 12", "das Haus and", "ß"):
        flat, at = utf8(pa.array([text]))
        best, score = langid.score_block(model, flat, at)
        g = grams(text)
        total = {lang: sum(math.log((c[x] + 0.5) / (c.total() + 0.5 * 2**20)) for x in g) * min(1, model.temper / len(g)) + math.log(0.5) for lang, c in counts.items()}
        top = max(total.values())
        share = {lang: math.exp(v - top) for lang, v in total.items()}
        assert model.languages[best[0]] == max(share, key=share.get)
        assert score[0] == pytest.approx(max(share.values()) / sum(share.values()), rel=1e-3)


def test_language_of_odd_rows(spark, odd, odd_rows, empty):
    model = langid.train(odd)
    assert model.languages == ("de", "en")
    found = langid.identify(odd, model).collect()
    assert len(found) == len(odd_rows)
    for r in found:
        silent = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == silent and 0 <= r["score"] <= 1 and (r["score"] == 0) == silent
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert none.languages == () and {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.stage(spark, odd, "").columns == odd.columns


def test_bytes_that_are_no_utf8():
    """A count of characters that fits what was decoded, for texts that end or begin within a character too."""
    texts = [b"ab\xff\x80cd", b"the man \xc3", b"\xa9 und das", b"", b"\xed\xa0\x80 x", "daß".encode()]
    column = pa.array(texts, pa.binary())
    clean = pa.array([t.decode("utf-8", "replace") for t in texts])
    for order in range(len(langid.ORDERS)):
        (a, x), (b, y) = (list(langid._columns(*utf8(c), 12))[order] for c in (column, clean))
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_language_stage_on_odd_rows(spark, odd, odd_rows, empty):
    model = langid.train(langid.learnable(odd))
    kept = Counter((r["doc_id"], r["text"]) for r in langid.stage(spark, odd, "").collect())
    expected = Counter()
    for row in odd_rows:
        best, score = langid.score_block(model, *utf8(pa.array([row[1]], pa.string())))
        if best[0] >= 0 and score[0] >= 0.5:
            expected[row[0], row[1]] += 1
    assert kept == expected and (5, "Two words") in kept and kept[5, "Two words"] == 3
    assert langid.stage(spark, empty, "").count() == 0 and langid.stage(spark, odd.drop("lang").withColumn("lang", odd["text"].substr(0, 0)).where("false"), "").count() == 0


def test_language_is_right_on_held_out_rows(spark, data):
    truth = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect())
    found = langid.op5_langid(spark, data).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


# --- quality -----------------------------------------------------------------------------------------


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality_mil.WIDTH)) for n in (1, 3, 2)]
    model = quality_mil.fit([], np.zeros(0), np.zeros(0))
    p = {k: rng.normal(0, 0.3, np.shape(v)) for k, v in model.weights.items()}
    p["mean"], p["scale"] = np.zeros(quality_mil.WIDTH), np.ones(quality_mil.WIDTH)
    model.weights = p
    where, label, weight = np.array([0, 1, 4, 6]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        y = model.forward(np.concatenate(bags), where)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum()

    gradients = model.gradients(model.forward(np.concatenate(bags), where), label, weight, where)
    for name, g in gradients.items():
        place = tuple(int(rng.integers(n)) for n in np.shape(p[name]))
        p[name] = np.array(p[name], dtype=float)
        p[name][place] += 1e-5
        high = loss()
        p[name][place] -= 2e-5
        low = loss()
        p[name][place] += 1e-5
        assert np.asarray(g)[place] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-6), name


def test_attention_weights_sum_to_one_and_passages_cover_the_text():
    texts = ["w " * 130, "", "a b"]
    flat, at = utf8(pa.array(texts))
    x, where = quality_mil.passages(flat, at)
    assert np.diff(where).tolist() == [3, 1, 1]
    f = quality_mil.fit([], np.zeros(0), np.zeros(0)).forward(x, where)
    assert np.add.reduceat(f["a"], where[:-1]) == pytest.approx([1, 1, 1])


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(12, 1), (13, 0), (14, 1), (14, 1), (None, 0), (15, None), (16, 5)], "doc_id long, quality int")
    model = quality_mil.train(odd, labels)
    found = quality_mil.score(odd, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    assert quality_mil.score(empty, model).count() == 0
    alike = quality_mil.train(odd, labels.where("quality = 1"))
    assert len({round(r["score"], 6) for r in quality_mil.score(odd, alike).collect()}) == 1


def brute_score(model, text):
    """A second forward pass, passage by passage and in plain loops."""
    p = {k: np.asarray(v, dtype=float) for k, v in model.weights.items()}
    x, _ = quality_mil.passages(*utf8(pa.array([text], pa.string())))
    hidden, energy = [], []
    for row in x:
        z = [max(-8.0, min(8.0, (float(a) - m) / s)) for a, m, s in zip(row, p["mean"], p["scale"])]
        h = [math.tanh(sum(z[i] * p["W"][i, j] for i in range(len(z))) + p["b"][j]) for j in range(len(p["b"]))]
        gates = range(len(p["w"]))
        v = [math.tanh(sum(h[j] * p["V"][j, g] for j in range(len(h)))) for g in gates]
        u = [1 / (1 + math.exp(-sum(h[j] * p["U"][j, g] for j in range(len(h))))) for g in gates]
        hidden.append(h)
        energy.append(sum(p["w"][g] * v[g] * u[g] for g in gates))
    attention = [math.exp(e - max(energy)) for e in energy]
    mixed = [sum(a * h[j] for a, h in zip(attention, hidden)) / sum(attention) for j in range(len(p["c"]))]
    return 1 / (1 + math.exp(-sum(c * m for c, m in zip(p["c"], mixed)) - float(p["c0"])))


def test_scores_equal_a_second_forward_pass(spark, odd, odd_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8, 20)], "doc_id long, quality int")
    model = quality_mil.train(odd, labels)
    found = sorted((r["text"] or "", r["score"]) for r in quality_mil.score(odd, model).collect() if len(r["text"] or "") < 10_000)
    expected = sorted((r[1] or "", brute_score(model, r[1])) for r in odd_rows if len(r[1] or "") < 10_000)
    assert [t for t, _ in found] == [t for t, _ in expected] and [s for _, s in found] == pytest.approx([s for _, s in expected], abs=1e-4)


def test_quality_stage_on_odd_rows(spark, odd, odd_rows, empty, tmp_path):
    labels = spark.createDataFrame([(i, int(i < 14)) for i in range(8, 20)] * 2 + [(None, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality_mil.train(odd, quality_mil.learnable(labels))
    scores = {r["text"]: r["score"] for r in quality_mil.score(odd, model).collect()}
    kept = quality_mil.stage(spark, odd, str(tmp_path))
    assert kept.columns == odd.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(r[1] for r in odd_rows if scores[r[1]] >= 0.3)
    assert 0 < sum(s >= 0.3 for s in scores.values()) < len(scores)
    assert quality_mil.stage(spark, empty, str(tmp_path)).count() == 0


def test_samples_are_bounded_whatever_repeats(spark):
    """A key with very many labels, documents and bytes brings no more than the bounds."""
    docs = spark.range(4000).selectExpr("id % 3 as doc_id", "concat('w', id % 50, repeat(' x', 300)) as text")
    labels = spark.range(3000).selectExpr("id % 3 as doc_id", "cast(id % 2 as int) as label")
    joined = written(docs.join(labels.distinct(), "doc_id").select("doc_id", "label", docs["text"].cast("binary").alias("data")), "test")
    kept = bounded(joined, "label", "data", 20, 1 << 30).groupBy("label").count().collect()
    assert sorted(tuple(r) for r in kept) == [(0, 20), (1, 20)]
    few = bounded(joined, "label", "data", 1000, 3000).selectExpr("label", "octet_length(data) as n").groupBy("label").sum("n").collect()
    assert all(600 <= r[1] <= 3000 for r in few) and len(few) == 2
    model = quality_mil.train(docs, labels.withColumnRenamed("label", "quality"), rows_per_class=2)
    assert quality_mil.score(docs, model).count() == 4000


def test_quality_on_held_out_rows(spark, data):
    wanted = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{wanted}/labels.parquet").select("doc_id", "quality").collect())
    found = quality_mil.op3_quality_mil(spark, wanted).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    good = [a for a, b in held if b == 1]
    assert sum(good) >= 0.95 * len(good)


# --- toxicity ----------------------------------------------------------------------------------------


def test_words_lose_case_and_edges():
    flat, at = utf8(pa.array(["Idiot! (idiot) IDIOT... \"idiot\"", "", "other"]))
    column, where = toxicity.word_columns(flat, at)
    assert where.tolist() == [0, 1, 1, 2] and column[0] != column[1]


def test_ordinal_model_orders_severity():
    rng = random.Random(2)
    clean = [f"w{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(600):
        bad = rng.choice([0, 0, 1, 4]) if i % 2 else 0
        texts.append(prose(rng, 40, clean) + " " + " ".join(rng.choice(["vile", "nasty", "rotten", "foul", "mean"]) for _ in range(bad)))
        toxic.append(float(bad > 0))
    flat, at = utf8(pa.array(texts))
    column, where = toxicity.word_columns(flat, at)
    model = toxicity.fit(column, where, np.array(toxic), np.ones(len(texts)))
    assert model.thresholds[0] < model.thresholds[1]
    ask = lambda t: model.above(*toxicity.word_columns(*utf8(pa.array([t]))))[0]
    one, many, none = ask("w1 vile w2"), ask("w1 vile nasty rotten foul"), ask("w1 w2 w3")
    assert none.sum() < one.sum() < many.sum() and none[0] < 0.5 < one[0] and all(p[0] >= p[1] for p in (one, many, none))


def test_gradients_of_the_ordinal_likelihood():
    rng = np.random.default_rng(3)
    w, low, gap = rng.normal(0, 1, 5), 0.3, -0.4
    doc, column = np.repeat(np.arange(12), 2), rng.integers(0, 5, 24)
    grade, share = rng.integers(0, 3, 12), rng.random(12)
    _, by_weight, by_low, by_gap = toxicity.likelihood(w, low, gap, column, doc, grade, share)
    at = lambda w=w, low=low, gap=gap: toxicity.likelihood(w, low, gap, column, doc, grade, share)[0]
    step = 1e-6
    for k in range(5):
        e = np.eye(5)[k] * step
        assert by_weight[k] == pytest.approx((at(w=w + e) - at(w=w - e)) / (2 * step), rel=1e-4, abs=1e-7)
    assert by_low == pytest.approx((at(low=low + step) - at(low=low - step)) / (2 * step), rel=1e-4)
    assert by_gap == pytest.approx((at(gap=gap + step) - at(gap=gap - step)) / (2 * step), rel=1e-4)


def test_grades_equal_a_second_computation(spark, data):
    """The query's rows, from its model, word by word."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    texts = dict(docs.select("doc_id", "text").collect())
    low, high = model.thresholds.tolist()
    for r in toxicity.op7_ordinal_toxicity(spark, data).collect():
        column, _ = toxicity.word_columns(*utf8(pa.array([texts[r["doc_id"]]], pa.string())))
        f = sum(float(model.weights[c]) for c in set(column.tolist()))
        above = [1 / (1 + math.exp(t - f)) for t in (low, high)]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert (r["score"], r["severity"]) == pytest.approx((above[0], sum(above)), abs=1e-5)
        assert r["toxic"] == (r["score"] >= 0.5) and each[r["grade"]] == pytest.approx(max(each), abs=1e-6)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(12, 1), (13, 0), (14, 0), (None, 1), (15, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    found = toxicity.grade(odd, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["severity"] <= 2 and 0 <= r["score"] <= 1 for r in found)
    assert toxicity.grade(empty, model).count() == 0
    assert not any(r["toxic"] for r in toxicity.grade(odd, toxicity.train(odd, labels.where("toxic = 0"))).collect())


def test_toxicity_against_labels(spark, data):
    wanted = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{wanted}/labels.parquet").select("doc_id", "toxic").collect())
    found = {r["doc_id"]: r["toxic"] for r in toxicity.op7_ordinal_toxicity(spark, wanted).collect()}
    bad, good = [found[k] for k, v in truth.items() if v == 1], [found[k] for k, v in truth.items() if v == 0]
    assert sum(bad) >= 0.75 * len(bad) and sum(good) <= 0.02 * len(good)


def test_written_tables_are_in_the_shared_folder(spark, odd):
    table = written(odd.select("doc_id"), "test")
    assert table._written_at.startswith(spark.conf.get("spark.checkpoint.dir")) and table.count() == odd.count()
