from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tidewatch.llm import common, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    fps = np.array(fps, dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints_of_odd_texts(odd_rows):
    for row in odd_rows:
        text = row[1] or ""
        if len(text) < 100_000:
            assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_forest_finds_every_pair():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 40, 600))
    values = (rng.integers(0, 1 << 9, 600, dtype=np.uint64) << np.uint64(30)) ^ rng.integers(0, 1 << 40, 600, dtype=np.uint64) % np.uint64(7)
    keep = np.unique(np.stack([group.astype(np.uint64), values]), axis=1)
    group, values = keep[0].astype(np.int64), keep[1]
    for radius in (0, 1, 2, 5):
        for most in (50, 1 << 20):
            found = {(int(i), int(j)) for a, b in simhash.BkForest(group, values.view(np.int64)).links(radius, most) for i, j in zip(a, b)}
            near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius) & (group[:, None] == group[None, :])
            assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if j < i}


def test_components_over_crowded_shards(spark):
    """Fingerprints in a ball of 14 bits, a chain, and random ones; crowds of 4 force finer shards and chunks."""
    rng = np.random.default_rng(1)
    base = 0x1234567890ABCDEF
    values = {base ^ int(sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False))) for _ in range(700)}
    chain = base ^ (1 << 60)
    for i in range(0, 40, 2):
        chain ^= 3 << (20 + i)
        values.add(chain)
    values |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps = np.array(sorted(values), dtype=np.uint64)
    expected = dict(zip(fps.view(np.int64).tolist(), brute_components(fps).tolist()))
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    # trees in their tasks; all of them sent; some sent and the rest dealt again and cut into chunks; none sent; more crowds than are looked at
    for bounds in ({}, {"small": 0}, {"small": 4, "crowd": 4, "sent": 300}, {"small": 4, "crowd": 4, "sent": 0}, {"small": 2, "crowd": 4, "sent": 20}):
        assert {r["fp"]: r["least"] for r in simhash.groups(rows, **bounds).collect()} == expected, bounds
    with pytest.raises(ValueError):
        simhash.groups(rows, radius=3)


def test_sent_trees_find_every_link(spark):
    """Recall of the broadcast trees: each link inside a shard, whichever task asks."""
    rng = np.random.default_rng(8)
    rows = {(int(s), int(rng.integers(0, 1 << 10)) << int(s)) for s in rng.integers(0, 5, 1500)}
    found = simhash._searched(spark.createDataFrame(sorted(rows), "shard long, fp long"), 2).collect()
    for shard in range(5):
        fps = np.array(sorted(f for s, f in rows if s == shard), dtype=np.uint64)
        label = {int(f): int(f) for f in fps}
        root = lambda x: x if label[x] == x else root(label[x])
        for r in found:
            if r["a"] in label and r["b"] in label and bin(r["a"] ^ r["b"]).count("1") >= 0:
                label[max(root(r["a"]), root(r["b"]))] = min(root(r["a"]), root(r["b"]))
        expected = {int(f): int(fps[i]) for f, i in zip(fps, brute_components(fps))}
        assert {f: min(g for g in label if root(g) == root(f)) for f in label} == expected


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {1001: 1000}


def check(found, rows):
    texts = [(r[0], r[1]) for r in rows]
    fps = [brute_fingerprint(t) if len(t or "") < 100_000 else simhash.fingerprint(t.encode()) for _, t in texts]
    label = brute_components(fps)
    least = {}
    for (key, _), c in zip(texts, label.tolist()):
        if key is not None:
            least[c] = min(key, least.get(c, key))
    expected = [(key, f"{fp:016x}", least.get(c)) for (key, _), fp, c in zip(texts, fps, label.tolist())]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=order) == sorted(expected, key=order)


def test_odd_rows(odd, odd_rows, empty):
    check(simhash.near_duplicates(odd).collect(), odd_rows)
    assert simhash.near_duplicates(empty).collect() == []


def test_query_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check(simhash.op4_simhash_bktree(spark, data).collect(), rows)


def test_stage_keeps_one_row_of_each_component(spark, odd, odd_rows, empty):
    kept = simhash.stage(spark, odd, "")
    assert kept.columns == odd.columns
    found = kept.collect()
    groups = {}
    for r, c in zip(odd_rows, brute_components([simhash.fingerprint((r[1] or "").encode()) for r in odd_rows]).tolist()):
        groups.setdefault(c, []).append(r[0])
    smallest = [min((k for k in keys if k is not None), default=None) for keys in groups.values()]
    order = lambda x: (x is None, x)
    assert sorted((r["doc_id"] for r in found), key=order) == sorted(smallest, key=order)
    assert simhash.stage(spark, empty, "").count() == 0


def test_filter_of_keys_loses_none(spark, monkeypatch):
    """No key is taken for another's absence; a full filter doubts everything, and the stage stays the same."""
    keys = spark.range(0, 20_000, 7).selectExpr("xxhash64(id) as h")
    every = spark.range(20_000).selectExpr("id", "xxhash64(id) as h")
    for bits, most in ((27, 0.05), (8, 1.0)):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        held = common.key_filter(keys, keys.count())
        doubted = {r["id"] for r in every.where(common.in_filter(spark, held)("h")).collect()}
        assert doubted >= set(range(0, 20_000, 7)) and len(doubted) <= 20_000 / 7 + most * 20_000
    assert not every.where(common.in_filter(spark, common.key_filter(keys.limit(0), 0))("h")).count()


def test_stage_with_a_full_filter(spark, odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr(common, "key_filter", lambda keys, count: np.full(1 << 4, (1 << 64) - 1, dtype=np.uint64))
    monkeypatch.setattr(simhash, "key_filter", common.key_filter)
    test_stage_keeps_one_row_of_each_component(spark, odd, odd_rows, empty)
