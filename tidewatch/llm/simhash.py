"""SimHash near-duplicate detection with sharded, broadcast BK-trees.

Fingerprints: one bit per majority over the XXH64 of all 3-word shingles. Equal fingerprints collapse to
one node before any search, so exact copies never meet in a group.

Search: the 64 bits fall into four blocks of 16. Two fingerprints at distance 2 or less agree on at least
two whole blocks, so each node goes to six shards, one for each pair of blocks, and every link lies inside
a shard. A shard is a BK-tree: children keyed by the integer distance to their parent, grown level by level in
numpy; a search follows only the edges within the radius. Small shards are trees in the task that they fall to. Shards
over ``small`` nodes, where near copies crowd, would hold that task up: their trees are broadcast, the largest shards
first, up to ``SENT`` nodes altogether, and their nodes search them from all tasks. That bound does not grow with
the corpus. What exceeds it goes an exact way without broadcast: a shard over ``crowd`` nodes is dealt again by the
same rule over its 32 other bits (agreeing on two of four blocks of 8), which leaves at most 2**16 nodes a shard; one
that is still crowded is cut into chunks, and each pair of chunks is searched as a shard. A task reports one edge to a
representative for each linked node of a shard, never all pairs.

Components: alternating large and small stars over those edges, each round a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, in_filter, key_filter, matched, table, unused, written
from .textblocks import utf8

RADIUS = 2
#: Nodes: of a shard that stays in one task; of one that is dealt again unless its tree is sent; of the largest tree that
#: is sent; of all that are sent: 8 bytes and an edge of 16 each.
SMALL, CROWD, TREE, SENT = 8, 512, 1 << 14, 1 << 18


# --- fingerprints ------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text: words between ASCII white space, A-Z lower-cased; no words give 0, and fewer
    words than a shingle are one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = max(0, len(words) - shingle)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends[: k + 1] - np.fromiter(map(len, words[: k + 1]), np.int64, k + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = [digest(line[a:b], seed) for a, b in zip(starts, ends[len(words) - 1 - k :].tolist(), strict=True)]
    return majority(np.array(h, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The 64-bit value whose bits are set in over half of ``h``."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # long texts in pieces
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = utf8(batch.column(1))
            raw, at = flat.tobytes(), at.tolist()
            fps = np.array([fingerprint(raw[a:b]) for a, b in zip(at, at[1:])], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


# --- shards ------------------------------------------------------------------------------------------


def _dealt(nodes: DataFrame, bits, width: int, prefix, *keep) -> DataFrame:
    """``nodes`` six times: for each two of the four ``width``-bit blocks of ``bits``, by these blocks' value.

    shard: ``prefix`` with the pair's number and its value; rest: the other two blocks.
    """
    block = [F.shiftrightunsigned(bits, width * i).bitwiseAND((1 << width) - 1) for i in range(4)]
    dealt = []
    for number, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        value, rest = (F.shiftleft(block[x], width) + block[y] for x, y in ((i, j), (k, m)))
        dealt.append(F.struct((prefix + F.lit(number << (2 * width)) + value).alias("shard"), rest.alias("rest")))
    return nodes.select(*keep, F.explode(F.array(*dealt)).alias("s")).select(*keep, "s.shard", "s.rest")


def _spread_over(shards: DataFrame, crowd: int) -> DataFrame:
    """(shard, part, fp) of shards over ``crowd`` nodes: dealt again by their other bits, and cut into chunks if still crowded."""
    second = _dealt(shards, F.col("rest"), 8, F.lit(1 << 62) + F.shiftleft(F.col("shard"), 19), "fp")
    hot = second.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    fine = second.join(hot, "shard", "left_anti").select("shard", F.lit(0).cast("long").alias("part"), "fp")
    chunks = F.ceil(F.col("n") / crowd).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.shiftleft(F.least(own, j), 20) + F.greatest(own, j))
    return fine.unionByName(second.join(hot, "shard").select("shard", F.explode(pairs).alias("part"), "fp"))


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL, crowd: int = CROWD, tree: int = TREE, sent: int = SENT) -> DataFrame:
    """(a, b): edges that connect all ``nodes`` (distinct fp) which links of ``radius`` or less connect, and no others."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree up to a radius of 2 only")
    dealt = _dealt(nodes, F.col("fp"), 16, F.lit(0).cast("long"), "fp")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > small)
    most = sent // (small + 1)  # shards that can be sent; one more tells whether there are others
    top = [tuple(r) for r in sizes.orderBy(F.desc("n"), "shard").limit(most + 1).collect()]
    chosen, left = [], sent
    for shard, n in top:
        if n <= min(tree, left):
            chosen.append(shard)
            left -= n
    here = dealt
    if chosen:
        some = nodes.sparkSession.createDataFrame([(x,) for x in chosen], "shard long")
        here = dealt.join(F.broadcast(some), "shard", "left_anti")
    known = set(chosen)
    rest = [(x,) for x, n in top if n > crowd and x not in known]
    again = None
    if len(top) > most:  # more than were looked at: the others by a join
        over = sizes.where(F.col("n") > crowd).select("shard")
        again, here = here.join(over, "shard"), here.join(over, "shard", "left_anti")
    elif rest:
        over = F.broadcast(nodes.sparkSession.createDataFrame(rest, "shard long"))
        again, here = here.join(over, "shard"), here.join(over, "shard", "left_anti")
    shards = here.select("shard", F.lit(0).cast("long").alias("part"), "fp")
    if again is not None:
        shards = shards.unionByName(_spread_over(again, crowd))
    found = star_edges(shards, radius)
    return found.unionByName(_searched(dealt.join(F.broadcast(some), "shard").select("shard", "fp"), radius)) if chosen else found


# --- BK-trees ----------------------------------------------------------------------------------------


class BkForest:
    """BK-trees of many groups at once. ``group`` is sorted; each group's values are distinct.

    The tree is its edges, sorted by ``parent * 65 + distance``: a node's children within a range of
    distances are one slice.
    """

    def __init__(self, group: np.ndarray, values: np.ndarray):
        self.values = values.view(np.uint64)
        n = len(values)
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.size = np.repeat(np.diff(np.r_[start, n]), np.diff(np.r_[start, n]))
        self.root = np.repeat(start, np.diff(np.r_[start, n]))
        at, left, keys, kids = self.root.copy(), np.flatnonzero(self.root != np.arange(n)), [], []
        while len(left):  # one level of all trees: the first to come along an edge becomes the child there
            key = at[left] * 65 + np.bitwise_count(self.values[left] ^ self.values[at[left]])
            edge, first, which = np.unique(key, return_index=True, return_inverse=True)
            child = left[first]
            keys.append(edge)
            kids.append(child)
            at[left] = child[which]
            left = left[at[left] != left]
        keys, kids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, kids))
        order = np.argsort(keys)
        self.key, self.child = keys[order], kids[order]

    def links(self, radius: int, most: int = 1 << 21, asking: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), j < i, of one group at distance ``radius`` or less, i among ``asking`` or any; all searches go down together."""
        asking = np.arange(len(self.values)) if asking is None else asking
        reach = np.cumsum(self.size[asking])
        i, n = 0, len(asking)
        while i < n:  # as many searches as can meet ``most`` nodes at once
            j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + most, "right")))
            query = asking[i:j]
            node = self.root[query]
            while len(query):
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                kids = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
                query = np.repeat(query, kids)
                skip = np.cumsum(kids) - kids
                node = self.child[np.repeat(low - skip, kids) + np.arange(len(query))]
            i = j


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges, in place, the components of ``label`` that the links a-b connect; labels are their least member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """Edges as of ``star_edges``, of shards (shard, fp) whose trees fit a broadcast: every task searches for its own rows."""
    held = rows.toArrow()
    shard, fp = (held.column(i).to_numpy() for i in range(2))
    order = np.lexsort((fp, shard))
    group, values = shard[order], fp[order]
    shared = rows.sparkSession.sparkContext.broadcast((group, values, BkForest(group, values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, values, forest = shared.value
        label = np.arange(len(values))
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for batch in batches:
            shard, fp = (batch.column(i).to_numpy() for i in range(2))
            asking = np.empty(len(fp), dtype=np.int64)
            low = np.searchsorted(group, shard)
            for x in np.unique(low).tolist():  # a row's place in its shard
                own = low == x
                end = starts[np.searchsorted(starts, x, "right")] if x < starts[-1] else len(values)
                asking[own] = x + np.searchsorted(values[x:end], fp[own])
            for a, b in forest.links(radius, asking=asking):
                _joined(label, a, b)
        linked = np.flatnonzero(label != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], names=["a", "b"])

    # nodes of one shard in all tasks: what a search costs, its own and the others', is dealt out evenly
    tasks = max(1, min(len(values) // 256 + 1, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks, "fp").mapInArrow(run, "a long, b long")


def star_edges(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for each node linked in a shard, an edge to the shard's representative of its component."""

    def found(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        forest, label = BkForest(group, fps), np.arange(len(fps))
        for a, b in forest.links(radius):
            _joined(label, a, b)
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rest = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(rest)]
            change = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1
            if len(rest[0]) >= 1 << 15 and len(change):  # whole groups only; the last may go on in the next batch
                end = change[-1]
                yield found(np.searchsorted(change, np.arange(end), "right"), rest[2][:end])
                rest = [x[end:] for x in rest]
        change = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1
        yield found(np.searchsorted(change, np.arange(len(rest[0])), "right"), rest[2])

    return shards.repartition("shard", "part").sortWithinPartitions("shard", "part").select("shard", "part", "fp").mapInArrow(run, "a long, b long")


# --- components --------------------------------------------------------------------------------------


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of an edge list (a, b) of at most ``rows`` rows: root is the least node that it reaches.

    Each round replaces the edges by large stars, then by small stars, which keeps connectivity and ends,
    after a number of rounds logarithmic in the length of chains, with each node at its root. Minima are
    aggregated before they are joined back, so that a star's centre is never gathered in one task.
    """
    now = written(edges.where("a <> b").distinct(), "stars", rows)
    state = _state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        then = written(small.distinct(), "stars", 2 * state[0])
        drop_written(now)
        now, before, state = then, state, _state(then)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS, **bounds: int) -> DataFrame:
    """(fp, root, least): each distinct fingerprint, its component and the component's smallest key."""
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("own")), "simhash-nodes", prints.count())
    roots = components(links(nodes.select("fp"), radius, **bounds), 6 * nodes.count())
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("own").alias("least"))
    return placed.join(least, "root").select("fp", "root", "least")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, **bounds: int) -> DataFrame:
    """One row for each row of ``docs``: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key that the row's fingerprint reaches over links of ``radius`` (at most 2, else
    ValueError) or fewer differing bits; ``bounds`` are those of ``links``, and change no result. Null and word-less texts have fingerprint zero and link like any other. Null keys are
    kept; they count for component_id only where a component has no other (it is null then). Repeated rows
    are all kept. An empty table gives an empty table. Only ``key`` and ``text`` are read.
    """
    prints = written(fingerprints(docs, text, key), "simhash-prints")
    placed = prints.join(groups(prints, key, radius, **bounds), "fp")
    return placed.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (of repeated rows, one).

    Rows are told apart by doc_id and a hash of their text, so that null or repeated ids do no harm.
    """
    sign, mark = unused(docs, "text_hash", "key_hash")
    signed = docs.withColumn(sign, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    ids = signed.select(F.struct("doc_id", sign).alias("id"), "text")
    prints = written(fingerprints(ids, key="id"), "simhash-prints")
    # least() of structs puts a null doc_id first; a document with an id is preferred
    ordered = prints.select(F.struct(F.col("id.doc_id").isNull().alias("none"), F.col("id.doc_id").alias("doc_id"), F.col(f"id.{sign}").alias("sign")).alias("id"), "fp")
    placed = ordered.groupBy("id", "fp").agg(F.count("*").alias("n")).join(groups(ordered, "id"), "fp")
    decided = placed.select(F.col("id.doc_id").alias("doc_id"), F.col("id.sign").alias(sign), "n", (F.col("id") == F.col("least")).alias("stays"))
    decided = written(decided, "simhash-decided")
    # Most rows stay and are not repeated: a filter of the keys of all others tells most of them, and their texts stay where
    # they are. What it can't tell is joined, and so is everything once the filter is full.
    hashed = F.xxhash64("doc_id", sign)
    others = decided.where(~F.col("stays") | (F.col("n") > 1)).select(hashed.alias(mark))
    doubted = in_filter(spark, key_filter(others, others.count()))
    flagged = signed.withColumn(mark, doubted(hashed))
    joined = matched(flagged.where(mark).drop(mark), decided.where("stays").drop("stays"), ["doc_id", sign], "n")
    kept = flagged.where(~F.col(mark)).drop(mark).unionByName(joined)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
