"""URL filters as a sort-merge range join.

A host is keyed by its labels in reverse, each ended by a dot (``www.example.com``: ``com.example.www.``), so a
rule's host and all its subdomains are one interval: the keys that start with the rule's. Pages and rules
are cut into the same ranges of (key, hash of the page), hot hosts into several; a rule goes to each range
that its interval meets. Inside a range, sorted by key with rules first, a sweep keeps the stack of rules
whose intervals are open: these are nested, and are the only ones that can fit the next page. What a rule
asks of the path is looked up the same way, in the sorted paths of each open host.
"""

from __future__ import annotations

import bisect
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import share_below, table

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
DEFAULT = "allow"
#: Pages in a range, about, and pages sampled for each range's bounds.
RANGE_ROWS, SAMPLED = 2000, 24
MAX_RANGES = 20_000
#: Bytes of a key that range bounds keep: any string will do as a bound.
KEPT = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end. Null, or without ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class _Paths:
    """The rules of one host: the longest whose path a path starts with, by the nesting of sorted prefixes."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by_path: dict[str, tuple[str, str]] = {}
        for path, rule, verdict in sorted(rules):  # of equal rules with two verdicts, block holds
            by_path[path] = max(by_path.get(path, ("", "")), (rule, verdict), key=lambda x: (x[1] == "block", x))
        self.paths = sorted(by_path)
        self.rules = [by_path[p] for p in self.paths]
        self.parent, stack = [], []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.parent.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect.bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.parent[i]
        return self.rules[i] if i >= 0 else None


def _bounds(pages: DataFrame, ranges: int, rows: int) -> list[tuple[str, int]]:
    """Sorted bounds between ``ranges`` ranges of about equally many pages: at most MAX_RANGES, from a bounded sample."""
    sample = pages.where(share_below(min(1.0, ranges * SAMPLED / max(1, rows)), "salt")).select("host", "salt").limit(2 * ranges * SAMPLED).collect()
    keys = sorted((host_key(r["host"])[:KEPT], r["salt"]) for r in sample)
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule, verdict.

    ``rules`` has the columns rule (``host/path``) and verdict. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest rule wins. Where none fits, rule is null and the verdict
    ``default``. Null rules are ignored; repeated rules count once, and if they disagree, block holds.
    Null keys and repeated rows are kept. Only ``key`` and ``url`` are read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"), F.xxhash64(key, url).alias("salt"))
    count = pages.count()
    ranges = max(1, min(MAX_RANGES, count // RANGE_ROWS + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shared = spark.sparkContext.broadcast(_bounds(rows, ranges, count))  # at most MAX_RANGES short keys
    asked = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).dropDuplicates(["rule", "verdict"])

    kinds = {"range": T.IntegerType(), "key": T.StringType(), "kind": T.IntegerType()} | dict.fromkeys(("host", "path", "rule", "verdict"), T.StringType())
    cut = T.StructType([T.StructField(*x) for x in kinds.items()] + [T.StructField("id", pages.schema[key].dataType)])
    id_type = to_arrow_type(pages.schema[key].dataType)

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            keys = [host_key(h) for h in batch.column(1).to_pylist()]
            at = [bisect.bisect_right(bounds, (k[:KEPT], s)) for k, s in zip(keys, batch.column(3).to_pylist())]
            none = pa.nulls(len(keys), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array([1] * len(keys), pa.int32()), batch.column(1), batch.column(2), none, none, batch.column(0)], names=cut.names)

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            out: list[tuple] = []
            for rule, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, slash, path = rule.partition("/")
                low = host_key(host)
                first = bisect.bisect_left(bounds, (low[:KEPT], -(1 << 63)))
                last = bisect.bisect_right(bounds, (low[:KEPT] + chr(0x10FFFF), 0))
                out += [(i, low, 0, host, slash + path, rule, verdict) for i in range(first, last + 1)]
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.nulls(len(out), id_type)], names=cut.names)

    result = T.StructType([T.StructField(key, pages.schema[key].dataType), *(T.StructField(x, T.StringType()) for x in ("host", "path", "rule", "verdict"))])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, _Paths]] = []  # open hosts' keys, each starting with the one before
        coming: list[tuple[str, str, str]] = []  # rules of the host just read
        coming_key, now = "", -1
        for batch in batches:
            found: list[tuple] = []
            places = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for i, (part, k, kind, _, path, rule, verdict) in enumerate(zip(*columns)):
                if part != now:
                    stack, coming, now = [], [], part
                if kind == 0:
                    if coming and k != coming_key:
                        _open(stack, coming_key, coming)
                        coming = []
                    coming_key = k
                    coming.append((path, rule, verdict))
                    continue
                if coming:
                    _open(stack, coming_key, coming)
                    coming = []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                fits = [x for x in (p.longest(path) for _, p in stack) if x]
                found.append(max(fits, key=lambda x: len(x[0])) if fits else (None, default))
                places.append(i)
            take = pa.array(places, pa.int64())
            rule, verdict = (pa.array([f[j] for f in found], pa.string()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(7).take(take), batch.column(3).take(take), batch.column(4).take(take), rule, verdict], names=result.names)

    both = rows.mapInArrow(place_pages, cut).unionByName(asked.select("rule", "verdict").mapInArrow(place_rules, cut))
    return both.repartition("range").sortWithinPartitions("range", "key", "kind").mapInArrow(sweep, result)


def _open(stack: list[tuple[str, _Paths]], key: str, rules: list[tuple[str, str, str]]) -> None:
    while stack and not key.startswith(stack[-1][0]):
        stack.pop()
    stack.append((key, _Paths(rules)))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
         ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), ranked AS (
  SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, verdict FROM ranked WHERE nth = 1
"""
