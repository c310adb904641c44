"""Folds over ordered rows of a key, without holding a key's rows in memory.

Keys are dealt out by hash and sorted; a task walks through its rows batch by batch and keeps only the state
of the key that it is at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fold_by_key(
    rows: DataFrame,
    key: str,
    order: list[str],
    schema: str,
    start: Callable[[], Any],
    feed: Callable[[Any, Any, pd.DataFrame], Iterable[tuple]],
    end: Callable[[Any, Any], Iterable[tuple]] = lambda key, state: (),
) -> DataFrame:
    """Rows of ``schema`` that ``feed(key, state, rows)`` and ``end(key, state)`` give.

    ``start`` makes a key's state, which ``feed`` changes in place; it gets a key's rows in order, in as many
    parts as they come in. A null key is a key like any other.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in batches:
            if part.empty:
                continue
            keys = part[key].to_numpy(dtype=object)
            none = pd.isna(keys)
            new = (keys[1:] != keys[:-1]) & ~(none[1:] & none[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys)]
            out: list[tuple] = []
            for low, high in zip(edges, edges[1:]):
                k = None if none[low] else keys[low]
                if state is None or k != now:
                    if state is not None:
                        out += end(now, state)
                    now, state = k, start()
                out += feed(k, state, part.iloc[low:high])
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame(list(end(now, state)), columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
