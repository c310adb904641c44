"""Dumps of a shared-memory ring: slot headers, live-first selection, bounded queues and pixels."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequential import fold_by_key

#: Fixed layout of a slot: magic, version, format, -, width, height, stride, frame id, PTS, payload bytes, -.
HEADER = struct.Struct("<IHBBHHIQQII")
MAGIC, VERSION = 0x53484D46, 1
FORMATS = {"BGR": (3, False), "BGRX": (4, False), "BGRA": (4, False), "RGB": (3, True), "RGBX": (4, True), "RGBA": (4, True)}


def default_stride(width: Column, fmt: Column) -> Column:
    return width * F.when(F.upper(fmt).isin("BGRX", "BGRA", "RGBX", "RGBA"), 4).otherwise(3)


def slot_bytes(stride: Column, height: Column) -> Column:
    return F.lit(HEADER.size) + stride * height


#: Header fields that a table keeps, with their place and type.
FIELDS = np.dtype(
    {
        "names": ["magic", "version", "fmt_code", "width", "height", "stride", "frame_id", "pts_ns", "payload_len", "width_high", "height_high"],
        "formats": ["<u4", "<u2", "u1", "<u2", "<u2", "<u4", "<u8", "<u8", "<u4", "<u2", "<u2"],
        "offsets": [0, 4, 6, 8, 10, 12, 16, 24, 32, 36, 38],
        "itemsize": HEADER.size,
    }
)


def slot_headers(slots: DataFrame, data: str = "slot", wide: bool = False) -> DataFrame:
    """Adds the header's fields of binary slots, and keeps slots of the right magic and version. A batch of headers
    is read as one structured array.

    wide: an extension of our own, for images of 65,536 pixels a side and more: the header's last word, which the layout
    leaves unused, holds the high halves of width and height. Without it that word is not read.
    """
    kept = [n for n in FIELDS.names if n not in ("magic", "version", "width_high", "height_high")]
    schema = T.StructType([*slots.schema.fields, *(T.StructField(n, T.LongType()) for n in kept)])
    place, size = slots.columns.index(data), HEADER.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [b[:size] if b is not None and len(b) >= size else bytes(size) for b in batch.column(place).to_pylist()]
            found = np.frombuffer(b"".join(heads), FIELDS)
            good = pa.array((found["magic"] == MAGIC) & (found["version"] == VERSION))
            values = {n: found[n].astype(np.int64) for n in kept}
            for n in ("width", "height") if wide else ():
                values[n] |= found[f"{n}_high"].astype(np.int64) << 16
            columns = [*batch.columns, *(pa.array(values[n]) for n in kept)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(good)

    return slots.mapInArrow(run, schema)


def live_first(polls: DataFrame, ring: str = "ring_id", poll: str = "poll", frame: str = "frame_id") -> DataFrame:
    """Of each poll's slots, the frame that a reader takes; polls that give nothing have no row.

    The first poll, and one that finds more than two new frames, jump to the newest; else the next new id
    is taken, or the newest when ids have started again. What was taken is the only state, so this is a fold
    over a ring's polls.
    """
    kind, poll_kind = polls.schema[ring].dataType.simpleString(), polls.schema[poll].dataType.simpleString()

    def pick(seen: int, ids: list[int]) -> int:
        newest, later = ids[-1], bisect.bisect_right(ids, seen)
        return newest if seen < 0 or newest - seen > 2 or later == len(ids) else ids[later]

    def taken(k, state: dict) -> list[tuple]:
        """The poll that has been read, once it is known to be whole."""
        got = pick(state["seen"], state["ids"]) if state["ids"] else state["seen"]
        found = [(k, state["poll"], got)] if got != state["seen"] else []
        state["seen"], state["ids"] = got, []
        return found

    def feed(k, state: dict, rows: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        for at, x in zip(rows[poll].tolist(), rows[frame].tolist()):
            if at != state["poll"]:
                out += taken(k, state)
                state["poll"] = at
            state["ids"].append(x)
        return out

    return fold_by_key(polls, ring, [poll, frame], f"{ring} {kind}, {poll} {poll_kind}, taken_id long", lambda: {"seen": -1, "poll": None, "ids": []}, feed, taken)


def untorn(reads: DataFrame, keys: tuple[str, ...] = ("ring_id", "poll"), attempt: str = "attempt", before: str = "frame_id", after: str = "frame_id_after", attempts: int = 2) -> DataFrame:
    """Of the attempts (from 1) to read a slot, the first that found the same frame before and after copying it; a read
    that is torn ``attempts`` times gives no row. A null id is a torn read."""
    whole = reads.where((F.col(attempt) <= attempts) & (F.col(before) == F.col(after)))
    rest = [c for c in reads.columns if c not in keys]
    first = whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), attempt).alias("_read"))
    return first.select(*keys, "_read.*")


def bounded_queue(trace: DataFrame, size: int, policy: str = "drop_new", key: str = "cam_id", order: str = "seq", action: str = "action", item: str = "frame_id") -> DataFrame:
    """A queue's trace of ``put`` and ``get`` actions, replayed: which frames went in, came out or were dropped.

    ``drop_new`` refuses a frame when the queue is full; ``drop_old`` throws the oldest out for it, which
    counts as a drop and as one in. The capacity is one at least.
    """
    room, kind = max(1, size), trace.schema[key].dataType.simpleString()

    def replay(k, queue: list, rows: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        for seq, act, x in zip(rows[order].tolist(), rows[action].tolist(), rows[item].tolist()):
            if act == "get":
                out.append((k, seq, "out" if queue else "idle", queue.pop(0) if queue else None))
                continue
            if len(queue) >= room and policy != "drop_old":
                out.append((k, seq, "drop", x))
                continue
            if len(queue) >= room:
                out.append((k, seq, "drop", queue.pop(0)))
            out.append((k, seq, "in", x))
            queue.append(x)
        return out

    return fold_by_key(trace, key, [order], f"{key} {kind}, {order} long, outcome string, frame_id long", list, replay)


def to_bgr(raw: bytes, width: int, height: int, stride: int, fmt: str) -> np.ndarray:
    """(height, width, [B, G, R]) of rows that may be padded; alpha goes, RGB orders turn round."""
    name = (fmt or "BGR").upper()
    if name not in FORMATS:
        raise ValueError(f"unsupported pixel format {fmt!r}; known: {', '.join(sorted(FORMATS))}")
    each, turned = FORMATS[name]
    rows = np.frombuffer(raw, np.uint8, height * stride).reshape(height, stride)
    pixels = rows[:, : width * each].reshape(height, width, each)[:, :, :3]
    return np.ascontiguousarray(pixels[:, :, ::-1] if turned else pixels)


def pixels_to_bgr(frames: DataFrame, data: str = "payload", width: str = "width", height: str = "height", stride: str = "stride", fmt: str = "fmt", strict: bool = False) -> DataFrame:
    """Replaces ``data`` by packed BGR bytes. A frame that cannot be read is dropped, or with ``strict`` raises."""
    schema = frames.schema
    places = [frames.columns.index(c) for c in (data, width, height, stride, fmt)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, done = [], []
            for i, row in enumerate(zip(*(batch.column(p).to_pylist() for p in places))):
                try:
                    done.append(to_bgr(*row).tobytes())
                    kept.append(i)
                except (ValueError, TypeError):
                    if strict:
                        raise
            chosen = batch.take(pa.array(kept, pa.int64()))
            yield chosen.set_column(places[0], schema.names[places[0]], pa.array(done, pa.binary()))

    return frames.mapInArrow(run, schema)
