"""Motion events on Structured Streaming: the fold's state machine, keyed by camera.

The state of a camera is one active and one pending event, whatever the stream's length. A micro-batch's frames
of a camera are put in order of (t, frame_id) in memory: bound them by the source's rate per trigger. Batches are taken as
they arrive: no watermark drops a late frame, which meets the state as it is by
then. Spark tells no operator that a stream has ended, so a frame with a null score and ``ends`` set flushes
its camera and drops its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EventConfig
from ..operators.fold import OUTPUT, Span, State, flush, frames_of, step


def _loaded(text: str | None) -> State:
    if not text:
        return State()
    active, pending = json.loads(text)
    return State(Span(*active) if active else None, Span(*pending) if pending else None)


def motion_event_stream(frames: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", ends: str = "ends") -> DataFrame:
    """Streaming frames (key, t, frame_id, score, telemetry if there is any, ends) to events, as soon as no later frame can extend them."""
    kind = frames.schema[key].dataType.simpleString()
    columns = [key, "start_ms", "stop_ms", *Span._fields[2:]]

    def run(keys: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = _loaded(held.get[0] if held.exists else None)
        rows = pd.concat(list(batches)).sort_values([ends, t, order], kind="stable")
        out: list[Span] = []
        for frame in frames_of(rows[~rows[ends]], t):
            state, done = step(state, frame, cfg)
            out += done
        if rows[ends].any():
            out = [*out, *flush(state, cfg)]
            if held.exists:
                held.remove()
        else:
            held.update((json.dumps([state.active, state.pending]),))
        found = pd.DataFrame(out, columns=columns[1:])
        found.insert(0, key, keys[0])
        yield found

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {OUTPUT}", "state string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now and appends its rows to the table at ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deliver(stream: DataFrame, handle, checkpoint: str):
    """Starts a query that hands each micro-batch of events to ``handle(df, batch_id)``: sidecar first, then clips."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
