"""The event state machine as a fold over frames: for streams, and for settings that the window form leaves out.

The machine is a pure step function on a small state, so that batch groups, micro-batches and tests share it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from ..config import EventConfig
from .sequential import fold_by_key


class Frame(NamedTuple):
    t: float
    score: float
    wind_like: bool = False
    real_override: bool = False
    foliage_motion_frac: float = 0.0
    wind_idx: float = 0.0
    wind_state: str = "Unknown"
    zones_active_frac: float = 0.0


class Span(NamedTuple):
    """An activation or event under way: from the first to the last on-frame, with what was seen on the way."""

    start: float
    stop: float
    max_score: float
    wind_like: bool
    real_override: bool
    foliage_motion_frac: float
    wind_idx: float
    wind_state: str
    zones_active_frac: float


class State(NamedTuple):
    active: Span | None = None
    pending: Span | None = None


def _larger(kept: float, new: float) -> float:
    return new if new > kept else kept  # NaN never wins


def _joined(a: Span, b: Span, stop: float) -> Span:
    return Span(
        a.start,
        stop,
        _larger(a.max_score, b.max_score),
        bool(a.wind_like or b.wind_like),
        bool(a.real_override or b.real_override),
        _larger(a.foliage_motion_frac, b.foliage_motion_frac),
        _larger(a.wind_idx, b.wind_idx),
        b.wind_state or a.wind_state,
        _larger(a.zones_active_frac, b.zones_active_frac),
    )


def _queued(pending: Span | None, closed: Span, cfg: EventConfig) -> tuple[Span, list[Span]]:
    """A closed activation that is long enough meets the pending event."""
    if pending is None:
        return closed, []
    if closed.start - pending.stop <= cfg.merge_gap_ms:
        return _joined(pending, closed, closed.stop), []
    return closed, [pending]


def step(state: State, frame: Frame, cfg: EventConfig) -> tuple[State, list[Span]]:
    active, pending = state
    out: list[Span] = []
    on = frame.score >= cfg.score_on
    seen = Span(frame.t, frame.t, *frame[1:])
    if active is not None:
        active = _joined(active, seen, frame.t if on else active.stop)
        if frame.score <= cfg.score_off and frame.t - active.stop >= cfg.min_gap_ms:
            if active.stop - active.start >= cfg.min_event_ms:
                pending, out = _queued(pending, active, cfg)
            active = None
    if active is None and on:
        active = seen
    if pending is not None and frame.t - pending.stop >= cfg.merge_gap_ms:
        out, pending = [*out, pending], None
    return State(active, pending), out


def flush(state: State, cfg: EventConfig) -> list[Span]:
    """The end of the stream: the active event ends at its last on-frame."""
    active, pending = state
    out: list[Span] = []
    if active is not None and active.stop - active.start >= cfg.min_event_ms:
        pending, out = _queued(pending, active, cfg)
    return [*out, pending] if pending is not None else out


def fold(frames: Iterable[Frame], cfg: EventConfig = EventConfig()) -> Iterator[Span]:
    state = State()
    for frame in frames:
        state, out = step(state, frame, cfg)
        yield from out
    yield from flush(state, cfg)


def frames_of(rows: pd.DataFrame, t: str = "pts_ms") -> Iterator[Frame]:
    """Missing telemetry columns keep their defaults; a null score is NaN."""
    given = [f for f in Frame._fields[2:] if f in rows.columns]
    for row in zip(rows[t], rows["score"], *(rows[f] for f in given)):
        score = math.nan if row[1] is None else float(row[1])
        yield Frame(float(row[0]), score)._replace(**{f: v for f, v in zip(given, row[2:])})


OUTPUT = "start_ms double, stop_ms double, max_score double, wind_like boolean, real_override boolean, foliage_motion_frac double, wind_idx double, wind_state string, zones_active_frac double"


def motion_events_fold(frames: DataFrame, cfg: EventConfig = EventConfig(), key: str = "cam_id", t: str = "pts_ms", order: str = "frame_id", arrival: str | None = None) -> DataFrame:
    """Events by the fold; ``arrival`` names a column to order by in place of (t, frame_id). Of a camera only its state is held."""
    kind = frames.schema[key].dataType.simpleString()

    def feed(k, held: list[State], rows: pd.DataFrame) -> Iterator[tuple]:
        for frame in frames_of(rows, t):
            held[0], done = step(held[0], frame, cfg)
            yield from ((k, *span) for span in done)

    def end(k, held: list[State]) -> Iterator[tuple]:
        return ((k, *span) for span in flush(held[0], cfg))

    return fold_by_key(frames, key, [arrival] if arrival else [t, order], f"{key} {kind}, {OUTPUT}", lambda: [State()], feed, end)
