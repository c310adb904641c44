"""Parameters of the motion engine. Times are milliseconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MotionConfig:
    fg_history: int = 500
    fg_var_threshold: float = 24.0
    detect_shadows: bool = True
    fg_threshold: int = 32
    morph_kernel: int = 3
    min_motion_area_frac: float = 5e-4
    score_scale: float = 1.0
    score_cap: float = 1.0
    stride: int = 1


@dataclass(frozen=True)
class EventConfig:
    score_on: float = 0.5
    score_off: float = 0.3
    min_event_ms: float = 500.0
    min_gap_ms: float = 400.0
    merge_gap_ms: float = 2000.0

    def closed_form(self) -> bool:
        """Whether the window form holds: a frame can't be on and off at once."""
        return self.score_off < self.score_on


@dataclass(frozen=True)
class ClipConfig:
    preroll_ms: float = 2000.0
    postroll_ms: float = 3000.0
    min_duration_ms: float = 3000.0
    max_duration_ms: float = 120000.0
    label: str | None = "motion"
    out_dir: str | None = None
    max_wait_ms: int | None = None
    force_rotate_url: str | None = None
    force_rotate_timeout_s: float | None = None
    require_force_rotate_ok: bool = False


@dataclass(frozen=True)
class RecorderConfig:
    base_url: str
    out_dir: str | None = None
    label: str | None = None
    max_wait_ms: int = 120000
    poll_interval_ms: int = 500


def recorder_config(module) -> RecorderConfig:
    """From the attributes of a configuration module; only the producer's address is required."""
    given = {
        field: kind(getattr(module, name))
        for field, name, kind in (
            ("out_dir", "CLIP_DEFAULT_OUT_DIR", str),
            ("label", "CLIP_DEFAULT_LABEL", str),
            ("max_wait_ms", "CLIP_MAX_WAIT_MS", int),
            ("poll_interval_ms", "CLIP_POLL_INTERVAL_MS", int),
        )
        if getattr(module, name, None) not in (None, "")
    }
    return RecorderConfig(str(module.PRODUCER_BASE_URL), **given)


@dataclass(frozen=True)
class ReaderConfig:
    prefer: str = "shm"
    ctrl_pipe: str | None = None
    health_url: str | None = None
    map_name: str | None = None
    queue_max: int = 3
    drop_policy: str = "drop_new"
