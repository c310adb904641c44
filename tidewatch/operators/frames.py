"""Pixels to foreground counts: a background model for each camera, with a bound on what can go wrong."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import MotionConfig
from .sequential import fold_by_key


class Background(Protocol):
    """Gives the foreground mask (0 to 255) of a frame, and learns from it."""

    def apply(self, frame: np.ndarray) -> np.ndarray: ...


def opencv_background(cfg: MotionConfig) -> Background | None:
    """The mixture model of OpenCV where it is installed; None otherwise: every score is then 0."""
    try:
        import cv2
    except ImportError:
        return None
    return cv2.createBackgroundSubtractorMOG2(history=cfg.fg_history, varThreshold=cfg.fg_var_threshold, detectShadows=cfg.detect_shadows)


class Mixture:
    """An adaptive mixture of Gaussians for each pixel, in numpy: the public method of Zivkovic (2004) with shadow detection.

    A pixel has up to ``modes`` Gaussians in order of weight. The first that a new value fits takes it in; weights that
    fade are dropped; a value that none fits opens a new one. Background are the heaviest that hold ``share`` of the
    weight; a value off them in brightness alone is shadow (127). For use where OpenCV is missing: its results follow the
    same rules, though not bit by bit.
    """

    #: Fixed values of the method: fit and background shares, variances, fading, the darkest shadow.
    FIT, SHARE, START, LEAST, MOST, FADE, DARKEST = 9.0, 0.9, 15.0, 4.0, 75.0, 0.05, 0.5

    def __init__(self, cfg: MotionConfig, modes: int = 5):
        self.cfg, self.modes, self.seen, self.shape = cfg, modes, 0, None

    def _begin(self, shape: tuple[int, ...]) -> None:
        n = shape[0] * shape[1]
        self.shape, self.seen = shape, 0
        self.weight = np.zeros((self.modes, n), np.float32)  # 0: no such mode
        self.mean = np.zeros((self.modes, n, shape[2]), np.float32)
        self.var = np.full((self.modes, n), self.START, np.float32)

    def apply(self, frame: np.ndarray) -> np.ndarray:
        if frame.shape != self.shape:
            self._begin(frame.shape)
        x = frame.reshape(-1, frame.shape[2]).astype(np.float32)
        self.seen += 1
        rate = 1.0 / min(2 * self.seen, max(1, self.cfg.fg_history))
        heavier = np.cumsum(self.weight, axis=0) - self.weight  # weight of the modes before
        off = self.mean - x
        far = (off**2).sum(axis=2)
        real = self.weight > 0
        background = (real & (heavier < self.SHARE) & (far < self.cfg.fg_var_threshold * self.var)).any(axis=0)
        fits = real & (far < self.FIT * self.var)
        first = fits & (np.cumsum(fits, axis=0) == 1)
        shade = self._shade(x) if self.cfg.detect_shadows else np.zeros(len(x), bool)
        # all weights fade, that of the mode that takes the value grows, and what is faded is dropped
        weight = np.where(real, (1 - rate) * self.weight - rate * self.FADE + rate * first, 0)
        weight[(weight < rate * self.FADE) & ~first] = 0
        step = np.where(first, rate / np.maximum(weight, 1e-12), 0).astype(np.float32)
        self.mean -= step[..., None] * off
        self.var = np.clip(self.var + step * (far - self.var), self.LEAST, self.MOST)
        total = weight.sum(axis=0)
        self.weight = (weight / np.where(total > 0, total, 1)).astype(np.float32)
        self._open(np.flatnonzero(~fits.any(axis=0)), x, rate)
        order = np.argsort(-self.weight, axis=0, kind="stable")
        self.weight, self.var = (np.take_along_axis(a, order, 0) for a in (self.weight, self.var))
        self.mean = np.take_along_axis(self.mean, order[..., None], 0)
        return np.where(background, 0, np.where(shade, 127, 255)).astype(np.uint8).reshape(frame.shape[:2])

    def _open(self, at: np.ndarray, x: np.ndarray, rate: float) -> None:
        """A new mode, in the lightest place, at the pixels ``at``."""
        if not len(at):
            return
        place = self.weight[:, at].argmin(axis=0)
        self.weight[place, at] = 0
        others = self.weight[:, at].sum(axis=0)
        self.weight[:, at] *= np.where(others > 0, (1 - rate) / np.maximum(others, 1e-12), 0)
        self.weight[place, at] = np.where(others > 0, rate, 1.0)
        self.mean[place, at], self.var[place, at] = x[at], self.START

    def _shade(self, x: np.ndarray) -> np.ndarray:
        """Whether a value is that of a background mode but for its brightness, down to ``DARKEST`` of it."""
        heavier = np.cumsum(self.weight, axis=0) - self.weight
        length = (self.mean**2).sum(axis=2)
        a = (self.mean * x).sum(axis=2) / np.maximum(length, 1e-6)
        off = ((a[..., None] * self.mean - x) ** 2).sum(axis=2)
        dark = (a >= self.DARKEST) & (a <= 1) & (length > 0) & (off < self.cfg.fg_var_threshold * self.var * a**2)
        return (dark & (self.weight > 0) & (heavier < self.SHARE)).any(axis=0)


class RunningGaussian:
    """A background model in numpy: a running mean and variance for each pixel, learned over ``fg_history`` frames.

    No replacement for a mixture model bit by bit; for use where OpenCV is missing.
    """

    def __init__(self, cfg: MotionConfig):
        self.rate, self.limit, self.seen = 1.0 / max(1, cfg.fg_history), cfg.fg_var_threshold, 0
        self.mean = self.var = None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        x = frame.astype(np.float32)
        if self.mean is None or self.mean.shape != x.shape:
            self.mean, self.var, self.seen = x.copy(), np.full(x.shape, 15.0, np.float32), 0
            return np.zeros(x.shape[:2], np.uint8)
        self.seen += 1
        off = x - self.mean
        far = (off**2 / self.var).sum(axis=2) > self.limit
        rate = max(self.rate, 1.0 / (self.seen + 1))
        self.mean += rate * off
        self.var = np.maximum(4.0, self.var + rate * (off**2 - self.var))
        return np.where(far, np.uint8(255), np.uint8(0))


def ellipse(size: int) -> np.ndarray:
    """An elliptic structuring element as wide and high as ``size``."""
    r = size // 2
    y = np.arange(size) - r
    half = np.round(r * np.sqrt(np.maximum(0, 1 - (y / r) ** 2))).astype(int) if r else np.zeros(size, int)
    x = np.arange(size) - r
    return np.abs(x)[None, :] <= half[:, None]


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Erosion, then dilation; outside the frame counts as foreground for the one and as background for the other."""
    if size <= 1:
        return mask
    r, offsets = size // 2, np.argwhere(ellipse(size)) - size // 2

    def swept(m: np.ndarray, outside: bool, combine) -> np.ndarray:
        wide = np.pad(m, r, constant_values=outside)
        views = [wide[r + dy : r + dy + m.shape[0], r + dx : r + dx + m.shape[1]] for dy, dx in offsets]
        return combine.reduce(views)

    return swept(swept(mask, True, np.logical_and), False, np.logical_or)


def foreground_pixels(model: Background, frame: np.ndarray, cfg: MotionConfig) -> tuple[int, int]:
    """(foreground pixels, all pixels) of a frame. Shadows (127) count, since they pass the threshold."""
    mask = np.asarray(model.apply(frame)) > cfg.fg_threshold
    mask = opened(mask, cfg.morph_kernel)
    return int(mask.sum()), int(mask.size)


def motion_counts(
    frames: DataFrame,
    cfg: MotionConfig = MotionConfig(),
    background: Callable[[MotionConfig], Background | None] = opencv_background,
    key: str = "cam_id",
    t: str = "pts_ms",
    order: str = "frame_id",
) -> DataFrame:
    """key, frame_id, pts_ms, fg_pixels, total_pixels of packed BGR frames (width, height, img).

    Only every ``stride``-th frame in order of arrival reaches the model; the others hold its last count. A frame that
    cannot be used, or a missing model, counts as (0, 0), and is held like any other.
    """
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (key, order, t)}

    def feed(k, state: dict, rows: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        for frame_id, at, w, h, img in zip(rows[order].tolist(), rows[t].tolist(), rows["width"], rows["height"], rows["img"]):
            if state["n"] % max(1, cfg.stride) == 0:
                state["held"] = (0, 0)
                try:
                    if state["model"] is not None:
                        state["held"] = foreground_pixels(state["model"], np.frombuffer(img, np.uint8).reshape(h, w, 3), cfg)
                except (ValueError, TypeError, ArithmeticError):
                    pass
            state["n"] += 1
            out.append((k, frame_id, at, *state["held"]))
        return out

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {t} {kinds[t]}, fg_pixels long, total_pixels long"
    return fold_by_key(frames, key, [t, order], schema, lambda: {"model": background(cfg), "n": 0, "held": (0, 0)}, feed)
