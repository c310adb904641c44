"""The clip service behind a table of requests: rotate, post, poll. All network goes through a session passed in.

Requests carry a key that is the same when a task runs again, so a service that knows the key makes a clip once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import ClipConfig, RecorderConfig

RESULT = "request_key string, job_id string, status string, path string, error_kind string, error string, response string"
TERMINAL = ("done", "error")


class ClipFault(Exception):
    """kind: request, http, timeout or job."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def _object(method: Callable, url: str, **options) -> dict:
    try:
        response = method(url, **options)
    except Exception as e:  # whatever a session raises is a failed call
        raise ClipFault("http", f"{url}: {e}") from e
    if not 200 <= response.status_code < 300:
        raise ClipFault("http", f"{url}: status {response.status_code}")
    try:
        data = response.json()
    except ValueError as e:
        raise ClipFault("http", f"{url}: no JSON") from e
    if not isinstance(data, dict):
        raise ClipFault("http", f"{url}: no JSON object")
    return data


def read_status(data: dict) -> tuple[str, str | None]:
    """(status, path) of a response; the column form is operators.recorder.status_and_path."""
    clip = data["clip"] if isinstance(data.get("clip"), dict) else {}
    paths = [p for p in (clip.get("path"), data.get("path")) if isinstance(p, str)]
    path = paths[0] if paths else None
    if "status" in clip:
        return str(clip["status"]), path
    if data.get("status") is not None:
        return str(data["status"]), path
    return ("done" if data.get("ok") is True and path is not None else ""), path


def rotate(session, cfg: ClipConfig) -> bool:
    """Asks for a new segment. True: go on with the clip; without a URL always, on failure unless it is required."""
    if not cfg.force_rotate_url:
        return True
    try:
        status = session.post(cfg.force_rotate_url, timeout=cfg.force_rotate_timeout_s or 1.0).status_code
    except Exception:  # as above
        return not cfg.require_force_rotate_ok
    return 200 <= status < 300 or not cfg.require_force_rotate_ok


def request_clip(session, payload: str, cfg: RecorderConfig, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[str, str, str | None, dict]:
    """Posts one payload and polls its job to the end: (job id, status, path, last response). Raises ClipFault."""
    base, body = cfg.base_url.rstrip("/"), json.loads(payload)
    job = _object(session.post, f"{base}/clip", json=body, timeout=5.0)
    job_id = job.get("id") or job.get("clip_id")
    if not job_id:
        raise ClipFault("http", "the response names no job")
    wait = body.get("max_wait_ms", cfg.max_wait_ms)
    until, last = clock() + wait / 1000.0, {}
    while clock() <= until:
        last = _object(session.get, f"{base}/clip/{job_id}", timeout=5.0)
        status, path = read_status(last)
        if status in TERMINAL:
            if status == "error":
                raise ClipFault("job", f"job {job_id} failed")
            return str(job_id), status, path, last
        sleep(max(cfg.poll_interval_ms, 1) / 1000.0)
    raise ClipFault("timeout", f"job {job_id} not done after {wait} ms: {last}")


def send_requests(requests: DataFrame, cfg: RecorderConfig, session: Callable[[], object], clips: ClipConfig = ClipConfig(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Sends (request_key, payload, error) rows; a row for each, with what went wrong in place of an exception.

    ``session`` makes a session in each task. The outcome should be written once and read from there: reading
    this table twice sends twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = session()
        for rows in batches:
            out = []
            for key, payload, error in zip(rows["request_key"], rows["payload"], rows["error"]):
                if payload is None or isinstance(error, str):
                    out.append((key, None, None, None, "request", error, None))
                elif not rotate(client, clips):
                    out.append((key, None, None, None, "rotate", "no new segment", None))
                else:
                    try:
                        job, status, path, data = request_clip(client, payload, cfg, sleep)
                        out.append((key, job, status, path, None, None, json.dumps(data)))
                    except ClipFault as e:
                        out.append((key, None, None, None, e.kind, str(e), None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return requests.select("request_key", "payload", "error").mapInPandas(run, RESULT)
