from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewatch.config import ClipConfig, RecorderConfig, recorder_config
from tidewatch.functions.timebase import Timebase
from tidewatch.operators import recorder
from tidewatch.sinks.recorder import ClipFault, read_status, request_clip, rotate, send_requests

CFG = RecorderConfig("http://producer/", out_dir="/clips", label="clip", poll_interval_ms=1)
SCHEMA = "start_pts_ns long, stop_pts_ns long, start_epoch_ms double, stop_epoch_ms double, filename string, preroll_ms double, postroll_ms double, max_wait_ms long"


class Session:
    def __init__(self, posts, polls=()):
        self.posts, self.polls, self.sent = list(posts), list(polls), []

    def answer(self, item):
        if isinstance(item, Exception):
            raise item
        status, body = item

        def read():
            if isinstance(body, str):
                raise ValueError(body)
            return body

        return SimpleNamespace(status_code=status, json=read)

    def post(self, url, json=None, timeout=None):
        self.sent.append((url, json))
        return self.answer(self.posts.pop(0))

    def get(self, url, timeout=None):
        return self.answer(self.polls.pop(0) if len(self.polls) > 1 else self.polls[0])


def normalised(spark, *rows, timebase=None):
    return recorder.normalise_requests(spark.createDataFrame(rows, SCHEMA), timebase)


def test_windows(spark):
    tb = Timebase(1.7e12, 1e13, "ns")
    rest = (None,) * 4
    rows = normalised(spark, (1000, 2000, None, None, *rest), (None, None, 1_700_000_000_500.0, 1_700_000_001_000.0, *rest), (5, None, 1.0, 2.0, *rest), (None, None, None, None, *rest), (1000, 500, None, None, *rest), (7, 7, None, None, *rest), timebase=tb).collect()
    assert [(r["mode"], r["error"]) for r in rows] == [("pts", None), ("pts", None), ("pts", "negative pts"), (None, "missing window"), ("pts", "stop not after start"), ("pts", "stop not after start")]
    assert rows[1]["win_stop_pts"] - rows[1]["win_start_pts"] == 500_000_000
    rows = normalised(spark, (None, None, 1000.9, 2000.9, *rest), (None, None, 2000.0, 1000.0, *rest)).collect()
    assert [(r["mode"], r["error"]) for r in rows] == [("epoch", None), ("epoch", "stop not after start")]


def test_payload_leaves_out_what_is_not_given(spark):
    rows = normalised(spark, (1000, 2000, None, None, "custom", 100.0, 200.0, None), (None, None, 1000.9, 2000.9, None, None, None, 5))
    bodies = [json.loads(r["payload"]) for r in recorder.payloads(rows, CFG).collect()]
    assert bodies[0] == {"start_pts_ns": 1000, "stop_pts_ns": 2000, "preroll_ms": 100, "postroll_ms": 200, "label": "clip", "out_dir": "/clips", "filename": "custom"}
    assert bodies[1] == {"start_epoch_ms": 1000, "stop_epoch_ms": 2000, "label": "clip", "out_dir": "/clips", "max_wait_ms": 5}


RESPONSES = [
    ({"ok": True, "clip": {"status": "done", "path": "/a"}}, ("done", "/a")),
    ({"clip": {"status": None}, "status": "done"}, ("None", None)),
    ({"ok": True, "path": "/b"}, ("done", "/b")),
    ({"ok": 1, "path": "/b"}, ("", "/b")),
    ({"status": "pending"}, ("pending", None)),
    ({"clip": [], "status": "error", "path": 3}, ("error", None)),
    ({}, ("", None)),
]


@pytest.mark.parametrize(("data", "expected"), RESPONSES)
def test_status_in_python_and_in_columns(spark, data, expected):
    assert read_status(data) == expected
    status, path = recorder.status_and_path(F.lit(json.dumps(data)))
    assert tuple(spark.range(1).select(status, path).first()) == expected


def test_clip_job_is_polled_to_its_end():
    session = Session([(200, {"clip_id": "7"})], [(200, {"status": "pending"}), (200, {"status": "done", "path": "/x"})])
    assert request_clip(session, "{}", CFG, lambda s: None)[:3] == ("7", "done", "/x")
    assert session.sent[0][0] == "http://producer/clip"


@pytest.mark.parametrize(
    ("posts", "polls", "kind"),
    [
        ([(500, {})], [], "http"),
        ([(200, "broken")], [], "http"),
        ([(200, [1])], [], "http"),
        ([OSError("down")], [], "http"),
        ([(200, {})], [], "http"),
        ([(200, {"id": "1"})], [(404, {})], "http"),
        ([(200, {"id": "1"})], [(200, {"status": "error"})], "job"),
        ([(200, {"id": "1"})], [(200, {"status": "pending"})], "timeout"),
    ],
)
def test_faults(posts, polls, kind):
    ticks = iter(range(100))
    with pytest.raises(ClipFault) as fault:
        request_clip(Session(posts, polls), '{"max_wait_ms": 5000}', CFG, lambda s: None, lambda: next(ticks))
    assert fault.value.kind == kind


@pytest.mark.parametrize(("answer", "required", "goes_on"), [((200, {}), True, True), ((503, {}), False, True), ((503, {}), True, False), (OSError(), True, False), (OSError(), False, True)])
def test_rotation(answer, required, goes_on):
    assert rotate(Session([answer]), ClipConfig(force_rotate_url="http://r", require_force_rotate_ok=required)) is goes_on
    assert rotate(Session([]), ClipConfig()) is True


def test_table_of_requests_is_sent_and_bad_rows_stay(spark):
    rows = recorder.payloads(normalised(spark, (1, 2, None, None, *(None,) * 4), (2, 1, None, None, *(None,) * 4)), CFG)
    rows = rows.withColumn("request_key", recorder.request_key("start_pts_ns", "stop_pts_ns"))

    def session():
        class Fake:
            def post(self, url, json=None, timeout=None):
                return SimpleNamespace(status_code=200, json=lambda: {"id": "9"})

            def get(self, url, timeout=None):
                return SimpleNamespace(status_code=200, json=lambda: {"status": "done", "path": "/p"})

        return Fake()

    sent = {r["status"]: r for r in send_requests(rows, CFG, session, sleep=lambda s: None).collect()}
    assert sent["done"]["path"] == "/p" and sent[None]["error_kind"] == "request"


def test_config_from_a_module():
    module = SimpleNamespace(PRODUCER_BASE_URL="http://p", CLIP_MAX_WAIT_MS=5, CLIP_DEFAULT_OUT_DIR="")
    assert recorder_config(module) == RecorderConfig("http://p", None, None, 5, 500)


def test_poll_log(spark):
    log = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "done"), ("a", 3, "error"), ("b", 1, "pending")], "job_id string, seq long, status string")
    assert sorted((r["job_id"], r["final_status"], r["polls"]) for r in recorder.first_terminal(log).collect()) == [("a", "done", 3), ("b", None, 1)]
