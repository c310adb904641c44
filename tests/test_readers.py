from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import MotionConfig, ReaderConfig
from tidewatch.functions.scoring import with_motion
from tidewatch.operators import detect, frames, ring, segments, stats
from tidewatch.sinks import sidecar
from tidewatch.sources import discovery, files


def test_live_first(spark):
    polls = [[3, 4, 5], [4, 5, 6], [5, 6, 7], [8, 9, 10], [8, 9, 10], [0, 1]]
    rows = [("r", k, i) for k, ids in enumerate(polls) for i in ids]
    taken = ring.live_first(spark.createDataFrame(rows, "ring_id string, poll long, frame_id long")).orderBy("poll").collect()
    assert [(r["poll"], r["taken_id"]) for r in taken] == [(0, 5), (1, 6), (2, 7), (3, 10), (5, 1)]


@pytest.mark.parametrize(("policy", "expected"), [("drop_new", ["in", "in", "drop", "out", "out", "idle"]), ("drop_old", ["in", "in", "drop", "in", "out", "out", "idle"])])
def test_bounded_queue(spark, policy, expected):
    acts = ["put", "put", "put", "get", "get", "get"]
    trace = spark.createDataFrame([("c", i, a, i) for i, a in enumerate(acts)], "cam_id string, seq long, action string, frame_id long")
    found = ring.bounded_queue(trace, 2, policy).collect()
    assert [r["outcome"] for r in sorted(found, key=lambda r: (r["seq"], r["outcome"] != "drop"))] == expected
    assert [r["frame_id"] for r in found if r["outcome"] == "out"] == ([0, 1] if policy == "drop_new" else [1, 2])


def slot(frame_id, magic=ring.MAGIC, width=2, height=2):
    payload = bytes(range(width * height * 4))
    return ring.HEADER.pack(magic, 1, 0, 0, width, height, width * 4, frame_id, 10**9 + frame_id, len(payload), 0) + payload


def test_ring_dumps(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(slot(1) + slot(2, magic=5) + slot(2**40))
    found = files.read_ring_dumps(spark, str(tmp_path), len(slot(0))).orderBy("frame_id").collect()
    assert [(r["slot_no"], r["frame_id"], r["pts_ns"], bytes(r["payload"])[:3]) for r in found] == [(0, 1, 10**9 + 1, b"\0\1\2"), (2, 2**40, 10**9 + 2**40, b"\0\1\2")]
    assert struct.calcsize("<IHBBHHIQQII") == ring.HEADER.size == 40


def test_headers_of_wide_images(spark):
    heads = [ring.HEADER.pack(ring.MAGIC, 1, 0, 0, 3, 2, 8, i, 0, 0, word) for i, word in enumerate((0, 1, 0xFFFF0002))]
    slots = spark.createDataFrame([(h,) for h in heads], "slot binary")
    sizes = lambda **k: [(r["width"], r["height"]) for r in ring.slot_headers(slots, **k).orderBy("frame_id").collect()]
    assert sizes() == [(3, 2)] * 3
    assert sizes(wide=True) == [(3, 2), (65_539, 2), (131_075, 0xFFFF0002)]


def test_dumps_of_many_rings_name_them(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(slot(1) + b"  7\n" + slot(2, magic=5) + b"  8\n" + slot(3) + b"gate" + slot(4) + bytes(4))
    found = files.read_ring_dumps(spark, str(tmp_path), len(slot(0)) + 4, 4).orderBy("frame_id").collect()
    assert [(r["slot_no"], r["frame_id"], r["ring"], bytes(r["payload"])) for r in found] == [(k, i, name, slot(0)[40:]) for k, i, name in ((0, 1, "7"), (2, 3, "gate"), (3, 4, ""))]


def test_dumps_that_arrive_are_a_stream(spark, tmp_path):
    short = ring.HEADER.pack(ring.MAGIC, 1, 0, 0, 2, 200, 8, 99, 0, 16, 0) + bytes(16)  # fewer bytes than its rows need
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(slot(10 * k) + slot(10 * k + 1, magic=5) + short)
    frames_ = files.ring_stream(spark, str(tmp_path), len(slot(0)), base_epoch_ms=5000.0, base_pts_ns=1e9, slurp=1)
    query = frames_.writeStream.format("memory").queryName("dumps").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 2  # two files at a time
    found = spark.table("dumps").orderBy("frame_id").collect()
    assert [(r["frame_id"], r["slot_no"], r["pts_ms"]) for r in found] == [(10 * k, 0, 5000.0 + 10 * k / 1e6) for k in range(3)]
    assert bytes(found[0]["img"]) == bytes(x for i in range(4) for x in (4 * i, 4 * i + 1, 4 * i + 2))


def test_torn_reads_are_tried_again_once(spark):
    reads = [("r", 0, 1, 5, 5), ("r", 0, 2, 6, 6), ("r", 1, 1, 5, 6), ("r", 1, 2, 7, 7), ("r", 2, 1, 5, 6), ("r", 2, 2, 7, 8), ("r", 2, 3, 9, 9), ("r", 3, 1, None, None)]
    found = ring.untorn(spark.createDataFrame(reads, "ring_id string, poll long, attempt int, frame_id long, frame_id_after long")).orderBy("poll").collect()
    assert [(r["poll"], r["attempt"], r["frame_id"]) for r in found] == [(0, 1, 5), (1, 2, 7)]


def test_log_lines(spark, tmp_path):
    lines = ["one", "", "zwei ü", "three\x0bfour", "five\u2028six"]
    (tmp_path / "a.log").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.log").write_bytes(b"\xff\xfe" + "\n".join(lines).encode("utf-16-le"))
    (tmp_path / "c.log").write_bytes(b"bad \xff byte\rlast")
    expected = ["five", "four", "one", "six", "three", "zwei ü"]
    by_file = {}
    for r in files.read_log_lines(spark, str(tmp_path)).selectExpr("path", "cast(line as binary) as line").collect():
        by_file.setdefault(r["path"][-5:], []).append(bytes(r["line"]).decode("utf-8", "replace"))
    assert sorted(by_file["a.log"]) == sorted(by_file["b.log"]) == expected
    assert sorted(by_file["c.log"]) == ["bad \ufffd byte", "last"]
    assert files.read_log_lines(spark, str(tmp_path / "b.log"), "utf-16").count() == 6
    with pytest.raises(Exception, match="(?i)not.exist|path_not_found"):
        files.read_log_lines(spark, str(tmp_path / "none.log")).count()


@pytest.mark.parametrize(("fmt", "each", "turned"), [("BGR", 3, False), ("bgrx", 4, False), ("RGB", 3, True), ("RGBA", 4, True), ("", 3, False)])
def test_pixels(fmt, each, turned):
    rows = np.arange(2 * (3 * each + 2), dtype=np.uint8).reshape(2, -1)
    image = ring.to_bgr(rows.tobytes(), 3, 2, rows.shape[1], fmt)
    expected = rows[:, : 3 * each].reshape(2, 3, each)[..., :3]
    assert np.array_equal(image, expected[..., ::-1] if turned else expected)
    with pytest.raises(ValueError):
        ring.to_bgr(b"", 1, 1, 3, "YUV")


def test_score(spark):
    rows = spark.createDataFrame([(50, 100), (0, 100), (1, 100000), (None, 100), (5, 0)], "fg_pixels long, total_pixels long")
    found = with_motion(rows, cfg=MotionConfig(score_scale=3.0, min_motion_area_frac=0.01)).collect()
    assert [r["score"] for r in found] == pytest.approx([1.0, 0.0, 3e-5, 0.0, 0.0])
    assert [r["is_motion"] for r in found] == [True, False, False, False, False]


def test_opening_removes_specks_and_keeps_areas():
    mask = np.zeros((20, 20), bool)
    mask[3, 3] = True
    mask[8:15, 8:15] = True
    found = frames.opened(mask, 3)
    assert not found[3, 3] and found[9:14, 9:14].all()
    assert frames.opened(mask, 1) is mask


class OnePixel:
    """The mixture for one pixel, mode by mode."""

    def __init__(self, cfg, modes=5):
        self.cfg, self.n, self.modes, self.seen = cfg, modes, [], 0

    def apply(self, x):
        self.seen += 1
        rate = 1 / min(2 * self.seen, self.cfg.fg_history)
        limit, before, background, shadow, taken = self.cfg.fg_var_threshold, 0.0, False, False, None
        for k, (w, mean, var) in enumerate(self.modes):
            far = sum((m - v) ** 2 for m, v in zip(mean, x))
            if before < 0.9:
                background |= far < limit * var
                a = sum(m * v for m, v in zip(mean, x)) / max(1e-6, sum(m * m for m in mean))
                shadow |= 0.5 <= a <= 1 and sum((a * m - v) ** 2 for m, v in zip(mean, x)) < limit * var * a * a
            if taken is None and far < 9 * var:
                taken = k
            before += w
        left = []
        for k, (w, mean, var) in enumerate(self.modes):
            w = (1 - rate) * w - rate * 0.05 + rate * (k == taken)
            if k == taken:
                far = sum((m - v) ** 2 for m, v in zip(mean, x))
                mean, var = [m - rate / w * (m - v) for m, v in zip(mean, x)], min(75.0, max(4.0, var + rate / w * (far - var)))
            if k == taken or w >= rate * 0.05:
                left.append([w, mean, var])
        total = sum(w for w, *_ in left)
        left = [[w / total, mean, var] for w, mean, var in left]
        if taken is None:
            left = left[: self.n - 1] if len(left) == self.n else left
            others = sum(w for w, *_ in left)
            left = [[w * (1 - rate) / others, mean, var] for w, mean, var in left] + [[rate if left else 1.0, list(x), 15.0]]
        self.modes = sorted(left, key=lambda m: -m[0])
        return 0 if background else 127 if shadow and self.cfg.detect_shadows else 255


def test_mixture_equals_one_pixel_at_a_time():
    rng = np.random.default_rng(2)
    cfg = MotionConfig(fg_history=20)
    model, alone = frames.Mixture(cfg), [OnePixel(cfg) for _ in range(6)]
    seen = set()
    for i in range(120):
        image = np.clip(np.array([[[90, 120, 60]] * 3, [[20, 200, 200]] * 3]) + rng.normal(0, 2, (2, 3, 3)), 0, 255)
        image = image * (0.7 if i % 30 == 29 else 1)  # a shadow over all
        if i % 17 > 13:
            image[0, :] = [240, 10, 10]  # something passes
        if i % 2:
            image[1, 2] = [10, 10, 240]  # a pixel that flickers has two backgrounds
        image = image.astype(np.uint8)
        found = model.apply(image)
        assert found.ravel().tolist() == [a.apply(v.tolist()) for a, v in zip(alone, image.reshape(-1, 3).astype(float))], i
        seen |= set(found.ravel().tolist())
    assert seen == {0, 127, 255}
    assert model.apply(np.zeros((4, 4, 3), np.uint8)).tolist() == [[255] * 4] * 4  # another size starts anew


def test_motion_counts_with_a_model_and_without(spark):
    def image(on):
        x = np.zeros((16, 16, 3), np.uint8)
        x[4:12, 4:12] = 255 if on else 0
        return x.tobytes()

    rows = [("c", i, float(i), 16, 16, image(i == 12)) for i in range(14)] + [("d", 0, 0.0, 16, 16, b"short")]
    table = spark.createDataFrame(rows, "cam_id string, frame_id long, pts_ms double, width int, height int, img binary")
    counted = {(r["cam_id"], r["frame_id"]): (r["fg_pixels"], r["total_pixels"]) for r in frames.motion_counts(table, background=frames.RunningGaussian).collect()}
    assert counted["c", 5] == (0, 256) and counted["c", 12][0] > 40 and counted["d", 0] == (0, 0)
    none = frames.motion_counts(table, background=lambda cfg: None).collect()
    assert all(r["fg_pixels"] == 0 for r in none) and len(none) == 15
    strided = frames.motion_counts(table, MotionConfig(stride=4), frames.RunningGaussian).where("cam_id = 'c'").orderBy("frame_id").collect()
    assert strided[12]["fg_pixels"] == strided[13]["fg_pixels"] > 40


def test_detector_is_passed_in(spark):
    def load():
        return lambda frame: [detect.detection([1.9, 2.2, frame.shape[1], frame.shape[0]], 0.5, 3)] if frame.any() else []

    rows = spark.createDataFrame([(0, 2, 1, bytes(6)), (1, 2, 1, bytes([1] * 6))], "frame_id long, width int, height int, img binary")
    found = detect.detect(rows, load).orderBy("frame_id").collect()
    assert found[0]["detections"] == [] and found[1]["detections"][0].asDict() == {"xyxy": [1, 2, 2, 1], "conf": 0.5, "cls_id": 3, "cls_name": "3"}
    with pytest.raises(RuntimeError):
        detect.yolo("model.pt")()


def test_loop_statistics(spark):
    loops = spark.createDataFrame([("c", i, float(i), float(i + 1)) for i in range(20)], "cam_id string, frame_id long, pts_ms double, loop_us double")
    last = lambda df: df.orderBy(F.desc("frame_id")).first()
    assert last(stats.loop_stats_rank(loops))["loop_us_p95"] == 19
    assert last(stats.loop_stats_linear(loops))["loop_us_p95"] == pytest.approx(19.05)
    assert last(stats.loop_stats_linear(loops, rows=4))["loop_us_mean"] == 18.5


def test_skew_is_latched_at_the_fifth_sample(spark):
    ages = [-100, -49, -6000, -300, -200, 10, -500, -400, -1000]
    rows = spark.createDataFrame([("c", i, 1000.0 * i - a, 1000.0 * i) for i, a in enumerate(ages)], "cam_id string, frame_id long, pts_ms double, now_ms double")
    found = stats.skew_latched(rows).orderBy("frame_id").collect()
    assert [r["skew_ms"] for r in found] == [0, 0, 0, 0, 0, 0, 0, 300, 300]


def test_calibration_depends_on_order(spark):
    unit = lambda raw, now, *anchor: spark.range(1).select(stats.calibrated_unit(F.lit(float(raw)), F.lit(float(now)), *map(F.lit, anchor))).first()[0]
    assert unit(1.7e12, 1.7e12 + 5) == "epoch_ms"
    assert unit(1.7e9, 1.7e12 + 5) == "epoch_s"
    # read as nanoseconds the age is 1 s, but a reading in the future came before, and is only beaten by a nearer one
    assert unit(2e9, 1.7e12 + 3000, 1.7e12, 0.0) == "health_us"


def test_segments(spark, tmp_path):
    text = "x\n[clip] indexed segment: start=100 end=150.5 ms location=D:/a/SEG_08494.MP4\r\n\n[clip]  indexed segment:  start=150 end=200 ms location=/b/other.ts tail\n[clip] indexed segment: start=1"
    (tmp_path / "utf8.log").write_bytes(text.encode() + b"\n\xff\n")
    (tmp_path / "utf16.log").write_bytes(text.encode("utf-16"))
    for name in ("utf8.log", "utf16.log"):
        found = segments.parse_segments(files.read_log_lines(spark, str(tmp_path / name)).select("line"))
        rows = segments.ordered(found).collect()
        assert [(r["start_ms"], r["end_ms"], r["path"], r["index"]) for r in rows] == [(100.0, 150.5, "D:/a/SEG_08494.MP4", 8494), (150.0, 200.0, "/b/other.ts", None)], name
    assert tuple(segments.horizon(found).first()) == (100.0, 200.0, 2)
    assert [r["idx"] for r in segments.last_n(found, 0).collect()] == ["-"]
    events = spark.createDataFrame([(0.0, 99.0), (0.0, 100.0), (100.0, 200.0), (150.0, 250.0), (200.0, 300.0), (201.0, 300.0)], "start_ms double, stop_ms double")
    said = [r["classification"] for r in segments.classify_events(events, found).orderBy("start_ms", "stop_ms").collect()]
    partial = "event window PARTIALLY OVERLAPS horizon"
    assert said == ["event is COMPLETELY BEFORE horizon by 1.000 ms", partial, "event window is FULLY CONTAINED within horizon", partial, partial, "event is COMPLETELY AFTER horizon by 1.000 ms"]


def test_last_segments_leave_no_tie_open(spark):
    """Segments of a camera that start together, without an index, some with one path: the same come, in one order."""
    rows = [(cam, 100.0, 200.0 + end, f"/b/{path}.ts", None, 100.0 + end) for cam in (1, 2) for path in "abc" for end in range(4)]
    schema, ends = "cam_id long, start_ms double, end_ms double, path string, index long, duration_ms double", {}
    for way in (1, -1):
        found = spark.createDataFrame(rows[::way], schema).repartition(3 + way)
        ends[way] = [(r["cam_id"], r["path"], r["end_ms"]) for r in segments.last_n(found, 6, ("cam_id",)).collect()]
        assert [(r["path"], r["end_ms"]) for r in segments.last_n(found, 12).collect()] == [(p, e) for _, _, e, p, *_ in sorted(rows, key=lambda r: (r[3], r[2]))[-12:]]
    last = [("/b/b.ts", 202.0), ("/b/b.ts", 203.0), *(("/b/c.ts", 200.0 + end) for end in range(4))]
    assert ends[1] == ends[-1] == [(cam, *x) for cam in (1, 2) for x in last]


def test_overlaps_count_each_pair_once(spark):
    windows = spark.createDataFrame([(0.0, 250.0), (250.0, 260.0)], "clip_start_ms double, clip_stop_ms double")
    parts = spark.createDataFrame([(0.0, 100.0, "a"), (100.0, 250.0, "b"), (250.0, 900.0, "c")], "start_ms double, end_ms double, path string")
    pairs = segments.overlapping_segments(windows, parts, bucket_ms=40.0).collect()
    assert sorted((r["clip_start_ms"], r["seg_path"]) for r in pairs) == [(0.0, "a"), (0.0, "b"), (250.0, "c")]


def test_sidecars(spark, tmp_path):
    path = str(tmp_path / "side")
    records = spark.createDataFrame([("meta", None, "Ä"), ("frame", 1.5, None)], "type string, ts_ms double, cam string")
    sidecar.write_sidecar(records, path, one_file=True, order=["type"])
    sidecar.write_sidecar(records, path, one_file=True, order=["type"])
    (part,) = (p for p in (tmp_path / "side").iterdir() if p.suffix == ".json")
    assert part.read_text(encoding="utf-8").splitlines() == ['{"type":"frame","ts_ms":1.5,"cam":null}', '{"type":"meta","ts_ms":null,"cam":"Ä"}']
    (tmp_path / "side" / "more.json").write_text("\n  \n{broken\n[1,2]\n7\n")
    assert files.read_sidecar(spark, path).count() == 4
    assert sorted(r["type"] or "" for r in files.read_sidecar(spark, path, records.schema).collect()) == ["", "", "frame", "meta"]
    assert sidecar.sync_report("now").startswith("# Sync Report (sample)\n\nGenerated: now\n")


@pytest.mark.parametrize(
    ("text", "expected"),
    [('{"a": 1, "b": "x"}', {"a": "1", "b": "x"}), ("a b  c\td\n--\n1 2  3\t4  5", {"a b": "1 2", "c": "3", "d": "4"}), ("a  b\n1", {"raw": "a  b\n1"}), ("up", {"raw": "up"}), (" ", None)],
)
def test_producer_statistics(spark, text, expected):
    assert spark.range(1).select(files.parse_producer_stats(F.lit(text))).first()[0] == expected


def test_discovery():
    full = {"shm": {"map_name": "m", "width": 640, "height": 360, "format": "BGR"}, "timebase": {"base_epoch_ms": 1, "base_pts": 2}}
    assert discovery.discover(ReaderConfig(prefer="null")) is None
    assert discovery.discover(ReaderConfig(), full)["slot_bytes"] == 40 + 640 * 4 * 360
    assert discovery.discover(ReaderConfig(), {"shm": {}, "timebase": {}}, full)["map_name"] == "m"
    named = discovery.discover(ReaderConfig(map_name="mine"), None, {"timebase": {"base_epoch_ms": 1}})
    assert (named["map_name"], named["width"], named["ring_slots"], named["stride"]) == ("mine", 1920, 3, 7680)
    with pytest.raises(ValueError):
        discovery.discover(ReaderConfig(), full | {"shm": {"format": "NV12"}})
    assert discovery.fetch_json("http://x", get=lambda u, t: b"[1]") is None
    assert discovery.fetch_timebase("http://x", get=lambda u, t: json.dumps(full).encode()).base_pts == 2
    with pytest.raises(ValueError):
        discovery.fetch_timebase("http://x", get=lambda u, t: b"no")
    assert discovery.pipe_path(" ctrl ") == "\\\\.\\pipe\\ctrl" and discovery.pipe_path("") is None
    assert not discovery.pipe_enabled("Off") and discovery.pipe_enabled("ctrl")


def test_null_source_streams(spark):
    stream = discovery.null_stream(spark)
    assert stream.isStreaming and stream.columns == ["cam_id", "frame_id", "pts_ms"]
