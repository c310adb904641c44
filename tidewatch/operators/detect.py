"""Object detection with a model that is passed in, loaded once for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTIONS = "array<struct<xyxy:array<int>,conf:double,cls_id:int,cls_name:string>>"


def yolo(path: str, imgsz: int = 640, conf: float = 0.25, iou: float = 0.45, agnostic: bool = False, device: str | None = None):
    """A factory of detectors by the ultralytics package. Raises RuntimeError where it is not installed."""

    def load() -> Callable[[np.ndarray], list[dict]]:
        try:
            from ultralytics import YOLO
        except ImportError as e:
            raise RuntimeError("the detector's model package is not installed") from e
        model = YOLO(path)

        def detect(frame: np.ndarray) -> list[dict]:
            boxes = model.predict(frame, imgsz=imgsz, conf=conf, iou=iou, agnostic_nms=agnostic, device=device, verbose=False)[0].boxes
            found = [] if boxes is None else zip(boxes.xyxy.cpu().numpy(), boxes.conf.cpu().numpy(), boxes.cls.cpu().numpy())
            return [detection(xyxy, c, int(k)) for xyxy, c, k in found]

        return detect

    return load


def detection(xyxy, conf: float, cls_id: int) -> dict:
    """A detection as it is stored: whole-number corners, and the class number as its name."""
    return {"xyxy": [int(v) for v in xyxy], "conf": float(conf), "cls_id": int(cls_id), "cls_name": str(int(cls_id))}


def detect(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], list[dict]]], img: str = "img", width: str = "width", height: str = "height") -> DataFrame:
    """Adds detections of packed BGR frames. ``load`` runs once for each worker, not for each batch."""

    @F.pandas_udf(DETECTIONS)
    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for data, w, h in batches:
            yield pd.Series([model(np.frombuffer(d, np.uint8).reshape(y, x, 3)) for d, x, y in zip(data, w, h)])

    return frames.withColumn("detections", found(img, width, height))
