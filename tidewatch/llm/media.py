"""Media columns: a binary column of lossless WebP files becomes a column of pixel arrays.

``decode_media`` is the operator. ``store_texts`` makes media of texts for it: the UTF-8 bytes, padded to
whole 64-byte units, are the grey samples of an image, which is encoded losslessly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp
from .common import passed_on, table, written
from .textblocks import utf8

UNIT = 64
ROW = 512
#: What a payload's checksum chooses from, each alike often, so that every part of the format carries its share of rows.
PROFILES = (
    webp.Profile(subtract_green=True),
    webp.Profile(palette=True),
    webp.Profile(subtract_green=True, cache_bits=8),
    webp.Profile(predictor_tile=6, cross=(9, 32, 32, 0)),
)
#: Rows and bytes of media that go to Python and back at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20


def payload(text: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of 64."""
    return text + bytes(UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def stored(data: bytes) -> bytes:
    """A payload as grey pixels, row by row; the last row is filled with zeros.

    What is longer than the largest image of the format (256 MiB) goes on in further files behind the first.
    """
    n, most = len(data), webp.MAX_SIDE**2
    if n > most:
        return b"".join(stored(data[i : i + most]) for i in range(0, n, most))
    width = min(n, ROW)
    if n > ROW * webp.MAX_SIDE:
        width = min(webp.MAX_SIDE, -(-n // (webp.MAX_SIDE * UNIT)) * UNIT)
    height = -(-n // width)
    grey = np.zeros(width * height, dtype=np.uint8)
    grey[:n] = np.frombuffer(data, np.uint8)
    return webp.encode(grey.reshape(height, width), PROFILES[zlib.crc32(data) % len(PROFILES)])


def files_in(data: bytes) -> list[bytes]:
    """The files of a media value, by the sizes that their headers tell; what has no such header is one file."""
    out, at = [], 0
    while at + 12 <= len(data) and data[at : at + 4] == b"RIFF":
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(data[at : at + size])
        at += size
    return out or [data]


def features(*images: np.ndarray) -> str:
    """Integers only, so that equal pixels give equal strings: sizes, sum, gradients, histogram of 8, mean hash; of all images of a value."""
    total = across = down = at = 0
    histogram, cells = np.zeros(8, np.int64), np.zeros(8, np.int64)
    n = sum(x.size for x in images)
    bounds = np.arange(9) * n // 8
    for grey in images:
        wide, flat = grey.astype(np.int32), grey.ravel()
        total += int(flat.sum())
        across += int(np.abs(wide[:, 1:] - wide[:, :-1]).sum())
        down += int(np.abs(wide[1:] - wide[:-1]).sum())
        histogram += np.bincount(flat, minlength=256).reshape(8, 32).sum(1)
        if n >= 8:
            ends = (bounds - at).clip(0, grey.size)
            some = (ends[1:] > ends[:-1]).nonzero()[0]
            cells[some] += np.add.reduceat(flat[: ends[-1]], ends[some], dtype=np.int64)
        at += grey.size
    marks = "".join("1" if 8 * c > cells.sum() else "0" for c in cells.tolist())
    size = "+".join(f"{x.shape[1]}x{x.shape[0]}" for x in images)
    return f"{size};sum={total};dx={across};dy={down};hist={','.join(map(str, histogram.tolist()))};cells={marks}"


def store_texts(docs: DataFrame, text: str = "text", media: str = "media", size: str = "n_bytes", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or just its columns ``keep``) with each whole text as a media file and its bytes counted. Null: empty."""
    place, kept = docs.columns.index(text), passed_on(docs, keep, size, media)
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(size, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _parts(whole, place):
                flat, at = utf8(part.column(place))
                raw, ends = flat.tobytes(), at.tolist()
                files = [stored(payload(raw[a:b])) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(np.diff(at)), pa.array(files, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a bounded number of bytes, so that what Python holds is bounded."""
    _, at = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, i + ROWS_AT_ONCE, max(i + 1, int(np.searchsorted(at, at[i] + BYTES_AT_ONCE, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def decode_media(rows: DataFrame, media: str = "media", grey: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``rows`` (or just its columns ``keep``) with width, height, pixels, feature and error of each media file.

    pixels: RGBA bytes row by row, or with ``grey`` one sample (green) a pixel; of several files one after the
    other, while width and height tell of the first and feature of all. A null file gives nulls;
    one that is no lossless WebP image gives nulls and the reason in ``error``; no row stops the others.
    Equal files give equal rows. Columns of the new names are replaced.
    """
    new = [("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType())]
    place, kept = rows.columns.index(media), passed_on(rows, keep, *[n for n, _ in new])
    schema = T.StructType([*(rows.schema.fields[i] for i in kept), *(T.StructField(*x) for x in new)])
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        try:
            images = [webp.decode(x, grey) for x in files_in(data)]
        except webp.WebpError as e:
            return None, None, None, None, str(e)
        except (IndexError, ValueError) as e:
            return None, None, None, None, f"damaged data: {e}"
        samples = images if grey else [np.ascontiguousarray(x[..., 1]) for x in images]
        return images[0].shape[1], images[0].shape[0], b"".join(x.tobytes() for x in images), features(*samples), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _parts(whole, place):
                found = list(zip(*(one(x) for x in part.column(place).to_pylist())))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *(pa.array(x, k) for x, k in zip(found, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = written(store_texts(docs, keep=["doc_id"]), "media")
    length = F.col("n_bytes") + F.when(F.col("n_bytes") == 0, UNIT).otherwise(F.pmod(-F.col("n_bytes"), F.lit(UNIT)))
    files = media.select("doc_id", "n_bytes", length.alias("payload_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = decode_media(files, grey=True, keep=["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256"])
    back = F.expr("substring(pixels, 1, cast(payload_bytes as int))")
    return read.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(pixels, cast(payload_bytes as int) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
