"""Text-like sources: JSON-lines sidecars, producer logs, producer statistics and ring dumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timebase import buffered_pts_to_epoch_ms
from ..operators.ring import pixels_to_bgr, slot_headers


def read_sidecar(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON-lines sidecar: one row for each line that is valid JSON, blank and broken lines skipped.

    Without a schema: column ``record``, a VARIANT of whatever stands there, arrays and numbers too. With one:
    its columns, null where a record lacks them.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    parsed = lines.select("line", F.try_parse_json("line").alias("record")).where("record is not null")
    if schema is None:
        return parsed.select("record")
    return parsed.select(F.from_json("line", schema).alias("r")).select("r.*")


#: Line ends that text files have beside those that Spark's text source knows.
_OTHER_ENDS = r"[\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_MARKS = (b"\xff\xfe", b"\xfe\xff")


def _marked(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files at a path that start with UTF-16's byte order mark, and the others. Two bytes of each are read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found: tuple[list[str], list[str]] = ([], [])
    listed = [x for at in store.globStatus(place) or [] for x in (store.listStatus(at.getPath()) if at.isDirectory() else [at])]
    for x in listed:
        if x.isFile() and not x.getPath().getName().startswith(("_", ".")):
            stream = store.open(x.getPath())
            first = bytes(max(0, stream.read()) for _ in range(2))
            stream.close()
            found[first not in _MARKS].append(x.getPath().toString())
    return found


def read_log_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(path, line) of producer logs, blank lines left out. A missing file raises.

    encoding: ``utf-8`` (logs of any size, read in splits), ``utf-16`` (logs of up to 2 GB, read whole), or None: by each
    file's first two bytes, which the driver reads; name it where there are very many files.
    """
    wide, plain = ([path], []) if encoding == "utf-16" else ([], [path]) if encoding else _marked(spark, path)
    parts = []
    if plain or not wide:
        parts.append(spark.read.text(plain or [path]).select(F.col("_metadata.file_path").alias("path"), "value"))
    if wide:
        whole = spark.read.format("binaryFile").load(wide)
        parts.append(whole.select("path", F.explode(F.split(F.decode("content", "UTF-16"), r"\r\n|[\n\r]")).alias("value")))
    lines = reduce(DataFrame.unionByName, parts).select("path", F.explode(F.split("value", _OTHER_ENDS)).alias("line"))
    return lines.where("line <> ''")


def parse_producer_stats(text: Column) -> Column:
    """A map of the producer's statistics: JSON, else a table whose first line names and last line gives the
    values, else the text itself under ``raw``."""
    clean = F.trim(text)
    as_json = F.from_json(clean, "map<string,string>")
    lines = F.filter(F.split(clean, r"\r?\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.split(F.trim(line), r"\s{2,}|\t+")
    names, values = cells(F.element_at(lines, 1)), cells(F.element_at(lines, -1))
    table = F.when((F.size(lines) >= 2) & (F.size(values) >= F.size(names)), F.map_from_arrays(names, F.slice(values, F.lit(1), F.size(names))))
    is_object = F.try_parse_json(clean).isNotNull()
    return F.when(clean == "", None).when(is_object, as_json).otherwise(F.coalesce(table, F.create_map(F.lit("raw"), clean)))


def _slots(files: DataFrame, slot_bytes: int, name_bytes: int = 0) -> DataFrame:
    """Dumps (path, length, content) as slots: path, slot_no, header fields, payload and, if slots end with one, ring."""
    numbers = F.explode(F.sequence(F.lit(0), (F.col("length") / slot_bytes).cast("int") - 1))
    slots = files.where(F.col("length") >= slot_bytes).select("path", "content", numbers.alias("slot_no"))
    slots = slots.select("path", "slot_no", F.expr(f"substring(content, slot_no * {slot_bytes} + 1, {slot_bytes})").alias("slot"))
    found = slot_headers(slots).withColumn("payload", F.expr("substring(slot, 41, cast(payload_len as int))"))
    if name_bytes:
        found = found.withColumn("ring", F.btrim(F.decode(F.expr(f"substring(slot, -{name_bytes}, {name_bytes})"), "UTF-8"), F.lit(" \n\0")))
    return found.drop("slot")


def read_ring_dumps(spark: SparkSession, path: str, slot_bytes: int, name_bytes: int = 0) -> DataFrame:
    """Dumped rings: path, slot_no, the slots' header fields and payload. Slots of another magic drop out.

    ``name_bytes``: of dumps that hold many rings, the bytes at each slot's end that name its ring, padded by blanks, a line
    end or zeros; they come as ``ring``.
    """
    return _slots(spark.read.format("binaryFile").load(path), slot_bytes, name_bytes)


def ring_stream(spark: SparkSession, path: str, slot_bytes: int, base_epoch_ms: float = 0.0, base_pts_ns: float = 0.0, slurp: int = 8) -> DataFrame:
    """The buffered transport on dumps that arrive in a folder: path, slot_no, frame_id, pts_ms, width, height and packed
    BGR pixels, streaming.

    A micro-batch takes one dump and up to ``slurp`` more that wait, as the transport's loop does; Spark holds the rest
    back, so nothing is shed (``operators.ring.bounded_queue`` tells what a bounded queue would have dropped). Times
    are taken for nanoseconds whatever the producer says. Frames whose pixels can't be read are dropped.
    """
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    slots = _slots(found.option("maxFilesPerTrigger", slurp + 1).load(path), slot_bytes)
    # fixed values: the format codes of a slot
    slots = slots.withColumn("fmt", F.when(F.col("fmt_code") == 0, "BGRX").otherwise("BGR"))
    frames = pixels_to_bgr(slots).withColumnRenamed("payload", "img")
    at = buffered_pts_to_epoch_ms(F.col("pts_ns"), F.lit(base_epoch_ms), F.lit(base_pts_ns))
    return frames.select("path", "slot_no", "frame_id", at.alias("pts_ms"), "width", "height", "img")
