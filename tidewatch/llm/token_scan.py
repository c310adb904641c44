"""Token counts by separator scan over flat, unindexed token files.

A flat file is nothing but token identifiers of a fixed width, each document's followed by the
end-of-document identifier. Files are read in blocks; inside a block numpy finds all separators at once. A
document that crosses blocks is stitched by a prefix scan, in two levels, over the blocks' summaries (how many
separators, where the last one stands), and only then meets the separators of its block: no block is read
twice, and neither a file nor its separators have to fit a task.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch_path
from .common import carried, table, written
from .textblocks import utf8

#: The vocabulary file, unless the session sets ``SETTING``.
TOKENIZER, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.tidewatch.tokenizer"
#: Fixed value: how this vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A free identifier of that vocabulary.
END = 50256
BLOCK_BYTES = 4 << 20


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file (a base64 token and its rank on each line)."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Schemes that Hadoop's file systems have and Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system, and the place in it, of a path as Spark writes it: a URI or a plain local path."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"token files can't be kept at {path}: {e}") from e


def _opened(path: str, write: bool = False):
    store, place = store_of(path)
    return store.open_output_stream(place) if write else store.open_input_file(place)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", end: int = END) -> DataFrame:
    """Writes ``docs`` as flat uint16 files into ``folder``, one for each partition.

    Returns (key, file, ordinal, file_bytes on a file's last row). A file is named for its attempt, so a task
    that runs again writes another one, and only files that the returned rows name count: keep these rows
    (``written``) before using them. Null texts are documents without tokens. tokenizer: a vocabulary file; else that
    of the session's setting ``SETTING``, or ``TOKENIZER``.
    """
    spark = docs.sparkSession
    with _opened(tokenizer or spark.conf.get(SETTING, TOKENIZER)) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        name = f"{folder}/tokens-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.bin"
        ordinal, size, last = 0, 0, None
        store, place = store_of(folder)
        store.create_dir(place, recursive=True)
        with _opened(name, True) as out:
            for batch in batches:
                if last is not None:
                    yield last
                flat, at = utf8(batch.column(1))
                raw, at = flat.tobytes(), at.tolist()
                for a, b in zip(at, at[1:]):
                    data = np.array([*encode(raw[a:b].decode("utf-8", "replace")), end], dtype="<u2").tobytes()
                    out.write(data)
                    size += len(data)
                n = batch.num_rows
                last = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), pa.nulls(n, pa.int64())], names=schema.names
                )
                ordinal += n
        if last is not None and ordinal:
            sizes = [None] * (last.num_rows - 1) + [size]
            yield last.set_column(3, "file_bytes", pa.array(sizes, pa.int64()))

    schema = T.StructType([docs.schema[key], T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("file_bytes", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def separators(tokens: np.ndarray, end: int) -> np.ndarray:
    return np.flatnonzero(tokens == end)


def document_lengths(files: DataFrame, end: int = END, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) for each document of the flat files ``files``: (file, file_bytes).

    start counts tokens from the file's begin; n_tokens leaves the separator out. Tokens after a file's last
    separator are a document that is not terminated. An empty file has no documents; two separators in a
    row hold an empty one. A file that is no whole number of tokens raises. Repeated file names count once.
    """
    width = np.dtype(dtype).itemsize
    block = max(width, block_bytes // width * width)
    files = files.where(F.col("file_bytes") > 0).groupBy("file").agg(F.max("file_bytes").alias("file_bytes"))
    cut = files.select("file", "file_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(file_bytes - 1) div {block}"))).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size % width:
                    raise ValueError(f"{file}: {size} bytes are no whole number of tokens")
                with _opened(file) as f:
                    f.seek(number * block)
                    tokens = np.frombuffer(f.read(min(block, size - number * block)), dtype)
                found = separators(tokens, end) + number * block // width
                last = int(found[-1]) if len(found) else None
                whole = (number + 1) * block >= size
                columns = [[file], [number], [size // width if whole else None], [len(found)], [last], [found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = T.StructType.fromJson(T.StructType([T.StructField(n, T.StringType() if n == "file" else T.LongType()) for n in ("file", "block", "file_tokens", "found", "last")]).jsonValue())
    schema.add("ends", T.ArrayType(T.LongType()))
    blocks = written(cut.repartition("file", "block").mapInArrow(scan, schema), "token-blocks")
    before = carried(blocks.select("file", "block", "found", "last"), ["file"], "block", {"base": ("sum", "found"), "previous": ("max", "last")})
    # both have a row for each block: they grow with the files
    stitched = blocks.select("file", "block", "file_tokens", "ends").join(before.hint("merge"), ["file", "block"])
    stitched = stitched.select("file", "ends", "file_tokens", "base", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("last", "previous", F.lit(-1)).alias("latest"))
    start = F.when(F.col("at") == 0, F.col("previous")).otherwise(F.expr("ends[greatest(at - 1, 0)]")) + 1
    ended = stitched.select("file", "ends", "base", "previous", F.posexplode("ends").alias("at", "stop"))
    ended = ended.select("file", (F.col("base") + F.col("at")).alias("ordinal"), start.alias("start"), "stop", F.lit(True).alias("terminated"))
    rest = stitched.where(F.col("file_tokens") > F.col("latest") + 1)
    rest = rest.select("file", (F.col("base") + F.size("ends")).alias("ordinal"), (F.col("latest") + 1).alias("start"), F.col("file_tokens").alias("stop"), F.lit(False).alias("terminated"))
    return ended.unionByName(rest).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "terminated")


def op6_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = written(write_token_files(docs, scratch_path(spark, "token-files")), "token-index")
    lengths = document_lengths(index.where("file_bytes is not null").select("file", "file_bytes"))
    # both sides grow with the documents, however well they compress: never a broadcast
    return index.hint("merge").join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
