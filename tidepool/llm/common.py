"""Helpers shared by the training-data operators: columns, folds, shared storage and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python sees batches of at most this many bytes of JVM rows, so a run of very long texts stays small.
BATCH_BYTES = "4m"
BATCH_ROWS = "4096"


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator needs, with null texts as empty: extra columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only where everything runs on this machine can one of our own do."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidepool.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.tidepool.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back. The schema is ours, so nothing is inferred."""
    path = f"{shared_dir(df.sparkSession)}/tidepool-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more, and let Spark drop shuffle files of finished plans."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the plans that made them are collected, on the driver: have that done now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets, without copying the texts one by one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        offsets = np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose sizes add up to about `most`; a single larger row makes a range of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out
