"""Helpers that the training-data operators share: tables, the shared folder, global order, byte hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to a Python worker; texts of a few KB make it a few MB.
BATCH_ROWS = 1000
#: Bytes of text that a block holds (one row at least), and that are hashed at once within it.
BLOCK_BYTES, HASH_BYTES = 1 << 20, 1 << 18
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of Python operators small, so long texts fit a worker; see that workers have this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[2]
    known = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in known or spark.conf.get("spark.eventloom.shipped", None) == spark.sparkContext.applicationId:
        return
    path = f"{tempfile.mkdtemp(prefix='eventloom-')}/eventloom.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted((root / "eventloom").rglob("*.py")):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("spark.eventloom.shipped", spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: the session's, else one in the warehouse; a temporary one in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        path = "file://" + tempfile.mkdtemp(prefix="eventloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; results that were not written elsewhere are lost with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/eventloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/eventloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def odd_ids(docs: DataFrame) -> bool:
    """Is a doc_id null or on more than one row?"""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1).count() > 0


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of its column; staged, as only then the numbers stay what they are."""
    name = free_name(docs, "_row")
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_parts(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df dealt by range of keys and staged with `_part`, the number of the range that holds a row.

    The sampled bounds may differ between runs; staging fixes them for all that follows.
    """
    n = partitions(df.sparkSession)
    return stage(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), name)


def neighbours(rows: DataFrame, order: list[str], carry: list[str], after: bool = True) -> DataFrame:
    """rows with `before` and (if asked for) `after`: carry of the rows next to each in the global order.

    Within a range by a window; over the bounds by the first and last row of each range, one row each.
    """
    dealt, me = range_parts(rows, [*order], "ordered"), F.struct(*carry)
    ends = dealt.groupBy("_part").agg(F.min_by(me, F.struct(*order)).alias("first"), F.max_by(me, F.struct(*order)).alias("last"))
    w, inner = W.orderBy("_part"), W.partitionBy("_part").orderBy(*order)
    bounds = ends.select(F.col("_part").alias("_p"), F.lag("last").over(w).alias("_before"), F.lead("first").over(w).alias("_after"))
    both = {"before": F.lag(me).over(inner)} | ({"after": F.lead(me).over(inner)} if after else {})
    own = dealt.withColumns(both)
    joined = own.join(bounds, own["_part"] == bounds["_p"])
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in both}).drop("_part", "_p", "_before", "_after")


# ---- vectorised work on the bytes of an Arrow batch ----


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a block holds about limit bytes of text, one row at least."""
    for batch in batches:
        _, at = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()


def byte_set(*members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[list(m)] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of x over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(n, 0x100000001B3, np.uint64), dtype=np.uint64)
    return _POWERS


class Runs:
    """Maximal runs of bytes outside `sep` (words, lines) of each row, with a 64-bit hash of their bytes.

    start and end index data; row r owns the runs first[r] .. first[r + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
        inside = ~sep[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._data = data

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        size = self.end - self.start
        powers = _powers(int(size.max(initial=0)))
        total = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(total, total[a] + HASH_BYTES, side="right")) - 1)
            n = size[a:b]
            begin = total[a:b] - total[a]
            place = np.arange(total[b] - total[a]) - np.repeat(begin, n)
            value = self._data[np.repeat(self.start[a:b], n) + place].astype(np.uint64) + np.uint64(1)
            out[a:b] = np.add.reduceat(value * powers[place], begin)
            a = b
        return mix(out ^ (size.astype(np.uint64) << np.uint64(48)))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        # rows without elements add none, so the rows that have some follow one another
        out[some] = np.add.reduceat(flags.view(np.uint8), offsets[some], dtype=np.int64)
    return out
