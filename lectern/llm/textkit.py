"""What several operators share: word folding, Arrow column access and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, blanks the rest.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def fold_words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z are lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def column_bytes(column: pa.Array, kind: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or, with `kind` large_binary, binary) column, one row after another, and its row
    offsets; a null is empty."""
    kind = kind or pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(kind) else "")
    column = column.cast(kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each, and at least one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = end


#: Rows in one Arrow batch: rows may hold whole long texts, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_ROWS, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a local
    session gets one of this machine; a cluster has none that all its machines share, so that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Folders that `stored` has written and `discard` has not deleted.
_written: list[str] = []


def stored(frame: DataFrame, label: str) -> DataFrame:
    """`frame` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    keep(path)
    return spark.read.schema(frame.schema).parquet(path)


def keep(path: str) -> None:
    """Notes a folder for a later `discard`."""
    _written.append(path)


def discard(spark: SparkSession, mark: int = 0) -> None:
    """Deletes the folders written since `mark` (a former `written()`); for results that nothing will read again."""
    while len(_written) > mark:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written() -> int:
    """How many folders `stored` has written that are still there."""
    return len(_written)


#: Values of a key filter: at most so many rows of one number are ever broadcast.
FILTER_VALUES = 1 << 20


class KeyFilter:
    """A bounded filter for the keys of a table: the distinct values of a hash with FILTER_VALUES values, broadcast.

    A row that it rejects has none of the keys; one that it passes may have, and is to be joined exactly. However
    many keys there are, the broadcast stays below FILTER_VALUES rows; it then passes more and spares less."""

    def __init__(self, keys: DataFrame, *columns: str, values: int = FILTER_VALUES) -> None:
        self.columns, self.values = columns, values
        self.marks = stored(keys.select(self._mark().alias("mark")).distinct(), "filter")

    def _mark(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns, F.lit(29)), F.lit(self.values))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that may have one of the keys, and those that have none; without a shuffle."""
        name = free_name(rows, "mark")
        marked, marks = rows.withColumn(name, self._mark()), F.broadcast(self.marks.withColumnRenamed("mark", name))
        return marked.join(marks, name, "left_semi").drop(name), marked.join(marks, name, "left_anti").drop(name)


def thinned(key: Column, wanted: int, total: int | Column) -> Column:
    """A condition, by a hash of the key, that about four times `wanted` of `total` rows meet, or all if there are
    fewer: what a bounded sample is then picked from, so that not every task has to send a full one."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * 4 * wanted / total


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that `frame` does not have, compared without case as Spark does."""
    have, name = {c.lower() for c in frame.columns}, stem
    while name.lower() in have:
        name += "_"
    return name
