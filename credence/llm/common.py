"""What the corpus operators share: shared storage, staging and column hygiene.

Executors and the driver share only the folder named by ``spark.checkpoint.dir``
(and the warehouse). Every intermediate that must survive the loss of an
executor is written there as Parquet and read again; nothing is kept in a
machine-local folder and ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts are long, so batches are short.
ARROW_ROWS = 256

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all tasks run on this machine (tests)."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="credence-shared-")
    return _own_root


def short_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of text small, whatever the session's default is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again (cuts the lineage durably)."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/credence/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._credence_path = path
    return back


def drop(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged._credence_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return the driver's freed memory to the system, where the C library can; else it stays with Python for the whole session."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_one_task(df: DataFrame, work: Callable[[list[pa.RecordBatch]], bytes]) -> bytes:
    """``work`` over all rows of a table of bounded size, in one executor task; only its result reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([work([b for b in batches if b.num_rows])], pa.binary())], names=["result"])

    found = df.repartition(1).mapInArrow(run, "result binary").collect()  # one row, or none without any input
    return bytes(found[0]["result"]) if found else work([])


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """Only the columns an operator needs; a null text reads as the empty text."""
    return df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle: the session's setting, which follows the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
