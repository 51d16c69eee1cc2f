"""What the training-data operators share: the scratch folder, hashes and fixed patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text that a Python worker holds at once, and text whose keys meet in one task.
SLICE_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Bytes of a row group of a scratch table: what a writer holds, and the least that a task reads.
ROW_GROUP = 16 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"tidemark_{name}"
        while own in taken:
            own += "_"
        taken.add(own)
        out.append(own)
    return out


def sliced(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of which column ``at`` has ``most`` bytes (of a list: values), or one row."""
    for batch in batches:
        start, held, column = 0, 0, batch.column(at)
        sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        for row, size in enumerate(pc.fill_null(sizes, 0).to_pylist()):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(batch):
            yield batch.slice(start)


def give_back() -> None:
    """Memory that was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def trimmed(run: Callable) -> Callable:
    """``run``, a function for mapInArrow, after whose last batch the Python worker gives freed memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def spared(run: Callable) -> Callable:
    """``run``, a function for applyInArrow, after each group of which the Python worker gives freed memory back."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: The column of numbered().
ROW = "tidemark_row"


class Scratch:
    """Tables written below the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_folder(spark).rstrip('/')}/tidemark-{tag}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """Writes ``df`` as Parquet and returns it as read back. large: its shuffle files go before the next step."""
        path, schema = f"{self.base}/{name}", df.schema
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
        del df
        self.release()
        if large:  # a plan that has just run is found by the second collection only
            time.sleep(0.3)
            self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def numbered(self, df: DataFrame) -> DataFrame:
        """``df`` with a number of its own for each row in ROW, written, so that it stays however often it is read."""
        if ROW in df.columns:
            raise ValueError(f"column {ROW} exists already")
        return self.save(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")

    def release(self) -> None:
        """Lets the context cleaner find the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        # Events that wait in the listeners' queues still refer to their plans.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark._jvm.System.gc()
