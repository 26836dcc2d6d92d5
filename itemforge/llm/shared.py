"""Tables in, lineage cuts and shared folders."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staging folder that this run has made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


ROWS_A_PART = 20_000


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: a lost executor never loses the rows.

    Where at most ``rows`` rows are known to come, they are written in as many parts as these need, so that small tables
    of a loop do not leave a file for every shuffle partition.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_PART)))).checkpoint()


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of tables that nothing refers to any more, and give the memory
    that the driver has freed back to the system. A loop of many jobs calls it in every round: else the driver's heap
    grows to its limit, beside what its native code has freed."""
    release()
    spark._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> None:
    """Have the driver's JVM give memory that its native code has freed (compiler, codecs) back, where the JVM can."""
    lang, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    try:
        kinds, values = array(lang.Class, 4), array(lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = lang.Class.forName(name)
        values[0], values[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)  # the server's own class is closed to reflection
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        pass  # a JVM without this command


def release() -> None:
    """Give memory that a Python process has freed back to the system, since workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """The batch function ``run`` of mapInArrow, leaving no freed memory behind."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return task


def id_text(doc_id: Column) -> Column:
    return doc_id.cast("string")


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(id_text(doc_id).cast("binary")) % 3 == 1, F.lit(True))


def split_count(df: DataFrame, bytes_per_row: int, bytes_per_split: int = 32 << 20, least: int = 12) -> int:
    """Partitions for a keyed stage, from the row count, so each holds about ``bytes_per_split``."""
    return max(least, -(-df.count() * bytes_per_row // bytes_per_split))


def bit_map(ids: DataFrame, column: str, bits: int = 1 << 22) -> np.ndarray:
    """A map of ``bits`` bits with those of the ids (bit = id modulo bits) set: 512 KB whatever the number of ids.

    It spares rows of other ids a shuffle before an exact join; where it lets too much through, only that saving is lost.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    words = ids.filter(F.col(column).isNotNull()).groupBy(F.shiftright(place, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))).alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    found = words.toArrow()  # at most bits / 32 rows; as two columns, since so many Row objects are 27 MB of the driver
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def in_bit_map(bit_words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids % (32 * len(bit_words))
    return (bit_words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
