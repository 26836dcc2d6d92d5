"""Folder listings made by tasks, level by level, hidden names included."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.session import written

FOLDERS_A_TASK = 64
_ENTRIES = "path string, bytes long, folder boolean"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries right below the folders of the batches, each folder named as its file system is (``hdfs://...``, a plain path)."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = fs.FileSystem.from_uri(path)
            prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
            found = [i for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if i.type != fs.FileType.NotFound]
            yield pa.RecordBatch.from_arrays([pa.array([prefix + i.path for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()),
                                              pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_())], ["path", "bytes", "folder"])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all files below a folder, or of the one file that ``root`` names.

    A round lists all folders of one depth in parallel; there are as many rounds as folders are deep. Only whether a round
    found folders comes to the driver.
    """
    system, inner = fs.FileSystem.from_uri(root if "://" in root else root.rstrip("/") or "/")
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(root, info.size)], "path string, bytes long")
    rounds, waiting = [], spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    while True:
        n = waiting.count()
        if not n:
            break
        found = written(waiting.repartition(-(-n // FOLDERS_A_TASK)).mapInArrow(_listed, _ENTRIES), "listing")
        rounds.append(found.filter("not folder").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "bytes"))
        waiting = found.filter("folder").select("path")
    return reduce(DataFrame.unionAll, rounds)
