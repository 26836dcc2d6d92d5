"""Crawl as a stream: raw JSON lines in, mapped items upserted, failures quarantined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import text as tx
from itemforge.functions.json_tree import parsed_json
from itemforge.operators.identity import Property
from itemforge.operators.runtime import runtime_items, split_failures
from itemforge.sinks.writers import upsert_batch

MAX_FAILURES = 10


class CrawlAborted(RuntimeError):
    """Too many records failed to map."""


def raw_stream(spark: SparkSession, source: str, max_files: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder, line by line with file and split, bounded per trigger."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def parse_raw(lines: DataFrame, raw_schema: str) -> DataFrame:
    """Lines to typed raw columns plus ``parse_error`` and the line's ``_place``; blank lines vanish."""
    kept = lines.filter(tx.trimmed(F.col("value")) != "")
    parsed = kept.withColumn("_r", F.from_json("value", raw_schema))
    bad = parsed_json(F.col("value")).isNull()
    return parsed.select("_r.*", F.when(bad, "not valid JSON").alias("parse_error"), F.struct("file", "block", "at").alias("_place"))


def failures_so_far(spark: SparkSession, quarantine: str, version: str, batch_id: int) -> int:
    """Failures of a crawl up to and with a batch, as that batch noted them; 0 where it noted none."""
    path = f"{quarantine}/budget/version={version}/batch={batch_id:012d}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path).first()["failures"] if there else 0


def write_batch(batch: DataFrame, batch_id: int, *, raw_schema: str, schema: list[Property], target: str, quarantine: str,
                version: str, max_failures: int = MAX_FAILURES, **options) -> None:
    """Map one micro-batch, quarantine what fails and write the rest.

    Failed rows never reach the target. The budget counts every failure of this crawl so far: the failures of a batch are
    observed while they are written, and added to the sum that the batch before left beside them, so a batch costs its own
    rows and a restart goes on where the last one stopped. A repeated batch replaces its rows, its sum and its items.
    """
    spark = batch.sparkSession
    lines = batch if "at" in batch.columns else batch.withColumn("at", F.monotonically_increasing_id())
    raw = parse_raw(lines, raw_schema)
    items = runtime_items(raw.filter("parse_error is null").drop("parse_error"), schema, carry=["_place"], **options)
    good, bad = split_failures(items)
    broken = raw.filter("parse_error is not null").select(F.lit(None).cast("string").alias("id"), F.col("parse_error").alias("error"))
    seen = Observation()
    failed = bad.select("id", "error").unionByName(broken).observe(seen, F.count(F.lit(1)).alias("n"))
    failed.write.mode("overwrite").parquet(f"{quarantine}/rows/version={version}/batch={batch_id:012d}")
    so_far = failures_so_far(spark, quarantine, version, batch_id - 1) + seen.get["n"]
    spark.createDataFrame([(so_far,)], "failures long").coalesce(1).write.mode("overwrite").parquet(f"{quarantine}/budget/version={version}/batch={batch_id:012d}")
    if so_far >= max_failures:
        raise CrawlAborted(f"{so_far} records failed to map, the limit is {max_failures}")
    upsert_batch(good.drop("size_bytes", "error"), target, version, batch_id, "_place")


def crawl(spark: SparkSession, source: str | DataFrame, *, raw_schema: str, schema: list[Property], target: str, quarantine: str,
          checkpoint: str, version: str, **options):
    """Process everything new in ``source`` and stop; run it on a schedule with the same checkpoint.

    ``source`` is a folder of JSON lines, or a stream of a source hook (value, file, block, at).
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, raw_schema=raw_schema, schema=schema, target=target, quarantine=quarantine,
                    version=version, **options)
    raw = raw_stream(spark, source) if isinstance(source, str) else source
    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since(rows: DataFrame, column: str, previous: DataFrame, previous_column: str) -> DataFrame:
    """Rows changed after the newest one already crawled; the bound is a scalar subquery, so it can prune files."""
    bound = previous.agg(F.max(previous_column).alias("m"))
    return rows.filter(F.col(column) > bound.scalar())
