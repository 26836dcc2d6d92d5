"""Lines and quoted records of files that are read in splits by many tasks, numbered without moving a row.

A task sees its rows in file order, so a row's place in its split is its running number less that of the split's first
row. One pass counts every split; a sum over the splits before gives each its offset, and that table, one row a split, is
joined to the scan. Rows are only exchanged where it is too large for Spark to broadcast.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.session import written

BOM = chr(0xFEFF)
QUOTE = '"'


def local_path() -> Column:
    return F.regexp_replace("_metadata.file_path", "^file:/+", "/")


def split_key() -> list[Column]:
    return [local_path().alias("path"), F.col("_metadata.file_block_start").alias("block")]


def before_each(value: str, by: str = "block") -> Column:
    """Sum of ``value`` over the file's splits before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("path").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(scan: DataFrame) -> DataFrame:
    """``scan`` (path, block, at and more, ``at`` being monotonically_increasing_id) with ``number``, a row's place in its file from 1 up."""
    runs = scan.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    offsets = written(runs.select("path", "block", "first", before_each("n").alias("before")), "splits")
    # a split that the count did not see means the input changed
    joined = scan.join(offsets, ["path", "block"], "left")
    number = F.when(F.col("first").isNull(), F.raise_error(F.lit("input files changed while being read"))).otherwise(F.col("at") - F.col("first") + F.col("before") + 1)
    return joined.withColumn("number", number).drop("block", "at", "first", "before")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, number, value): every physical line with its number in its file."""
    scan = spark.read.text(paths).select(*split_key(), F.monotonically_increasing_id().alias("at"), "value")
    return numbered(scan)


def is_blank(record: str, sep: str) -> bool:
    """True where all cells are blank."""
    return all(not cell.strip() for row in csv.reader(record.split("\n"), delimiter=sep) for cell in row)


def _maybe_blank(values: pa.Array, sep: str) -> np.ndarray:
    """Lines of white space, separators and quotes only: the others are filled for sure."""
    return pc.match_substring_regex(values, r"^[\s\pZ\x{FEFF}" + QUOTE + re.escape(sep) + "]*$").to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Pieces of batches that lie in one split (the columns before the last tell), and whether a new split starts."""
    last = None
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), keys[a] != last
            last = keys[a]


def _split_facts(sep: str):
    """Per split: whether its quotes are odd in number, and for both ways of entering it (outside or inside quotes) its
    whole records that are not blank and whether a record starts in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def facts(key: tuple, quotes: list[np.ndarray], maybe: list[np.ndarray], texts: dict[int, str]) -> pa.RecordBatch:
            count, doubtful = np.concatenate(quotes), np.concatenate(maybe)
            running = np.cumsum(count)
            inside, odd, found = (running - count) & 1, bool(running[-1] & 1), []
            for enter in (0, 1):
                starts = np.flatnonzero(inside == enter)
                whole = starts if odd == bool(enter) else starts[:-1]
                ends = np.append(starts[1:], len(count))[:len(whole)]
                filled = np.concatenate([[0], np.cumsum(~doubtful)])
                unsure = np.flatnonzero(filled[ends] == filled[whole])
                blank = sum(is_blank("\n".join(texts[i] for i in range(whole[k], ends[k])), sep) for k in unsure.tolist())
                found += [len(whole) - blank, len(starts) > 0]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, odd, *found)], ["path", "block", "odd", "n0", "s0", "n1", "s1"])
        key, quotes, maybe, texts, at = None, [], [], {}, 0
        for piece, fresh in _runs(batches):
            if fresh and key is not None:
                yield facts(key, quotes, maybe, texts)
            if fresh:
                key, quotes, maybe, texts, at = (piece.column(0)[0].as_py(), piece.column(1)[0].as_py()), [], [], {}, 0
            values = piece.column(2)
            quotes.append(pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64))
            doubtful = _maybe_blank(values, sep)
            maybe.append(doubtful)
            texts |= {at + i: values[i].as_py() for i in np.flatnonzero(doubtful).tolist()}
            at += len(values)
        if key is not None:
            yield facts(key, quotes, maybe, texts)
    return run


def _split_records(sep: str):
    """Lines of splits (file, block, enter, value) to records: ``part`` 0 for a whole one with its place in the split,
    1 for the start of one that goes on in the next split, 2 for a later piece of one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, parity, place, entered = None, [], 0, 0, False

        def out(texts: list[str], part: int) -> pa.RecordBatch:
            nonlocal place
            kept = [t for t, b in zip(texts, _maybe_blank(pa.array(texts, pa.string()), sep)) if not (part == 0 and b and is_blank(t, sep))]
            places = range(place, place + len(kept)) if part == 0 else [None] * len(kept)
            place += len(kept) if part == 0 else 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(kept), pa.int64()), pa.array([key[1]] * len(kept), pa.int64()), pa.array([part] * len(kept), pa.int32()),
                                               pa.array(places, pa.int64()), pa.array(kept, pa.string())], ["file", "block", "part", "place", "record"])

        def ended() -> Iterator[pa.RecordBatch]:
            if key is not None and (held or entered):
                yield out(["\n".join(held)], 2 if entered else 1 if parity else 0)
        for piece, fresh in _runs(batches):
            if fresh:
                yield from ended()
                key, held, place = tuple(c[0].as_py() for c in piece.columns[:2]), [], 0
                parity = piece.column(2)[0].as_py()
                entered = parity == 1
            values = piece.column(3)
            count = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
            running = np.cumsum(count) + parity
            starts = np.flatnonzero((running - count) & 1 == 0)
            parity = int(running[-1] & 1)
            if not len(starts):
                held += values.to_pylist()
                continue
            held += values.slice(0, int(starts[0])).to_pylist()
            if held or entered:
                yield out(["\n".join(held)], 2 if entered else 0)
                entered = False
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
            if len(lists):
                yield out(pc.binary_join(lists.cast(pa.list_(pa.string())), "\n").to_pylist(), 0)
            held = values.slice(int(starts[-1])).to_pylist()
        yield from ended()
    return run


def quoted_records(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """(path, place, record): the records of delimited files whose quoted cells may hold line breaks, blank ones left out.

    Whether a line starts inside quotes follows from the number of quotes before it in the file, so a file is read in
    splits: one pass tells how many quotes each split has, a parity over the splits before tells how each is entered, and
    only the pieces of a record that crosses a split are brought together. ``place`` counts a file's records from 0 up.
    Line ends are LF or CR LF.
    """
    scan = spark.read.option("lineSep", "\n").text(paths).select(*split_key(), F.monotonically_increasing_id().alias("at"), "value")
    facts = written(scan.drop("at").mapInArrow(_split_facts(sep), "path string, block long, odd boolean, n0 long, s0 boolean, n1 long, s1 boolean"), "quotes")
    entered = facts.withColumn("quotes", F.col("odd").cast("int")).withColumn("enter", (before_each("quotes") % 2).cast("int"))
    inside = F.col("enter") == 1
    goes_on = F.when(inside, F.col("s1") & ~F.col("odd")).otherwise(F.col("s0") & F.col("odd"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(entered.select("path", "block", "enter", F.when(inside, F.col("n1")).otherwise(F.col("n0")).alias("n"), F.xxhash64("path").alias("file"),
                                    F.last(F.when(goes_on, F.col("block")), ignorenulls=True).over(earlier).alias("begun")), "entered")
    # a join may change the order of rows, whichever side Spark broadcasts
    read = scan.join(placed.select("path", "block", "enter", "file"), ["path", "block"]).sortWithinPartitions("file", "block", "at").select("file", "block", "enter", "value")
    records = read.mapInArrow(_split_records(sep), "file long, block long, part int, place long, record string")
    whole = records.filter("part = 0").select("file", "block", "place", "record")
    crossing = records.filter("part > 0").join(placed.select("file", "block", "begun"), ["file", "block"])
    pieces = crossing.select("file", F.when(F.col("part") == 1, F.col("block")).otherwise(F.col("begun")).alias("begun"), "block", "record")
    glued = pieces.groupBy("file", F.col("begun").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"))
    glued = written(glued.filter(~F.col("record").rlike(rf"^[\s\pZ{BOM}{QUOTE}\Q{sep}\E]*$")), "crossing")
    more = placed.select("path", "file", "block", "n").join(glued.select("file", "block", F.lit(1).alias("crossing")), ["file", "block"], "left")
    offsets = written(more.withColumn("all", F.col("n") + F.coalesce("crossing", F.lit(0))).select("path", "file", "block", "n", before_each("all").alias("before")), "offsets")
    last = glued.join(offsets.select("file", "block", "n"), ["file", "block"]).select("file", "block", F.col("n").alias("place"), "record")
    found = whole.unionByName(last).join(offsets.select("path", "file", "block", "before"), ["file", "block"])
    place = F.col("place") + F.col("before")
    clean = F.regexp_replace(F.col("record"), "\r$", "")
    return found.select("path", place.alias("place"), F.when(place == 0, F.regexp_replace(clean, f"^{BOM}", "")).otherwise(clean).alias("record"))
