"""Positions, stable top-k and last-wins picks that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(df: DataFrame, group: list[str], order: str, name: str = "ordinal", width: int = 1_000_000) -> DataFrame:
    """1-based position of each row inside its group by an integer ``order`` column.

    A group is cut into blocks of ``width`` consecutive order values. Only one block is ever sorted
    in one task; a small table of block counts supplies the offset, so a group that holds a third
    of all rows is numbered in parallel.
    """
    block = F.floor(F.col(order) / F.lit(width))
    cut = df.withColumn("_block", block)
    in_block = Window.partitionBy(*group, "_block").orderBy(order)
    numbered = cut.withColumn("_rank", F.row_number().over(in_block))
    running = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_block"]]
    on = keys[0]
    for key in keys[1:]:
        on = on & key
    return (numbered.alias("l").join(offsets.alias("r"), on)
            .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._before") + F.col("l._rank")).alias(name)))


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark cuts every task to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last row per key as a partial aggregate, so repeated keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return picked.select(*keys, "_last.*")


def first_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return picked.select(*keys, "_first.*")


def stride(df: DataFrame, ordinal: str, total: Column, max_rows: int) -> DataFrame:
    """Every n-th row by 1-based ordinal with n = ceil(total / max_rows); all rows when they fit."""
    step = F.greatest(F.lit(1), F.ceil(total / F.lit(max_rows)))
    return df.filter((F.col(ordinal) - 1) % step == 0)
