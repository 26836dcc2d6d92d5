"""File statistics, column profiles and type inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import numbers as nm
from itemforge.functions import text as tx
from itemforge.functions.names import keeps_text
from itemforge.operators.ordinals import first_n


def file_stats(df: DataFrame, header: list[str]) -> DataFrame:
    """Row count and, per column, filled count and first filled row. One aggregate, no wide shuffle."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, f in enumerate(header):
        filled = ~tx.is_empty(F.col(f"`{f}`"))
        aggs += [F.count_if(filled).alias(f"_n{i}"), F.min(F.when(filled, F.col("source_row"))).alias(f"_f{i}")]
    wide = df.groupBy("source_file").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("column"),
                              F.col(f"_n{i}").alias("filled"), F.col(f"_f{i}").alias("first_row"))
                     for i, f in enumerate(header)])
    return wide.select("source_file", "row_count", F.inline(rows))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and first row of each non-blank value per file."""
    return (df.filter(F.col(column) != "").groupBy("source_file", column)
            .agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("first_row")))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """``k`` most frequent values per file; equal counts keep first-seen order."""
    return first_n(value_counts(df, column), ["source_file"], [F.desc("n"), F.asc("first_row")], k)


def year_span(df: DataFrame, column: str) -> DataFrame:
    """Distinct years with the first and last by (length, text)."""
    distinct = df.filter(F.col(column) != "").select("source_file", column).distinct()
    key = F.struct(F.length(column).alias("n"), F.col(column).alias("y"))
    return (distinct.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("year_count"), F.min(key)["y"].alias("first_year"), F.max(key)["y"].alias("last_year")))


def field_weights(*counts: DataFrame, k: int = 80) -> DataFrame:
    """Summed weight per field over (field, weight, ordinal) tables; top ``k``, first seen first."""
    merged = counts[0]
    for other in counts[1:]:
        merged = merged.unionByName(other)
    return (merged.groupBy("field").agg(F.sum("weight").alias("weight"), F.min("ordinal").alias("ordinal"))
            .orderBy(F.desc("weight"), F.asc("ordinal")).limit(k))


def unpivot(df: DataFrame, header: list[str], keep: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("column"),
                               tx.text_or_blank(F.col(f"`{f}`").cast("string")).alias("value"))
                      for i, f in enumerate(header)])
    return df.select(*keep, F.inline(cells))


def _observations(value: Column) -> dict[str, Column]:
    v = tx.trimmed(value)
    numeric = nm.looks_numeric(v)
    boolean = v.rlike("(?i)^(true|false)$")
    return {
        "total": F.lit(True),
        "non_empty": v != "",
        "numeric_like": numeric,
        "float_like": numeric & F.contains(v, F.lit(".")),
        "scientific": numeric & v.rlike("[eE]"),
        "leading_zero": numeric & v.rlike(r"^0\d"),
        "unsafe_integer": numeric & ~nm.is_safe_integer(v),
        "boolean_like": boolean,
        "date_like": ~numeric & ~boolean & nm.looks_iso(v),
    }


OBSERVATIONS = ("total", "non_empty", "numeric_like", "float_like", "scientific", "leading_zero",
                "unsafe_integer", "boolean_like", "date_like")


def column_profile(df: DataFrame, header: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts that decide each column's type, over every row. Aggregates wide first, so one row per
    source and task is shuffled instead of one row per cell."""
    by = by or []
    aggs = []
    for i, f in enumerate(header):
        seen = _observations(tx.text_or_blank(F.col(f"`{f}`").cast("string")))
        aggs += [F.count_if(seen[name]).alias(f"_{name}{i}") for name in OBSERVATIONS]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("column"),
                              *[F.col(f"_{name}{i}").alias(name) for name in OBSERVATIONS])
                     for i, f in enumerate(header)])
    return wide.select(*by, F.inline(rows))


def entry_profile(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Same profile for (column, value) rows whose columns are only known from the data."""
    by = by or []
    seen = _observations(tx.text_or_blank(F.col("value")))
    return entries.groupBy(*by, "column").agg(*[F.count_if(seen[name]).alias(name) for name in OBSERVATIONS])


def inferred_type(column: Column | None = None) -> Column:
    name = F.col("column") if column is None else column
    c = F.col
    return (F.when(keeps_text(name), "String")
            .when((c("leading_zero") > 0) | (c("unsafe_integer") > 0) | (c("scientific") > 0), "String")
            .when(c("non_empty") == 0, "String")
            .when((c("numeric_like") == c("non_empty")) & (c("float_like") > 0), "Double")
            .when(c("numeric_like") == c("non_empty"), "Int64")
            .when(c("date_like") == c("non_empty"), "DateTime")
            .when(c("boolean_like") == c("non_empty"), "Boolean")
            .otherwise("String"))


def batch_summary(items: DataFrame, issues: DataFrame, done: DataFrame) -> DataFrame:
    """One line per dataset not yet done: items, errors, warnings and a status."""
    found = issues.groupBy("source_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    counted = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("items"))
    zero = F.lit(0).cast("long")
    joined = counted.join(done.select("source_id"), "source_id", "left_anti").join(found, "source_id", "left")
    errors = F.coalesce("errors", zero)
    return joined.select("source_id", "items", errors.alias("errors"), F.coalesce("warnings", zero).alias("warnings"),
                         F.when(errors > 0, "failed").otherwise("completed").alias("status"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once (file base names, header names)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
