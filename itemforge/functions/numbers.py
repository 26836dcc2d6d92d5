"""Rounding, number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_INTEGER = 9007199254740991
ISO_DATE_REGEX = r"^\d{4}-\d{2}-\d{2}([T\s]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
NUMBER_REGEX = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"


def round_half_up(c: Column, decimals: int) -> Column:
    """Half rounds toward plus infinity, also below zero."""
    scale = F.lit(float(10 ** decimals))
    return F.floor(c * scale + F.lit(0.5)) / scale


def round_pct(fraction: Column) -> Column:
    """Fraction to a percentage with one decimal."""
    return F.floor(fraction * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def round_delta(c: Column) -> Column:
    return round_half_up(c, 1)


def exact_mean(c: Column) -> Column:
    """Mean of one-decimal scores through an exact decimal sum, so row order never matters."""
    return F.sum(c.cast("decimal(28,6)")).cast("double") / F.count(c)


def number_text(c: Column) -> Column:
    """Number as text: no fraction for integral values, plain digits from 1e-6 up to 1e21, else an exponent like 1.5e-7."""
    d = c.cast("double")
    size, shortest = F.abs(d), d.cast("string")

    def plain(scale: int) -> Column:
        return F.regexp_replace(d.try_cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")
    power = F.replace(F.replace(F.replace(shortest, F.lit(".0E"), F.lit("E")), F.lit("E-"), F.lit("e-")), F.lit("E"), F.lit("e+"))
    return (F.when((d == F.floor(d)) & (size < 1e18), F.floor(d).cast("string"))
            .when(F.isnan(d) | (size == float("inf")), shortest)
            .when((size >= 1e21) | (size < 1e-6), power)
            .when(size >= 1e18, d.try_cast("decimal(38,0)").cast("string"))
            .when(size >= 1e7, plain(14)).when(size < 1e-3, plain(24)).otherwise(shortest))


def scalar_text(c: Column, kind: str) -> Column:
    """Scalar as text by its Spark type name; nested values become compact JSON."""
    if kind in ("double", "float"):
        out = number_text(c)
    elif kind.startswith(("struct", "array", "map")):
        out = F.to_json(c)
    elif kind == "timestamp":
        out = iso_text(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def is_finite(c: Column) -> Column:
    d = c.try_cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def is_safe_integer(c: Column) -> Column:
    d = c.try_cast("double")
    return F.coalesce(is_finite(c) & d.between(-SAFE_INTEGER, SAFE_INTEGER), F.lit(False))


def looks_iso(c: Column) -> Column:
    return c.rlike(ISO_DATE_REGEX)


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMBER_REGEX)


def parse_datetime(c: Column) -> Column:
    """Timestamp from ISO text first, then the other accepted layouts in order."""
    formats = ("MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "yyyy-MM")
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
