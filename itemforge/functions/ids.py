"""Stable identifiers and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.text import percent_encode, slug, text_or_blank, trimmed

UNIT = "\x1f"


def joined(*parts: Column) -> Column:
    """Parts joined by the unit separator; nulls count as blank so positions never shift."""
    return F.concat_ws(UNIT, *[text_or_blank(p.cast("string")) for p in parts])


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined(*parts), 256), 1, 24))


def short_hash(c: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def row_key(path: Column, iso: Column, entity: Column, year: Column, row: Column) -> Column:
    return joined(path, iso, entity, year, F.lit("row"), row)


def indicator_key(path: Column, indicator: Column, iso: Column, entity: Column, year: Column) -> Column:
    return joined(path, indicator, iso, entity, year)


def document_id(source: Column, title: Column, index: Column | None = None) -> Column:
    return stable_id("docsrc", source, F.lit("0") if index is None else index, title)


def chunk_id(source: Column, doc_id: Column, index: Column, section_path: Column) -> Column:
    return stable_id("doc", source, doc_id, index, section_path)


def item_url(path: Column, row: Column | None = None, prefix: str = "") -> Column:
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    if prefix:
        base = F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(unix, "^/", ""))
    else:
        base = F.concat(F.lit("file:///"), unix)
    return base if row is None else F.concat(base, F.lit("#row="), row.cast("string"))


def grouped_url(entity: Column, year: Column, iso: Column, primary: Column, prefix: str = "") -> Column:
    if not prefix:
        return item_url(primary)
    parts = F.concat_ws("/", *[F.when(p != "", percent_encode(p)) for p in (entity, year, iso)])
    return F.concat(F.lit(prefix.rstrip("/") + "/_grouped/"), F.when(parts == "", "unknown").otherwise(parts))


def document_url(path: Column, prefix: str = "", anchor: Column | None = None) -> Column:
    base = item_url(path, None, prefix)
    if anchor is None:
        return base
    tail = slug(anchor)
    return F.when(tail == "", base).otherwise(F.concat(base, F.lit("#"), tail))


def safe_raw_id(candidates: list[Column], source: Column, index: Column) -> Column:
    """First filled candidate made URL-safe; a hash of the place when none is filled or it is too long."""
    filled = F.coalesce(*[F.when(trimmed(c) != "", trimmed(c)) for c in candidates])
    cleaned = F.regexp_replace(F.regexp_replace(filled, r"[/?#&\\]+", "-"), "[^A-Za-z0-9._~-]+", "_")
    hashed = F.concat(F.lit("item-"), short_hash(filled, 24))
    placed = F.concat(F.lit("item-"), short_hash(joined(source, index), 24))
    return (F.when(filled.isNull(), placed)
            .when(F.length(cleaned) <= 120, cleaned).otherwise(hashed))
