"""Crawl-time mapping of raw records to items by a registered schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import numbers as nm
from itemforge.functions import text as tx
from itemforge.operators.identity import DEFAULT_ICON, Property
from itemforge.operators.records import access_entries

MAX_ITEM_BYTES = 4 * 1024 * 1024

# Raw columns tried in turn when the schema column itself is missing.
TITLE_CHAIN = ("title", "primaryName", "name", "companyName", "organizationName", "duns", "id")
URL_CHAIN = ("url", "sourceUrl", "link")
ICON_CHAIN = ("iconUrl", "icon", "imageUrl")
ID_CHAIN = ("duns", "DUNS", "recordId", "recordID", "id", "ID", "primaryName", "name")

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def coerce_value(value: Column, raw_type: str, target: str) -> Column:
    """Text of one property value; null when it cannot be coerced."""
    text = nm.scalar_text(value, raw_type)
    numeric = raw_type in _NUMERIC or raw_type.startswith("decimal")
    if target == "Int64":
        number = value.cast("double") if numeric else F.regexp_extract(tx.trimmed(text), r"^([+-]?\d+)", 1).try_cast("double")
        out = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string")
    elif target == "Double":
        number = value.cast("double") if numeric else F.regexp_extract(
            tx.trimmed(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
        out = nm.number_text(number)
    elif target == "Boolean":
        out = F.when(F.lower(text) == "true", "true").otherwise("false")
    elif target == "DateTime":
        out = nm.iso_text(F.timestamp_millis(value.cast("long"))) if numeric else text
    else:
        out = text
    return F.when(value.isNotNull(), out)


def _first(raw: DataFrame, keys: tuple[str, ...], kinds: dict[str, str]) -> Column:
    found = [F.when(tx.trimmed(nm.scalar_text(F.col(f"`{k}`"), kinds[k])) != "", nm.scalar_text(F.col(f"`{k}`"), kinds[k]))
             for k in keys if k in kinds]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def runtime_items(raw: DataFrame, schema: list[Property], *, access: str = "everyone", icon: str = DEFAULT_ICON,
                  property_hook: Callable[[dict[str, Column]], dict[str, Column]] | None = None,
                  content_hook: Callable[[Column], Column] | None = None,
                  access_hook: Callable[[DataFrame], Column] | None = None, carry: list[str] = ()) -> DataFrame:
    """Map raw columns to schema properties, build the content text and flag rows that must not be written.

    Columns to ``carry`` go along as they are and are no content.

    The hooks work on columns, so custom mappings stay inside the same plan.
    """
    kinds = dict(raw.dtypes)
    key = F.col("id").cast("string") if "id" in kinds else F.lit(None).cast("string")
    props: dict[str, Column] = {}
    for p in schema:
        options = [coerce_value(F.col(f"`{c}`"), kinds[c], p.type) for c in (p.name, *p.aliases) if c in kinds]
        if p.name == "title":
            options.append(_first(raw, TITLE_CHAIN, kinds))
        elif p.name == "url":
            options.append(_first(raw, URL_CHAIN, kinds))
            options.append(F.concat(F.lit("file:///external-items/"), tx.percent_encode(key)))
        elif p.name == "iconUrl":
            options += [_first(raw, ICON_CHAIN, kinds), F.lit(icon)]
        if options:
            props[p.name] = F.coalesce(*options)
    if property_hook:
        props = property_hook(props)
    lines = [F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in props.items()]
    for c, kind in kinds.items():
        if c == "id" or c in carry or kind.startswith(("struct", "array", "map")):
            continue
        text = nm.scalar_text(F.col(f"`{c}`"), kind)
        unmapped = props[c].isNull() if c in props else F.lit(True)
        lines.append(F.when(unmapped & (text != ""), F.concat(F.lit(f"{c}: "), text)))
    content = F.concat_ws("\n", *lines)
    if content_hook:
        content = content_hook(content)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in props.items()])
    acl = access_hook(raw) if access_hook else access_entries(access)
    built = raw.select(key.alias("id"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("properties"),
                       content.alias("content"), acl.alias("acl"), *[F.col(f"`{c}`") for c in carry])
    size = F.octet_length(F.to_json(F.struct("id", "acl", "properties", "content")))
    error = (F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("missing id"))
             .when(size > MAX_ITEM_BYTES, F.concat(F.lit("item exceeds 4 MB ("), size.cast("string"), F.lit(" bytes)"))))
    return built.withColumns({"size_bytes": size, "error": error})


def split_failures(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writable, failed); failed rows are never written."""
    return items.filter(F.col("error").isNull()), items.filter(F.col("error").isNotNull())
