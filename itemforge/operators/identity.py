"""Identity items: typed properties straight from the source, nothing added but the three labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import names
from itemforge.functions import numbers as nm
from itemforge.functions import text as tx
from itemforge.functions.ids import UNIT
from itemforge.operators.profile import column_profile, inferred_type
from itemforge.operators.records import access_entries, capped

# Normalized column names that carry a label.
LABEL_SOURCES = {
    "title": ("title", "name", "headline", "subject", "displayname", "primaryname"),
    "url": ("url", "link", "permalink", "sourceurl", "canonicalurl"),
    "iconUrl": ("iconurl", "icon", "image", "imageurl", "thumbnail", "thumbnailurl"),
}
DEFAULT_ICON = "https://example.com/icons/generic_16x16.png"


@dataclass
class Property:
    """One row of a search schema."""

    name: str
    type: str
    is_searchable: bool | None = None
    is_queryable: bool | None = True
    is_retrievable: bool | None = True
    is_refinable: bool | None = None
    is_exact_match: bool | None = None
    labels: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)


PROPERTY_SCHEMA = ("source_id string, ordinal int, name string, type string, is_searchable boolean, "
                   "is_queryable boolean, is_retrievable boolean, is_refinable boolean, is_exact_match boolean, "
                   "labels array<string>, aliases array<string>")


def infer_types(df: DataFrame, header: list[str]) -> dict[str, str]:
    """Column types over every row. One row per header column comes back, never data rows."""
    rows = column_profile(df, header).select("column", inferred_type().alias("type")).collect()
    return {r["column"]: r["type"] for r in rows}


def label_source(header: list[str], label: str) -> str | None:
    """First column whose squeezed name is a known source of the label."""
    squeezed = ["".join(ch for ch in h.lower() if ch.isascii() and ch.isalnum()) for h in header]
    return next((h for h, s in zip(header, squeezed) if s in LABEL_SOURCES[label]), None)


def identity_names(header: list[str]) -> dict[str, str]:
    return dict(zip(header, names.unique_names([names.plain_base(h) for h in header], first_suffix=1)))


def identity_schema(header: list[str], types: dict[str, str]) -> list[Property]:
    """Property list in header order, then the labels no column could carry."""
    named = identity_names(header)
    out = []
    for h in header:
        last = h.lower().split(".")[-1]
        exact = last in ("id", "code", "key") or last.endswith(("_id", "_code", "_key"))
        out.append(Property(named[h], types[h], is_searchable=types[h] == "String" and not exact,
                            is_exact_match=True if exact else None))
    for label in LABEL_SOURCES:
        source = label_source(header, label)
        target = named[source] if source else label
        found = next((p for p in out if p.name == target), None)
        if found is None:
            out.append(Property(label, "String", is_searchable=label == "title", labels=[label]))
        elif label not in found.labels:
            found.labels.append(label)
    return out


def label_promotion(columns: DataFrame) -> DataFrame:
    """Data form of the label search: (source_id, ordinal, column) to the carrying column per label."""
    squeezed = tx.norm_key(F.col("column"))
    cases = F.lit(None).cast("string")
    for label, sources in LABEL_SOURCES.items():
        cases = F.when(squeezed.isin(*sources), label).otherwise(cases)
    return (columns.withColumn("label", cases).filter(F.col("label").isNotNull())
            .groupBy("source_id", "label").agg(F.min_by("column", "ordinal").alias("column")))


def coerced(value: Column, kind: str) -> Column:
    """Property text of one cell; null when the cell is blank."""
    t = tx.trimmed(value)
    if kind in ("Int64", "Double"):
        number = t.try_cast("double")
        whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string")
        t = F.when(nm.is_finite(t), whole if kind == "Int64" else nm.number_text(number)).otherwise(t)
    elif kind == "Boolean":
        t = F.when(F.lower(t).isin("true", "false"), F.lower(t)).otherwise(t)
    return F.when(t != "", t)


def flat_json(header: list[str]) -> Column:
    """Row as a JSON object in header order, blanks kept."""
    return F.to_json(F.struct(*[tx.text_or_blank(F.col(f"`{h}`")).alias(h) for h in header]))


def identity_items(df: DataFrame, header: list[str], types: dict[str, str] | None = None, *, url_prefix: str = "",
                   access: str = "everyone", icon: str = DEFAULT_ICON) -> DataFrame:
    """One item per row with typed properties; title, url and icon fall back when the source has none."""
    types = types or infer_types(df, header)
    named = identity_names(header)
    values = {h: coerced(tx.text_or_blank(F.col(f"`{h}`")), types[h]) for h in header}
    file, row = F.col("source_file"), F.col("source_row").cast("string")

    def filled(h: str) -> Column:
        v = values[h]
        if types[h] in ("Int64", "Double"):
            return v.isNotNull() & (v != "0")
        return v.isNotNull() & (v != "false") if types[h] == "Boolean" else v.isNotNull()
    if url_prefix:
        place = F.concat(F.lit(url_prefix.removesuffix("/") + "/"), tx.percent_encode(file), F.lit("#row-"), row)
    else:
        place = F.concat(F.lit("file:///raw/"), file, F.lit("#row-"), row)
    fallback = {"title": F.concat(file, F.lit(" row "), row), "url": place, "iconUrl": F.lit(icon)}
    by_name = {named[h]: h for h in header}
    labels, from_source = {}, {}
    for label in LABEL_SOURCES:
        source = label_source(header, label)
        has = filled(source) if source else F.lit(False)
        own = values[by_name[label]] if label in by_name else F.lit(None).cast("string")
        labels[label] = F.when(has, F.coalesce(own, values[source]) if source else own).otherwise(fallback[label])
        from_source[label] = F.coalesce(has, F.lit(False))
    entries = [F.struct(F.lit(named[h]).alias("key"), values[h].alias("value")) for h in header if named[h] not in labels]
    entries += [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in labels.items()]
    props = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    content = F.concat_ws("\n", *[F.concat(F.lit(f"{h}: "), tx.text_or_blank(F.col(f"`{h}`"))) for h in header])
    key = F.concat(file, F.lit(UNIT), row, F.lit(UNIT), flat_json(header))
    return (df.withColumn("_content", content).select(
        F.substring(F.sha2(key, 256), 1, 32).alias("id"), labels["title"].alias("title"), labels["url"].alias("url"),
        labels["iconUrl"].alias("icon_url"), "source_file", F.col("source_row").cast("long").alias("source_row"),
        props.alias("properties"), capped(F.col("_content")).alias("content"),
        from_source["title"].alias("title_from_source"), from_source["url"].alias("url_from_source"),
        from_source["iconUrl"].alias("icon_from_source"), access_entries(access).alias("acl")))


def provenance(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of items whose labels came from the source, three decimals."""
    def share(flag: str) -> Column:
        return nm.round_half_up(F.sum(F.col(flag).cast("long")).cast("double") / F.count(F.lit(1)), 3)
    return items.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("items"), share("title_from_source").alias("title_share"),
        share("url_from_source").alias("url_share"), share("icon_from_source").alias("icon_share"))
