"""Long-format indicator tables to one item per (entity, year, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.config import EnrichConfig
from itemforge.functions import ids
from itemforge.functions import text as tx
from itemforge.operators.ordinals import first_n
from itemforge.operators.records import CONTENT_LIMIT, access_entries, capped, item_properties, record_items, with_roles

GROUP = ["entity_name", "role_year", "iso_code"]
# Every listed line has at least five characters, so this many lines always pass the content limit
# and the lines after them can only change the reported length, which is summed separately.
PREFIX_LINES = CONTENT_LIMIT // 5 + 200


def indicator_rows(df: DataFrame, header: list[str], config: EnrichConfig) -> DataFrame:
    """Filled indicator values with their group, field name and listing line."""
    li = config.long_columns
    roles = with_roles(df, header, config).filter((F.col("entity_name") != "") & (F.col("role_year") != ""))
    ind, name = tx.text_or_blank(F.col(f"`{li['id']}`")), tx.text_or_blank(F.col(f"`{li['name']}`"))
    value = F.col(f"`{li['value']}`")
    field = F.when(ind != "", F.concat(ind, F.lit(" value"))).otherwise(name)
    label = (F.when((ind != "") & (name != ""), F.concat(ind, F.lit(" ("), name, F.lit(")")))
             .when(name != "", name).otherwise(F.lit(li["value"])))
    line = F.concat(F.lit("- "), label, F.lit(": "), tx.trimmed(value))
    return (roles.filter(~tx.is_empty(value))
            .select(*GROUP, "source_file", "source_row", ind.alias("indicator"), field.alias("field"),
                    value.alias("value"), line.alias("line")))


def group_sources(df: DataFrame, header: list[str], config: EnrichConfig) -> DataFrame:
    """Sorted distinct files per group; rows without a value still count as a source."""
    roles = with_roles(df, header, config).filter((F.col("entity_name") != "") & (F.col("role_year") != ""))
    files = roles.select(*GROUP, "source_file").distinct()
    return files.groupBy(*GROUP).agg(F.sort_array(F.collect_list("source_file")).alias("files"))


def grouped_fields(rows: DataFrame) -> DataFrame:
    """One row per group and field: last value wins, the first sighting fixes the place."""
    place = F.struct("indicator", "source_file", "source_row")
    return rows.groupBy(*GROUP, "field").agg(F.max_by("value", place).alias("value"), F.min(place).alias("place"))


def grouped_items(df: DataFrame, header: list[str], config: EnrichConfig, *, questions: DataFrame | None = None,
                  eval_counts: dict[str, int] | None = None, url_prefix: str = "",
                  access: str = "everyone") -> DataFrame:
    """Grouped items. A hot group is never gathered whole: its fields and lines are first ranked and cut
    to what the content limit can show, and full lengths are plain sums."""
    li, counts = config.long_columns, eval_counts or {}
    rows = indicator_rows(df, header, config)
    fields, place = grouped_fields(rows), F.struct("indicator", "source_file", "source_row")
    key_names = list(dict.fromkeys(config.priority_fields)) + sorted((k for k in counts if k not in config.priority_fields),
                                                                     key=lambda k: (-counts[k], k))

    # lengths over everything
    field_len = fields.groupBy(*GROUP).agg(
        F.sum(F.length("field") + F.length("value") + 3).alias("raw_len"),
        F.sum(F.length("field") + F.length(tx.trimmed(F.col("value"))) + 5).alias("fact_len"),
        F.count_if(~F.col("field").isin(*key_names) if key_names else F.lit(True)).alias("plain_fields"))
    line_len = rows.groupBy(*GROUP).agg((F.sum(F.length("line") + 1) - 1).alias("lines_len"))
    # the shown prefix
    head_fields = (first_n(fields, GROUP, [F.col("place")], PREFIX_LINES).groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.struct("place", "field", "value"))).alias("fields")))
    head_lines = (first_n(rows.withColumn("place", place), GROUP, [F.col("place")], PREFIX_LINES).groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines")))
    joined = (field_len.join(line_len, GROUP).join(head_fields, GROUP).join(head_lines, GROUP)
              .join(group_sources(df, header, config), GROUP))
    entity, year, iso = (F.col(c) for c in GROUP)
    files = F.array_join("files", ", ")
    title = F.concat(entity, F.lit(" ("), year, F.lit(") — "), F.lit(li["label"] or "grouped long-format values"))

    roles = [(li["entity"], entity), (li["year"], year)] + ([(li["iso"], iso)] if li.get("iso") else [])
    fixed = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in roles])
    known = F.filter(fixed, lambda f: ~tx.is_empty(f["value"]))
    shown = F.concat(known, F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"))))

    def fact(f: Column) -> Column:
        return F.concat(F.lit("- "), f["field"], F.lit(": "), tx.trimmed(f["value"]))

    raw = F.array_join(F.transform(shown, lambda f: F.concat(f["field"], F.lit(": "), f["value"])), "\n")
    if key_names:
        key_list = F.array(*[F.lit(k) for k in key_names])
        key_facts = F.flatten(F.transform(key_list, lambda k: F.transform(F.filter(shown, lambda f: f["field"] == k), fact)))
        rest = F.transform(F.filter(shown, lambda f: ~f["field"].isin(*key_names)), fact)
    else:
        key_facts, rest = F.array().cast("array<string>"), F.transform(shown, fact)
    key_block = F.when(F.size(key_facts) > 0, F.array_join(key_facts, "\n"))
    rest_block = F.when(F.size(rest) > 0, F.concat(F.lit("\nAll populated fields:\n"), F.array_join(rest, "\n")))
    absent = [F.when(tx.is_empty(v), F.lit(n)) for n, v in roles if n in key_names]
    absent_block = (F.when(F.concat_ws(", ", *absent) != "", F.concat(
        F.lit("\nImportant fields with no value in this row:\n- "), F.concat_ws(", ", *absent)))
        if absent else F.lit(None).cast("string"))
    asked = F.lit(None).cast("string")
    if questions is not None:
        keyed = questions.select(F.col("entity").alias("_e"), F.col("year").alias("_y"), "ordinal", "prompt")
        top = first_n(keyed, ["_e", "_y"], [F.asc("ordinal")], 8).groupBy("_e", "_y").agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "prompt"))).alias("asked"))
        joined = joined.join(top, (tx.norm_value(entity) == F.col("_e")) & (tx.norm_value(year) == F.col("_y")), "left")
        listed = F.array_join(F.transform(F.filter("asked", lambda q: q["prompt"] != ""), lambda q: F.concat(F.lit("- "), q["prompt"])), "\n")
        asked = F.when(F.size("asked") > 0, F.concat_ws("\n", F.lit("\nExample questions this record can answer:"), F.when(listed != "", listed)))
    body = F.concat_ws("\n", title, F.lit("\nRaw fields:"), raw, F.lit("\nKey facts:"), key_block, rest_block, absent_block, asked)
    content = F.concat(body, F.lit("\n\nGrouped values:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))

    # what the cut arrays leave out of the text still counts in its length
    shown_fields = F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + 2 * F.length(f["field"]) + F.length(f["value"]) + F.length(tx.trimmed(f["value"])) + 8)
    shown_lines = F.aggregate("lines", F.lit(-1).cast("long"), lambda a, x: a + F.length(x["line"]) + 1)
    hidden = F.col("raw_len") + F.col("fact_len") - shown_fields + F.col("lines_len") - shown_lines
    core = {"url": ids.grouped_url(entity, year, iso, tx.first_of(F.col("files")), url_prefix), "sourceFile": files,
            "entityName": entity, "year": year, "isoCode": iso}
    return (joined.withColumn("_content", content)
            .select(ids.stable_id("indicator-group", files, entity, year, iso if li.get("iso") else F.lit("")).alias("id"),
                    F.lit("grouped-record").alias("item_type"), title.alias("title"), core["url"].alias("url"),
                    files.alias("source_file"), entity.alias("entity_name"), year.alias("year"), iso.alias("iso_code"),
                    item_properties(title, "grouped-record", core).alias("properties"),
                    capped(F.col("_content"), F.length("_content") + hidden).alias("content"),
                    access_entries(access).alias("acl")))


def long_items(df: DataFrame, header: list[str], config: EnrichConfig, mode: str = "grouped", **options) -> DataFrame:
    """``grouped``, ``row`` or ``both`` item forms of a long table; other tables give plain records."""
    if mode == "row" or not config.is_long_table(header):
        return record_items(df, header, config, **options)
    grouped = grouped_items(df, header, config, **options)
    if mode == "grouped":
        return grouped
    return grouped.unionByName(record_items(df, header, config, **options).drop("full_content"), allowMissingColumns=True)
