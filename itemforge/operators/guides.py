"""Dataset guide items: what a file holds, in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.config import EnrichConfig
from itemforge.functions import ids
from itemforge.functions import text as tx
from itemforge.operators import profile
from itemforge.operators.records import access_entries, capped, item_properties, with_roles

# Closing advice of every guide.
_GUIDANCE = ("\nRetrieval guidance:\n"
             "- Use row records for exact entity/year lookups and multi-field metric questions.\n"
             "- Use this dataset guide for field meanings, abbreviations, units, and available columns.")


def dataset_guides(df: DataFrame, header: list[str], config: EnrichConfig | None = None, *,
                   questions: DataFrame | None = None, url_prefix: str = "", access: str = "everyone") -> DataFrame:
    """One guide per file from its statistics. Only per-file aggregates meet here, never rows."""
    config = config or EnrichConfig()
    roles = with_roles(df, header, config)
    stats = profile.file_stats(df, header).withColumn(
        "label", tx.humanize_field(F.col("column")))
    for name, label in config.field_aliases.items():
        stats = stats.withColumn("label", F.when(F.col("column") == name, F.lit(label)).otherwise(F.col("label")))
    line = F.concat(F.lit("- "), F.col("column"), F.lit(": "), F.col("label"), F.lit("; populated in "),
                    F.col("filled").cast("string"), F.lit(" row(s)"))
    per_file = stats.groupBy("source_file").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns"),
        F.array_sort(F.collect_list(F.struct(F.col("position"), line.alias("line")))).alias("glossary"),
        F.array_sort(F.collect_list(F.when(F.col("filled") > 0, F.struct(
            (-F.col("filled")).alias("k"), F.col("first_row"), F.col("position"), F.col("column"))))).alias("populated"))
    entities = (profile.top_values(roles, "entity_name", 8).groupBy("source_file").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("k"), F.col("first_row"), F.col("entity_name")))).alias("entities")))
    joined = (per_file.join(entities, "source_file", "left")
              .join(profile.year_span(roles, "role_year"), "source_file", "left"))
    file = F.col("source_file")
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: Dataset guide — "), file),
        F.concat(F.lit("Source file: "), file),
        F.concat(F.lit("Rows: "), F.col("row_count").cast("string")),
        F.concat(F.lit("Columns: "), F.col("columns").cast("string")),
        F.concat(F.lit("Common entities: "), F.array_join(F.transform("entities", lambda e: e["entity_name"]), ", ")),
        F.concat(F.lit("Year/date range: "), F.col("first_year"), F.lit(" to "), F.col("last_year")),
        F.lit("\nColumn glossary:"),
        F.array_join(F.transform("glossary", lambda g: g["line"]), "\n"),
        F.when(F.size("populated") > 0, F.concat(F.lit("\nMost populated fields:\n- "), F.array_join(
            F.transform(F.slice("populated", 1, 20), lambda p: p["column"]), ", "))),
        *([F.col("question_block")] if questions is not None else []),
        F.lit(_GUIDANCE))
    if questions is not None:
        listed = F.array_sort(F.collect_list(F.struct("ordinal", "prompt")))
        # at most eight prompts, read as a scalar subquery
        block = questions.orderBy("ordinal").limit(8).filter(F.col("prompt") != "").agg(
            F.when(F.count(F.lit(1)) > 0, F.concat(
                F.lit("\nRepresentative evaluation questions for this corpus:\n- "),
                F.array_join(F.transform(listed, lambda q: q["prompt"]), "\n- "))).alias("b"))
        joined = joined.withColumn("question_block", block.scalar())
    title = F.concat(F.lit("Dataset guide — "), file)
    url = ids.item_url(file, None, url_prefix)
    core = {"url": url, "sourceFile": file, "rowCount": F.col("row_count")}
    return joined.withColumn("full_content", content).select(
        ids.stable_id("dataset-guide", file).alias("id"), F.lit("dataset-guide").alias("item_type"),
        title.alias("title"), url.alias("url"), file.alias("source_file"), F.col("row_count"),
        item_properties(title, "dataset-guide", core).alias("properties"),
        capped(F.col("full_content")).alias("content"), F.col("full_content"), access_entries(access).alias("acl"))
