"""Dataset shape: which field sets occur, which fields hold prose, and what that recommends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import text as tx
from itemforge.functions.json_tree import parsed_json
from itemforge.operators.ordinals import first_n

# Thresholds of the verdict.
SAMPLE_PER_FILE, SAMPLE_TOTAL = 100, 1000
SINGLE_SHAPE_SHARE, BORDERLINE_SHARE = 0.9, 0.8
PROSE_SHARE, MIN_OBSERVATIONS = 0.5, 10


def schema_key(fields: Column) -> Column:
    return F.array_join(F.array_sort(fields), "\x00")


def table_samples(df: DataFrame, header: list[str]) -> DataFrame:
    """Rows of one table as sample records."""
    entries = F.array(*[F.struct(F.lit(h).alias("field"), tx.trimmed(tx.text_or_blank(F.col(f"`{h}`").cast("string"))).alias("value"))
                        for h in header])
    names = F.array_sort(F.array(*[F.lit(h) for h in header]))
    return df.select("source_id", "source_file", "ordinal", names.alias("fields"),
                     F.array_join(names, "\x00").alias("schema_key"), entries.alias("entries"))


def json_samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects as sample records; other lines are left out. Nested values give no text."""
    kept = lines.filter(F.col(column).rlike(r"^\s*\{") & parsed_json(F.col(column)).isNotNull())
    raw = F.map_entries(F.from_json(F.col(column), "map<string,string>"))
    names = F.json_object_keys(F.col(column))
    entries = F.transform(raw, lambda e: F.struct(e["key"].alias("field"), F.when(
        e["value"].rlike(r"^\s*[\[{]"), "").otherwise(tx.text_or_blank(e["value"])).alias("value")))
    return kept.select("source_id", "source_file", "ordinal", F.array_sort(names).alias("fields"),
                       schema_key(names).alias("schema_key"), entries.alias("entries"))


def text_samples(docs: DataFrame, column: str = "raw") -> DataFrame:
    """A document-like file as one record with a single ``content`` field."""
    entry = F.array(F.struct(F.lit("content").alias("field"), F.substring(column, 1, 2000).alias("value")))
    return docs.select("source_id", "source_file", F.lit(1).cast("long").alias("ordinal"),
                       F.array(F.lit("content")).alias("fields"), F.lit("content").alias("schema_key"), entry.alias("entries"))


def bounded_sample(samples: DataFrame, per_file: int = SAMPLE_PER_FILE, total: int = SAMPLE_TOTAL) -> DataFrame:
    """First rows of each file, then of all files in order. This is a sampling operator by intent;
    the verdict runs on all rows unless the caller samples first."""
    return first_n(samples, ["source_file"], [F.asc("ordinal")], per_file).orderBy("source_file", "ordinal").limit(total)


def schema_clusters(samples: DataFrame) -> DataFrame:
    """Record count, share and first sighting of each field set per source."""
    counted = samples.groupBy("source_id", "schema_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("source_file", "ordinal")).alias("first"),
        F.first("fields").alias("fields"))
    totals = counted.groupBy("source_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_schemas"))
    return counted.join(totals, "source_id").withColumn("share", F.col("n") / F.col("total"))


def dominant_schemas(clusters: DataFrame) -> DataFrame:
    """Largest field set per source; equal counts keep the first seen."""
    best = F.struct((-F.col("n")).alias("k"), F.col("first"))
    return clusters.groupBy("source_id").agg(
        F.min_by("schema_key", best).alias("schema_key"), F.min_by("fields", best).alias("dominant"),
        F.max("share").alias("share"), F.max("total").alias("records"), F.max("distinct_schemas").alias("distinct_schemas"))


def text_rich_fields(samples: DataFrame, dominant: DataFrame) -> DataFrame:
    """Fields of the dominant shape that mostly hold prose."""
    rows = samples.join(dominant.select("source_id", "schema_key"), ["source_id", "schema_key"], "left_semi")
    cells = rows.select("source_id", "source_file", "ordinal", F.inline("entries")).filter(F.col("value") != "")
    prose = tx.is_prose(F.col("value"))
    rank = F.struct(F.length("value").alias("n"), (-F.col("ordinal")).alias("o"))
    shown = F.when(F.length("value") > 120, F.concat(F.substring("value", 1, 120), F.lit("…"))).otherwise(F.col("value"))
    # flags first, so the aggregate only carries numbers and the short sample
    flagged = cells.select("source_id", "field", prose.alias("prose"), F.length("value").alias("len"), rank.alias("rank"), shown.alias("shown"))
    out = flagged.groupBy("source_id", "field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("prose").alias("prose_n"), F.sum("len").alias("len_sum"),
        F.max_by("shown", F.when(F.col("prose"), F.col("rank"))).alias("sample"))
    return out.filter((F.col("n") >= MIN_OBSERVATIONS) & (F.col("prose_n") / F.col("n") >= PROSE_SHARE)).select(
        "source_id", "field", "n", (F.col("prose_n") / F.col("n")).alias("prose_share"),
        (F.col("len_sum") / F.col("n")).alias("average_length"), "sample")


def verdict_of(records: Column, share: Column, rich: Column) -> Column:
    return (F.when(F.coalesce(records, F.lit(0)) == 0, "enhance").when(share < BORDERLINE_SHARE, "enhance")
            .when(share < SINGLE_SHAPE_SHARE, "tie").when(rich == 0, "tie").otherwise("identity"))


def shape_verdicts(samples: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One verdict per source; ``sources`` adds those without any record."""
    dominant = dominant_schemas(schema_clusters(samples))
    rich = text_rich_fields(samples, dominant)
    listed = rich.groupBy("source_id").agg(F.count(F.lit(1)).alias("rich"), F.array_sort(F.collect_list(F.struct(
        (-F.col("prose_share")).alias("k"), F.col("field"), F.col("average_length")))).alias("fields"))
    joined = dominant.join(listed, "source_id", "left")
    if sources is not None:
        joined = sources.select("source_id").distinct().join(joined, "source_id", "left")
    n, fields = F.col("distinct_schemas"), F.size("dominant")
    rich_n = F.coalesce("rich", F.lit(0).cast("long"))
    named = F.array_join(F.transform(F.slice("fields", 1, 3), lambda f: F.concat(
        f["field"], F.lit(" (prose "), F.format_string("%.0f", -f["k"] * 100), F.lit("%, avg "),
        F.format_string("%.0f", f["average_length"]), F.lit(" chars)"))), ", ")
    reason = F.when(F.col("records").isNull(), "no parseable records found; keeping enhancer default").otherwise(F.concat(
        F.lit("sampled "), F.col("records").cast("string"), F.lit(" records across "), n.cast("string"),
        F.lit(" distinct schema"), F.when(n == 1, "").otherwise("s"),
        F.lit("; dominant schema covers "), F.format_string("%.1f", F.col("share") * 100), F.lit("% ("),
        fields.cast("string"), F.lit(" field"), F.when(fields == 1, "").otherwise("s"), F.lit("); "),
        F.when(rich_n == 0, "no text-rich fields detected").otherwise(F.concat(F.lit("text-rich fields: "), named))))
    return joined.select("source_id", F.coalesce("records", F.lit(0).cast("long")).alias("records"),
                         F.coalesce(n, F.lit(0).cast("long")).alias("distinct_schemas"),
                         F.coalesce("share", F.lit(0.0)).alias("dominant_share"), rich_n.alias("text_rich_fields"),
                         verdict_of(F.col("records"), F.col("share"), rich_n).alias("recommendation"), reason.alias("reason"))
