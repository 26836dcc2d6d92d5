"""Writers for items, tables and reports. Each one is a plain distributed write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators.ordinals import last_wins
from itemforge.operators.records import flat_table


def item_json(items: DataFrame) -> Column:
    """One item as a JSON object; the access list is left out when empty."""
    content = F.struct(F.lit("text").alias("type"), F.col("content").alias("value"))
    acl = F.when(F.size("acl") > 0, F.col("acl"))
    return F.to_json(F.struct(F.col("id"), F.col("properties"), content.alias("content"), acl.alias("acl")))


def write_items(items: DataFrame, path: str) -> None:
    items.select(item_json(items).alias("value")).write.mode("overwrite").text(path)


def write_flat_table(items: DataFrame, path: str) -> None:
    (flat_table(items).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))


def write_schema(props: DataFrame, path: str) -> None:
    """Property tables are a few rows per source, so each source is one file."""
    props.repartition("source_id").sortWithinPartitions("ordinal").write.mode("overwrite").partitionBy("source_id").json(path)


def source_mappings(props: DataFrame) -> DataFrame:
    """Which source column fills which property."""
    return props.filter("field is not null").select("source_id", F.col("field").alias("source_field"),
                                                    F.col("name").alias("schema_property"), "display_name")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def eval_prompts(evals: DataFrame) -> DataFrame:
    return evals.select("prompt", "expected_answer", "source_location", F.lit("").alias("actual_answer"))


def eval_review(evals: DataFrame) -> DataFrame:
    """Review text per item."""
    return evals.select("ordinal", F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col("ordinal").cast("string"), F.lit(". "), F.col("prompt")), F.lit(""), "expected_answer",
        F.lit(""), F.concat(F.lit("Source: "), F.col("source_location")), F.lit("")).alias("review"))


def write_eval_set(evals: DataFrame, path: str) -> None:
    quoted = {"header": "true", "quote": '"', "escape": '"', "emptyValue": ""}
    eval_prompts(evals).write.mode("overwrite").options(**quoted).csv(f"{path}/prompts")
    evals.write.mode("overwrite").json(f"{path}/items")
    eval_review(evals).orderBy("ordinal").select(F.col("review").alias("value")).write.mode("overwrite").text(f"{path}/review")


def _num(c: str) -> Column:
    from itemforge.functions.numbers import number_text
    return number_text(F.col(c))


def report_markdown(report: DataFrame) -> DataFrame:
    """Readable lines per run report."""
    return report.select("run_id", F.concat_ws(
        "\n", F.lit("# Answer scoring\n"), F.concat(F.lit("- run: `"), F.col("run_id").cast("string"), F.lit("`")),
        F.concat(F.lit("- prompts: "), F.col("prompts").cast("string"), F.lit(" (valid "), F.col("valid_prompts").cast("string"), F.lit(")")),
        F.lit("\n## Aggregates\n"), F.concat(F.lit("- Deterministic average: "), _num("deterministic_avg")),
        F.concat(F.lit("- Semantic average: "), _num("semantic_avg")), F.concat(F.lit("- Citation rate: "), _num("citation_rate")),
        F.concat(F.lit("- Retries: "), F.col("retry_count").cast("string"), F.lit(", rate-limited: "),
                 F.col("rate_limit_count").cast("string"))).alias("markdown"))


def agent_markdown(summary: DataFrame) -> DataFrame:
    """One table line per agent summary."""
    return summary.select("agent", F.concat(
        F.lit("| "), F.col("agent"), F.lit(" | "), _num("avg_grounding"), F.lit("% | "), _num("avg_overlap"), F.lit("% | "),
        F.col("assertions_passed").cast("string"), F.lit("/"), F.col("assertions_total").cast("string"), F.lit(" | "),
        _num("fact_rate"), F.lit("% | "), F.col("pass_count").cast("string"), F.lit(" | "), F.col("partial_count").cast("string"),
        F.lit(" | "), F.col("fail_count").cast("string"), F.lit(" |")).alias("line"))


def comparison_markdown(pairs: DataFrame, deltas: DataFrame) -> DataFrame:
    joined = pairs.join(deltas, ["run_a", "run_b"], "left")
    return joined.select("run_a", "run_b", F.concat_ws(
        "\n", F.lit("# Comparison report\n"), F.concat(F.lit("- comparable: **"), F.col("comparable").cast("string"), F.lit("**")),
        F.concat(F.lit("- semanticComparable: **"), F.col("semantic_comparable").cast("string"), F.lit("**")),
        F.when(F.col("reasons") != "", F.concat(F.lit("\n## Diagnostics\n\n- "), F.col("reasons"))),
        *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- `{c}`: "), F.col(c).cast("string")))
          for c in deltas.columns if c.endswith("_delta")]).alias("markdown"))


def score_matrix(questions: DataFrame) -> DataFrame:
    """Ten text columns per question, blank where a side is missing."""
    def text(c: str) -> Column:
        return F.coalesce(_num(c), F.lit(""))
    return questions.select(
        "id", "prompt", text("a_score").alias("enhanced_deterministic"), text("a_semantic").alias("enhanced_semantic"),
        F.coalesce("a_status", F.lit("")).alias("enhanced_status"), text("b_score").alias("nonenhanced_deterministic"),
        text("b_semantic").alias("nonenhanced_semantic"), F.coalesce("b_status", F.lit("")).alias("nonenhanced_status"),
        text("score_delta").alias("deterministic_delta"), text("semantic_delta").alias("semantic_delta"))


def write_score_matrix(questions: DataFrame, path: str) -> None:
    ordered = score_matrix(questions).orderBy(F.collate("id", "UNICODE"))
    ordered.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def upsert_batch(items: DataFrame, target: str, version: str, batch_id: int, order: str | None = None) -> None:
    """Write one batch of items to the table's log, under its own folder.

    The same batch written twice replaces itself, so the cost is the batch, never the table. Of rows with one id the last
    by the column ``order`` stays, which must come from the data (a file and a place in it), so that a retried task picks
    the same, and is not written; without one the rows' own values decide.
    """
    placed = items.withColumn("_order", F.col(order) if order else F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns])))
    latest = last_wins(placed.drop(order) if order else placed, ["id"], F.col("_order")).drop("_order")
    latest.write.mode("overwrite").parquet(f"{target}/log/version={version}/batch={batch_id:012d}")


def version_place(version: Column, batch: Column) -> Column:
    """Order of a batch: the numbers inside its version one by one (v9 before v10), the version as text, the batch."""
    numbers = F.transform(F.regexp_extract_all(version.cast("string"), F.lit("([0-9]+)")), lambda n: n.cast("decimal(38,0)"))
    return F.struct(numbers.alias("numbers"), version.cast("string").alias("version"), batch.cast("long").alias("batch"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders right below a path; none where it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    return sorted(n for n in names if not n.startswith(("_", ".")))


def _log_batches(spark: SparkSession, target: str) -> list[tuple[str, int]]:
    return [(v.split("=", 1)[1], int(b.split("=", 1)[1])) for v in _folders(spark, f"{target}/log") for b in _folders(spark, f"{target}/log/{v}")]


def _logged(spark: SparkSession, target: str, batches: list[tuple[str, int]]) -> DataFrame:
    read = spark.read.option("basePath", f"{target}/log").parquet(*[f"{target}/log/version={v}/batch={b:012d}" for v, b in batches])
    return read.withColumns({"version": F.col("version").cast("string"), "batch": F.col("batch").cast("long")})


def _table_parts(spark: SparkSession, target: str) -> tuple[DataFrame | None, list[tuple[str, int]]]:
    """The newest base (items with the version and batch that wrote them), and the batches it does not hold yet."""
    bases = _folders(spark, f"{target}/base")
    if not bases:
        return None, _log_batches(spark, target)
    newest = f"{target}/base/{bases[-1]}"
    held = {(r["version"], r["batch"]) for r in spark.read.parquet(f"{newest}/batches").collect()}  # one row a batch
    return spark.read.parquet(f"{newest}/items"), [b for b in _log_batches(spark, target) if b not in held]


def versioned_items(spark: SparkSession, target: str) -> DataFrame:
    """Current item per id with the version and batch that wrote it: the newest batch that holds the id."""
    base, open_ = _table_parts(spark, target)
    parts = [p for p in (base, _logged(spark, target, open_) if open_ else None) if p is not None]
    if not parts:
        raise ValueError(f"no batch was written to {target}")
    log = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return last_wins(log, ["id"], version_place(F.col("version"), F.col("batch")))


def latest_items(spark: SparkSession, target: str) -> DataFrame:
    return versioned_items(spark, target).drop("version", "batch")


def compact(spark: SparkSession, target: str) -> int:
    """Fold base and log into a new base; returns how many batches it took in.

    A base is sorted by id, its files hold one id range each. It is written under a hidden name and renamed when whole, so
    a reader sees the old base or the new one, and a run that breaks off changes nothing. Batches already held are left in
    the log; they are never read again, and one that is written anew brings the same rows.
    """
    base, open_ = _table_parts(spark, target)
    if not open_:
        return 0
    held = spark.createDataFrame(open_, "version string, batch long")
    bases = _folders(spark, f"{target}/base")
    if base is not None:
        held = held.unionByName(spark.read.parquet(f"{target}/base/{bases[-1]}/batches"))
    hidden, name = f"{target}/base/_{uuid.uuid4().hex}", f"{target}/base/n={len(bases):012d}"
    versioned_items(spark, target).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{hidden}/items")
    held.coalesce(1).write.parquet(f"{hidden}/batches")
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(hidden).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(hidden), path(name)):
        raise OSError(f"{name} could not be put in place")
    return len(open_)


def require_items(items: DataFrame, present: list[str], searched: list[str]) -> DataFrame:
    """Refuse an enrichment that wrote nothing."""
    if items.isEmpty():
        raise ValueError(f"no items written; extensions present: {sorted(present)}, searched: {sorted(searched)}")
    return items


def enrichment_report(items: DataFrame, skipped: DataFrame, evals: DataFrame, edges: DataFrame, gaps: DataFrame) -> DataFrame:
    """One-row run report. Each part is counted on its own and the counts meet as rows of one aggregate."""
    def counted(df: DataFrame, name: str, n: Column | None = None) -> DataFrame:
        return df.agg((F.count(F.lit(1)) if n is None else n).cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [counted(items, "items_written"), counted(items.select("source_file").distinct(), "files_processed"),
             counted(skipped, "files_skipped"), counted(evals, "eval_items"),
             counted(edges.select("eval_id").distinct(), "eval_items_matched"), counted(gaps, "eval_assertion_gaps")]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    names = ["items_written", "files_processed", "files_skipped", "eval_items", "eval_items_matched", "eval_assertion_gaps"]
    report = merged.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])
    return report.withColumn("eval_items_unmatched", F.col("eval_items") - F.col("eval_items_matched"))


def document_report(items: DataFrame, max_titles: int = 10) -> DataFrame:
    """Chunk count and the first distinct titles per document file."""
    titles = items.select("source_file", "content_type", "doc_title").distinct()
    from itemforge.operators.ordinals import first_n
    shown = first_n(titles, ["source_file"], [F.asc("doc_title")], max_titles).groupBy("source_file").agg(
        F.array_join(F.sort_array(F.collect_list("doc_title")), "; ").alias("titles"))
    counts = items.groupBy("source_file", "content_type").agg(F.count(F.lit(1)).alias("chunks"))
    return counts.join(shown, "source_file")
