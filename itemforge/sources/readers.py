"""Dataset discovery and scans. Every reader is a plain Spark scan; only file listings and headers are metadata."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import text as tx
from itemforge.functions.json_tree import is_json, parsed_json
from itemforge.sources import listing, splits

# Extensions, skipped folders and evaluation-set files.
DISCOVERED = ("csv", "tsv", "json", "jsonl", "xlsx", "xls", "docx", "pdf", "pptx", "txt", "md")
TABULAR = ("csv", "tsv")
SKIPPED_FOLDERS = ("evalset", "eval-set", "eval_set", "workspace", "node_modules", ".git")
SKIPPED_FOLDERS_SHORT = ("evalset", "workspace", "node_modules", ".git")
EVAL_FILE_REGEX = r"(?i)^eval[-_]?set"
DELIMITERS = (",", "\t", ";", "|")
BOM = chr(0xFEFF)


def discover(spark: SparkSession, root: str, extensions: list[str] | None = None, *, rule: str = "enrich",
             exclude: list[str] | None = None) -> DataFrame:
    """Files under ``root`` as (path, relative_path, ext, bytes), sorted.

    ``rule`` picks the exclusions: ``enrich`` (eval sets, workspaces, ``_`` folders), ``identity`` (fewer
    names, ``_`` files too), ``profile`` (none). Contents are not read; names that start with ``_`` or ``.`` are listed too.
    """
    files = listing.files_below(spark, root)
    rel = tx.relative_path(F.col("path"), re.sub("^file:/+", "/", root))
    named = files.select("path", rel.alias("relative_path"), tx.extension(F.col("path")).alias("ext"), "bytes")
    parts = F.split("relative_path", "/")
    folders, base = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    keep = F.lit(True)
    if rule == "enrich":
        keep = ~F.exists(folders, lambda p: p.startswith("_") | F.lower(p).isin(*SKIPPED_FOLDERS)) & ~base.rlike(EVAL_FILE_REGEX)
    elif rule == "identity":
        keep = ~F.exists(parts, lambda p: p.startswith("_") | F.lower(p).isin(*SKIPPED_FOLDERS_SHORT))
    if extensions:
        keep = keep & F.col("ext").isin(*[e.lower().lstrip(".") for e in extensions])
    for path in exclude or []:
        keep = keep & ~((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    return named.filter(keep).orderBy("path")


def extension_profile(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(*DISCOVERED)).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def default_extensions(files: DataFrame) -> list[str] | None:
    """``None`` keeps the tabular default; a list names the document kinds when no table is present."""
    present = sorted(r["ext"] for r in extension_profile(files).collect())  # at most one row per extension
    return None if not present or set(present) & set(TABULAR) else present


def read_lines(spark: SparkSession, paths: str | list[str], root: str = "") -> DataFrame:
    """(source_file, line, value): every physical line with its 1-based number inside the file."""
    found = splits.lines(spark, paths)
    value = F.when(F.col("number") == 1, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value"))
    return found.select(tx.relative_path(F.col("path"), root).alias("source_file") if root else F.col("path").alias("source_file"),
                        F.col("number").alias("line"), F.regexp_replace(value, "\r$", "").alias("value"))


def read_documents(spark: SparkSession, paths: str | list[str], root: str = "") -> DataFrame:
    """(source_file, raw): whole files without a byte-order mark; blank files are left out."""
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    scan = spark.read.option("wholetext", "true").text(paths)
    return scan.select((tx.relative_path(path, root) if root else path).alias("source_file"),
                       F.regexp_replace("value", f"^{BOM}", "").alias("raw")).filter(tx.trimmed(F.col("raw")) != "")


def delimiter_of(first_line: Column, path: Column) -> Column:
    """Delimiter giving most fields on the first line, earlier candidates winning ties."""
    bare = F.regexp_replace(first_line, '"(?:[^"]|"")*"', "q")
    counts = [F.size(F.split(bare, "\\Q" + d + "\\E", -1)) for d in DELIMITERS]
    best = F.greatest(*counts)
    pick = F.lit(DELIMITERS[-1])
    for d, n in reversed(list(zip(DELIMITERS[:-1], counts[:-1]))):
        pick = F.when(n == best, F.lit(d)).otherwise(pick)
    return F.when(best > 1, pick).when(tx.extension(path) == "tsv", "\t").otherwise(",")


def _headers(spark: SparkSession, paths: list[str]) -> list:
    """First line and delimiter per file; one short row per file comes back."""
    first = (spark.read.text(paths).select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"), "value").filter("b = 0")
        .groupBy("path").agg(F.min_by("value", "i").alias("head")))
    return first.withColumn("head", F.regexp_replace("head", f"^{BOM}|\r$", "")).withColumn(
        "delimiter", delimiter_of(F.col("head"), F.col("path"))).collect()


def header_names(names: list[str], blank_names: bool = False) -> list[str]:
    """Header cells; blank ones become ``column_n`` when asked."""
    return [n if n or not blank_names else f"column_{i + 1}" for i, n in enumerate(names)]


def keep_last_duplicates(names: list[str]) -> dict[str, int]:
    """Header name to the position that fills it: the last of equal names."""
    return {n: i for i, n in enumerate(names)}


def read_table(spark: SparkSession, paths: list[str], *, root: str = "", multi_line: bool = False, encoding: str = "UTF-8",
               blank_names: bool = False) -> list[tuple[list[str], DataFrame]]:
    """Delimited files grouped by delimiter and header: one (header, rows) pair per group.

    All cells are text, missing ones blank. ``multi_line`` follows quoted line breaks and drops rows of
    blank cells; otherwise one physical line is one row. Either way a file is read in splits.
    """
    if multi_line:
        return _quoted_tables(spark, paths, root, blank_names)
    groups: dict[tuple, list[str]] = {}
    for r in _headers(spark, paths):
        groups.setdefault((r["delimiter"], r["head"]), []).append(r["path"])
    out = []
    for (sep, head), members in groups.items():
        names = header_names(next(csv.reader([head], delimiter=sep), [""]), blank_names)
        scan = (spark.read.schema(_cell_schema(names)).option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", encoding)
                .option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", "false").csv(members))
        placed = scan.select(*splits.split_key(), F.monotonically_increasing_id().alias("at"), *_cells(names, lambda i: F.col(f"c{i}")))
        out.append((list(keep_last_duplicates(names)), _rows(splits.numbered(placed), "number", names, root)))
    return out


def _cell_schema(names: list[str]) -> str:
    return ", ".join(f"c{i} string" for i in range(len(names)))


def _cells(names: list[str], cell) -> list[Column]:
    """One column per header name, filled by the last cell of that name; missing cells are blank."""
    return [tx.text_or_blank(cell(i)).alias(n) for n, i in keep_last_duplicates(names).items()]


def _rows(found: DataFrame, number: str, names: list[str], root: str) -> DataFrame:
    path = F.col("path")
    return found.select((tx.relative_path(path, root) if root else path).alias("source_file"), F.col(number).alias("source_row"), *[F.col(f"`{n}`") for n in keep_last_duplicates(names)])


def _quoted_tables(spark: SparkSession, paths: list[str], root: str, blank_names: bool) -> list[tuple[list[str], DataFrame]]:
    out = []
    for sep, members in ((",", [p for p in paths if not p.lower().endswith(".tsv")]), ("\t", [p for p in paths if p.lower().endswith(".tsv")])):
        if not members:
            continue
        records, groups = splits.quoted_records(spark, members, sep), {}
        for r in records.filter("place = 0").collect():  # one header a file
            groups.setdefault(r["record"], []).append(r["path"])
        for head, of_group in groups.items():
            names = header_names(next(csv.reader(io.StringIO(head), delimiter=sep)), blank_names)
            parsed = records.filter((F.col("place") > 0) & F.col("path").isin(of_group)).select("path", "place", F.from_csv(
                "record", _cell_schema(names), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n"}).alias("_c"))
            cells = parsed.select("path", "place", *_cells(names, lambda i: F.col(f"_c.c{i}")))
            out.append((list(keep_last_duplicates(names)), _rows(cells, "place", names, root)))
    return out


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(parsed_json(c)).startswith("OBJECT"), F.lit(False))


def json_lines_files(lines: DataFrame) -> DataFrame:
    """Files that hold one JSON object per line although they are named ``.json``."""
    kept = lines.filter((tx.extension(F.col("source_file")) == "json") & (tx.trimmed(F.col("value")) != ""))
    return (kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"), F.bool_and(is_object(F.col("value"))).alias("ok"))
            .filter("ok and lines >= 2").select("source_file", "lines"))


def read_json_records(lines: DataFrame, on_error: str = "text") -> DataFrame:
    """(source_file, ordinal, json, raw) per non-blank line. A line that is not JSON is kept as text
    (``text``), left out (``skip``) or fails the query (``error``). ``ordinal`` counts physical lines."""
    v = tx.trimmed(F.col("value"))
    kept = lines.withColumn("raw", v).filter(F.col("raw") != "")
    good = is_json(F.col("raw"))
    json = F.when(good, F.col("raw"))
    if on_error == "error":
        json = F.when(good, F.col("raw")).otherwise(F.raise_error(F.concat(
            F.lit("not JSON: "), F.col("source_file"), F.lit(" line "), F.col("line").cast("string"))))
    out = kept.select("source_file", F.col("line").alias("ordinal"), json.alias("json"), "raw")
    return out.filter(F.col("json").isNotNull()) if on_error == "skip" else out


def read_json_documents(docs: DataFrame, fallback: str = "text") -> DataFrame:
    """(source_file, ordinal, json, raw) per element of each whole JSON file.

    Arrays give one record per element, a non-object becomes ``{"value": ...}``. A file that is no JSON
    is kept as text, or read line by line with ``fallback="lines"``.
    """
    raw = tx.trimmed(F.col("raw"))
    array = F.from_json(raw, "array<string>")
    known = docs.withColumn("_ok", parsed_json(raw).isNotNull()).withColumn("_arr", F.when(
        F.col("_ok") & raw.startswith("["), array).when(F.col("_ok"), F.array(raw)))
    parts = known.filter("_ok").select("source_file", F.posexplode("_arr").alias("at", "json"))
    wrapped = F.when(is_object(F.col("json")), F.col("json")).otherwise(F.concat(
        F.lit('{"value":'), F.when(parsed_json(F.col("json")).isNotNull(), F.col("json")).otherwise(F.to_json(F.array("json")).substr(F.lit(2), F.length(F.to_json(F.array("json"))) - 2)), F.lit("}")))
    good = parts.select("source_file", (F.col("at") + 1).cast("long").alias("ordinal"), wrapped.alias("json"), F.col("json").alias("raw"))
    bad = known.filter(~F.col("_ok"))
    if fallback == "lines":
        rows = bad.select("source_file", F.posexplode(F.filter(F.transform(F.split(raw, r"\r?\n"), lambda x: tx.trimmed(x)), lambda x: x != "")).alias("at", "json"))
        return good.unionByName(rows.select("source_file", (F.col("at") + 1).cast("long").alias("ordinal"), "json", F.col("json").alias("raw")))
    return good.unionByName(bad.select("source_file", F.lit(1).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("json"), "raw"))


def key_order(records: DataFrame, column: str = "json") -> DataFrame:
    """Distinct top-level keys with the place they were first seen; grows with the keys, not the rows."""
    at = F.struct("source_file", "ordinal", "pos")
    keys = records.select("source_file", "ordinal", F.posexplode(F.json_object_keys(column)).alias("pos", "key"))
    return keys.groupBy("key").agg(F.min(at).alias("first"))


def json_lines_table(records: DataFrame, max_columns: int = 20_000) -> tuple[list[str], DataFrame]:
    """JSON objects as a table over the union of their keys in first-seen order; missing cells blank.

    The header is metadata: its width is checked before the names come to the driver.
    """
    keys = key_order(records).orderBy("first").limit(max_columns + 1).select("key").collect()
    if len(keys) > max_columns:
        raise ValueError(f"more than {max_columns} distinct columns")
    header = [r["key"] for r in keys]
    cells = F.from_json("json", "map<string,string>")
    staged = records.withColumn("_m", cells)
    return header, staged.select("source_file", F.col("ordinal").alias("source_row"), *[
        F.coalesce(F.try_element_at("_m", F.lit(h)), F.lit("")).alias(h) for h in header])


# Leading columns of the sampled record table.
BASE_COLUMNS = ("recordId", "title", "summary", "recordType", "lastModified")


def sampled_table(records: DataFrame, max_rows: int = 0, nested: str = "customProperties") -> tuple[list[str], DataFrame]:
    """Strided sample flattened one level: base columns, then every key of the nested object.

    ``records`` carry a 0-gap 1-based ``ordinal`` over non-blank lines. A nested key that repeats a base
    name is prefixed with ``cp_``.
    """
    kept = records
    if max_rows:
        total = records.agg(F.count(F.lit(1)).alias("n"))
        step = F.greatest(F.lit(1), F.ceil(total.scalar() / F.lit(max_rows)))
        kept = records.filter((F.col("ordinal") - 1) % step == 0)
    inner = kept.withColumn("json", F.get_json_object("json", f"$.{nested}")).filter(F.col("json").isNotNull())
    keys = [r["key"] for r in key_order(inner).filter("key <> ''").orderBy("first").select("key").collect()]
    top, deep = F.from_json("json", "map<string,string>"), F.from_json(F.get_json_object("json", f"$.{nested}"), "map<string,string>")
    staged = kept.withColumns({"_t": top, "_d": deep})
    names = {k: (f"cp_{k}" if k in BASE_COLUMNS else k) for k in keys}
    columns = [F.coalesce(F.try_element_at("_t", F.lit(c)), F.lit("")).alias(c) for c in BASE_COLUMNS]
    columns += [F.coalesce(F.try_element_at("_d", F.lit(k)), F.lit("")).alias(n) for k, n in names.items()]
    return [*BASE_COLUMNS, *names.values()], staged.select("source_file", F.col("ordinal").alias("source_row"), *columns)


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from JSON (``items`` or a bare array) or a prompt table."""
    from itemforge.functions import ids
    from itemforge.operators.evalset import parse_facts
    if not path.lower().endswith(".json"):
        header, rows = read_table(spark, [path])[0]
        have = [c for c in ("prompt", "expected_answer", "source_location") if c in header]
        cell = {c: F.col(c) if c in have else F.lit("") for c in ("prompt", "expected_answer", "source_location")}
        return rows.select(F.col("source_row").alias("ordinal"),
                           ids.stable_id("eval", cell["prompt"], F.col("source_row")).alias("eval_id"),
                           *[v.alias(k) for k, v in cell.items()], F.array().cast("array<string>").alias("assertions"),
                           F.array().cast("array<struct<value:string,whole_word:boolean>>").alias("checks"),
                           F.array().cast("array<string>").alias("supporting_facts"),
                           F.array().cast("array<struct<name:string,value:string>>").alias("facts"),
                           F.lit("").alias("category"), F.lit("").alias("difficulty"))
    raw = spark.read.option("wholetext", "true").text(path)
    body = F.when(tx.trimmed(F.col("value")).startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.items"))
    shape = ("struct<id:string,prompt:string,expected_answer:string,expectedAnswer:string,source_location:string,"
             "referenced_rows:array<string>,assertions:array<struct<type:string,value:string,wholeWord:boolean>>,"
             "supporting_facts:array<string>,supportingFacts:array<string>,category:string,difficulty:string>")
    items = raw.select(F.posexplode(F.from_json(body, f"array<{shape}>")).alias("at", "i"))
    i = F.col("i")
    must = F.filter(i["assertions"], lambda a: (F.coalesce(a["type"], F.lit("must_contain")) == "must_contain") & a["value"].isNotNull())
    facts = F.coalesce(i["supporting_facts"], i["supportingFacts"], F.array().cast("array<string>"))
    given = tx.text_or_blank(i["id"])
    places = F.concat_ws(" ", F.concat(F.coalesce(i["referenced_rows"], F.array().cast("array<string>")),
                                       F.array(tx.text_or_blank(i["source_location"]))))
    return items.select(
        (F.col("at") + 1).cast("long").alias("ordinal"),
        F.when(given != "", given).otherwise(F.concat(F.lit("eval-"), (F.col("at") + 1).cast("string"))).alias("eval_id"),
        tx.text_or_blank(i["prompt"]).alias("prompt"),
        F.coalesce(i["expected_answer"], i["expectedAnswer"], F.lit("")).alias("expected_answer"), places.alias("source_location"),
        F.coalesce(F.transform(must, lambda a: a["value"]), F.array().cast("array<string>")).alias("assertions"),
        F.coalesce(F.transform(i["assertions"], lambda a: F.struct(tx.text_or_blank(a["value"]).alias("value"), F.coalesce(a["wholeWord"], F.lit(False)).alias("whole_word"))),
                   F.array().cast("array<struct<value:string,whole_word:boolean>>")).alias("checks"),
        facts.alias("supporting_facts"), parse_facts(facts).alias("facts"),
        tx.text_or_blank(i["category"]).alias("category"), tx.text_or_blank(i["difficulty"]).alias("difficulty"))


def normalize_responses(rows: DataFrame, column: str = "json") -> DataFrame:
    """Judge output rows in any accepted spelling to one response schema; rows without a prompt are dropped."""
    from itemforge.functions import ids
    from itemforge.operators.scoring import mean_of_map

    def text(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(column, f"$.{p}") for p in paths], F.lit(""))

    def number(*paths: str) -> Column:
        # only true JSON numbers count
        v = F.try_parse_json(column)
        return F.coalesce(*[F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant")) == "STRING", F.lit(False)),
                                   F.try_variant_get(v, f"$.{p}", "double")) for p in paths])

    def flag(*paths: str) -> Column:
        return F.coalesce(*[F.when(F.get_json_object(column, f"$.{p}").isin("true", "false"),
                                   F.get_json_object(column, f"$.{p}") == "true") for p in paths])
    judged = F.from_json(F.get_json_object(column, "$.scores"), "map<string,struct<score_0_100:double,reason:string>>")
    scored = F.transform_values(F.map_filter(judged, lambda _, v: v["score_0_100"].isNotNull()), lambda _, v: v["score_0_100"])
    plain = F.from_json(F.coalesce(F.get_json_object(column, "$.semantic_dimensions"), F.get_json_object(column, "$.semanticDimensions")), "map<string,double>")
    plain = F.map_filter(plain, lambda _, v: v.isNotNull())
    dims = F.when(F.size(plain) > 0, plain).when(F.size(scored) > 0, scored)
    prompt = text("prompt")
    given = text("id")
    return rows.filter(F.coalesce(prompt, F.lit("")) != "").select(
        F.when(given != "", given).otherwise(ids.short_hash(prompt)).alias("eval_id"), prompt.alias("prompt"),
        text("expected_answer", "expectedAnswer", "expected_response").alias("expected_answer"),
        text("actual_answer", "actualAnswer", "answer", "response").alias("actual_answer"),
        F.coalesce(F.get_json_object(column, "$.error.message"), text("error")).alias("error"),
        F.nullif(text("judge_provider", "judgeProvider"), F.lit("")).alias("judge"),
        F.coalesce(number("semantic_score", "semanticScore"), mean_of_map(scored)).alias("semantic_score"),
        dims.alias("dimensions"), flag("has_citation", "hasCitation").alias("has_citation"),
        number("retries").cast("long").alias("retries"), flag("rate_limited").alias("rate_limited"))


def envelope_or_raw(records: DataFrame) -> DataFrame:
    """Crawl records (``source_file``, ``ordinal``, ``json``) with an id; already enveloped ones are marked.

    A record that is no JSON object gets an error instead of an id.
    """
    from itemforge.functions import ids
    from itemforge.operators.runtime import ID_CHAIN
    v = F.try_parse_json("json")

    def kind(p: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit(""))
    enveloped = ((kind("$.id") == "STRING") & kind("$.acl").startswith("ARRAY") & kind("$.properties").startswith("OBJECT")
                 & (kind("$.content.value") == "STRING"))
    own = F.when(kind("$.id") == "STRING", F.get_json_object("json", "$.id"))
    chain = [F.when(~kind(f"$.{k}").rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)"), F.get_json_object("json", f"$.{k}")) for k in ID_CHAIN]
    made = ids.safe_raw_id(chain, F.col("source_file"), (F.col("ordinal") - 1).cast("string"))
    ok = is_object(F.col("json"))
    return records.select(
        "source_file", "ordinal", "json",
        F.when(ok, F.when(tx.trimmed(own) != "", own).otherwise(made)).alias("id"),
        (ok & enveloped).alias("enveloped"), F.when(~ok, F.lit("record is not a JSON object")).alias("error"))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run records under ``root/*/job.json``, newest first."""
    schema = ("id string, status string, createdAt string, updatedAt string, datasetHash string, evalSetHash string, "
              "config struct<dataset:string,mode:string,noEnhance:boolean,connectorId:string,connectorName:string>")
    runs = spark.read.schema(schema).option("multiLine", "true").json(f"{root.rstrip('/')}/*/job.json")
    return runs.select(F.col("id").alias("run_id"), "status", F.col("createdAt").alias("created_at"),
                       F.col("datasetHash").alias("dataset_hash"), F.col("evalSetHash").alias("evalset_hash"),
                       F.col("config.mode").alias("mode"), F.coalesce("config.noEnhance", F.lit(False)).alias("no_enhance"),
                       F.col("config.dataset").alias("dataset"), F.col("config.connectorId").alias("connector_id"),
                       F.col("config.connectorName").alias("connector_name")).orderBy(F.desc("created_at"))


def filter_runs(runs: DataFrame, *, mode: str | None = None, scored: bool = False, reports: DataFrame | None = None,
                limit: int = 200) -> DataFrame:
    """Runs by mode and by whether they have a report; at most 1000."""
    out = runs.filter(F.col("mode") == mode) if mode else runs
    if scored and reports is not None:
        out = out.join(reports.select("run_id"), "run_id", "left_semi")
    return out.orderBy(F.desc("created_at")).limit(max(1, min(limit, 1000)))


def file_hashes(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, sha256, bytes) of every file below ``root`` under the hashing exclusions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = tx.relative_path(F.regexp_replace("path", "^file:/+", "/"), root)
    parts = F.split(rel, "/")
    keep = ~F.exists(parts, lambda p: p.startswith("_") | F.lower(p).isin(*SKIPPED_FOLDERS_SHORT))
    if extensions:
        keep = keep & tx.extension(rel).isin(*[e.lower().lstrip(".") for e in extensions])
    return files.filter(keep).select(rel.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
