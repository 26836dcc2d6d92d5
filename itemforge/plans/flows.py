"""Queries for scans, sinks and incremental work over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from itemforge.operators import profile, runtime
from itemforge.operators.identity import Property
from itemforge.operators.ordinals import last_wins, stride
from itemforge.plans import sql as S
from itemforge.plans.registry import query
from itemforge.plans.tables import table
from itemforge.session import shared_folder
from itemforge.sinks import writers
from itemforge.sources import readers
from itemforge.streaming import crawl, hook


def event_records(spark, sf):
    """Event lines with a nested object whose keys differ by type."""
    custom = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "view", F.lit(', "title": "inner"')).otherwise(""),
                      F.when(F.col("event_type") == "error", F.lit(', "codes": [1, 2]')).otherwise(""), F.lit("}"))
    line = F.concat(F.lit('{"recordId": "e'), F.col("event_id").cast("string"), F.lit('", "title": "'), F.col("event_type"), F.lit('", "customProperties": '), custom, F.lit("}"))
    return table(spark, sf, "events").select(F.lit("events.jsonl").alias("source_file"), (F.col("event_id") + 1).alias("line"), line.alias("value"))


@query("jsonl_scan", "SRC-05 SRC-04", """SELECT event_id + 1 AS ordinal, json_extract_string(props, '$.k') AS k FROM events""")
def jsonl_scan(spark, sf):
    lines = table(spark, sf, "events").select(F.lit("e.jsonl").alias("source_file"), (F.col("event_id") + 1).alias("line"), F.concat(F.lit("  "), F.col("props")).alias("value"))
    r = readers.read_json_records(lines, on_error="skip")
    return r.select("ordinal", F.get_json_object("json", "$.k").alias("k"))


def _files(df, spark, write):
    """A copy of a table as files in the shared folder, for the scans that read files."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(df.write, path)
    return path


@query("numbered_lines", "SRC-01 STM-01", "SELECT doc_id, true AS placed FROM documents")
def numbered_lines(spark, sf):
    """Documents as lines of files, each line with its own place; the scan finds the same places."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string")
    lines = table(spark, sf, "documents").select(F.concat_ws("|", place, "doc_id").alias("value"))
    found = F.split("value", r"\|")
    return readers.read_lines(spark, _files(lines, spark, lambda w, p: w.text(p))).select(found[1].cast("long").alias("doc_id"), (found[0].cast("long") + 1 == F.col("line")).alias("placed"))


@query("quoted_scan", "SRC-02", "SELECT doc_id, length(coalesce(text, '')) AS n, sha256(coalesce(text, '')) AS digest FROM documents")
def quoted_scan(spark, sf):
    """Documents as delimited files whose cells hold the texts' own line breaks, read in splits."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = _files(docs, spark, lambda w, p: w.option("header", True).option("quoteAll", True).option("escape", '"').csv(p))
    (_, rows), = readers.read_table(spark, [path], multi_line=True)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query("disguised_lines", "SRC-10", """WITH l AS (SELECT 'part-' || (user_id % 40) || CASE WHEN user_id % 2 = 0 THEN '.json' ELSE '.jsonl' END AS source_file, user_id % 8 <> 0 OR event_id % 5 <> 0 AS ok FROM events)
SELECT source_file, count(*) AS lines FROM l WHERE source_file LIKE '%.json' GROUP BY 1 HAVING bool_and(ok) AND count(*) >= 2""")
def disguised_lines(spark, sf):
    """Events as lines of forty files; some files named .json also hold lines that are no objects."""
    name = F.concat(F.lit("part-"), (F.col("user_id") % 40).cast("string"), F.when(F.col("user_id") % 2 == 0, ".json").otherwise(".jsonl"))
    value = F.when((F.col("user_id") % 8 != 0) | (F.col("event_id") % 5 != 0), F.col("props")).otherwise("[1]")
    return readers.json_lines_files(table(spark, sf, "events").select(name.alias("source_file"), F.col("event_id").alias("line"), value.alias("value")))


@query("line_delimiters", "SRC-03", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM pages""")
def line_delimiters(spark, sf):
    """Header lines in four spellings; a quoted cell with other signs does not count."""
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (F.col("page_id") % 4 + 1).cast("int"))
    head = F.concat_ws("\u0001", F.lit("id"), F.lit('"a,b;c|d\te"'), F.lit("url"), F.lit("size"))
    return table(spark, sf, "pages").select("page_id", readers.delimiter_of(F.replace(head, F.lit("\u0001"), sep), F.lit("x.csv")).alias("delimiter"))


@query("newest_runs", "FLT-12 SRT-06", """SELECT 'run-' || doc_id AS run_id, lpad(doc_id::VARCHAR, 12, '0') AS created_at FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
ORDER BY created_at DESC LIMIT 200""")
def newest_runs(spark, sf):
    """Runs of one mode that have a report, the newest first; the limit is the operator's own."""
    marks = table(spark, sf, "labels")
    run = F.concat(F.lit("run-"), F.col("doc_id").cast("string")).alias("run_id")
    runs = marks.select(run, F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at"), F.when(F.col("quality") == 1, "evaluate").otherwise("build").alias("mode"))
    return readers.filter_runs(runs, mode="evaluate", scored=True, reports=marks.filter("toxic = 1").select(run)).select("run_id", "created_at")


@query("required_items", "FLT-13", "SELECT page_id, url FROM pages")
def required_items(spark, sf):
    return writers.require_items(table(spark, sf, "pages").select("page_id", "url"), [".html"], [".html"])


@query("jsonl_table", "SRC-11 SRC-10", """SELECT event_id + 1 AS source_row, 'e' || event_id AS record_id, event_type AS title, '{"k":' || json_extract_string(props, '$.k') || CASE event_type WHEN 'view' THEN ',"title":"inner"' WHEN 'error' THEN ',"codes":[1,2]' ELSE '' END || '}' AS custom FROM events""")
def jsonl_table(spark, sf):
    header, rows = readers.json_lines_table(readers.read_json_records(event_records(spark, sf)))
    compact = F.replace(F.replace(F.col("customProperties"), F.lit(": "), F.lit(":")), F.lit(", "), F.lit(","))
    assert header == ["recordId", "title", "customProperties"]
    return rows.select("source_row", F.col("recordId").alias("record_id"), "title", compact.alias("custom"))


@query("stride_sample", "SRC-12 WIN-05", """WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS o, count(*) OVER () AS n FROM events) SELECT event_id + 1 AS source_row, 'e' || event_id AS record_id, event_type AS title, json_extract_string(props, '$.k') AS k,
 CASE WHEN event_type = 'view' THEN 'inner' ELSE '' END AS cp_title FROM e WHERE (o - 1) % greatest(1, CAST(ceil(n / 3000.0) AS BIGINT)) = 0""")
def stride_sample(spark, sf):
    records = readers.read_json_records(event_records(spark, sf))
    header, rows = readers.sampled_table(records, max_rows=3000)
    assert header[:5] == list(readers.BASE_COLUMNS) and "cp_title" in header
    return rows.select("source_row", F.col("recordId").alias("record_id"), "title", "k", "cp_title")


@query("stride_rows", "WIN-05", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE (o - 1) % greatest(1, CAST(ceil(n / 150.0) AS BIGINT)) = 0""")
def stride_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 1).alias("ordinal"))
    return stride(d, "ordinal", table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar(), 150).select("doc_id")


@query("response_rows", "SRC-14 SCR-03 MAP-02", f"""SELECT c.conv_id || ':' || c.turn AS eval_id, {S.trim("' ' || c.role")} AS expected_answer, c.text AS actual_answer, CASE WHEN c.turn = 1 THEN 'late' ELSE '' END AS error,
 CASE WHEN c.turn = 2 THEN 50.0::DOUBLE WHEN c.turn = 3 THEN NULL ELSE (c.turn * 10 + 40) / 2.0 END AS semantic_score, c.turn AS retries FROM conversations c""")
def response_rows(spark, sf):
    c = table(spark, sf, "conversations")
    ident = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    scores = F.create_map(F.lit("Relevance"), F.struct((F.col("turn") * 10).cast("double").alias("score_0_100"), F.lit("r").alias("reason")),
                          F.lit("Coherence"), F.struct(F.lit(40.0).alias("score_0_100"), F.lit("c").alias("reason")))
    err = F.when(F.col("turn") == 1, F.struct(F.lit("late").alias("message")))
    modern = F.to_json(F.struct(ident.alias("id"), F.lit("p").alias("prompt"), F.col("role").alias("expected_response"), F.col("text").alias("response"), err.alias("error"),
                                F.when(~F.col("turn").isin(2, 3), scores).alias("scores"), F.when(F.col("turn") == 2, F.lit(50)).alias("semanticScore"), F.col("turn").alias("retries")))
    dropped = F.to_json(F.struct(ident.alias("id"), F.lit("").alias("prompt")))
    lines = c.select(F.explode(F.array(modern, dropped)).alias("json"))
    return readers.normalize_responses(lines).select("eval_id", "expected_answer", "actual_answer", "error", "semantic_score", "retries")


@query("raw_items", "SRC-15 STR-13", """SELECT s_suppkey + 1 AS ordinal, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_nationkey < 5 THEN 'env-' || s_suppkey WHEN s_nationkey < 10 THEN CAST(s_suppkey AS VARCHAR) ELSE replace(s_name, '#', '-') END AS id,
 s_acctbal >= 0 AND s_nationkey < 5 AS enveloped, s_acctbal < 0 AS failed FROM supplier""")
def raw_items(spark, sf):
    s = table(spark, sf, "supplier")
    enveloped = F.concat(F.lit('{"id":"env-'), F.col("s_suppkey").cast("string"), F.lit('","acl":[],"properties":{},"content":{"type":"text","value":"x"}}'))
    numbered = F.concat(F.lit('{"recordId":'), F.col("s_suppkey").cast("string"), F.lit(',"name":"n"}'))
    named = F.concat(F.lit('{"id":" ","name":"'), F.col("s_name"), F.lit('"}'))
    json = (F.when(F.col("s_acctbal") < 0, "[1]").when(F.col("s_nationkey") < 5, enveloped).when(F.col("s_nationkey") < 10, numbered).otherwise(named))
    records = s.select(F.lit("s.json").alias("source_file"), (F.col("s_suppkey") + 1).alias("ordinal"), json.alias("json"))
    return readers.envelope_or_raw(records).select("ordinal", "id", "enveloped", F.col("error").isNotNull().alias("failed"))


@query("newest_versions", "SNK-08 STM-04", """SELECT user_id AS id, event_id FROM (SELECT user_id, event_id, row_number() OVER (
 PARTITION BY user_id ORDER BY event_id % 12 DESC, event_id DESC) AS place FROM events) WHERE place = 1""")
def newest_versions(spark, sf):
    """The newest row of a log of twelve versions, v10 after v9."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", F.concat(F.lit("v"), (F.col("event_id") % 12).cast("string")).alias("version"), F.col("event_id").alias("batch"))
    return last_wins(log, ["id"], writers.version_place(F.col("version"), F.col("batch"))).select("id", "event_id")


@query("replayed_items", "SNK-08 STM-04", """SELECT user_id AS id, event_id FROM (SELECT user_id, event_id, row_number() OVER (
 PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS place FROM events) WHERE place = 1""")
def replayed_items(spark, sf):
    """Events through the sink as three batches, the second one twice, with a compaction between them and a replay of what it holds."""
    target = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", F.col("event_id").alias("place"))
    for batch in (0, 1, 1, None, 1, 2):
        if batch is None:
            writers.compact(spark, target)
        else:
            writers.upsert_batch(events.filter(F.col("event_id") % 3 == batch), target, "v1", batch, "place")
    return writers.latest_items(spark, target)


@query("crawled_items", "STM-01 STM-02 STM-03 UDF-01", """SELECT 'c' || c_custkey AS id, upper(c_name) AS title, c_mktsegment AS segment FROM customer WHERE c_acctbal >= 0""")
def crawled_items(spark, sf):
    """Customers as JSON lines through the stream into the item table, a hook on the title; those in debt have no id and are quarantined."""
    c = table(spark, sf, "customer")
    ident = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    folder = _files(c.select(F.to_json(F.struct(ident.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("value")), spark, lambda w, p: w.text(p))
    base = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    crawl.crawl(spark, folder, raw_schema="id string, name string, segment string", schema=[Property("title", "String", aliases=["name"]), Property("segment", "String")],
                target=f"{base}/items", quarantine=f"{base}/bad", checkpoint=f"{base}/at", version="v1", max_failures=c.count() + 1,
                property_hook=lambda props: {**props, "title": F.upper(props["title"])}).awaitTermination()
    p = F.col("properties")
    return writers.latest_items(spark, f"{base}/items").select("id", p["title"].alias("title"), p["segment"].alias("segment"))


@query("hooked_items", "UDF-02", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def hooked_items(spark, sf):
    """The customer table as raw items of a source hook, read block by block."""
    hook.register(spark, "parquet_rows", lambda options: hook.ParquetRows(options))
    raw = hook.read(spark, "parquet_rows", path=f"{sf}/customer.parquet")
    return raw.select(F.from_json("value", "c_custkey long, c_name string, c_acctbal double").alias("r")).select(
        F.col("r.c_custkey").alias("id"), F.col("r.c_name").alias("name"), F.col("r.c_acctbal").alias("balance"))


@query("upsert_latest", "SNK-08 WIN-06 STM-04", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, sf):
    """Two overlapping batches, the first applied twice: what the item table would hold."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.month("ts").alias("m"))
    early, late = e.withColumn("batch", F.lit(0)), e.withColumn("batch", F.lit(1))
    log = early.unionByName(early).unionByName(late)
    return last_wins(log, ["user_id"], F.struct("batch", "event_id")).select("user_id", "event_id")


@query("error_budget", "STM-03 PRJ-22", """SELECT event_type AS batch, count(*) AS rows_read, count(*) FILTER (event_type = 'error' AND user_id < 10) AS failed, count(*) FILTER (event_type = 'error' AND user_id < 10) >= 10 AS aborted FROM events GROUP BY 1""")
def error_budget(spark, sf):
    e = table(spark, sf, "events")
    ident = F.when((F.col("event_type") == "error") & (F.col("user_id") < 10), F.lit(None)).otherwise(F.col("event_id").cast("string"))
    raw = e.select(ident.alias("id"), F.col("event_type").alias("name"), "value")
    items = runtime.runtime_items(raw, [Property("title", "String"), Property("url", "String"), Property("batch", "String", aliases=["name"])])
    counted = items.groupBy(F.col("properties")["batch"].alias("batch")).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return counted.withColumn("aborted", F.col("failed") >= crawl.MAX_FAILURES)


@query("incremental_rows", "STM-05", "SELECT event_id, user_id FROM events WHERE ts > (SELECT max(o_orderdate) + INTERVAL 8200 DAY FROM orders)")
def incremental_rows(spark, sf):
    done = table(spark, sf, "orders").select((F.col("o_orderdate") + F.expr("INTERVAL 8200 DAYS")).alias("at"))
    return crawl.since(table(spark, sf, "events"), "ts", done, "at").select("event_id", "user_id")


@query("item_lines", "SNK-01", """SELECT '{"id":"s-' || s_suppkey || '","properties":{"title":"' || s_name || '"},"content":{"type":"text","value":"' || s_name || '"},"acl":[{"type":"everyone","value":"everyone","accessType":"grant"}]}' AS line FROM supplier""")
def item_lines(spark, sf):
    from itemforge.operators.records import access_entries
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("id"), F.create_map(F.lit("title"), F.col("s_name")).alias("properties"),
                                            F.col("s_name").alias("content"), access_entries("everyone").alias("acl"))
    return s.select(writers.item_json(s).alias("line"))


@query("eval_prompt_table", "SNK-05", "SELECT text AS prompt, upper(substr(text, 1, 1)) AS expected_answer, 'b.csv:row ' || item_id AS source_location, '' AS actual_answer FROM benchmark")
def eval_prompt_table(spark, sf):
    return writers.eval_prompts(_evals(spark, sf))


@query("eval_reviews", "SNK-05", "SELECT item_id + 1 AS ordinal, '## ' || (item_id + 1) || '. ' || text || chr(10) || chr(10) || upper(substr(text, 1, 1)) || chr(10) || chr(10) || 'Source: b.csv:row ' || item_id || chr(10) AS review FROM benchmark")
def eval_reviews(spark, sf):
    return writers.eval_review(_evals(spark, sf))


def _evals(spark, sf):
    return table(spark, sf, "benchmark").select((F.col("item_id") + 1).alias("ordinal"), F.col("text").alias("prompt"), F.upper(F.substring("text", 1, 1)).alias("expected_answer"),
                                                F.concat(F.lit("b.csv:row "), F.col("item_id").cast("string")).alias("source_location"))


@query("document_report", "AGG-20", """WITH d AS (SELECT source AS source_file, 'text/plain' AS content_type, lang AS doc_title, doc_id FROM documents) SELECT source_file, content_type, count(*) AS chunks, string_agg(DISTINCT doc_title, '; ' ORDER BY doc_title) AS titles FROM d GROUP BY ALL""")
def document_report(spark, sf):
    items = table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.lit("text/plain").alias("content_type"), F.col("lang").alias("doc_title"))
    return writers.document_report(items)


@query("extension_counts", "SRC-09 AGG-27", """WITH p AS (SELECT CASE WHEN lang = 'en' THEN 'csv' WHEN lang = 'de' THEN 'md' ELSE 'bin' END AS ext FROM documents) SELECT ext, count(*) AS files FROM p WHERE ext <> 'bin' GROUP BY 1""")
def extension_counts(spark, sf):
    ext = F.when(F.col("lang") == "en", "csv").when(F.col("lang") == "de", "md").otherwise("bin")
    return readers.extension_profile(table(spark, sf, "documents").select(ext.alias("ext")))


@query("duplicate_names", "AGG-27", "SELECT lower(url) AS name, count(*) AS n FROM (SELECT split_part(url, '/', 3) AS url FROM pages) GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    host = F.lower(F.split("url", "/")[2])
    return profile.duplicates(table(spark, sf, "pages").select(host.alias("name")), "name")
