"""Queries for evaluation items: matching, coverage, generation and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemforge.config import EnrichConfig
from itemforge.operators import evalset, matching, records
from itemforge.plans import sql as S
from itemforge.plans.registry import query
from itemforge.plans.tables import CUSTOMER_HEADER, ORDER_HEADER, customer_records, order_records, table
from itemforge.sinks import writers

CONFIG = EnrichConfig()


def doc_items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"))


def passage_items(spark, sf):
    """Benchmark passages with two assertions each: the passage and its first characters in small letters."""
    first = F.lower(F.substring("text", 1, 12))
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("eval_id"), F.col("text").alias("prompt"), F.array(F.col("text"), first).alias("assertions"))


_PASSAGES = "b AS (SELECT CAST(item_id AS VARCHAR) AS eval_id, unnest([text, lower(substr(text, 1, 12))]) AS a FROM benchmark)"
_EDGES = f"""{_PASSAGES}, edges AS (SELECT DISTINCT doc_id AS item_id, eval_id FROM documents JOIN b ON contains(lower(text), lower({S.trim('a')})))"""
_FOUND = f"""{_EDGES}, found AS (SELECT DISTINCT b.eval_id, a FROM b JOIN edges USING (eval_id) JOIN documents ON doc_id = item_id WHERE contains(text, a))"""


@query("content_matches", "JOIN-04", f"WITH {_EDGES} SELECT item_id, eval_id FROM edges")
def content_matches(spark, sf):
    return matching.match_by_content(doc_items(spark, sf), passage_items(spark, sf))


@query("unmatched_items", "JOIN-06", f"WITH {_EDGES} SELECT CAST(item_id AS VARCHAR) AS eval_id FROM benchmark WHERE CAST(item_id AS VARCHAR) NOT IN (SELECT eval_id FROM edges)")
def unmatched_items(spark, sf):
    e = passage_items(spark, sf)
    return matching.unmatched(e, matching.match_by_content(doc_items(spark, sf), e)).select("eval_id")


@query("focus_rows", "JOIN-08 FLT-03", f"WITH {_EDGES} SELECT DISTINCT item_id FROM edges")
def focus_rows(spark, sf):
    d = doc_items(spark, sf)
    return matching.rows_with_match(d, matching.match_by_content(d, passage_items(spark, sf))).select("item_id")


@query("assertion_gaps", "JOIN-07 SET-05", f"""WITH {_FOUND} SELECT b.eval_id, string_agg(b.a, '|' ORDER BY b.a) AS missing, count(*) AS n FROM b LEFT JOIN found f ON f.eval_id = b.eval_id AND f.a = b.a WHERE f.a IS NULL GROUP BY 1""")
def assertion_gaps(spark, sf):
    d, e = doc_items(spark, sf), passage_items(spark, sf)
    edges = matching.match_by_content(d, e)
    gaps = matching.assertion_gaps(e, matching.found_assertions(d, e, edges))
    return gaps.select("eval_id", F.array_join("missing", "|").alias("missing"), F.size("missing").cast("long").alias("n"))


@query("eval_coverage", "AGG-15", f"""WITH {_FOUND} SELECT CAST(item_id AS VARCHAR) AS eval_id, 2 AS assertions, (SELECT count(*) FROM edges e WHERE e.eval_id = CAST(b0.item_id AS VARCHAR)) AS matched_records,
 (SELECT count(*) FROM found f WHERE f.eval_id = CAST(b0.item_id AS VARCHAR)) AS assertions_found FROM benchmark b0""")
def eval_coverage(spark, sf):
    d, e = doc_items(spark, sf), passage_items(spark, sf)
    edges = matching.match_by_content(d, e)
    return matching.coverage(e, edges, matching.found_assertions(d, e, edges))


@query("enrichment_report", "SNK-04 AGG-20 FLT-13", f"""WITH {_FOUND} SELECT (SELECT count(*) FROM documents) AS items_written, (SELECT count(DISTINCT source) FROM documents) AS files_processed,
 (SELECT count(*) FROM documents WHERE length(text) < 20) AS files_skipped, (SELECT count(*) FROM benchmark) AS eval_items, (SELECT count(DISTINCT eval_id) FROM edges) AS eval_items_matched,
 (SELECT count(DISTINCT b.eval_id) FROM b LEFT JOIN found f ON f.eval_id = b.eval_id AND f.a = b.a WHERE f.a IS NULL) AS eval_assertion_gaps,
 (SELECT count(*) FROM benchmark) - (SELECT count(DISTINCT eval_id) FROM edges) AS eval_items_unmatched""")
def enrichment_report(spark, sf):
    d, e = doc_items(spark, sf), passage_items(spark, sf)
    edges = matching.match_by_content(d, e)
    gaps = matching.assertion_gaps(e, matching.found_assertions(d, e, edges))
    items = table(spark, sf, "documents").select(F.col("source").alias("source_file"))
    skipped = table(spark, sf, "documents").filter(F.length("text") < 20).select("doc_id")
    return writers.enrichment_report(items, skipped, e, edges, gaps)


def order_evals(spark, sf):
    """One evaluation item per lineitem order: its reference and the facts it should meet."""
    o = order_records(spark, sf)
    # a third of the items expect a status their order does not have
    status = F.when(F.col("status") == "P", "F").otherwise(F.col("status"))
    facts = F.array(F.concat(F.lit("country="), F.col("country")), F.concat(F.lit("Year = "), F.col("year")), F.concat(F.lit("STATUS="), status),
                    F.concat(F.lit("total="), F.col("total")))
    return o.select(F.col("code").alias("eval_id"), evalset.parse_facts(facts).alias("facts"),
                    F.concat(F.lit("Orders.csv:row "), F.col("source_row").cast("string")).alias("source_location"))


@query("reference_matches", "JOIN-01 STR-09", """SELECT o_orderkey + 1 AS item_id, 'ORD-' || o_orderkey AS eval_id FROM orders""")
def reference_matches(spark, sf):
    rows = order_records(spark, sf).select(F.col("source_row").alias("item_id"), F.concat(F.lit("dir/"), F.col("source_file")).alias("source_file"), "source_row")
    return matching.match_by_reference(rows, matching.reference_rows(order_evals(spark, sf)))


@query("line_band_matches", "JOIN-03", """SELECT o_orderkey + 1 AS item_id, 'ORD-' || o_orderkey AS eval_id FROM orders UNION SELECT o_orderkey, 'ORD-' || o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey + 1 FROM orders)""")
def line_band_matches(spark, sf):
    lines = order_records(spark, sf).select(F.col("source_row").alias("item_id"), "source_file", F.col("source_row").alias("line"))
    return matching.match_by_line_band(lines, matching.reference_rows(order_evals(spark, sf)))


_EY = f"""{S.ORDERS}, ev AS (SELECT code AS eval_id, country, year, CASE WHEN status = 'P' THEN 'F' ELSE status END AS status, total FROM ord),
 ey AS (SELECT o.source_row AS item_id, e.eval_id FROM ord o JOIN ev e ON lower(o.country) = lower(e.country) AND o.year = e.year AND lower(o.status) = lower(e.status) AND o.total = e.total)"""


@query("entity_year_matches", "JOIN-02 PRJ-25", f"WITH {_EY} SELECT DISTINCT item_id, eval_id FROM ey")
def entity_year_matches(spark, sf):
    o = records.with_roles(order_records(spark, sf), ORDER_HEADER, CONFIG)
    rows = o.withColumnRenamed("source_row", "item_id")
    return matching.match_by_entity_year(rows, ORDER_HEADER, order_evals(spark, sf), CONFIG)


@query("merged_matches", "JOIN-05", f"""WITH {_EY} SELECT item_id, eval_id FROM ey UNION SELECT o_orderkey + 1, 'ORD-' || o_orderkey FROM orders""")
def merged_matches(spark, sf):
    return matching.merge_matches(entity_year_matches(spark, sf), reference_matches(spark, sf))


def customer_entries(spark, sf):
    cells = F.array(*[F.struct(F.lit(h).alias("key"), F.col(h).alias("value")) for h in CUSTOMER_HEADER])
    return customer_records(spark, sf).select(F.col("source_file").alias("source"), F.col("source_row").alias("row"), cells.alias("entries"))


# Customer facts are picked in key order: id, country, name, then segment (balance only when a slot is left).
_GENERATED = f"""{S.CUSTOMERS}, gen AS (SELECT {S.short_hash("'customers.csv:' || source_row || ':' || id || ':' || id || '|' || country || '|' || name || '|' || segment")} AS eval_id, source_row,
 'For ' || name || ', what are the values for id, country, name, segment?' AS prompt,
 name || ': id is ' || id || '; country is ' || country || '; name is ' || name || '; segment is ' || segment || '.' AS expected_answer,
 'customers.csv:row ' || source_row AS source_location, CAST(4 AS BIGINT) AS n_assertions, 'high' AS confidence FROM cust)"""


@query("eval_items", "PRJ-23 STR-03 STR-19", f"WITH {_GENERATED} SELECT eval_id, prompt, expected_answer, source_location, n_assertions, confidence FROM gen")
def eval_items(spark, sf):
    g = evalset.generate(customer_entries(spark, sf))
    return g.select("eval_id", "prompt", "expected_answer", "source_location", F.size("assertions").cast("long").alias("n_assertions"),
                    F.col("grounding_confidence").alias("confidence"))


@query("target_eval_set", "SET-02", f"""WITH {_GENERATED}, seed AS (SELECT 'seed-' || item_id AS eval_id, CASE WHEN item_id = 3 THEN '  for CUSTOMER#000000001,  what are the values for id, country, name, segment?' ELSE text END AS prompt, item_id FROM benchmark),
 fresh AS (SELECT eval_id, prompt, source_row FROM gen WHERE prompt <> 'For Customer#000000001, what are the values for id, country, name, segment?'),
 both_sets AS (SELECT eval_id, prompt, 0 AS r, item_id AS o FROM seed UNION ALL SELECT eval_id, prompt, 1, source_row FROM fresh)
SELECT eval_id, prompt FROM both_sets QUALIFY row_number() OVER (ORDER BY r, o) <= 300""")
def target_eval_set(spark, sf):
    same = F.lit("  for CUSTOMER#000000001,  what are the values for id, country, name, segment?")
    seed = table(spark, sf, "benchmark").select(F.concat(F.lit("seed-"), F.col("item_id").cast("string")).alias("eval_id"),
                                                F.when(F.col("item_id") == 3, same).otherwise(F.col("text")).alias("prompt"), F.col("item_id").alias("ordinal"))
    generated = evalset.generate(customer_entries(spark, sf))
    return evalset.build_eval_set(generated, 300, seed).select("eval_id", "prompt")


def canonical_source(spark, sf):
    """Benchmark passages as raw evaluation items, some without an id."""
    t = table(spark, sf, "benchmark")
    return t.select(F.when(F.length("text") > 250, F.concat(F.lit("item-"), F.lpad(F.col("item_id").cast("string"), 6, "0"))).alias("eval_id"),
                    F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("prompt"), F.lit(None).cast("string").alias("expected_answer"),
                    F.array(F.struct(F.lit(" x ").alias("value"), F.lit(True).alias("whole_word")),
                            F.struct(F.lit("y").alias("value"), F.lit(False).alias("whole_word"))).alias("assertions"),
                    F.array(F.lit(" k=v "), F.lit("  ")).alias("supporting_facts"), F.lit("c").alias("category"), F.lit(None).cast("string").alias("difficulty"))


_CANON = f"""c AS (SELECT item_id, {S.trim('text')} AS p, CASE WHEN length(text) > 250 THEN 'item-' || lpad(CAST(item_id AS VARCHAR), 6, '0') ELSE {S.short_hash(S.trim('text'))} END AS id FROM benchmark),
 j AS (SELECT id, p, '{{"id":' || to_json(id) || ',"prompt":' || to_json(p) || ',"expected_answer":"","assertions":[{{"value":"x","wholeWord":true}},{{"value":"y"}}],"supporting_facts":["k=v"],"category":"c","difficulty":""}}' AS canonical FROM c)"""


@query("canonical_eval_items", "JSN-03 STR-18", f"WITH {_CANON} SELECT id, canonical FROM j")
def canonical_eval_items(spark, sf):
    return evalset.canonical_items(canonical_source(spark, sf)).select("id", "canonical")


_TREE = """g AS (SELECT substr(h, 1, 4) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM l GROUP BY 1),
 t AS (SELECT substr(g, 1, 2) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, sum(n) AS n FROM g GROUP BY 1)
 SELECT 'sha256-tree:' || sha256(string_agg(h, chr(10) ORDER BY h)) AS hash, sum(n)::BIGINT AS n FROM t"""


@query("evalset_fingerprint", "AGG-22 SRT-02", f"WITH {_CANON}, l AS (SELECT sha256(canonical) AS h FROM j), {_TREE}")
def evalset_fingerprint(spark, sf):
    return evalset.evalset_fingerprint(canonical_source(spark, sf))


@query("dataset_fingerprint", "AGG-21", """WITH f AS (SELECT 'docs/' || source || '-' || doc_id || '.txt' AS path, sha256(text) AS h, octet_length(encode(text)) AS b FROM documents)""" + f", l AS (SELECT sha256(path || chr(9) || h || chr(9) || b) AS h FROM f), {_TREE}")
def dataset_fingerprint(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("Docs/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    return evalset.dataset_fingerprint(files)


@query("locale_order", "SRT-02", "SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages")
def locale_order(spark, sf):
    names = table(spark, sf, "pages").select(F.split("url", "/")[2].alias("host")).distinct()
    return names.orderBy(F.collate("host", "UNICODE"))


@query("indexed_items", "SRC-13 GEN-06", "SELECT 'eval-' || (item_id + 1) AS eval_id, text AS prompt, 'must' AS assertion FROM benchmark")
def indexed_items(spark, sf):
    t = table(spark, sf, "benchmark").select(F.concat(F.lit("eval-"), (F.col("item_id") + 1).cast("string")).alias("eval_id"), F.col("text").alias("prompt"),
                                             F.array(F.lit("must")).alias("assertions"))
    return t.select("eval_id", "prompt", F.explode_outer("assertions").alias("assertion"))



_TREE = """h4 AS (SELECT folder, substr(h, 1, 4) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM leaf GROUP BY ALL),
 h2 AS (SELECT folder, substr(g, 1, 2) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, sum(n) AS n FROM h4 GROUP BY folder, substr(g, 1, 2))"""


@query("folder_hashes", "AGG-23", f"""WITH f AS (SELECT lang AS l, source AS s, 'doc-' || doc_id || '.txt' AS name, substr(sha256(text), 1, 16) AS hash FROM documents),
 leaf AS (SELECT '' AS folder, sha256(l || '/' || s || '/' || name || ':' || hash) AS h FROM f UNION ALL SELECT l, sha256(s || '/' || name || ':' || hash) FROM f
  UNION ALL SELECT l || '/' || s, sha256(name || ':' || hash) FROM f), {_TREE}
SELECT folder, 'sha256-tree:' || sha256(string_agg(h, chr(10) ORDER BY h)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM h2 GROUP BY folder""")
def folder_hashes(spark, sf):
    """Documents as files two folders deep: a hash for the root, every language and every source in it."""
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return evalset.folder_hashes(d.select(path.alias("path"), evalset.file_hash(F.col("text")).alias("hash")))
