"""Queries for scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemforge.functions import ids
from itemforge.functions import names as nm_
from itemforge.functions import numbers as nm
from itemforge.functions import text as tx
from itemforge.functions.json_tree import canonical_json, parsed_json
from itemforge.operators.scoring import mean_of_map, numeric_entries
from itemforge.plans import sql as S
from itemforge.plans.registry import query
from itemforge.plans.tables import table, turn_pairs


@query("clean_text", "STR-01", f"""WITH c AS (SELECT doc_id, {S.clean('text')} AS t FROM documents)
SELECT doc_id, length(t) AS n_clean, sha256(t) AS digest FROM c""")
def clean_text(spark, sf):
    t = tx.clean_content(F.col("text"))
    return table(spark, sf, "documents").withColumn("t", t).select(
        "doc_id", F.length("t").cast("long").alias("n_clean"), F.sha2("t", 256).alias("digest"))


@query("entity_decode", "STR-02", f"SELECT page_id, sha256({S.decode('html')}) AS digest FROM pages")
def entity_decode(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(tx.decode_entities(F.col("html")), 256).alias("digest"))


_HUMAN = f"""WITH p AS (SELECT p_partkey, p_brand, replace(p_name, ' ', '_') || '-' || upper(substr(p_type,1,1)) || lower(substr(p_type,2)) || 'Type' AS k FROM part)
SELECT p_partkey, {S.camel("trim(regexp_replace(k, '[_-]+', ' ', 'g'))")} AS field_label,
 {S.upper_first(S.camel("trim(regexp_replace(k, '[_-]+', ' ', 'g'))"))} AS json_label,
 lower({S.camel("regexp_replace(k, '[_-]+', ' ', 'g')")}) AS leaf_label FROM p"""


@query("humanized_names", "STR-03 PRJ-24", _HUMAN)
def humanized_names(spark, sf):
    kind = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substr("p_type", F.lit(2))))
    k = F.concat(F.translate("p_name", " ", "_"), F.lit("-"), kind, F.lit("Type"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.humanize_field(k).alias("field_label"), tx.humanize_json_key(k).alias("json_label"),
        tx.humanize_leaf(F.concat(F.lit("a."), k)).alias("leaf_label"))


@query("fold_compact", "STR-04 STR-05", f"""WITH d AS (SELECT doc_id, {S.fold('text')} AS f FROM documents)
SELECT doc_id, sha256(f) AS folded, sha256(regexp_replace(f, '[^a-z0-9]+', '', 'g')) AS compacted FROM d""")
def fold_compact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.fold(F.col("text")).alias("f"))
    return d.select("doc_id", F.sha2("f", 256).alias("folded"), F.sha2(tx.compact(F.col("f")), 256).alias("compacted"))


@query("contains_checks", "STR-06 STR-08", f"""WITH {S.TURNS}, w AS (SELECT eval_id, answer,
  split_part(prompt, ' ', 1) AS word, upper(substr(prompt, 1, 2)) AS code FROM turns)
SELECT eval_id, contains({S.fold('answer')}, {S.fold('word')}) OR contains(regexp_replace({S.fold('answer')}, '[^a-z0-9]+', '', 'g'),
  regexp_replace({S.fold('word')}, '[^a-z0-9]+', '', 'g')) AS holds,
 length(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) BETWEEN 2 AND 3
  AND upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) = regexp_replace(code, '[^A-Za-z0-9]', '', 'g') AS short_code FROM w""")
def contains_checks(spark, sf):
    w = turn_pairs(spark, sf).select("eval_id", tx.fold(F.col("answer")).alias("a"),
                                     tx.fold(F.substring_index("prompt", " ", 1)).alias("w"), tx.upper_each(F.substring("prompt", 1, 2)).alias("code"))
    return w.select("eval_id", tx.contains_folded(F.col("a"), F.col("w")).alias("holds"), tx.is_short_code(F.col("code")).alias("short_code"))


_TOKENS = "list_distinct(list_filter(string_split_regex({x}, '[^a-z0-9.]+'), lambda t: length(t) > 1))"


@query("answer_overlap_f1", "STR-07 SET-04 MTH-01 ARR-01", f"""WITH {S.TURNS}, t AS (SELECT eval_id,
 {_TOKENS.format(x=S.fold('prompt'))} AS e, {_TOKENS.format(x=S.fold('answer'))} AS a FROM turns),
 n AS (SELECT eval_id, len(e) AS ne, len(a) AS na, len(list_intersect(e, a)) AS o FROM t)
SELECT eval_id, CAST(o AS BIGINT) AS shared, {S.pct('''CASE WHEN ne = 0 AND na = 0 THEN 1.0 WHEN ne = 0 OR na = 0 OR o = 0 THEN 0.0
 ELSE 2.0 * (o / na) * (o / ne) / ((o / na) + (o / ne)) END''')} AS f1 FROM n""")
def answer_overlap_f1(spark, sf):
    t = turn_pairs(spark, sf).select("eval_id", tx.fold(F.col("prompt")).alias("p"), tx.fold(F.col("answer")).alias("r"))
    t = t.select("eval_id", tx.tokens(F.col("p")).alias("e"), tx.tokens(F.col("r")).alias("a"))
    return t.select("eval_id", F.size(F.array_intersect("e", "a")).cast("long").alias("shared"),
                    nm.round_pct(tx.overlap_f1(F.col("e"), F.col("a"))).alias("f1"))


@query("row_references", "STR-09 GEN-06", """SELECT o_orderkey, lower(o_orderstatus || '/Orders.csv') AS file, o_orderkey + 1 AS row FROM orders
UNION ALL SELECT o_orderkey, 'customers.tsv', o_custkey FROM orders""")
def row_references(spark, sf):
    text = F.concat(F.lit("see "), F.col("o_orderstatus"), F.lit("/Orders.csv:row "), (F.col("o_orderkey") + 1).cast("string"),
                    F.lit("; also Customers.TSV:row  "), F.col("o_custkey").cast("string"), F.lit(" and nothing:row x"))
    refs = table(spark, sf, "orders").select("o_orderkey", F.explode(tx.row_references(text)).alias("r"))
    return refs.select("o_orderkey", F.col("r.file").alias("file"), F.col("r.row").alias("row"))


@query("fact_split", "STR-10", """SELECT p_partkey, 'p_name' AS fact_key, p_name || '=' || p_size AS fact_value, p_brand AS bare_value FROM part""")
def fact_split(spark, sf):
    fact = F.concat(F.lit(" p_name = "), F.col("p_name"), F.lit("="), F.col("p_size").cast("string"), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", tx.fact_key(fact).alias("fact_key"), tx.fact_value(fact).alias("fact_value"),
                                           F.coalesce(tx.fact_key(F.col("p_brand")), tx.fact_value(F.col("p_brand"))).alias("bare_value"))


@query("normalized_keys", "STR-11 STR-12", f"""SELECT o_orderkey, {S.norm_key('o_orderpriority')} AS key_form,
 lower({S.trim("' ' || o_orderpriority || chr(9)")}) AS value_form,
 trim(regexp_replace(lower('  ' || o_orderpriority || chr(10) || o_orderstatus), '\\s+', ' ', 'g')) AS prompt_form FROM orders""")
def normalized_keys(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", tx.norm_key(p).alias("key_form"), tx.norm_value(F.concat(F.lit(" "), p, F.lit("\t"))).alias("value_form"),
        tx.norm_prompt(F.concat(F.lit("  "), p, F.lit("\n"), F.col("o_orderstatus"))).alias("prompt_form"))


@query("safe_raw_ids", "STR-13", """WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[/?#&\\\\]+', '-', 'g'), '[^A-Za-z0-9._~-]+', '_', 'g') AS c FROM pages)
SELECT page_id, CASE WHEN length(c) <= 120 THEN c ELSE 'item-' || substr(sha256(url), 1, 24) END AS item_id,
 'item-' || substr(sha256('pages.json' || chr(31) || page_id), 1, 24) AS placed_id FROM p""")
def safe_raw_ids(spark, sf):
    at = F.col("page_id").cast("string")
    blank = F.lit(None).cast("string")
    return table(spark, sf, "pages").select(
        "page_id", ids.safe_raw_id([F.lit(""), F.col("url")], F.lit("pages.json"), at).alias("item_id"),
        ids.safe_raw_id([blank, F.lit("  ")], F.lit("pages.json"), at).alias("placed_id"))


@query("source_defaults", "STR-14", f"""WITH s AS (SELECT 'My-data.' || source || '_' || lang AS base, count(*) AS n FROM documents GROUP BY 1),
 n AS (SELECT base, n, trim(regexp_replace(regexp_replace(base, '[._-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS pretty FROM s),
 t AS (SELECT base, n, list_aggregate(list_transform(string_split(pretty, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name FROM n)
SELECT base, n AS documents, name, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS source_key,
 'Search items for the ' || name || ' dataset.' AS description FROM t""")
def source_defaults(spark, sf):
    from itemforge.operators.naming import with_defaults
    base = F.concat(F.lit("My-data."), F.col("source"), F.lit("_"), F.col("lang"))
    counted = table(spark, sf, "documents").groupBy(base.alias("base")).agg(F.count(F.lit(1)).alias("documents"))
    return with_defaults(counted, F.col("base")).select("base", "documents", "name", "source_key", "description")


@query("url_slugs", "STR-15 PRJ-06", f"""SELECT page_id, 'https://h/d/' || split_part(url, '/', 3) || '#' || regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS doc_link,
 'file:///' || split_part(url, '/', 3) || '#row=' || (page_id + 1) AS row_link FROM pages""")
def url_slugs(spark, sf):
    host = F.split("url", "/")[2]
    return table(spark, sf, "pages").select(
        "page_id", ids.document_url(host, "https://h/d/", F.col("url")).alias("doc_link"),
        ids.item_url(host, F.col("page_id") + 1).alias("row_link"))


@query("grouped_links", "PRJ-06", """SELECT o_orderkey, 'https://h/_grouped/' || replace(o_orderpriority, ' ', '%20') || '/' || year(o_orderdate) || '/' || o_orderstatus AS link FROM orders""")
def grouped_links(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ids.grouped_url(
        F.col("o_orderpriority"), F.year("o_orderdate").cast("string"), F.col("o_orderstatus"), F.lit("x.csv"), "https://h/").alias("link"))


@query("alias_lists", "STR-16", """SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN p_name ELSE p_name || '|' || p_type END AS aliases FROM part""")
def alias_lists(spark, sf):
    values = F.array(F.concat(F.lit(" "), F.col("p_name")), F.col("p_brand"), F.upper("p_name"), F.col("p_type"), F.lit("9x"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.alias_list(values), "|").alias("aliases"))


@query("scalar_texts", "STR-18 DAT-03", f"""SELECT o_orderkey, {S.num('o_totalprice')} AS total, {S.num("floor(o_totalprice)")} AS whole,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS placed, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS nested, '' AS missing FROM orders""")
def scalar_texts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", nm.scalar_text(F.col("o_totalprice"), "double").alias("total"),
                    nm.scalar_text(F.floor("o_totalprice").cast("double"), "double").alias("whole"),
                    nm.scalar_text(F.col("o_orderdate"), "timestamp").alias("placed"),
                    nm.scalar_text(F.array("o_orderstatus", "o_orderpriority"), "array<string>").alias("nested"),
                    nm.scalar_text(F.lit(None).cast("string"), "string").alias("missing"))


@query("wide_numbers", "STR-18 PRJ-20 PRJ-22", """SELECT o_orderkey, (o_orderkey + 12345678) || '.25' AS large,
 CASE WHEN o_orderkey >= 1000 THEN '0.' || rtrim(lpad(o_orderkey::VARCHAR, 9, '0'), '0')
  ELSE rtrim(substr(o_orderkey::VARCHAR, 1, 1) || CASE WHEN rtrim(substr(o_orderkey::VARCHAR, 2), '0') <> '' THEN '.' || rtrim(substr(o_orderkey::VARCHAR, 2), '0') ELSE '' END, '.')
   || 'e-' || (10 - length(o_orderkey::VARCHAR)) END AS small FROM orders WHERE o_orderkey > 0""")
def wide_numbers(spark, sf):
    key = F.col("o_orderkey").cast("double")
    return table(spark, sf, "orders").filter("o_orderkey > 0").select("o_orderkey", nm.number_text(key + 12345678.25).alias("large"), nm.number_text(key / 1e9).alias("small"))


@query("short_ids", "STR-19", f"SELECT conv_id, turn, {S.short_hash('text')} AS short_id FROM conversations")
def short_ids(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ids.short_hash(F.col("text")).alias("short_id"))


@query("path_parts", "STR-20", """WITH p AS (SELECT page_id, '/data/set/' || split_part(url, '/', 3) || '/Page ' || page_id || '.Part.HTML' AS path FROM pages)
SELECT page_id, split_part(path, '/', 4) || '/' || split_part(path, '/', 5) AS relative_path, 'Page ' || page_id || '.Part' AS stem, 'html' AS ext FROM p""")
def path_parts(spark, sf):
    path = F.concat(F.lit("file:/data/set/"), F.split("url", "/")[2], F.lit("/Page "), F.col("page_id").cast("string"), F.lit(".Part.HTML"))
    return table(spark, sf, "pages").select("page_id", tx.relative_path(path, "/data/set").alias("relative_path"),
                                            tx.file_stem(path).alias("stem"), tx.extension(path).alias("ext"))


@query("iso_dates", "DAT-01 DAT-02", """SELECT o_orderkey, true AS date_ok, true AS stamp_ok, false AS slash_ok, regexp_matches(o_orderpriority, '^\\d{4}-') AS text_ok,
 o_orderdate AS parsed FROM orders""")
def iso_dates(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey", nm.looks_iso(day).alias("date_ok"), nm.looks_iso(nm.iso_text(F.col("o_orderdate"))).alias("stamp_ok"),
        nm.looks_iso(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("slash_ok"), nm.looks_iso(F.col("o_orderpriority")).alias("text_ok"),
        nm.parse_datetime(F.date_format("o_orderdate", "MM/dd/yyyy")).cast("timestamp_ntz").alias("parsed"))


@query("half_up_rounding", "MTH-01 MTH-02", f"""SELECT l_orderkey, l_linenumber, {S.half_up('l_extendedprice - 50000.25', 1)} AS one_decimal,
 {S.half_up('l_discount - l_tax', 3)} AS three_decimals, {S.pct('l_discount')} AS percent FROM lineitem""")
def half_up_rounding(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", nm.round_delta(F.col("l_extendedprice") - 50000.25).alias("one_decimal"),
        nm.round_half_up(F.col("l_discount") - F.col("l_tax"), 3).alias("three_decimals"), nm.round_pct(F.col("l_discount")).alias("percent"))


@query("safe_integers", "MTH-03", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey || '00000000000000000' WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END AS v FROM orders)
SELECT o_orderkey, TRY_CAST(v AS DOUBLE) IS NOT NULL AS finite, coalesce(abs(TRY_CAST(v AS DOUBLE)) <= 9007199254740991, false) AS safe FROM t""")
def safe_integers(spark, sf):
    v = (F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_orderkey").cast("string"), F.lit("00000000000000000")))
         .when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(nm.is_finite(v), F.lit(False)).alias("finite"), nm.is_safe_integer(v).alias("safe"))


@query("array_helpers", "ARR-01", """WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_words, list_aggregate(w[1:5], 'string_agg', ',') AS first_five, list_contains(w, 'the') AS has_the,
 coalesce(list_filter(w, lambda x: length(x) > 12)[1], '') AS first_long FROM d""")
def array_helpers(spark, sf):
    w = F.split("text", " ")
    return table(spark, sf, "documents").withColumn("w", w).select(
        "doc_id", F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), F.array_join(F.slice("w", 1, 5), ",").alias("first_five"),
        F.exists("w", lambda x: x == "the").alias("has_the"),
        F.coalesce(F.get(F.filter("w", lambda x: F.length(x) > 12), F.lit(0)), F.lit("")).alias("first_long"))


@query("map_merge", "MAP-01 MAP-02 SCR-03 JSN-04", """SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
 (CAST(json_extract_string(props, '$.k') AS DOUBLE) + value) / 2 AS mean_score, 2 AS numeric_keys FROM events""")
def map_merge(spark, sf):
    props = F.from_json("props", "map<string,string>")
    extra = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"), F.lit("note"), F.lit(""))
    merged = F.transform_keys(F.map_filter(F.map_concat(props, extra), lambda _, v: v != ""), lambda k, _: F.lower(k))
    staged = table(spark, sf, "events").withColumn("m", merged).withColumn("n", numeric_entries(F.col("m")))
    return staged.select("event_id", F.col("m")["kind"].alias("kind"), F.col("n")["k"].alias("k"),
                         mean_of_map(F.col("n")).alias("mean_score"), F.size("n").alias("numeric_keys"))


@query("json_parse", "JSN-01 JSN-04 SRC-05", """WITH l AS (SELECT event_id, props AS v FROM events UNION ALL SELECT -1 - doc_id, text FROM documents)
SELECT event_id, json_valid(v) AS parsed, coalesce(try(json_type(v)) = 'OBJECT', false) AS is_object, coalesce(TRY_CAST(try(json_extract_string(v, '$.k')) AS BIGINT), -1) AS k FROM l""")
def json_parse(spark, sf):
    from itemforge.sources.readers import is_object
    events = table(spark, sf, "events").select("event_id", F.col("props").alias("v"))
    lines = events.unionByName(table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("event_id"), F.col("text").alias("v")))
    return lines.select("event_id", parsed_json(F.col("v")).isNotNull().alias("parsed"), is_object(F.col("v")).alias("is_object"),
                        F.coalesce(F.try_variant_get(parsed_json(F.col("v")), "$.k", "bigint"), F.lit(-1).cast("long")).alias("k"))


@query("canonical_json_text", "JSN-02 AGG-23", """SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"},"id":' || event_id || ',"z":null}' AS canonical,
 substr(sha256('{"a":{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"},"id":' || event_id || ',"z":null}'), 1, 16) AS object_hash FROM events""")
def canonical_json_text(spark, sf):
    raw = F.concat(F.lit('{"z": null, "id": '), F.col("event_id").cast("string"), F.lit(', "a": {"type": "'), F.col("event_type"),
                   F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    c = table(spark, sf, "events").select("event_id", canonical_json(raw).alias("canonical"))
    return c.withColumn("object_hash", ids.short_hash(F.col("canonical"), 16))


@query("empty_cells", "FLT-01 FLT-02", f"""WITH {S.CUSTOMERS}, v AS (SELECT source_row, balance, CASE WHEN segment = 'BUILDING' THEN ' None ' ELSE segment END AS segment FROM cust)
SELECT source_row, {S.empty('balance')} AS no_balance, {S.empty('segment')} AS no_segment FROM v WHERE NOT ({S.empty('balance')} AND {S.empty('segment')})""")
def empty_cells(spark, sf):
    from itemforge.operators.records import drop_empty_rows
    from itemforge.plans.tables import customer_records
    v = customer_records(spark, sf).withColumn("segment", F.when(F.col("segment") == "BUILDING", " None ").otherwise(F.col("segment")))
    return drop_empty_rows(v, ["balance", "segment"]).select(
        "source_row", tx.is_empty(F.col("balance")).alias("no_balance"), tx.is_empty(F.col("segment")).alias("no_segment"))


@query("useful_values", "FLT-06", f"SELECT doc_id, {S.useful('text')} AS text_useful, {S.useful('lang')} AS lang_useful, {S.useful(chr(39) + 'NaN' + chr(39))} AS nan_useful FROM documents")
def useful_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.is_useful(F.col("text")).alias("text_useful"),
                                                tx.is_useful(F.col("lang")).alias("lang_useful"), tx.is_useful(F.lit("NaN")).alias("nan_useful"))


@query("prose_values", "FLT-05", f"SELECT 'd' || doc_id AS id, {S.prose('text')} AS prose FROM documents UNION ALL SELECT 'p' || page_id, {S.prose('url')} FROM pages UNION ALL SELECT 'e' || event_id, {S.prose('props')} FROM events")
def prose_values(spark, sf):
    parts = [table(spark, sf, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(c).alias("v"))
             for t, p, k, c in (("documents", "d", "doc_id", "text"), ("pages", "p", "page_id", "url"), ("events", "e", "event_id", "props"))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.select("id", tx.is_prose(F.col("v")).alias("prose"))


_ANSWER = "(CASE WHEN role = 'user' THEN text || ' [^' || turn || '^]' WHEN turn > 2 THEN 'No  matching rows; it was NOT found. ' || text ELSE text END)"


def _answer():
    return (F.when(F.col("role") == "user", F.concat(F.col("text"), F.lit(" [^"), F.col("turn").cast("string"), F.lit("^]")))
            .when(F.col("turn") > 2, F.concat(F.lit("No  matching rows; it was NOT found. "), F.col("text"))).otherwise(F.col("text")))


@query("no_result_and_citation", "FLT-09 FLT-10", f"""SELECT conv_id, turn, regexp_matches({S.fold(_ANSWER)}, 'no matching|not found|unable to return|was not located|no records found|could not find') AS phrase,
 regexp_matches({_ANSWER}, '(?i)no\\s+(matching|records|results)|not\\s+found|unable\\s+to\\s+return') AS wording,
 contains({_ANSWER}, 'cite') OR regexp_matches({_ANSWER}, '\\[\\^\\d+\\^\\]') AS cited FROM conversations""")
def no_result_and_citation(spark, sf):
    c = table(spark, sf, "conversations").withColumn("a", _answer())
    return c.select("conv_id", "turn", tx.has_no_result_phrase(tx.fold(F.col("a"))).alias("phrase"),
                    tx.has_no_result_wording(F.col("a")).alias("wording"), tx.has_citation(F.col("a")).alias("cited"))


_COLUMN = "(CASE event_type WHEN 'view' THEN 'meta.' || event_type || '_id' WHEN 'click' THEN 'Zip' WHEN 'error' THEN 'x.errorcode' WHEN 'signup' THEN 'Fiscal_Year' ELSE 'amount' END)"


@query("column_name_hints", "FLT-11", f"""WITH c AS (SELECT event_id, {_COLUMN} AS col FROM events), l AS (SELECT event_id, col, list_extract(string_split(lower(col), '.'), -1) AS s FROM c)
SELECT event_id, s IN ('year','month','quarter','period','fiscal_year','fiscalyear','week','date','time','timestamp')
  OR regexp_matches(s, '(^|[._])(id|code|key|no|num|iso|zip|postal|phone|fax|npi|duns|taxonomy|account)$') AS keeps_text,
 regexp_matches(s, '(^|[._])(id|code|key)$') AS exact FROM l""")
def column_name_hints(spark, sf):
    t = F.col("event_type")
    col = (F.when(t == "view", F.concat(F.lit("meta."), t, F.lit("_id"))).when(t == "click", "Zip").when(t == "error", "x.errorcode")
           .when(t == "signup", "Fiscal_Year").otherwise("amount"))
    return table(spark, sf, "events").select("event_id", nm_.keeps_text(col).alias("keeps_text"), nm_.hints_exact_match(col).alias("exact"))


_RAW_NAME = "(p_name || '.' || lower(p_brand) || '_' || p_type)"
_PARTS = f"string_split_regex({_RAW_NAME}, '[^A-Za-z0-9]+')"


@query("property_names", "PRJ-08a PRJ-08b", f"""WITH n AS (SELECT p_partkey, regexp_extract_all({_RAW_NAME}, '[A-Za-z0-9]+') AS s FROM part)
SELECT p_partkey, substr(lower(s[1][1]) || s[1][2:] || list_aggregate(list_transform(s[2:], lambda w: upper(w[1]) || w[2:]), 'string_agg', ''), 1, 32) AS search_name,
 substr(s[1] || list_aggregate(list_transform(s[2:], lambda w: upper(w[1]) || w[2:]), 'string_agg', ''), 1, 32) AS plain_name FROM n""")
def property_names(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit("."), F.lower("p_brand"), F.lit("_"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", nm_.search_name(raw).alias("search_name"), nm_.plain_name(raw).alias("plain_name"))


@query("name_collisions", "WIN-07 PRJ-08b", """WITH c AS (SELECT source, min(doc_id) AS ordinal, lang, replace(lang, 'e', '-e') || '.' || 'Col' AS col FROM documents GROUP BY source, lang),
 d AS (SELECT source, ordinal, col, regexp_replace(lang, '[^a-z]', '', 'g') AS lang FROM c UNION ALL SELECT source, ordinal + 100000000, lang || ' col', lang FROM c),
 b AS (SELECT source, ordinal, col, CASE WHEN col LIKE '%.Col' THEN replace(upper(substr(replace(lang,'e','-e'),1,1)), '-', '') ELSE '' END AS h, lang FROM d),
 n AS (SELECT source, ordinal, col, CASE lang WHEN 'de' THEN CASE WHEN col LIKE '%.Col' THEN 'dECol' ELSE 'deCol' END WHEN 'en' THEN CASE WHEN col LIKE '%.Col' THEN 'EnCol' ELSE 'enCol' END
   WHEN 'es' THEN CASE WHEN col LIKE '%.Col' THEN 'EsCol' ELSE 'esCol' END ELSE 'frCol' END AS base FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY ordinal) AS k FROM n)
SELECT source, ordinal, col AS column_name, CASE WHEN k = 1 THEN base ELSE substr(base, 1, 31) || (k - 1) END AS name, k > 1 AS collided FROM r""")
def name_collisions(spark, sf):
    from itemforge.operators.schema import name_collisions as assign
    first = table(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("ordinal"))
    dashed = first.select("source", "ordinal", F.concat(F.replace("lang", F.lit("e"), F.lit("-e")), F.lit(".Col")).alias("column"))
    spaced = first.select("source", (F.col("ordinal") + 100000000).alias("ordinal"), F.concat("lang", F.lit(" col")).alias("column"))
    columns = dashed.unionByName(spaced).withColumnRenamed("source", "source_id")
    return assign(columns).select(F.col("source_id").alias("source"), "ordinal", F.col("column").alias("column_name"), "name", "collided")


@query("strict_words", "STR-06", f"""WITH {S.TURNS}, w AS (SELECT eval_id, {S.fold('answer')} AS a, {S.fold("split_part(prompt, ' ', 1)")} AS w FROM turns)
SELECT eval_id, w = '' OR regexp_matches(a, '(^|[^a-z0-9])' || regexp_escape(w) || '([^a-z0-9]|$)') AS whole_word FROM w""")
def strict_words(spark, sf):
    w = turn_pairs(spark, sf).select("eval_id", tx.fold(F.col("answer")).alias("a"), tx.fold(F.substring_index("prompt", " ", 1)).alias("w"))
    return w.select("eval_id", tx.contains_word(F.col("a"), F.col("w")).alias("whole_word"))

