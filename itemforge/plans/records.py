"""Queries for record items, profiles, long tables and guides."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemforge.config import EnrichConfig
from itemforge.functions import ids
from itemforge.operators import guides, identity, longform, profile, records, runtime
from itemforge.operators.identity import Property
from itemforge.operators.json_items import domain_counts as count_domains
from itemforge.operators.json_items import infer_domain
from itemforge.operators.ordinals import first_n
from itemforge.operators.ordinals import last_wins
from itemforge.operators.ordinals import with_ordinal
from itemforge.plans import sql as S
from itemforge.plans.registry import query
from itemforge.plans.tables import CUSTOMER_HEADER, ORDER_HEADER, customer_records, order_records, table

PLAIN = EnrichConfig()
RANKED = EnrichConfig(priority_fields=("total", "status"), field_aliases={"total": "Order total"})


@query("stable_item_ids", "PRJ-05", f"""SELECT c_custkey, {S.stable_id('row', "'customers.csv'", 'c_custkey', 'c_name', "''", "'row'", 'c_custkey + 1')} AS row_id,
 {S.stable_id('docsrc', 'c_name', "'0'", 'c_mktsegment')} AS doc_id,
 {S.stable_id('doc', 'c_name', S.stable_id('docsrc', 'c_name', "'0'", 'c_mktsegment'), '3', 'NULL')} AS chunk_id FROM customer""")
def stable_item_ids(spark, sf):
    c = table(spark, sf, "customer")
    key = ids.row_key(F.lit("customers.csv"), F.col("c_custkey"), F.col("c_name"), F.lit(""), F.col("c_custkey") + 1)
    doc = ids.document_id(F.col("c_name"), F.col("c_mktsegment"))
    return c.select("c_custkey", F.concat(F.lit("row-"), ids.short_hash(key, 24)).alias("row_id"), doc.alias("doc_id"),
                    ids.chunk_id(F.col("c_name"), doc, F.lit("3"), F.lit(None).cast("string")).alias("chunk_id"))


def _lines(header, fmt):
    return ", ".join(f"CASE WHEN NOT {S.empty(h)} THEN '{fmt.format(h)}' || {h} END" for h in header)


_CUST_TITLE = "country || ' — customers'"
_CUST_CONTENT = f"""concat_ws(chr(10), {_CUST_TITLE} || ' (sourceRow=' || source_row || ')', '', 'Raw fields:', {_lines(CUSTOMER_HEADER, '{}: ')}, '', 'Key facts:',
 chr(10) || 'All populated fields:' || chr(10) || concat_ws(chr(10), {_lines(CUSTOMER_HEADER, '- {}: ')}))"""


@query("record_items", "PRJ-01 PRJ-02 PRJ-04 PRJ-05 PRJ-07 SET-01", f"""WITH {S.CUSTOMERS} SELECT {S.stable_id('row', 'source_file', 'id', 'country', "''", "'row'", 'source_row')} AS id,
 {_CUST_TITLE} AS title, 'file:///customers.csv#row=' || source_row AS url, source_row, country AS entity_name, '' AS year, id AS iso_code,
 segment, CASE WHEN balance <> 'N/A' THEN balance END AS balance, {S.capped(_CUST_CONTENT)} AS content, 'everyone' AS acl FROM cust""")
def record_items(spark, sf):
    items = records.record_items(customer_records(spark, sf), CUSTOMER_HEADER, PLAIN)
    p = F.col("properties")
    return items.select("id", "title", "url", "source_row", "entity_name", "year", "iso_code", p["segment"].alias("segment"),
                        p["balance"].alias("balance"), "content", F.col("acl")[0]["type"].alias("acl"))


_ORD_TITLE = "country || ' (' || year || ') — orders'"
_ORD_ORDER = ["total", "status", "priority", "code", "country", "year"]
_ORD_CONTENT = f"""concat_ws(chr(10), {_ORD_TITLE} || ' (sourceRow=' || source_row || ')', '', 'Raw fields:', {_lines(ORDER_HEADER, '{}: ')}, '', 'Key facts:',
 {_lines(['total', 'status', 'priority'], '- {}: ')}, chr(10) || 'All populated fields:' || chr(10) || concat_ws(chr(10), {_lines(['code', 'country', 'year'], '- {}: ')}))"""


@query("order_items", "PRJ-01 PRJ-02 PRJ-03 PRJ-06 PRJ-08a", f"""WITH {S.ORDERS} SELECT {S.stable_id('row', 'source_file', 'code', 'country', 'year', "'row'", 'source_row')} AS id,
 {_ORD_TITLE} AS title, 'https://h/orders.csv#row=' || source_row AS url, year AS core_year, year AS year2, status, {S.capped(_ORD_CONTENT)} AS content FROM ord""")
def order_items(spark, sf):
    items = records.record_items(order_records(spark, sf), ORDER_HEADER, RANKED, eval_counts={"priority": 3}, url_prefix="https://h/")
    p = F.col("properties")
    return items.select("id", "title", "url", p["year"].alias("core_year"), p["year2"].alias("year2"), p["status"].alias("status"), "content")


@query("role_lookup", "PRJ-04 PRJ-25", f"""WITH {S.ORDERS} SELECT source_row, country AS entity, year, code AS iso, total AS exact_fact, country AS role_fact,
 priority AS suffix_fact, year AS member_fact, '' AS no_fact FROM ord""")
def role_lookup(spark, sf):
    o = order_records(spark, sf).withColumnRenamed("priority", "order_priority")
    header = [h if h != "priority" else "order_priority" for h in ORDER_HEADER]
    with_roles = records.with_roles(o, header, PLAIN)

    def fact(key):
        return records.fact_value_for(header, key, PLAIN)
    return with_roles.select("source_row", F.col("entity_name").alias("entity"), F.col("role_year").alias("year"), F.col("iso_code").alias("iso"),
                             fact("TOTAL").alias("exact_fact"), fact("entity").alias("role_fact"), fact("Priority").alias("suffix_fact"),
                             fact("quarter").alias("member_fact"), fact("missing").alias("no_fact"))


@query("file_stats", "AGG-01", f"""WITH {S.CUSTOMERS}, u AS ({' UNION ALL '.join(f"SELECT source_file, source_row, '{h}' AS col, {h} AS v FROM cust" for h in CUSTOMER_HEADER)})
SELECT source_file, col AS column_name, count(*) AS row_count, count(*) FILTER (NOT {S.empty('v')}) AS filled,
 min(source_row) FILTER (NOT {S.empty('v')}) AS first_row FROM u GROUP BY ALL""")
def file_stats(spark, sf):
    stats = profile.file_stats(customer_records(spark, sf), CUSTOMER_HEADER)
    return stats.select("source_file", F.col("column").alias("column_name"), "row_count", "filled", "first_row")


@query("top_entities", "AGG-02 WIN-04 SRT-01", f"""WITH {S.ORDERS}, c AS (SELECT source_file, country, count(*) AS n, min(source_row) AS first_row FROM ord GROUP BY ALL)
SELECT country, n, row_number() OVER (ORDER BY n DESC, first_row) AS place FROM c QUALIFY place <= 8""")
def top_entities(spark, sf):
    o = records.with_roles(order_records(spark, sf), ORDER_HEADER, PLAIN)
    top = profile.top_values(o, "entity_name", 8)
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("n"), "first_row"))
    return top.select(F.col("entity_name").alias("country"), "n", place.alias("place"))


@query("year_range", "AGG-03 SRT-03", f"""WITH {S.ORDERS}, y AS (SELECT DISTINCT CASE WHEN status = 'P' THEN year || '-Q1' ELSE year END AS y FROM ord)
SELECT count(*) AS year_count, arg_min(y, (length(y), y)) AS first_year, arg_max(y, (length(y), y)) AS last_year FROM y""")
def year_range(spark, sf):
    o = order_records(spark, sf).withColumn("year", F.when(F.col("status") == "P", F.concat("year", F.lit("-Q1"))).otherwise(F.col("year")))
    span = profile.year_span(records.with_roles(o, ORDER_HEADER, PLAIN), "role_year")
    return span.select("year_count", "first_year", "last_year")


@query("domain_counts", "AGG-04 PRJ-17", """WITH d AS (SELECT CASE WHEN p_brand = 'Brand#7' THEN 'npi' WHEN p_size > 40 THEN 'icd10' WHEN p_size < 10 THEN 'cms' ELSE 'generic' END AS domain FROM part
 UNION ALL SELECT 'generic' FROM events) SELECT domain, count(*) AS n FROM d GROUP BY 1""")
def domain_counts(spark, sf):
    def entry(k, v):
        return F.struct(F.lit(k).alias("key"), v.alias("value"))
    size = F.col("p_size")
    entries = F.filter(F.array(
        entry("name", F.col("p_name")), entry("npi", F.when(F.col("p_brand") == "Brand#7", "1093137432")),
        entry("data.code", F.when(size > 40, "9")), entry("code", F.when(size > 40, "A000")),
        entry("measure_name", F.when(size < 10, "m"))), lambda e: e["value"].isNotNull())
    parts = table(spark, sf, "part").select(infer_domain(entries).alias("domain"))
    events = table(spark, sf, "events").select(infer_domain(F.array(entry("k", F.get_json_object("props", "$.k")))).alias("domain"))
    return count_domains(parts, events)


_FACTS = """f AS (SELECT unnest(CASE WHEN quality = 1 THEN ['doc_id','quality'] ELSE ['doc_id','toxic','quality'] END) AS field FROM labels)"""


def _label_facts(spark, sf):
    names = F.when(F.col("quality") == 1, F.array(F.lit("doc_id"), F.lit("quality"))).otherwise(
        F.array(F.lit("doc_id"), F.lit("toxic"), F.lit("quality")))
    return table(spark, sf, "labels").select(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("x").alias("value"))).alias("facts"))


@query("fact_key_counts", "AGG-05 GEN-06", f"WITH {_FACTS} SELECT field, count(*) AS n FROM f GROUP BY 1")
def fact_key_counts(spark, sf):
    from itemforge.operators.evalset import fact_key_counts as count
    return count(_label_facts(spark, sf))


@query("field_weights", "AGG-06 SRT-01 WIN-04", f"""WITH {_FACTS}, {S.CUSTOMERS}, w AS (SELECT field, count(*) AS weight, CASE field WHEN 'doc_id' THEN 0 WHEN 'quality' THEN 1 ELSE 2 END AS ordinal FROM f GROUP BY ALL
 UNION ALL {' UNION ALL '.join(f"SELECT '{h}', count(*) FILTER (NOT {S.empty(h)}), {100 + i} FROM cust" for i, h in enumerate(CUSTOMER_HEADER))})
SELECT field, sum(weight)::BIGINT AS weight, row_number() OVER (ORDER BY sum(weight) DESC, min(ordinal)) AS place FROM w GROUP BY field QUALIFY place <= 6""")
def field_weights(spark, sf):
    from itemforge.operators.evalset import fact_key_counts as count
    cited = count(_label_facts(spark, sf)).select("field", F.col("n").alias("weight"), F.when(F.col("field") == "doc_id", 0).when(
        F.col("field") == "quality", 1).otherwise(2).alias("ordinal"))
    filled = profile.file_stats(customer_records(spark, sf), CUSTOMER_HEADER).select(
        F.col("column").alias("field"), F.col("filled").alias("weight"), (F.col("position") + 100).alias("ordinal"))
    top = profile.field_weights(cited, filled, k=6)
    # six rows: placed after the cut
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "ordinal", "field", "weight"))).alias("rows"))
    return ordered.select(F.posexplode("rows").alias("at", "row")).select("row.field", "row.weight", (F.col("at") + 1).alias("place"))


LONG_HEADER = ["indicatorId", "indicatorName", "countryName", "date", "value", "countryiso3code"]
LONG = EnrichConfig(explicit_long=True)
_LONG = f"""{S.ORDERS}, agg AS (SELECT country, year, count(*) AS n, max(o_totalprice) AS mx, min(o_totalprice) AS mn FROM
  (SELECT n_name AS country, CAST(year(o_orderdate) AS VARCHAR) AS year, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL),
 li AS (SELECT country, year, 'ORD.CNT' AS i, 'Orders' AS nm, CAST(n AS VARCHAR) AS v FROM agg
  UNION ALL SELECT country, year, 'ORD.MAX', 'Largest order', {S.num('mx')} FROM agg
  UNION ALL SELECT country, year, 'ORD.MIN', 'Smallest order', CASE WHEN mn < 1500 THEN 'n/a' ELSE {S.num('mn')} END FROM agg),
 ok AS (SELECT *, 'C-' || country AS iso FROM li WHERE NOT {S.empty('v')})"""


def long_rows(spark, sf):
    """Yearly order measures per country in long form, one file per measure."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    agg = o.groupBy(F.col("n_name").alias("countryName"), F.year("o_orderdate").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("mx"), F.min("o_totalprice").alias("mn"))
    from itemforge.functions.numbers import number_text
    rows = F.array(*[F.struct(F.lit(i).alias("indicatorId"), F.lit(nm).alias("indicatorName"), v.alias("value"), F.lit(f).alias("source_file"))
                     for i, nm, v, f in (("ORD.MIN", "Smallest order", F.when(F.col("mn") < 1500, "n/a").otherwise(number_text(F.col("mn"))), "min.csv"),
                                         ("ORD.CNT", "Orders", F.col("n").cast("string"), "count.csv"),
                                         ("ORD.MAX", "Largest order", number_text(F.col("mx")), "max.csv"))])
    return agg.select("countryName", "date", F.concat(F.lit("C-"), F.col("countryName")).alias("countryiso3code"), F.inline(rows)).withColumn(
        "source_row", F.col("date").cast("long"))


_LONG_BODY = """title || chr(10) || chr(10) || 'Raw fields:' || chr(10) || 'countryName: ' || country || chr(10) || 'date: ' || year || chr(10) || 'countryiso3code: ' || iso || chr(10) || raw
 || chr(10) || chr(10) || 'Key facts:' || chr(10) || chr(10) || 'All populated fields:' || chr(10) || '- countryName: ' || country || chr(10) || '- date: ' || year || chr(10) || '- countryiso3code: ' || iso || chr(10) || facts
 || chr(10) || chr(10) || 'Grouped values:' || chr(10) || lines"""


@query("long_grouped", "AGG-07 PRJ-06", f"""WITH {_LONG}, g AS (SELECT country, year, iso, country || ' (' || year || ') — long-format indicators' AS title,
  string_agg(i || ' value: ' || v, chr(10) ORDER BY i) AS raw, string_agg('- ' || i || ' value: ' || v, chr(10) ORDER BY i) AS facts,
  string_agg('- ' || i || ' (' || nm || '): ' || v, chr(10) ORDER BY i) AS lines FROM ok GROUP BY country, year, iso)
SELECT {S.stable_id('indicator-group', "'count.csv, max.csv, min.csv'", 'country', 'year', 'iso')} AS id, title, country AS entity_name, year, iso AS iso_code,
 'file:///count.csv' AS url, {S.capped(_LONG_BODY)} AS content FROM g""")
def long_grouped(spark, sf):
    items = longform.grouped_items(long_rows(spark, sf), LONG_HEADER, LONG)
    return items.select("id", "title", "entity_name", "year", "iso_code", "url", "content")


@query("long_fields", "AGG-07 WIN-06", f"""WITH {_LONG} SELECT country AS entity_name, year, i || ' value' AS field, v AS value FROM ok""")
def long_fields(spark, sf):
    rows = longform.indicator_rows(long_rows(spark, sf), LONG_HEADER, LONG)
    return longform.grouped_fields(rows).select("entity_name", F.col("role_year").alias("year"), "field", "value")


@query("item_union", "SET-01 AGG-07", f"""WITH {S.CUSTOMERS}, {_LONG.replace(S.ORDERS + ', ', '')} SELECT 'record' AS item_type, count(*) AS items FROM cust UNION ALL
SELECT 'grouped-record', count(DISTINCT (country, year)) FROM ok UNION ALL SELECT 'dataset-guide', count(DISTINCT source_file) FROM cust""")
def item_union(spark, sf):
    c = customer_records(spark, sf)
    parts = [records.record_items(c, CUSTOMER_HEADER, PLAIN), longform.grouped_items(long_rows(spark, sf), LONG_HEADER, LONG),
             guides.dataset_guides(c, CUSTOMER_HEADER, PLAIN)]
    merged = parts[0].select("id", "item_type")
    for p in parts[1:]:
        merged = merged.unionByName(p.select("id", "item_type"))
    return merged.groupBy("item_type").agg(F.count(F.lit(1)).alias("items"))


_GUIDE_STATS = ", ".join(f"count(*) FILTER (NOT {S.empty(h)}) AS n_{h}" for h in ORDER_HEADER)
_GLOSSARY = " || chr(10) || ".join(f"'- {h}: {h}; populated in ' || n_{h} || ' row(s)'" for h in ORDER_HEADER)


@query("dataset_guides", "AGG-08 AGG-02 AGG-03", f"""WITH {S.ORDERS}, s AS (SELECT source_file, count(*) AS rows_n, {_GUIDE_STATS} FROM ord GROUP BY 1),
 e AS (SELECT string_agg(country, ', ' ORDER BY n DESC, f) AS entities FROM (SELECT country, count(*) AS n, min(source_row) AS f FROM ord GROUP BY 1 ORDER BY n DESC, f LIMIT 8)),
 y AS (SELECT min(year) AS y0, max(year) AS y1 FROM ord)
SELECT {S.stable_id('dataset-guide', 'source_file')} AS id, 'Dataset guide — ' || source_file AS title, rows_n AS row_count,
 'Title: Dataset guide — orders.csv' || chr(10) || 'Source file: orders.csv' || chr(10) || 'Rows: ' || rows_n || chr(10) || 'Columns: 6' || chr(10) || 'Common entities: ' || entities
 || chr(10) || 'Year/date range: ' || y0 || ' to ' || y1 || chr(10) || chr(10) || 'Column glossary:' || chr(10) || {_GLOSSARY} || chr(10) || chr(10) || 'Most populated fields:' || chr(10)
 || '- {", ".join(ORDER_HEADER)}' || chr(10) || chr(10) || 'Retrieval guidance:' || chr(10) || '- Use row records for exact entity/year lookups and multi-field metric questions.' || chr(10)
 || '- Use this dataset guide for field meanings, abbreviations, units, and available columns.' AS content FROM s, e, y""")
def dataset_guides(spark, sf):
    items = guides.dataset_guides(order_records(spark, sf), ORDER_HEADER, PLAIN)
    return items.select("id", "title", "row_count", "content")


@query("capped_records", "FLT-04 WIN-02", f"""WITH {S.ORDERS} SELECT country, source_row FROM ord QUALIFY row_number() OVER (PARTITION BY country ORDER BY source_row) <= 20""")
def capped_records(spark, sf):
    return first_n(order_records(spark, sf), ["country"], [F.asc("source_row")], 20).select("country", "source_row")


@query("row_ordinals", "WIN-01", "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem")
def row_ordinals(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return with_ordinal(line, ["l_returnflag"], "at", width=20_000).drop("at")


@query("last_per_key", "WIN-06", """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def last_per_key(spark, sf):
    return last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("flat_records", "SNK-02 PRJ-07", f"""WITH {S.ORDERS} SELECT {S.stable_id('row', 'source_file', 'code', 'country', 'year', "'row'", 'source_row')} AS id, 'record' AS itemType, {_ORD_TITLE} AS title,
 source_file AS sourceFile, CAST(source_row AS VARCHAR) AS sourceRow, country AS entityName, year, '' AS documentId, '' AS contentType, '' AS sectionPath, '' AS chunkIndex,
 '' AS chunkCount, '' AS author, '' AS datePublished, length({S.capped(_ORD_CONTENT)}) AS content_length FROM ord""")
def flat_records(spark, sf):
    items = records.record_items(order_records(spark, sf), ORDER_HEADER, RANKED, eval_counts={"priority": 3})
    flat = records.flat_table(items)
    return flat.withColumn("content_length", F.length("content").cast("long")).drop("content")


_OBS = {
    "total": "true", "non_empty": "t <> ''", "numeric_like": "n", "float_like": "n AND contains(t, '.')", "scientific": "n AND regexp_matches(t, '[eE]')",
    "leading_zero": "n AND regexp_matches(t, '^0\\d')", "unsafe_integer": "n AND abs(TRY_CAST(t AS DOUBLE)) > 9007199254740991",
    "boolean_like": "regexp_matches(t, '(?i)^(true|false)$')", "date_like": "regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$')"}
_LINE_COLS = {"l_orderkey": "CAST(l_orderkey AS VARCHAR)", "part_code": "'00' || l_partkey", "l_quantity": S.num("l_quantity"), "l_discount": S.num("l_discount"),
              "shipped": "strftime(l_shipdate, '%Y-%m-%d')", "returned": "CAST(l_returnflag = 'R' AS VARCHAR)", "flag": "l_linestatus"}
_CELLS = " UNION ALL ".join(f"SELECT '{k}' AS col, {v} AS t FROM lineitem" for k, v in _LINE_COLS.items())
_PROFILE = f"""WITH c AS ({_CELLS}), o AS (SELECT col, t, regexp_matches(t, '^[+-]?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$') AS n FROM c),
 p AS (SELECT col AS column_name, {', '.join(f"count(*) FILTER ({v}) AS {k}" for k, v in _OBS.items())} FROM o GROUP BY 1)"""


def _line_records(spark, sf):
    from itemforge.functions.numbers import number_text
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.concat(F.lit("00"), F.col("l_partkey").cast("string")).alias("part_code"),
        number_text(F.col("l_quantity")).alias("l_quantity"), number_text(F.col("l_discount")).alias("l_discount"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), (F.col("l_returnflag") == "R").cast("string").alias("returned"),
        F.col("l_linestatus").alias("flag"))


@query("column_profile", "AGG-12", f"{_PROFILE} SELECT * FROM p")
def column_profile(spark, sf):
    return profile.column_profile(_line_records(spark, sf), list(_LINE_COLS)).drop("position").withColumnRenamed("column", "column_name")


@query("inferred_types", "AGG-13 FLT-11", f"""{_PROFILE} SELECT column_name, CASE WHEN column_name IN ('part_code') THEN 'String' WHEN leading_zero > 0 OR unsafe_integer > 0 OR scientific > 0 THEN 'String'
 WHEN non_empty = 0 THEN 'String' WHEN numeric_like = non_empty AND float_like > 0 THEN 'Double' WHEN numeric_like = non_empty THEN 'Int64' WHEN date_like = non_empty THEN 'DateTime'
 WHEN boolean_like = non_empty THEN 'Boolean' ELSE 'String' END AS type FROM p""")
def inferred_types(spark, sf):
    p = profile.column_profile(_line_records(spark, sf), list(_LINE_COLS))
    return p.select(F.col("column").alias("column_name"), profile.inferred_type().alias("type"))


_JSON_ROW = "'{' || " + " || ',' || ".join(f"'\"{h}\":' || to_json({h})" for h in CUSTOMER_HEADER) + " || '}'"
_ID_CONTENT = " || chr(10) || ".join(f"'{h}: ' || {h}" for h in CUSTOMER_HEADER)


@query("identity_items", "PRJ-20 PRJ-21 AGG-12 AGG-13", f"""WITH {S.CUSTOMERS} SELECT substr(sha256(source_file || chr(31) || source_row || chr(31) || {_JSON_ROW}), 1, 32) AS id, name AS title,
 'file:///raw/customers.csv#row-' || source_row AS url, source_row, id AS id_text, segment, balance, {_ID_CONTENT} AS content, true AS title_from_source, false AS url_from_source FROM cust""")
def identity_items(spark, sf):
    items = identity.identity_items(customer_records(spark, sf), CUSTOMER_HEADER)
    p = F.col("properties")
    return items.select("id", "title", "url", "source_row", p["id"].alias("id_text"), p["segment"].alias("segment"), p["balance"].alias("balance"),
                        "content", "title_from_source", "url_from_source")


_BARE = "CASE WHEN segment = 'BUILDING' THEN '' ELSE name END"


@query("provenance_fractions", "AGG-14 MTH-02", f"""WITH {S.CUSTOMERS} SELECT country, count(*) AS items, {S.half_up(f"sum(CASE WHEN {_BARE} <> '' THEN 1 ELSE 0 END) / count(*)", 3)} AS title_share,
 0.0::DOUBLE AS url_share, 1.0::DOUBLE AS icon_share FROM cust GROUP BY 1""")
def provenance_fractions(spark, sf):
    c = customer_records(spark, sf).withColumn("name", F.when(F.col("segment") == "BUILDING", "").otherwise(F.col("name"))).withColumnRenamed("segment", "image")
    header = ["id", "name", "country", "image", "balance"]
    items = identity.identity_items(c, header, dict.fromkeys(header, "String"))
    return identity.provenance(items.withColumn("country", F.col("properties")["country"]), ["country"])


@query("label_promotion", "PRJ-21", """WITH c AS (SELECT source AS source_id, CASE lang WHEN 'de' THEN 'Head-line' WHEN 'en' THEN 'Name' WHEN 'es' THEN 'canonical_url' ELSE 'n' END AS col, min(doc_id) AS o FROM documents GROUP BY ALL),
 l AS (SELECT *, CASE WHEN col IN ('Head-line','Name') THEN 'title' WHEN col = 'canonical_url' THEN 'url' END AS label FROM c)
SELECT source_id, label, arg_min(col, o) AS column_name FROM l WHERE label IS NOT NULL GROUP BY ALL""")
def label_promotion(spark, sf):
    col = F.when(F.col("lang") == "de", "Head-line").when(F.col("lang") == "en", "Name").when(F.col("lang") == "es", "canonical_url").otherwise("n")
    columns = table(spark, sf, "documents").groupBy(F.col("source").alias("source_id"), col.alias("column")).agg(F.min("doc_id").alias("ordinal"))
    return identity.label_promotion(columns).withColumnRenamed("column", "column_name")


RUNTIME_SCHEMA = [Property("title", "String"), Property("url", "String"), Property("total", "Int64", aliases=["o_totalprice"]),
                  Property("exactTotal", "Double", aliases=["o_totalprice"]), Property("urgent", "Boolean", aliases=["o_orderpriority"]),
                  Property("placed", "DateTime", aliases=["o_orderdate"]), Property("missing", "String")]


@query("runtime_items", "PRJ-22 UDF-01", f"""SELECT 'o-' || o_orderkey AS id, 'o-' || o_orderkey AS title, 'file:///external-items/o-' || o_orderkey AS url, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total,
 {S.num('o_totalprice')} AS exact_total, 'false' AS urgent, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS placed,
 'title: o-' || o_orderkey || chr(10) || 'url: file:///external-items/o-' || o_orderkey || chr(10) || 'total: ' || CAST(floor(o_totalprice) AS BIGINT) || chr(10) || 'exactTotal: ' || {S.num('o_totalprice')} || chr(10)
 || 'urgent: false' || chr(10) || 'placed: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' || chr(10) || 'o_custkey: ' || o_custkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10)
 || 'o_totalprice: ' || {S.num('o_totalprice')} || chr(10) || 'o_orderdate: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' || chr(10) || 'o_orderpriority: ' || o_orderpriority AS content, true AS writable FROM orders""")
def runtime_items(spark, sf):
    raw = table(spark, sf, "orders").select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"), "o_custkey", "o_orderstatus",
                                            "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderpriority")
    items = runtime.runtime_items(raw, RUNTIME_SCHEMA)
    p = F.col("properties")
    return items.select("id", p["title"].alias("title"), p["url"].alias("url"), p["total"].alias("total"), p["exactTotal"].alias("exact_total"),
                        p["urgent"].alias("urgent"), p["placed"].alias("placed"), "content", F.col("error").isNull().alias("writable"))


@query("batch_summary", "AGG-26", """SELECT d.source AS source_id, count(*) AS items, count(*) FILTER (text LIKE '%&%') AS errors, count(*) FILTER (length(text) > 2000) AS warnings,
 CASE WHEN count(*) FILTER (text LIKE '%&%') > 0 THEN 'failed' ELSE 'completed' END AS status FROM documents d
 WHERE d.source NOT IN (SELECT source FROM documents GROUP BY source HAVING max(n_chars) < 4000) GROUP BY 1""")
def batch_summary(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "source_id")
    issues = docs.select("source_id", F.explode(F.filter(F.array(
        F.when(F.contains("text", F.lit("&")), "error"), F.when(F.length("text") > 2000, "warning")), lambda s: s.isNotNull())).alias("severity"))
    done = docs.groupBy("source_id").agg(F.max("n_chars").alias("m")).filter("m < 4000")
    return profile.batch_summary(docs, issues, done)
