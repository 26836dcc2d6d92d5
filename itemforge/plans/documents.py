"""Queries for documents, sections, chunks and JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemforge.functions.chunks import packed_chunks
from itemforge.functions.chunks import window_chunks as cut_windows
from itemforge.functions.json_tree import entry_rows, with_eval_entries, with_identity_entries, with_outline, with_search_entries
from itemforge.operators import documents as docs
from itemforge.operators import json_items
from itemforge.plans import sql as S
from itemforge.plans.registry import query
from itemforge.plans.tables import table
from itemforge.session import dealt

# Records of the JSON queries in a task: opening them is the work, reading them is not.
DEEP_ROWS, FLAT_ROWS = 5_000, 10_000


def text_files(spark, sf):
    """Documents as text files with a metadata head."""
    head = F.concat(F.lit("Source: "), F.col("source"), F.lit("\n  DATE :  2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
                    F.lit("\nby: nobody\n\n"))
    return table(spark, sf, "documents").select(
        "doc_id", F.concat("lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.concat(head, F.col("text")).alias("raw"))


def page_files(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"),
                                            F.col("html").alias("raw"))


_TEXT_DOCS = f"""d AS (SELECT doc_id, lang || '/doc-' || doc_id || '.txt' AS source_file, source,
 'Source: ' || source || chr(10) || 'DATE : 2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || chr(10) || 'by: nobody' || chr(10) || chr(10) || text AS raw,
 lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM documents), b AS (SELECT *, {S.clean('raw')} AS body FROM d)"""


@query("text_documents", "PRJ-09 SRC-06", f"""WITH {_TEXT_DOCS} SELECT doc_id, 'by: nobody' AS title, '' AS author, '2024-01-' || day AS date, source AS doc_url, sha256(body) AS body_digest FROM b""")
def text_documents(spark, sf):
    d = docs.text_documents(text_files(spark, sf))
    return d.select("doc_id", "title", "author", "date", "doc_url", F.sha2("body", 256).alias("body_digest"))


def _drop(x):
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "footer", "form", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return x


def _tag(x, tag):
    return S.decode(S.trim(f"regexp_replace(regexp_extract({x}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), '<[^>]+>', ' ', 'g')"))


_LINE_TAGS = "article|aside|blockquote|br|div|li|main|ol|p|pre|section|table|tbody|td|th|tr|ul"
_H1 = "regexp_replace(h, '(?is)<h1\\b[^>]*>(.*?)</h1>', chr(10) || '# \\1' || chr(10), 'g')"
_BODY = S.clean(f"regexp_replace(regexp_replace({_H1}, '(?i)</?({_LINE_TAGS})\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
_PAGES = f"""h AS (SELECT page_id, {_drop('html')} AS h FROM pages), p AS (SELECT page_id, 'page-' || page_id || '.html' AS source_file,
 coalesce(nullif({_tag('h', 'title')}, ''), {_tag('h', 'h1')}) AS title, {_BODY} AS body FROM h)"""


@query("html_titles", "PRJ-11", f"""WITH h AS (SELECT page_id, {_drop('html')} AS h FROM pages) SELECT page_id, {_tag('h', 'title')} AS title, {_tag('h', 'h1')} AS heading FROM h""")
def html_titles(spark, sf):
    clean = docs._without_blocks(F.col("html"))
    p = table(spark, sf, "pages").select("page_id", clean.alias("h"))
    return p.select("page_id", docs._tag_text(F.col("h"), "title").alias("title"), docs._tag_text(F.col("h"), "h1").alias("heading"))


@query("html_documents", "PRJ-11 SRC-06 STR-02", f"""WITH {_PAGES} SELECT page_id, title, 'file:///' || source_file AS doc_url, length(body) AS n, sha256(body) AS body_digest FROM p""")
def html_documents(spark, sf):
    d = docs.html_documents(page_files(spark, sf))
    return d.select("page_id", "title", "doc_url", F.length("body").cast("long").alias("n"), F.sha2("body", 256).alias("body_digest"))


@query("document_sections", "GEN-01 WIN-08", f"""WITH {_PAGES}, l AS (SELECT page_id, generate_subscripts(string_split(body, chr(10)), 1) AS i, unnest(string_split(body, chr(10))) AS line FROM p),
 s AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS is_heading FROM l),
 g AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM s),
 t AS (SELECT page_id, sec, coalesce(max(CASE WHEN is_heading THEN regexp_extract(line, '^#{{1,6}}\\s+(\\S.*)$', 1) END), '') AS heading,
  {S.clean("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_heading), '')")} AS text FROM g GROUP BY ALL)
SELECT page_id, heading AS section_path, heading, sha256(text) AS digest FROM t WHERE text <> ''""")
def document_sections(spark, sf):
    d = docs.html_documents(page_files(spark, sf)).select("page_id", F.inline(docs.heading_sections(F.col("body"))))
    return d.select("page_id", "section_path", "heading", F.sha2("text", 256).alias("digest"))


@query("paragraph_sections", "GEN-02", f"""WITH p AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
 s AS (SELECT conv_id, unnest(string_split_regex(body, '\\n{{2,}}')) AS part FROM p) SELECT conv_id, {S.trim('part')} AS part FROM s WHERE {S.trim('part')} <> ''""")
def paragraph_sections(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("part", F.concat("role", F.lit(": "), F.col("text"), F.lit("\n\n\n")))
    return turns.select("conv_id", F.inline(docs.paragraph_sections(F.col("part")))).select("conv_id", F.col("text").alias("part"))


# The cursor of the window chunker as a recursive query: each step looks at the next 2,080 characters.
_MARKS = (r"\n\n", r"\n", ". ", "! ", "? ", "; ", ", ", " ")


def _last(mark):
    m = "chr(10)||chr(10)" if mark == r"\n\n" else "chr(10)" if mark == r"\n" else f"'{mark}'"
    n = 2 if len(mark) == 2 and mark != r"\n" or mark == r"\n\n" else 1
    return (f"(CASE WHEN contains(substr(t, s + 1, 2000 + {n}), {m}) THEN length(substr(t, s + 1, 2000 + {n})) - "
            f"strpos(reverse(substr(t, s + 1, 2000 + {n})), reverse({m})) - {n - 1} ELSE -1 END)")


_CUT = f"greatest({', '.join(_last(m) for m in _MARKS)})"
_WINDOWS = f"""RECURSIVE x AS (SELECT doc_id, {S.clean('text')} AS t FROM documents),
 step AS (SELECT doc_id, t, 0 AS i, 0 AS s, CASE WHEN length(t) <= 2000 THEN length(t) ELSE -1 END AS e FROM x WHERE t <> ''
  UNION ALL SELECT doc_id, t, i + 1, CASE WHEN e < 0 THEN s ELSE greatest(e - 200, s + 1) END,
   CASE WHEN e < 0 THEN (SELECT CASE WHEN s + 2000 >= length(t) THEN length(t) WHEN {_CUT} > 0 THEN s + {_CUT} + 1 ELSE s + 2000 END) ELSE -1 END
  FROM step WHERE e < length(t))"""


@query("window_chunks", "GEN-04", f"""WITH {_WINDOWS}, c AS (SELECT doc_id, s, {S.trim('substr(t, s + 1, e - s)')} AS piece FROM step WHERE e >= 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, length(piece) AS n, sha256(piece) AS digest FROM c WHERE piece <> ''""")
def window_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(cut_windows(F.col("text"), 2000, 200)).alias("chunk_index", "piece"))
    return d.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("piece").cast("long").alias("n"), F.sha2("piece", 256).alias("digest"))


def plain_files(spark, sf):
    """Documents as bare text files."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
                                                F.col("text").alias("raw"))


# A document without blank lines is one paragraph, so its chunks are the plain windows.
_CHUNKS = f"""{_WINDOWS}, w AS (SELECT doc_id, t, s, {S.trim('substr(t, s + 1, e - s)')} AS text FROM step WHERE e >= 0),
 k AS (SELECT doc_id, 'doc-' || doc_id || '.txt' AS source_file, t, text, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM w WHERE text <> ''), c AS (SELECT *, split_part(t, chr(10), 1) AS title FROM k)"""
_CHUNK_ID = S.stable_id('doc', 'source_file', S.stable_id('docsrc', 'source_file', "'0'", 'title'), 'i', "''")


@query("document_chunks", "GEN-03 GEN-05 WIN-03 PRJ-05", f"""WITH {_CHUNKS} SELECT {_CHUNK_ID} AS id, source_file, {S.stable_id('docsrc', 'source_file', "'0'", 'title')} AS document_id,
 i AS chunk_index, n AS chunk_count, sha256(text) AS digest FROM c""")
def document_chunks(spark, sf):
    c = docs.document_chunks(docs.text_documents(plain_files(spark, sf)))
    return c.select("id", "source_file", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("chunk_count").cast("long").alias("chunk_count"), F.sha2("text", 256).alias("digest"))


@query("chunk_items", "PRJ-19 PRJ-07 WIN-03", f"""WITH {_CHUNKS}, named AS (SELECT *, title || ' [' || (i + 1) || '/' || n || ']' AS chunk_title FROM c)
SELECT {_CHUNK_ID} AS id, chunk_title AS title, 'file:///' || source_file || '#chunk=' || i AS url, CAST(i AS VARCHAR) AS chunk_index, CAST(n AS VARCHAR) AS chunk_count, '' AS icon_url,
 {S.capped("""text || chr(10) || chr(10) || 'Connector metadata:' || chr(10) || 'Title: ' || chunk_title || chr(10) || 'Source file: ' || source_file || chr(10) || 'Content type: text/plain' || chr(10)
 || 'Chunk: ' || (i + 1) || ' of ' || n || chr(10) || 'Source URL: file:///' || source_file""")} AS content FROM named""")
def chunk_items(spark, sf):
    items = docs.chunk_items(docs.document_chunks(docs.text_documents(plain_files(spark, sf))))
    p = F.col("properties")
    return items.select("id", "title", "url", p["chunkIndex"].alias("chunk_index"), p["chunkCount"].alias("chunk_count"), p["iconUrl"].alias("icon_url"), "content")


_SECTIONS = f"""l AS (SELECT page_id, generate_subscripts(string_split(body, chr(10)), 1) AS i, unnest(string_split(body, chr(10))) AS line FROM p),
 s AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS is_heading FROM l),
 g AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM s),
 ht AS (SELECT page_id, sec, coalesce(max(CASE WHEN is_heading THEN regexp_extract(line, '^#{{1,6}}\\s+(\\S.*)$', 1) END), '') AS heading,
  {S.clean("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_heading), '')")} AS text FROM g GROUP BY ALL)"""
_GAP = "chr(10) || chr(10)"
# Paragraphs are packed one after the other, and a last pack over the limit is cut by the windows of above.
_PACKS = f"""{_TEXT_DOCS}, {_PAGES}, {_SECTIONS},
 meta AS (SELECT 'd' || doc_id AS k, source_file, 'by: nobody' AS title, '2024-01-' || day AS date, source AS doc_url, 'text/plain' AS mime FROM b
  UNION ALL SELECT 'p' || page_id, source_file, title, '', 'file:///' || source_file, 'text/html' FROM p),
 part AS (SELECT 'd' || doc_id AS k, 0 AS sec, '' AS heading, body AS text FROM b UNION ALL SELECT 'p' || page_id, sec, heading, text FROM ht WHERE text <> ''),
 split AS (SELECT k, sec, heading, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: {S.trim('x')}), lambda x: x <> '') AS pars FROM part),
 pack AS (SELECT k, sec, heading, pars, 1 AS i, pars[1] AS held, NULL::VARCHAR AS closed FROM split WHERE len(pars) > 0
  UNION ALL SELECT k, sec, heading, pars, i + 1,
   CASE WHEN length(held) + 2 + length(pars[i + 1]) <= 2000 OR length(held) < 50 THEN held || {_GAP} || pars[i + 1]
    WHEN {S.trim('right(held, 200)')} = '' THEN pars[i + 1] ELSE {S.trim('right(held, 200)')} || {_GAP} || pars[i + 1] END,
   CASE WHEN length(held) + 2 + length(pars[i + 1]) <= 2000 OR length(held) < 50 THEN NULL ELSE held END FROM pack WHERE i < len(pars)),
 long AS (SELECT k, sec, heading, {S.clean('held')} AS t FROM pack WHERE i = len(pars) AND length(held) > 2000),
 wstep AS (SELECT k, sec, heading, t, 0 AS s, CASE WHEN length(t) <= 2000 THEN length(t) ELSE -1 END AS e FROM long WHERE t <> ''
  UNION ALL SELECT k, sec, heading, t, CASE WHEN e < 0 THEN s ELSE greatest(e - 200, s + 1) END,
   CASE WHEN e < 0 THEN (SELECT CASE WHEN s + 2000 >= length(t) THEN length(t) WHEN {_CUT} > 0 THEN s + {_CUT} + 1 ELSE s + 2000 END) ELSE -1 END FROM wstep WHERE e < length(t)),
 piece AS (SELECT k, sec, heading, i AS place, 0 AS s, closed AS text FROM pack WHERE closed IS NOT NULL
  UNION ALL SELECT k, sec, heading, i + 1, 0, held FROM pack WHERE i = len(pars) AND length(held) <= 2000
  UNION ALL SELECT k, sec, heading, 1000000000, s, {S.trim('substr(t, s + 1, e - s)')} FROM wstep WHERE e >= 0),
 cleaned AS (SELECT k, sec, heading, place, s, {S.clean('text')} AS text FROM piece),
 chunk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sec, place, s) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM cleaned WHERE text <> ''),
 named AS (SELECT *, CASE WHEN heading <> '' THEN title || ' — ' || heading ELSE title || ' [' || (i + 1) || '/' || n || ']' END AS chunk_title FROM chunk JOIN meta USING (k))"""


@query("all_chunk_items", "PRJ-19 GEN-03 GEN-05", f"""WITH RECURSIVE {_PACKS} SELECT {S.stable_id('doc', 'source_file', S.stable_id('docsrc', 'source_file', "'0'", 'title'), 'i', 'heading')} AS id, chunk_title AS title,
 regexp_replace(doc_url, '#.*$', '') || '#chunk=' || i AS url, i AS chunk_index, n AS chunk_count,
 {S.capped("""text || chr(10) || chr(10) || 'Connector metadata:' || chr(10) || 'Title: ' || chunk_title || chr(10) || 'Source file: ' || source_file || chr(10) || 'Content type: ' || mime || chr(10)
 || 'Chunk: ' || (i + 1) || ' of ' || n || CASE WHEN heading <> '' THEN chr(10) || 'Section path: ' || heading ELSE '' END || CASE WHEN date <> '' THEN chr(10) || 'Date published: ' || date ELSE '' END
 || chr(10) || 'Source URL: ' || doc_url""")} AS content FROM named""")
def all_chunk_items(spark, sf):
    both = docs.text_documents(text_files(spark, sf)).drop("doc_id").unionByName(docs.html_documents(page_files(spark, sf)).drop("page_id"))
    items = docs.chunk_items(docs.document_chunks(both))
    return items.select("id", "title", "url", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_count").cast("long").alias("chunk_count"), "content")


def mixed_files(spark, sf):
    """Suppliers as JSON files: an array per nation of those with money, a file each for the others; every nation as text, every page as a page."""
    s = table(spark, sf, "supplier")
    record = F.to_json(F.struct(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("recordId"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    arrays = s.filter("s_acctbal >= 0").groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", record.alias("r")))), lambda x: x["r"]), ",").alias("r"))
    return (arrays.select(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit(".json")).alias("source_file"), F.concat(F.lit("["), F.col("r"), F.lit(',"odd"]')).alias("raw"))
            .unionByName(s.filter("s_acctbal < 0").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("source_file"), record.alias("raw")))
            .unionByName(table(spark, sf, "nation").select(F.concat("n_name", F.lit(".txt")).alias("source_file"), F.concat(F.lit("Author: x\n"), F.col("n_name")).alias("raw")))
            .unionByName(page_files(spark, sf).drop("page_id")))


def _record_body(title: str, ident: str, nation: str) -> str:
    n = "chr(10)"
    return (f"{ident} || ' record.' || {n} || {n} || 'Canonical facts:' || {n} || '- domain: generic' || {n} || '- recordId: ' || {ident} || {n} || {n} || 'Search aliases:' || {n} || '- Domain: generic' || {n} || '- Record Id: ' || {ident}")


@query("mixed_documents", "PRJ-12 PRJ-15 PRJ-18 PRJ-19 GEN-05", f"""WITH {_PAGES}, j AS (SELECT *, s_acctbal >= 0 AS many FROM supplier)
SELECT CASE WHEN many THEN 'nation-' || s_nationkey ELSE 's-' || s_suppkey END || '.json' AS source_file, 'json' AS kind, s_name AS title, 'file:///' || CASE WHEN many THEN 'nation-' || s_nationkey ELSE 's-' || s_suppkey END || '.json' AS doc_url,
 sha256({_record_body('s_name', "'s-' || s_suppkey", 's_nationkey')}) AS digest FROM j
UNION ALL SELECT 'nation-' || s_nationkey || '.json', 'json', 'nation-' || s_nationkey || ' item ' || (count(*) + 1), 'file:///nation-' || s_nationkey || '.json',
 sha256('Canonical facts:' || chr(10) || '- domain: generic' || chr(10) || chr(10) || 'Search aliases:' || chr(10) || '- Domain: generic') FROM j WHERE many GROUP BY s_nationkey
UNION ALL SELECT n_name || '.txt', 'text', n_name, 'file:///' || n_name || '.txt', sha256('Author: x' || chr(10) || n_name) FROM nation
UNION ALL SELECT source_file, 'html', title, 'file:///' || source_file, sha256(body) FROM p""")
def mixed_documents(spark, sf):
    return json_items.documents_by_kind(mixed_files(spark, sf)).select("source_file", "kind", "title", "doc_url", F.sha2("body", 256).alias("digest"))


@query("nested_headings", "GEN-01 WIN-08", """WITH n AS (SELECT item_id, unnest([1, 2, 3, 4]) AS i FROM benchmark)
SELECT item_id, ['Top ' || item_id, 'Top ' || item_id || ' > Skip', 'Top ' || item_id || ' > Skip > Deep', 'Top ' || item_id || ' > Side'][i] AS section_path,
 ['Top ' || item_id, 'Skip', 'Deep', 'Side'][i] AS heading, ['x' || item_id, 'y' || item_id, 'z' || item_id, 'w' || item_id][i] AS text FROM n""")
def nested_headings(spark, sf):
    """Levels 1, 3, 3 and 2: a path keeps the last level - 1 headings by position, so a skipped level closes up and a repeated one nests."""
    n = F.col("item_id").cast("string")
    body = F.concat(F.lit("# Top "), n, F.lit("\nx"), n, F.lit("\n\n### Skip\ny"), n, F.lit("\n### Deep\nz"), n, F.lit("\n## Side\nw"), n)
    return table(spark, sf, "benchmark").select("item_id", F.inline(docs.heading_sections(body))).select("item_id", "section_path", "heading", "text")


@query("packed_paragraphs", "GEN-03 GEN-05", """WITH n AS (SELECT item_id, unnest([0, 1]) AS i FROM benchmark)
SELECT item_id, i::BIGINT AS chunk_index, CASE i WHEN 0 THEN repeat('a', 2500) ELSE repeat('a', 200) || chr(10) || chr(10) || 'tail ' || item_id END AS text FROM n""")
def packed_paragraphs(spark, sf):
    """A paragraph over the limit stays whole; the next chunk starts with its last 200 characters."""
    body = F.concat(F.repeat(F.lit("a"), F.lit(2500)), F.lit("\n\n"), F.lit("tail "), F.col("item_id").cast("string"))
    chunks = table(spark, sf, "benchmark").select("item_id", F.posexplode(packed_chunks(body, 2000, 200)).alias("chunk_index", "text"))
    return chunks.select("item_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def event_json(spark, sf):
    """Events as nested records."""
    nested = F.struct(F.col("event_id").cast("string").alias("recordId"), F.concat(F.col("event_type"), F.lit(" event")).alias("title"),
                      F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.array("event_type", F.lit("")).alias("tags"),
                               F.col("user_id").alias("userId"), F.lit(None).cast("string").alias("gone")).alias("customProperties"))
    events = dealt(spark.read.parquet(f"{sf}/events.parquet"), FLAT_ROWS)
    return events.select("event_id", F.lit("events.jsonl").alias("source_file"), (F.col("event_id") + 1).alias("line"), F.to_json(nested).alias("value"))


_EVENT = """e AS (SELECT event_id, event_type AS t, user_id AS u, json_extract_string(props, '$.k') AS k FROM events)"""


@query("json_flatten_search", "PRJ-13a JSN-04 MAP-01", f"""WITH {_EVENT} SELECT event_id, unnest(['recordId','title','customProperties.k','k','customProperties.tags','tags','customProperties.userId','userId']) AS key,
 unnest([CAST(event_id AS VARCHAR), t || ' event', k, k, t, t, CAST(u AS VARCHAR), CAST(u AS VARCHAR)]) AS value FROM e""")
def json_flatten_search(spark, sf):
    return entry_rows(with_search_entries(event_json(spark, sf), "value", "e"), "e", "event_id")


@query("json_flatten_identity", "PRJ-13b", f"""WITH {_EVENT} SELECT event_id, unnest(['recordId','title','customProperties.k','customProperties.tags','customProperties.userId']) AS key,
 unnest([CAST(event_id AS VARCHAR), t || ' event', k, t, CAST(u AS VARCHAR)]) AS value FROM e""")
def json_flatten_identity(spark, sf):
    return entry_rows(with_identity_entries(event_json(spark, sf), "value", "e"), "e", "event_id")


@query("json_flatten_eval", "PRJ-13c", f"""WITH {_EVENT} SELECT event_id, unnest(['recordId','title','customProperties.k','customProperties.tags','customProperties.userId']) AS key,
 unnest([CAST(event_id AS VARCHAR), t || ' event', k, t, CAST(u AS VARCHAR)]) AS value FROM e""")
def json_flatten_eval(spark, sf):
    return entry_rows(with_eval_entries(event_json(spark, sf), "value", "e"), "e", "event_id")


DEEP = 20
_PATHS = [".".join(f"k{k}" for k in range(DEEP, i, -1)) for i in range(DEEP + 1)]  # of the object on level i, 0 being the innermost


def deep_json(spark, sf):
    """Customers as records of twenty-one levels, each with a name of its own before the next level."""
    record = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('-0","tags":["'), F.col("c_mktsegment"), F.lit('",'), F.col("c_custkey").cast("string"), F.lit("]}"))
    for i in range(1, DEEP + 1):
        record = F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit(f'-{i}","k{i}":'), record, F.lit("}"))
    return dealt(table(spark, sf, "customer"), DEEP_ROWS).select("c_custkey", record.alias("value"))


def _deep_entries(tags: str, outer: str, aliases: str = "") -> str:
    names = ", ".join(f"{{'key': '{p}.name', 'value': c_name || '-{i}'}}" for i, p in enumerate(_PATHS[:-1]))
    entries = f"[{{'key': 'name', 'value': c_name || '-{outer}'}}, {names}, {{'key': '{_PATHS[0]}.tags', 'value': {tags}}}{aliases}]"
    return f"SELECT c_custkey, e.key AS key, e.value AS value FROM (SELECT c_custkey, unnest({entries}) AS e FROM customer)"


@query("deep_search_entries", "PRJ-13a", _deep_entries("c_mktsegment || '; ' || c_custkey", "0", ", {'key': 'tags', 'value': c_mktsegment || '; ' || c_custkey}"))
def deep_search_entries(spark, sf):
    """The innermost name is the alias, as the last nested member that has one gives it."""
    return entry_rows(with_search_entries(deep_json(spark, sf), "value", "e"), "e", "c_custkey")


@query("deep_identity_entries", "PRJ-13b", _deep_entries("c_mktsegment || ', ' || c_custkey", str(DEEP)))
def deep_identity_entries(spark, sf):
    return entry_rows(with_identity_entries(deep_json(spark, sf), "value", "e"), "e", "c_custkey")


@query("deep_eval_entries", "PRJ-13c", _deep_entries("c_mktsegment || ', ' || c_custkey", str(DEEP)))
def deep_eval_entries(spark, sf):
    return entry_rows(with_eval_entries(deep_json(spark, sf), "value", "e"), "e", "c_custkey")


_BREAK = "chr(10) || chr(10)"
_DEEP_OUTLINE = " || ".join([f"'- Name: ' || c_name || '-{i}' || {_BREAK} || repeat('#', least({DEEP - i + 2}, 6)) || ' K{i}' || {_BREAK}" for i in range(DEEP, 0, -1)])


@query("deep_outline", "PRJ-14", f"SELECT c_custkey, {_DEEP_OUTLINE} || '- Name: ' || c_name || '-0' || {_BREAK} || '###### Tags' || {_BREAK} || '- ' || c_mktsegment || {_BREAK} || '- ' || c_custkey AS outline FROM customer")
def deep_outline(spark, sf):
    return with_outline(deep_json(spark, sf), "value", "outline").select("c_custkey", "outline")


@query("json_flatten_level1", "PRJ-16 JSN-04", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events")
def json_flatten_level1(spark, sf):
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    e = table(spark, sf, "events").withColumn("e", entries)
    picked = docs.pick_value(F.col("e"), "K")
    return e.select("event_id", F.lit("k").alias("key"), picked.alias("value"), picked.try_cast("double").alias("number"))


@query("json_outline", "PRJ-14", f"""WITH {_EVENT} SELECT event_id, '- Record Id: ' || event_id || chr(10) || chr(10) || '- Title: ' || t || ' event' || chr(10) || chr(10) || '## Custom Properties' || chr(10) || chr(10) || '- K: ' || k
 || chr(10) || chr(10) || '### Tags' || chr(10) || chr(10) || '- ' || t || chr(10) || chr(10) || '-' || chr(10) || chr(10) || '- User Id: ' || u AS outline FROM e""")
def json_outline(spark, sf):
    return with_outline(event_json(spark, sf), "value", "outline").select("event_id", "outline")


_STRUCT = """t || ' event record.' || chr(10) || chr(10) || 'Canonical facts:' || chr(10) || '- domain: generic' || chr(10) || '- recordId: ' || event_id || chr(10) || '- title: ' || t || ' event' || chr(10) || chr(10)
 || 'Exact source fields:' || chr(10) || '- customProperties.k: ' || k || chr(10) || '- customProperties.tags: ' || t || chr(10) || '- customProperties.userId: ' || u || chr(10) || chr(10)
 || 'Search aliases:' || chr(10) || '- Domain: generic' || chr(10) || '- Record Id: ' || event_id || chr(10) || '- Title: ' || t || ' event' || chr(10) || chr(10) || 'Summary:' || chr(10) || t || ' event record.'"""


@query("structured_items", "PRJ-12 PRJ-15 PRJ-18 PRJ-16 PRJ-17 SRC-05", f"""WITH {_EVENT}, c AS (SELECT *, 'events.jsonl#line-' || (event_id + 1) AS place, t || ' event' AS ti, {_STRUCT} AS body FROM e)
SELECT {S.stable_id('doc', 'place', S.stable_id('docsrc', 'place', "'0'", 'ti'), '0', "''")} AS id, ti AS title, 'file:///events.jsonl#chunk=0' AS url, 'generic' AS domain, CAST(event_id AS VARCHAR) AS record_id,
 {S.capped('''body || chr(10) || chr(10) || 'Connector metadata:' || chr(10) || 'Title: ' || ti || ' — ' || ti || chr(10) || 'Source file: ' || place || chr(10) || 'Content type: application/jsonl' || chr(10)
 || 'Chunk: 1 of 1' || chr(10) || 'Source URL: file:///' || place''')} AS content FROM c""")
def structured_items(spark, sf):
    items = json_items.json_line_items(event_json(spark, sf).drop("event_id"))
    p = F.col("properties")
    return items.select("id", p["title"].alias("title"), "url", p["domain"].alias("domain"), p["recordId"].alias("record_id"), "content")


@query("markdown_documents", "PRJ-10", f"""WITH d AS (SELECT doc_id, source, {S.clean("text")} AS t FROM documents WHERE NOT regexp_matches(text, '[*_`~\\[\\]#]'))
SELECT doc_id, 'Doc ' || doc_id AS title, source AS author, sha256('# H ' || doc_id || chr(10) || chr(10) || 'Image: pic' || chr(10) || 'site (http://x/y)' || chr(10) || 'bold' || chr(10) || t) AS body_digest FROM d""")
def markdown_documents(spark, sf):
    """Documents free of markup signs, wrapped in Markdown whose plain form is known."""
    d = table(spark, sf, "documents").filter(~F.col("text").rlike(r"[*_`~\[\]#]"))
    raw = F.concat(F.lit("---\ntitle: \"Doc "), F.col("doc_id").cast("string"), F.lit("\"\nauthor: "), F.col("source"), F.lit("\ntitle: other\n---\n# H "),
                   F.col("doc_id").cast("string"), F.lit("\n\n\n![pic](a.png)\n[site](http://x/y)\n**bold**\n"), F.col("text"))
    files = d.select("doc_id", F.lit("x.md").alias("source_file"), raw.alias("raw"))
    return docs.markdown_documents(files).select("doc_id", "title", "author", F.sha2("body", 256).alias("body_digest"))

