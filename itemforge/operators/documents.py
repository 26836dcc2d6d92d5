"""Documents: text, Markdown, HTML and JSON to titled bodies, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import ids
from itemforge.functions import numbers as nm
from itemforge.functions import text as tx
from itemforge.functions.chunks import packed_chunks
from itemforge.functions.fixed import AUTHOR_KEYS, DATE_KEYS, ICON_KEYS, URL_KEYS
from itemforge.operators.records import access_entries, capped

CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200

# Extension to document kind, kind to media type.
KINDS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "html": "html",
         "htm": "html", "json": "json", "jsonl": "jsonl"}
MEDIA_TYPES = {"text": "text/plain", "markdown": "text/markdown", "html": "text/html",
               "json": "application/json", "jsonl": "application/jsonl"}

# Patterns of a text head and of a heading line.
_TEXT_META = r"(?i)^(author|byline|date|published|source|url)\s*:\s*(.+)$"
_HEADING = r"^(#{1,6})\s+(\S.*)$"

# Markup removed with its content, and markup that ends a line.
_DROPPED_BLOCKS = ("script", "style", "nav", "footer", "form", "noscript")
_LINE_TAGS = ("article|aside|blockquote|br|div|li|main|ol|p|pre|section|table|tbody|td|th|tr|ul")


def kind_of(ext: Column) -> Column:
    out = F.lit("text")
    for name, kind in KINDS.items():
        out = F.when(ext == name, F.lit(kind)).otherwise(out)
    return out


def media_type(kind: Column) -> Column:
    out = F.lit(MEDIA_TYPES["text"])
    for name, mime in MEDIA_TYPES.items():
        out = F.when(kind == name, F.lit(mime)).otherwise(out)
    return out


def first_by_key(entries: Column, *keys: str) -> Column:
    """Value of the first entry for each key in turn; blank when none is filled."""
    def pick(key: str) -> Column:
        return tx.first_of(F.filter(entries, lambda e: (e["key"] == F.lit(key)) & (e["value"] != "")))["value"]
    return F.coalesce(*[pick(k) for k in keys], F.lit(""))


def keep_first(entries: Column) -> Column:
    """Entries with later repeats of a key removed."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def _document(df: DataFrame, kind: str, *, title: Column, body: Column, entries: Column, author: Column, date: Column,
              url: Column) -> DataFrame:
    kept = F.filter(keep_first(entries), lambda e: tx.trimmed(e["value"]) != "")
    return df.select(*[c for c in df.columns if c not in ("raw", "body", "entries")], F.lit(kind).alias("kind"),
                     title.alias("title"), author.alias("author"), date.alias("date"), url.alias("doc_url"),
                     body.alias("body"), F.map_from_entries(kept).alias("metadata"))


def text_documents(df: DataFrame, url_prefix: str = "") -> DataFrame:
    """``source_file`` and ``raw`` to a document with metadata read from its first twelve lines."""
    staged = df.withColumn("body", tx.clean_content(F.col("raw")))
    lines = F.split("body", "\n")
    marked = F.filter(F.slice(lines, 1, 12), lambda x: x.rlike(_TEXT_META))
    entries = F.transform(marked, lambda x: F.struct(
        F.lower(F.regexp_extract(x, _TEXT_META, 1)).alias("key"),
        tx.trimmed(F.regexp_extract(x, _TEXT_META, 2)).alias("value")))
    staged = staged.withColumn("entries", entries)
    e = F.col("entries")
    plain = F.filter(lines, lambda x: (x != "") & ~x.rlike(_TEXT_META))
    title = F.coalesce(F.get(plain, F.lit(0)), tx.file_stem(F.col("source_file")))
    link = first_by_key(e, "source", "url")
    return _document(staged, "text", title=title, body=F.col("body"), entries=e,
                     author=first_by_key(e, "author", "byline"), date=first_by_key(e, "date", "published"),
                     url=F.when(link != "", link).otherwise(ids.document_url(F.col("source_file"), url_prefix)))


_FRONT = r"^---\s*\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)\s*\r?\n"


def markdown_plain(c: Column) -> Column:
    """Images and links spelled out, emphasis marks dropped."""
    image = F.regexp_replace(c, r"!\[\s*([^\]]*?)\s*\]\(([^)]+)\)", "Image: $1\u0001$2\u0002")
    image = F.regexp_replace(image, "Image: \u0001\\s*([^\u0002]*?)\\s*\u0002", "Image: $1")
    image = F.regexp_replace(image, "\u0001[^\u0002]*\u0002", "")
    return F.regexp_replace(F.regexp_replace(image, r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)"), "[*_`~]+", "")


def markdown_documents(df: DataFrame, url_prefix: str = "") -> DataFrame:
    raw = F.col("raw")
    front = F.regexp_extract(raw, _FRONT, 1)
    lines = F.filter(F.split(front, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.filter(F.transform(lines, lambda x: F.struct(
        tx.norm_key(F.substring_index(x, ":", 1)).alias("key"),
        F.regexp_replace(tx.trimmed(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']|[\"']$", "").alias("value"))),
        lambda e: e["value"] != "")
    staged = df.withColumn("entries", entries).withColumn(
        "body", tx.clean_content(markdown_plain(F.regexp_replace(raw, _FRONT, ""))))
    e = F.col("entries")
    heads = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_extract(x, _HEADING, 2)), lambda x: x != "")
    named, link = first_by_key(e, "title"), first_by_key(e, "url")
    title = F.coalesce(F.when(named != "", named), F.get(heads, F.lit(0)), tx.file_stem(F.col("source_file")))
    return _document(staged, "markdown", title=title, body=F.col("body"), entries=e, author=first_by_key(e, "author"),
                     date=first_by_key(e, "date", "published"),
                     url=F.when(link != "", link).otherwise(ids.document_url(F.col("source_file"), url_prefix)))


def _without_blocks(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in _DROPPED_BLOCKS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return out


def _tag_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return tx.decode_entities(tx.trimmed(F.regexp_replace(inner, "<[^>]+>", " ")))


def _html_body(html: Column) -> Column:
    pattern = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"
    around = F.split(html, pattern, -1)
    levels = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    inner = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), lambda x: tx.decode_entities(tx.trimmed(
        F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "[ \t]+", " "))))
    marks = F.zip_with(levels, inner, lambda n, x: F.when(x == "", F.lit("\n")).otherwise(
        F.concat(F.lit("\n"), F.repeat(F.lit("#"), n.cast("int")), F.lit(" "), x, F.lit("\n"))))
    marked = F.array_join(F.zip_with(around, marks, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")
    lined = F.regexp_replace(marked, rf"(?i)</?({_LINE_TAGS})\b[^>]*>", "\n")
    return tx.clean_content(F.regexp_replace(lined, "<[^>]+>", " "))


def html_documents(df: DataFrame, url_prefix: str = "") -> DataFrame:
    """Page markup to a document: metadata tags, canonical link, headings as ``#`` markers."""
    staged = df.withColumn("raw", _without_blocks(F.col("raw")))
    html = F.col("raw")
    meta = r"(?i)<meta\b[^>]*(?:name|property)\s*=\s*[\"']([^\"']+)[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*>"
    metas = F.zip_with(F.regexp_extract_all(html, F.lit(meta), F.lit(1)), F.regexp_extract_all(html, F.lit(meta), F.lit(2)),
                       lambda k, v: F.struct(tx.norm_key(k).alias("key"), tx.trimmed(tx.decode_entities(v)).alias("value")))
    links = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<link\b([^>]*)>"), F.lit(1)), lambda a: F.struct(
        F.split(F.lower(F.regexp_extract(a, r"(?i)(?<![\w:.-])rel\s*=\s*[\"']([^\"']*)[\"']", 1)), r"\s+").alias("rel"),
        tx.trimmed(F.regexp_extract(a, r"(?i)(?<![\w:.-])href\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("href")))
    staged = (staged.withColumn("_meta", metas).withColumn("_links", links)
              .withColumn("_title", _tag_text(html, "title")).withColumn("_h1", _tag_text(html, "h1"))
              .withColumn("body", _html_body(html)))

    def from_meta(keys) -> Column:
        return tx.first_of(F.filter("_meta", lambda m: m["key"].isin(*keys) & (m["value"] != "")))["value"]

    def from_link(rel: str) -> Column:
        return tx.first_of(F.filter("_links", lambda x: F.array_contains(x["rel"], rel) & (x["href"] != "")))["href"]

    blank = F.lit("")
    title = F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("_h1"))
    author, date = F.coalesce(from_meta(AUTHOR_KEYS), blank), F.coalesce(from_meta(DATE_KEYS), blank)
    link = F.coalesce(from_meta(URL_KEYS), from_link("canonical"), blank)
    icon = F.coalesce(from_meta(ICON_KEYS), from_link("icon"), blank)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (
        ("title", title), ("author", author), ("date", date), ("iconUrl", icon), ("url", link))])
    out = _document(staged, "html", title=F.when(title != "", title).otherwise(tx.file_stem(F.col("source_file"))),
                    body=F.col("body"), entries=entries, author=author, date=date,
                    url=F.when(link != "", link).otherwise(ids.document_url(F.col("source_file"), url_prefix)))
    return out.drop("_meta", "_links", "_title", "_h1")


def heading_sections(body: Column) -> Column:
    """``array<struct<section_path,heading,text>>`` cut at heading lines. A path keeps the last
    ``level - 1`` headings by position, so skipped levels close up and repeated ones nest."""
    parts = F.split(F.regexp_replace(body, r"(?md)^(?=#{1,6}[ \t]+\S)", "\u0001"), "\u0001", -1)
    cut = F.transform(parts, lambda p: F.struct(
        F.length(F.regexp_extract(F.substring_index(p, "\n", 1), _HEADING, 1)).alias("level"),
        tx.trimmed(F.regexp_extract(F.substring_index(p, "\n", 1), _HEADING, 2)).alias("heading"),
        p.alias("part")))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, s: Column) -> Column:
        stack = F.when(s["level"] == 0, acc["stack"]).otherwise(
            F.concat(F.slice(acc["stack"], F.lit(1), F.greatest(s["level"] - 1, F.lit(0))), F.array(s["heading"])))
        return F.struct(stack.alias("stack"), F.concat(acc["paths"], F.array(F.array_join(stack, " > "))).alias("paths"))

    def placed(rows: Column) -> Column:
        paths = F.aggregate(rows, start, step, lambda acc: acc["paths"])
        return F.zip_with(rows, paths, lambda s, path: F.struct(
            path.alias("section_path"), s["heading"].alias("heading"), tx.clean_content(F.when(s["level"] == 0, s["part"]).otherwise(
                F.regexp_replace(s["part"], r"^[^\n]*\n?", ""))).alias("text")))
    kept = F.filter(tx.let(cut, placed), lambda s: s["text"] != "")
    return tx.let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(_one_section(body)))


def _one_section(body: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("section_path"), F.lit("").alias("heading"), body.alias("text")))


def paragraph_sections(body: Column) -> Column:
    """Blank-line separated sections."""
    parts = F.filter(F.transform(F.split(body, r"\n{2,}"), lambda p: tx.trimmed(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.lit("").alias("section_path"), F.lit("").alias("heading"), p.alias("text")))


def sections(kind: Column, body: Column) -> Column:
    return (F.when(kind.isin("markdown", "html"), heading_sections(body))
            .when(kind == "jsonl", paragraph_sections(body))
            .when(body != "", _one_section(body)))


def document_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk. Sections stay inside their document row, so cutting and numbering need no shuffle."""
    with_sections = docs.withColumn("_s", sections(F.col("kind"), F.col("body")))
    cut = with_sections.withColumn("_c", F.transform("_s", lambda s: packed_chunks(s["text"], size, overlap)))
    merged = F.flatten(F.zip_with("_s", "_c", lambda s, c: F.transform(c, lambda t: F.struct(
        s["section_path"].alias("section_path"), s["heading"].alias("heading"), t.alias("text")))))
    whole = F.array(F.struct(F.lit("").alias("section_path"), F.lit("").alias("heading"), F.substring("body", 1, size).alias("text")))
    chosen = tx.let(merged, lambda m: F.when(F.size(m) > 0, m).when(F.col("body") != "", whole))
    staged = cut.withColumns({"_k": chosen, "structured": structured_properties(F.map_entries("metadata"))}).drop("_s", "_c")
    doc_id = ids.document_id(F.col("source_file"), F.col("title"))
    # The outer form keeps the optimizer from deriving a filter on the chunks, which would cut every text again below the scan.
    return (staged.select(*docs.columns, "structured", F.size("_k").alias("chunk_count"), F.posexplode_outer("_k").alias("chunk_index", "_p"))
            .filter("chunk_index is not null")
            .select(*docs.columns, "structured", "chunk_index", "chunk_count", "_p.section_path", "_p.heading", "_p.text",
                    doc_id.alias("document_id"))
            .withColumn("id", ids.chunk_id(F.col("source_file"), F.col("document_id"), F.col("chunk_index"), F.col("section_path"))))


# Structured keys carried from record metadata into item properties.
STRUCTURED_KEYS = (
    "recordId", "title", "summary", "recordType", "lastModified", "domain", "cmsDatasetId", "cmsDatasetTitle",
    "measureName", "providerName", "facilityType", "reportingPeriod", "geography", "metricValue", "methodologyUrl",
    "packageName", "displayName", "recordCount", "bytes", "status", "npi", "providerType", "organizationName",
    "taxonomyCodes", "taxonomyDescriptions", "primaryTaxonomyCode", "primaryTaxonomyDescription", "practiceAddress",
    "mailingAddress", "phoneNumber", "faxNumber", "enumerationDate", "nppesLastUpdatedDate", "code", "codeSystem",
    "shortDescription", "longDescription", "chapter", "category", "parentCode", "releaseYear", "effectiveDate")


def chunk_items(chunks: DataFrame, access: str = "everyone") -> DataFrame:
    """Search item per chunk; the icon link is always present, also when blank."""
    n = (F.col("chunk_index") + 1).cast("string")
    count = F.col("chunk_count").cast("string")
    title = F.when(F.col("heading") != "", F.concat(F.col("title"), F.lit(" — "), F.col("heading"))).otherwise(
        F.concat(F.col("title"), F.lit(" ["), n, F.lit("/"), count, F.lit("]")))
    mime = media_type(F.col("kind"))

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    content = F.concat_ws(
        "\n", F.col("text"), F.lit("\nConnector metadata:"), F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Source file: "), F.col("source_file")), F.concat(F.lit("Content type: "), mime),
        F.concat(F.lit("Chunk: "), n, F.lit(" of "), count), line("Section path", F.col("section_path")),
        line("Author", F.col("author")), line("Date published", F.col("date")), line("Source URL", F.col("doc_url")))
    base = F.regexp_replace(F.when(F.col("doc_url") != "", F.col("doc_url")).otherwise(
        ids.document_url(F.col("source_file"))), "#.*$", "")
    url = F.concat(base, F.lit("#chunk="), F.col("chunk_index").cast("string"))
    core = [("title", title), ("itemType", F.lit("document-chunk")), ("url", url), ("sourceFile", F.col("source_file")),
            ("documentId", F.col("document_id")), ("contentType", mime), ("sectionPath", F.col("section_path")),
            ("chunkIndex", F.col("chunk_index").cast("string")), ("chunkCount", count),
            ("author", F.col("author")), ("datePublished", F.col("date"))]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in core])
    picked = F.col("structured")
    # a structured value of the same name replaces the core one, except author and date
    structured_names = F.transform(picked, lambda e: e["key"])
    kept_core = F.filter(entries, lambda e: (e["value"] != "") & ~F.array_contains(structured_names, e["key"]))
    icon = F.coalesce(F.try_element_at("metadata", F.lit("iconUrl")), F.lit(""))
    props = F.map_from_entries(F.concat(kept_core, picked, F.array(F.struct(F.lit("iconUrl").alias("key"), icon.alias("value")))))
    return chunks.select("id", F.lit("document-chunk").alias("item_type"), title.alias("title"), url.alias("url"),
                         "source_file", "document_id", mime.alias("content_type"), "section_path", "chunk_index",
                         "chunk_count", "author", F.col("date").alias("date_published"), props.alias("properties"),
                         capped(content).alias("content"), access_entries(access).alias("acl"))


def with_norms(entries: Column) -> Column:
    """Entries with their normalized key alongside."""
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), tx.norm_key(e["key"]).alias("norm")))


def _squeezed(key: str) -> str:
    return "".join(ch for ch in key.lower() if ch.isascii() and ch.isalnum())


def pick_values(entries: Column, keys, suffix: bool = True) -> Column:
    """(key, value) for each wanted key the entries can answer: the exact key if filled, else the first
    key whose normalized form equals (or ends with) the wanted one.

    A joined list of the normalized keys rules out most wanted keys with one text search each.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(_squeezed(k)).alias("norm"),
                                F.lit(_squeezed(k) + "|" if suffix else f"|{_squeezed(k)}|").alias("mark")) for k in keys])

    def one(rows: Column, w: Column) -> Column:
        exact = tx.first_of(F.filter(rows, lambda e: (e["key"] == w["key"]) & (e["value"] != "")))
        close = tx.first_of(F.filter(rows, lambda e: e["norm"].endswith(w["norm"]) if suffix else e["norm"] == w["norm"]))
        return F.struct(w["key"].alias("key"), F.coalesce(exact["value"], close["value"], F.lit("")).alias("value"))

    def answer(rows: Column) -> Column:
        marks = F.concat(F.lit("|"), F.array_join(F.transform(rows, lambda e: e["norm"]), "|"), F.lit("|"))
        return tx.let(marks, lambda m: F.transform(F.filter(wanted, lambda w: F.contains(m, w["mark"])), lambda w: one(rows, w)))
    return tx.let(with_norms(entries), answer)


def pick_value(entries: Column, key: str, suffix: bool = True) -> Column:
    return F.coalesce(tx.first_of(pick_values(entries, [key], suffix))["value"], F.lit(""))


# Structured keys that are numbers when they parse.
NUMBER_KEYS = ("bytes", "recordCount", "metricValue")


def structured_properties(entries: Column) -> Column:
    """Filled structured keys as (key, value) entries."""
    def shaped(e: Column) -> Column:
        number = F.when(e["key"].isin(*NUMBER_KEYS) & nm.is_finite(e["value"]), nm.number_text(e["value"].try_cast("double")))
        return F.struct(e["key"].alias("key"), F.coalesce(number, e["value"]).alias("value"))
    filled = F.filter(pick_values(entries, STRUCTURED_KEYS), lambda e: e["value"] != "")
    return F.when(F.size(entries) > 0, F.transform(filled, shaped)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
