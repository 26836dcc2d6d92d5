"""JSON records: flattening, domain, structured text and one item per line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import ids
from itemforge.functions import text as tx
from itemforge.functions.json_tree import is_json, parsed_json, record_roles, with_search_entries
from itemforge.operators.documents import (STRUCTURED_KEYS, chunk_items, html_documents, kind_of, markdown_documents, pick_values, structured_properties,
                                           text_documents, with_norms)
from itemforge.session import filter_settled

BODY_LIMIT = 30_000

# Canonical fact order per record domain.
DOMAIN_ORDER = {
    "cms": ("recordId", "title", "summary", "recordType", "lastModified", "cmsDatasetId", "cmsDatasetTitle",
            "measureName", "providerName", "facilityType", "reportingPeriod", "geography", "metricValue",
            "methodologyUrl"),
    "npi": ("npi", "providerName", "organizationName", "providerType", "recordId", "title", "taxonomyCodes",
            "taxonomyDescriptions", "primaryTaxonomyCode", "primaryTaxonomyDescription", "practiceAddress",
            "mailingAddress", "phoneNumber", "faxNumber", "enumerationDate", "nppesLastUpdatedDate"),
    "icd10": ("code", "codeSystem", "shortDescription", "longDescription", "chapter", "category", "parentCode",
              "releaseYear", "effectiveDate", "recordId", "title", "summary"),
    "generic": ("recordId", "title", "summary", "recordType", "lastModified", "packageName", "displayName",
                "recordCount", "bytes", "status"),
}

# Keys whose presence decides a domain, tried in this order.
DOMAIN_MARKS = {
    "npi": ("taxonomycodes", "taxonomydescriptions", "providertype", "practiceaddress"),
    "icd10": ("codesystem", "shortdescription", "longdescription", "chapter", "parentcode"),
    "cms": ("cmsdatasetid", "cmsdatasettitle", "measurename", "facilitytype", "methodologyurl", "reportingperiod"),
}


def infer_domain(entries: Column) -> Column:
    """Record domain from key presence and value patterns; first match wins."""
    def decide(rows: Column) -> Column:
        keys = F.transform(rows, lambda e: e["norm"])

        def has(domain: str) -> Column:
            return F.arrays_overlap(keys, F.array(*[F.lit(k) for k in DOMAIN_MARKS[domain]]))

        def exact(key: str) -> Column:
            hit = tx.first_of(F.filter(rows, lambda e: (e["key"] == F.lit(key)) & (e["value"] != "")))
            return F.coalesce(hit["value"], tx.first_of(F.filter(rows, lambda e: e["norm"] == key.lower()))["value"], F.lit(""))
        return (F.when(has("npi") | exact("npi").rlike(r"^\d{10}$"), "npi")
                .when(has("icd10") | exact("codeSystem").rlike("(?i)icd-?10") | exact("code").rlike("^[A-TV-Z][0-9][0-9A-Z]"), "icd10")
                .when(has("cms"), "cms").otherwise("generic"))
    return tx.let(with_norms(entries), decide)


def _sentence(*parts: Column) -> Column:
    return F.concat(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " — "), F.lit("."))


def _after(label: str, value: Column) -> Column:
    return tx.let(value, lambda v: F.when(v != "", F.concat(F.lit(f"{label} "), v)).otherwise(""))


def _either(*values: Column) -> Column:
    return F.coalesce(tx.first_of(F.filter(F.array(*values), lambda v: v != "")), F.lit(""))


# Keys that must match whole, not by their ending.
_WHOLE_KEYS = ("npi", "recordId", "code", "cmsDatasetTitle", "title")


def _canonical_sentence(domain: Column, pick, whole) -> Column:
    """One sentence that names the record; blank when its key value is missing."""
    npi, code = _either(whole("npi"), whole("recordId")), _either(whole("code"), whole("recordId"))
    dataset = _either(whole("cmsDatasetTitle"), whole("title"))
    title = _either(pick("title"), pick("displayName"), pick("recordId"))
    texts = {
        "npi": (npi, _sentence(_after("NPI", npi), _either(pick("providerName"), pick("organizationName"), pick("title")),
                               pick("providerType"),
                               _after("primary taxonomy", _either(pick("primaryTaxonomyDescription"), pick("taxonomyDescriptions"))),
                               _after("practice address", pick("practiceAddress")))),
        "icd10": (code, _sentence(F.concat(_either(pick("codeSystem"), F.lit("ICD-10")), F.lit(" code "), code),
                                  _either(pick("longDescription"), pick("shortDescription"), pick("summary")),
                                  _after("chapter", pick("chapter")))),
        "cms": (dataset, _sentence(_after("CMS dataset", dataset), _after("measure", pick("measureName")),
                                   _after("reporting period", pick("reportingPeriod")), _after("geography", pick("geography")))),
        "generic": (title, F.concat(title, F.lit(" record."))),
    }
    out = F.lit("")
    for name, (key, text) in texts.items():
        out = F.when((domain == name) & (key != ""), text).otherwise(out)
    return out


_NO_ENTRIES = "array<struct<key:string,value:string>>"


def with_structured(df: DataFrame, entries: str, json_text: str) -> DataFrame:
    """Add ``domain``, ``structured`` (filled structured keys) and ``content`` (sentence, canonical facts,
    exact source fields, search aliases, summary) for the record in ``entries``.

    Each step is its own column, so every pick is made once per record.
    """
    staged = df.withColumn("domain", infer_domain(F.col(entries)))
    staged = staged.withColumn("_listed", F.concat(
        F.filter(entries, lambda e: e["key"] != "domain"),
        F.array(F.struct(F.lit("domain").alias("key"), F.col("domain").alias("value")))))
    staged = staged.withColumns({"_picked": pick_values(F.col("_listed"), STRUCTURED_KEYS),
                                 "_whole": pick_values(F.col("_listed"), _WHOLE_KEYS, suffix=False)})
    staged = staged.withColumns({"_pm": F.map_from_entries("_picked"), "_wm": F.map_from_entries("_whole")})

    def pick(key: str) -> Column:
        return F.coalesce(F.try_element_at("_pm", F.lit(key)), F.lit(""))

    def whole(key: str) -> Column:
        return F.coalesce(F.try_element_at("_wm", F.lit(key)), F.lit(""))
    order = F.array(*[F.lit(k) for k in dict.fromkeys(("domain", *DOMAIN_ORDER["generic"], *STRUCTURED_KEYS))])
    for name in ("cms", "icd10", "npi"):
        keys = dict.fromkeys(("domain", *DOMAIN_ORDER[name], *STRUCTURED_KEYS))
        order = F.when(F.col("domain") == name, F.array(*[F.lit(k) for k in keys])).otherwise(order)
    placed = F.transform(F.filter("_picked", lambda e: e["value"] != ""), lambda e: F.struct(F.array_position(order, e["key"]).alias("place"), e["key"].alias("key"), e["value"].alias("value")))
    canonical = F.sort_array(placed)
    staged = staged.withColumns({
        "_canonical": canonical, "_exact": F.filter("_listed", lambda e: F.contains(e["key"], F.lit("."))),
        "_sentence": _canonical_sentence(F.col("domain"), pick, whole),
        "_title": _either(pick("title"), pick("displayName"), pick("cmsDatasetTitle"))})

    def bullets(rows: str, label=None) -> Column:
        return F.array_join(F.transform(rows, lambda e: F.concat(
            F.lit("- "), e["key"] if label is None else label(e["key"]), F.lit(": "), e["value"])), "\n")
    text = F.concat_ws(
        "\n",
        F.when(F.col("_sentence") != "", F.concat(F.col("_sentence"), F.lit("\n"))),
        F.concat(F.lit("Canonical facts:\n"), bullets("_canonical")),
        F.when(F.size("_exact") > 0, F.concat(F.lit("\nExact source fields:\n"), bullets("_exact"))),
        F.concat(F.lit("\nSearch aliases:\n"), bullets("_canonical", tx.humanize_json_key)),
        F.when(pick("summary") != "", F.concat(F.lit("\nSummary:\n"), pick("summary")))
        .when(F.col("_title") != "", F.concat(F.lit("\nSummary:\n"), F.col("_title"), F.lit(" record."))))
    out = staged.withColumn("content", F.when(F.col(json_text).isNotNull(), text))
    return out.drop("_listed", "_picked", "_whole", "_pm", "_wm", "_canonical", "_exact", "_sentence", "_title")


def _role(entries: str, roles: str, name: str) -> Column:
    """A record's role: the flat record answers when one of its keys is the role's name, else its own members do."""
    direct = tx.first_of(F.filter(entries, lambda e: e["key"] == F.lit(name)))["value"]
    top = tx.first_of(F.filter(roles, lambda e: e["key"] == F.lit(name)))["value"]
    return F.coalesce(F.when(direct != "", direct), F.when(top != "", top), F.lit(""))


def _metadata(entries: str, roles: str, domain: str) -> Column:
    """The flat record, its domain and the roles no key of it has; blank values left out."""
    own_keys = F.transform(entries, lambda e: e["key"])
    found = F.concat(F.filter(entries, lambda e: e["key"] != "domain"), F.array(F.struct(F.lit("domain").alias("key"), F.col(domain).alias("value"))),
                     F.filter(roles, lambda e: ~F.array_contains(own_keys, e["key"])))
    return F.filter(found, lambda e: tx.trimmed(e["value"]) != "")


def json_file_documents(files: DataFrame, url_prefix: str = "") -> DataFrame:
    """``source_file`` and ``raw`` of whole JSON files to documents: one for each element of an array, else one.

    An element that is no object counts as the member ``value`` of one. A file that is no JSON is a document of its text.
    """
    raw = tx.trimmed(F.col("raw"))
    known = files.withColumn("_ok", parsed_json(raw).isNotNull())
    listed = F.when(F.col("_ok") & raw.startswith("["), F.from_json(raw, "array<variant>")).when(F.col("_ok"), F.array(parsed_json(raw)))
    texts = F.when(F.col("_ok") & raw.startswith("["), F.from_json(raw, "array<string>")).when(F.col("_ok"), F.array(raw))
    parts = F.zip_with(listed, texts, lambda v, t: F.struct(F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), t).otherwise(F.to_json(v)).alias("json"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object")))
    one = F.coalesce(parts, F.array(F.struct(F.lit(None).cast("string").alias("json"), F.lit(False).alias("is_object"))))
    keep = [c for c in files.columns if c != "raw"]
    rows = known.select(*keep, "raw", "_ok", raw.startswith("[").alias("_many"), F.posexplode(one).alias("_nth", "_p"))
    rows = rows.select(*keep, "raw", "_many", "_nth", F.col("_p.json").alias("_json"), F.col("_p.is_object").alias("_is_object"))
    rows = rows.withColumns({"_record": F.when(F.col("_is_object"), F.col("_json")).otherwise(F.concat(F.lit('{"value":'), F.col("_json"), F.lit("}"))),
                             "_other": F.when(~F.col("_is_object"), F.col("_json"))})
    flat = with_search_entries(with_search_entries(rows, "_record", "_e"), "_other", "_o")
    none = F.array().cast(_NO_ENTRIES)
    flat = flat.withColumns({"_meta": F.coalesce("_e", none), "_entries": F.coalesce(F.when(F.col("_is_object"), F.col("_e")).otherwise(F.col("_o")), none), "_roles": F.coalesce(record_roles(F.col("_record")), none)})
    shaped = with_structured(flat, "_entries", "_json")
    shaped = shaped.withColumns({"_own_domain": infer_domain(F.col("_meta")), "body": tx.clean_content(F.when(F.col("_json").isNull(), F.col("raw")).otherwise(F.col("content")))})
    staged = filter_settled(shaped, F.col("body") != "")
    parsed = F.col("_json").isNotNull()
    staged = staged.withColumns({f"_{n}": F.when(parsed, _role("_meta", "_roles", n)).otherwise("") for n in ("title", "author", "date", "url")})
    stem = tx.file_stem(F.col("source_file"))
    title = _either(F.col("_title"), F.when(F.col("_many") & parsed, F.concat(stem, F.lit(" item "), (F.col("_nth") + 1).cast("string"))).otherwise(stem))
    return staged.select(*keep, F.lit("json").alias("kind"), title.alias("title"), F.col("_author").alias("author"), F.col("_date").alias("date"),
                         _either(F.col("_url"), ids.document_url(F.col("source_file"), url_prefix)).alias("doc_url"), "body",
                         F.map_from_entries(F.when(parsed, _metadata("_meta", "_roles", "_own_domain")).otherwise(none)).alias("metadata"))


def documents_by_kind(files: DataFrame, url_prefix: str = "") -> DataFrame:
    """Whole files (``source_file``, ``raw``) routed by extension; blank files give nothing.

    Files of JSON lines are no single documents: ``json_lines_documents`` makes one of every line.
    """
    known = files.filter(tx.trimmed(F.col("raw")) != "").withColumn("_kind", kind_of(tx.extension(F.col("source_file"))))
    builders = {"text": text_documents, "markdown": markdown_documents, "html": html_documents, "json": json_file_documents}
    parts = [build(known.filter(F.col("_kind") == kind).drop("_kind"), url_prefix) for kind, build in builders.items()]
    return reduce(DataFrame.unionByName, parts)


def json_lines_documents(lines: DataFrame, url_prefix: str = "") -> DataFrame:
    """``source_file``, ``line``, ``value`` to one single-chunk document per non-blank line.

    A line that is not JSON is kept as text.
    """
    kept = filter_settled(lines.withColumn("value", tx.trimmed(F.col("value"))), F.col("value") != "").withColumn("_ok", is_json(F.col("value")))
    parsed = kept.withColumn("_json", F.when(F.col("_ok"), F.col("value")))
    flat = with_search_entries(parsed, "_json", "_e").withColumn("_r", record_roles(F.col("_json")))
    flat = flat.withColumns({"_entries": F.coalesce("_e", F.array().cast(_NO_ENTRIES)), "_roles": F.coalesce("_r", F.array().cast(_NO_ENTRIES)),
                             "_is_record": F.col("_ok") & F.col("value").startswith("{")})
    shaped = with_structured(flat, "_entries", "_json")
    quoted = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")
    body = tx.clean_content(F.when(~F.col("_ok"), F.col("value"))
                            .when(F.col("value").startswith('"'), tx.first_of(quoted)).otherwise(F.col("content")))
    staged = filter_settled(shaped.withColumn("body", body), F.col("body") != "")

    staged = staged.withColumns({f"_{n}": F.when(F.col("_is_record"), _role("_entries", "_roles", n)).otherwise("") for n in ("title", "author", "date", "url")})
    line = F.col("line").cast("string")
    title = _either(F.col("_title"), F.concat(F.lit("Line "), line))
    place = F.concat(F.col("source_file"), F.lit("#line-"), line)
    link = _either(F.col("_url"), F.concat(ids.document_url(F.col("source_file"), url_prefix), F.lit("#line-"), line))
    text = F.when(F.length("body") > BODY_LIMIT, F.concat(F.substring("body", 1, BODY_LIMIT), F.lit(
        "\n\n[Content truncated for connector item size; source record remains available in RAW baseline.]"))).otherwise(F.col("body"))
    meta = F.when(F.col("_is_record"), _metadata("_entries", "_roles", "domain")).otherwise(F.array().cast(_NO_ENTRIES))
    return staged.select(
        place.alias("source_file"), F.col("source_file").alias("file"), F.col("line"), F.lit("jsonl").alias("kind"),
        title.alias("title"), F.col("_author").alias("author"), F.col("_date").alias("date"), link.alias("doc_url"),
        F.col("body"), meta.alias("entries"), F.lit("").alias("section_path"),
        title.alias("heading"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"), text.alias("text"))


def json_line_items(lines: DataFrame, url_prefix: str = "", access: str = "everyone") -> DataFrame:
    docs = json_lines_documents(lines, url_prefix)
    doc_id = ids.document_id(F.col("source_file"), F.col("title"))
    chunks = (docs.withColumns({"document_id": doc_id, "metadata": F.map_from_entries("entries")})
              .withColumn("structured", structured_properties(F.col("entries")))
              .withColumn("id", ids.chunk_id(F.col("source_file"), F.col("document_id"), F.lit(0), F.lit(""))))
    return chunk_items(chunks, access)


def domain_counts(*domains: DataFrame) -> DataFrame:
    """Occurrences per domain over rows and items."""
    merged = domains[0].select("domain")
    for other in domains[1:]:
        merged = merged.unionByName(other.select("domain"))
    return merged.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
