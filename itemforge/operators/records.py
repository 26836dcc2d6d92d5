"""Record items: one search item per table row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.config import EnrichConfig
from itemforge.functions import ids
from itemforge.functions import names
from itemforge.functions import text as tx

CONTENT_LIMIT = 4000
CORE_PROPERTIES = ("url", "sourceFile", "sourceRow", "entityName", "year", "isoCode")
GUARD = "\x00"


def role_columns(header: list[str], candidates: list[str]) -> list[str]:
    """Header columns that carry a role, in candidate order, matched ignoring case (last header wins)."""
    by_lower = {name.lower(): name for name in header}
    found = [by_lower[c.lower()] for c in candidates if c.lower() in by_lower]
    return list(dict.fromkeys(found))


def role_value(header: list[str], config: EnrichConfig, role: str) -> Column:
    return tx.first_filled([F.col(f"`{c}`") for c in role_columns(header, config.key_fields.get(role, []))])


def with_roles(df: DataFrame, header: list[str], config: EnrichConfig) -> DataFrame:
    return df.withColumns({
        "entity_name": role_value(header, config, "entity"),
        "role_year": role_value(header, config, "year"),
        "iso_code": role_value(header, config, "iso"),
    })


def fact_value_for(header: list[str], key: str, config: EnrichConfig) -> Column:
    """Value a row holds for a fact key: same column, then role name, then like-named column, then role member."""
    lowered = {name.lower(): name for name in header}
    exact = lowered.get(key.lower())
    options = []
    if exact:
        options.append(F.when(~tx.is_empty(F.col(f"`{exact}`")), tx.trimmed(F.col(f"`{exact}`"))))
    roles = {role.lower(): members for role, members in config.key_fields.items()}
    if key.lower() in roles:
        options.append(tx.first_filled([F.col(f"`{c}`") for c in role_columns(header, roles[key.lower()])]))
    else:
        wanted = "".join(ch for ch in key.lower() if ch.isascii() and ch.isalnum())
        for name in header:
            if "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum()).endswith(wanted):
                options.append(F.when(~tx.is_empty(F.col(f"`{name}`")), tx.trimmed(F.col(f"`{name}`"))))
        for members in config.key_fields.values():
            if key.lower() in [m.lower() for m in members]:
                options.append(tx.first_filled([F.col(f"`{c}`") for c in role_columns(header, members)]))
                break
    return F.coalesce(*options, F.lit("")) if options else F.lit("")


def ordered_fields(header: list[str], eval_counts: dict[str, int], config: EnrichConfig) -> list[str]:
    """Configured priority, then eval-cited fields by count, then header order."""
    priority = list(config.priority_fields)

    def place(name: str):
        if name in priority:
            return 0, priority.index(name), name
        if eval_counts.get(name, 0) > 0:
            return 1, -eval_counts[name], name
        return 2, header.index(name), name
    return sorted(header, key=place)


def capped(content: Column, full_length: Column | None = None) -> Column:
    """Cut to the content limit and say how many characters were left out."""
    total = F.length(content) if full_length is None else full_length
    cut = F.concat(F.substring(content, 1, CONTENT_LIMIT), F.lit("\n…(truncated; "),
                   (total - CONTENT_LIMIT).cast("string"), F.lit(" chars elided)"))
    return F.when(total > CONTENT_LIMIT, cut).otherwise(content)


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def record_content(title: Column, row_number: Column | None, header: list[str], config: EnrichConfig,
                   eval_counts: dict[str, int] | None = None, questions: Column | None = None,
                   with_answers: bool = False) -> Column:
    """Searchable text of one row. Field order is header metadata, so the text is one flat expression."""
    counts = eval_counts or {}
    order = ordered_fields(header, counts, config)
    filled = {f: ~tx.is_empty(F.col(f"`{f}`")) for f in header}

    def fact(f: str) -> Column:
        return F.concat(F.lit(f"- {f}: "), tx.trimmed(F.col(f"`{f}`")))

    head = title if row_number is None else F.concat(title, F.lit(" (sourceRow="), row_number.cast("string"), F.lit(")"))
    raw = [F.when(filled[f], F.concat(F.lit(f"{f}: "), F.col(f"`{f}`"))) for f in header]

    priority = [f for f in dict.fromkeys(config.priority_fields) if f in header]
    cited = [f for f in order if f not in priority and counts.get(f, 0) > 0]
    # only the first twelve filled cited fields of a row count as key facts
    among_first = {}
    seen = F.lit(0)
    for f in cited:
        among_first[f] = (seen < 12) if len(cited) > 12 else F.lit(True)
        seen = seen + F.when(filled[f], 1).otherwise(0)
    key_facts = ([F.when(filled[f], fact(f)) for f in priority]
                 + [F.when(filled[f] & among_first[f], fact(f)) for f in cited])
    if len(priority) + min(12, len(cited)) > 28:
        kept = F.slice(F.filter(F.array(*key_facts), lambda x: x.isNotNull()), 1, 28)
        key_facts = [F.when(F.size(kept) > 0, F.array_join(kept, "\n"))]
    rest = ([F.when(filled[f], fact(f)) for f in order if f not in priority and f not in cited])
    if len(cited) > 12:
        rest = [F.when(filled[f] & ~among_first[f], fact(f)) for f in cited] + rest
    important = priority + [f for f in order if f in counts and f not in priority]
    blanks = F.array(*[F.when(~filled[f], F.lit(f)) for f in important]) if important else None

    parts = [head, F.lit(""), F.lit("Raw fields:"), *raw, F.lit(""), F.lit("Key facts:"), *key_facts]
    if rest:
        block = _lines(*rest)
        parts.append(F.when(block != "", F.concat(F.lit("\nAll populated fields:\n"), block)))
    if blanks is not None:
        listed = F.slice(F.filter(blanks, lambda x: x.isNotNull()), 1, 25)
        parts.append(F.when(F.size(listed) > 0, F.concat(
            F.lit("\nImportant fields with no value in this row:\n- "), F.array_join(listed, ", "))))
    if questions is not None:
        shown = F.transform(F.slice(questions, 1, 8), lambda q: F.concat_ws(
            "\n", F.when(q["prompt"] != "", F.concat(F.lit("- "), q["prompt"])),
            *([F.when(q["answer"] != "", F.concat(F.lit("  Expected answer: "), q["answer"]))] if with_answers else [])))
        listed = F.array_join(F.filter(shown, lambda x: x != ""), "\n")
        parts.append(F.when(F.size(questions) > 0, F.concat(
            F.lit("\nExample questions this record can answer:"), F.when(listed == "", "").otherwise(F.concat(F.lit("\n"), listed)))))
    return _lines(*parts)


def property_entries(header: list[str]) -> list[tuple[Column, Column]]:
    """(name, value) per header column under its schema-safe name.

    Names depend on which earlier like-named cells are filled in the same row, so a clashing column
    counts the filled columns before it. Columns that clash with nothing get a constant name.
    """
    bases = [names.search_base(f) for f in header]
    values = [F.when(~tx.is_empty(F.col(f"`{f}`")), F.col(f"`{f}`")) for f in header]
    if _numbered_names_clash(bases):
        return _entries_in_sequence(bases, values)
    out = []
    for i, base in enumerate(bases):
        earlier = [v for v, b in zip(values[:i], bases[:i]) if b == base]
        taken = 1 if base in CORE_PROPERTIES else 0
        if not earlier:
            label = F.lit(names.suffixed(base, 2) if taken else base)
        else:
            n = F.lit(taken + 1)
            for v in earlier:
                n = n + F.when(v.isNotNull(), 1).otherwise(0)
            label = F.when(n == 1, F.lit(base)).otherwise(_numbered(F.lit(base), n.cast("string")))
        out.append((label, values[i]))
    return out


def _numbered(base: Column, digits: Column) -> Column:
    return F.concat(F.substring(base, F.lit(1), F.lit(names.NAME_LIMIT) - F.length(digits)), digits)


def _numbered_names_clash(bases: list[str]) -> bool:
    """True when a numbered name could equal another column's own base name."""
    possible = set()
    for base in set(bases):
        most = bases.count(base) + (base in CORE_PROPERTIES)
        possible |= {names.suffixed(base, n) for n in range(2, most + 1)}
    return bool(possible & (set(bases) | set(CORE_PROPERTIES)))


def _entries_in_sequence(bases: list[str], values: list[Column]) -> list[tuple[Column, Column]]:
    """Column by column: take the first free numbered name among those already used in the row."""
    out, used = [], [F.lit(name) for name in CORE_PROPERTIES]
    for base, value in zip(bases, values):
        options = F.array(F.lit(base), *[F.lit(names.suffixed(base, n)) for n in range(2, len(bases) + 3)])
        taken = F.array(*used)
        label = tx.first_of(F.filter(options, lambda o: ~F.coalesce(F.array_contains(taken, o), F.lit(False))))
        label = F.when(value.isNotNull(), label)
        used.append(F.coalesce(label, F.lit("")))
        out.append((label, value))
    return out


def item_properties(title: Column, item_type: str, core: dict[str, Column], header: list[str] | None = None) -> Column:
    """Property map without blanks. Title and item type always stay; a like-named column replaces them."""
    first = {"title": title, "itemType": F.lit(item_type)}
    entries = [(F.lit(k), F.when(v.cast("string") != "", v.cast("string"))) for k, v in core.items()]
    for i, (label, value) in enumerate(property_entries(header or [])):
        base = names.search_base(header[i])
        if base in first:
            first[base] = F.coalesce(value, first[base])
        else:
            entries.append((label, value))
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in first.items()]
    pairs += [F.struct(k.alias("key"), v.alias("value")) for k, v in entries]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def access_entries(mode: str) -> Column:
    entry = F.struct(F.lit(mode).alias("type"), F.lit(mode).alias("value"), F.lit("grant").alias("accessType"))
    return F.when(F.lit(mode != "none"), F.array(entry)).otherwise(F.array().cast(
        "array<struct<type:string,value:string,accessType:string>>"))


def record_items(df: DataFrame, header: list[str], config: EnrichConfig | None = None, *,
                 eval_counts: dict[str, int] | None = None, questions: str | None = None,
                 with_answers: bool = False, url_prefix: str = "", access: str = "everyone") -> DataFrame:
    """Items from rows that carry ``source_file``, ``source_row`` and the header columns as text.

    One projection over the scan: no shuffle, no Python.
    """
    config = config or EnrichConfig()
    file, row = F.col("source_file"), F.col("source_row")
    usable = df.filter(~_all_empty(header)) if header else df.limit(0)
    roles = with_roles(usable, header, config)
    entity, year, iso = F.col("entity_name"), F.col("role_year"), F.col("iso_code")
    stem = tx.file_stem(file)
    title = F.concat(F.when(entity == "", stem).otherwise(entity),
                     F.when(year == "", "").otherwise(F.concat(F.lit(" ("), year, F.lit(")"))),
                     F.lit(" — "), stem)
    key = ids.row_key(file, iso, entity, year, row)
    if config.is_long_table(header):
        ind = F.col(f"`{config.long_columns['id']}`")
        key = F.when((tx.text_or_blank(ind) != "") & (entity != "") & (year != ""),
                     ids.indicator_key(file, ind, iso, entity, year)).otherwise(key)
    asked = F.col(questions) if questions else None
    content = record_content(title, row, header, config, eval_counts, asked, with_answers)
    core = {"url": ids.item_url(file, row, url_prefix), "sourceFile": file, "sourceRow": row,
            "entityName": entity, "year": year, "isoCode": iso}
    return (roles.withColumn("full_content", content)
            .select(F.concat(F.lit("row-"), ids.short_hash(key, 24)).alias("id"),
                    F.lit("record").alias("item_type"), title.alias("title"),
                    core["url"].alias("url"), file.alias("source_file"), row.cast("long").alias("source_row"),
                    entity.alias("entity_name"), year.alias("year"), iso.alias("iso_code"),
                    item_properties(title, "record", core, header).alias("properties"),
                    capped(F.col("full_content")).alias("content"), F.col("full_content"),
                    access_entries(access).alias("acl")))


def _all_empty(header: list[str]) -> Column:
    out = F.lit(True)
    for f in header:
        out = out & tx.is_empty(F.col(f"`{f}`"))
    return out


def drop_empty_rows(df: DataFrame, header: list[str]) -> DataFrame:
    return df.filter(~_all_empty(header))


# Column order of the flat records table.
FLAT_COLUMNS = ("id", "itemType", "title", "sourceFile", "sourceRow", "entityName", "year", "documentId",
                "contentType", "sectionPath", "chunkIndex", "chunkCount", "author", "datePublished", "content")


def flat_table(items: DataFrame) -> DataFrame:
    """Fifteen text columns per item; a numeric zero is written blank."""
    def prop(name: str) -> Column:
        value = F.coalesce(F.try_element_at(F.col("properties"), F.lit(name)), F.lit(""))
        return F.when(value == "0", "").otherwise(value) if name in ("sourceRow", "chunkIndex", "chunkCount") else value
    return items.select(F.col("id"), *[prop(c).alias(c) for c in FLAT_COLUMNS[1:-1]], F.col("content"))
