"""JSON texts opened level by level with the JVM's own parsers: no Python, no shuffle.

A level is an array of ``(path, kind, text)``; opening it replaces every object by its members, in document order.
Each level is one projection over the level before, so a record's work stays in its row. There are as many levels as
the deepest record of the table has, which one pass over the texts measures; every ``STEP`` levels the rows are written
to the shared folder, so plans stay small at any depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import text as tx
from itemforge.functions.fixed import AUTHOR_KEYS, DATE_KEYS, ICON_KEYS, TITLE_KEYS, URL_KEYS
from itemforge.functions.numbers import number_text
from itemforge.session import written

STEP, FEW_BRACKETS = 24, 4
# Keys whose long text becomes a section of its own, the length from which it does, and the scalars of an
# array that an evaluation fact shows.
BODY_KEYS = ("body", "content", "text", "summary", "description", "excerpt", "message")
LONG_TEXT = 120
SHOWN_SCALARS = 5
# The longest text that becomes a search fact, and how an object inside an array is spelled there.
LONGEST_FACT = 1000
OBJECT_TEXT = "[object Object]"
ROLE_KEYS = {"title": TITLE_KEYS, "author": AUTHOR_KEYS, "date": DATE_KEYS, "url": URL_KEYS, "iconUrl": ICON_KEYS}


def _wraps(raw: Column) -> tuple[Column, Column]:
    """A text as the only element of an array and as the only member of an object.

    The parsers stop after the first value and never see what follows it. No rest of a text can go on both in an array
    and in an object, so both wraps are JSON exactly when the text is one value and nothing else.
    """
    return F.concat(F.lit("["), raw, F.lit("]")), F.concat(F.lit('{"v":'), raw, F.lit("}"))


def parsed_json(raw: Column) -> Column:
    """The value of a JSON text; null when the text is anything else but one JSON value."""
    listed, named = _wraps(raw)
    return F.when(F.try_parse_json(listed).isNotNull(), F.try_variant_get(F.try_parse_json(named), "$.v", "variant"))


def _is_value(raw: Column) -> Column:
    """Whether ``parsed_json`` has a value, without taking it out."""
    listed, named = _wraps(raw)
    return F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull()


def is_json(raw: Column) -> Column:
    """Whether a text is one JSON value; an object may name a member twice."""
    listed, named = _wraps(raw)
    return _is_value(raw) | (F.get_json_object(listed, "$").isNotNull() & F.get_json_object(named, "$").isNotNull())


def _kind(value: Column) -> Column:
    return tx.let(F.schema_of_variant(value), lambda shape: F.when(shape.isNull() | (shape == "VOID"), "null").when(shape.startswith("OBJECT"), "object")
                  .when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number"))


def _nested_kind(raw: Column) -> Column:
    """``object`` or ``array`` of a whole JSON text, else null. Its first sign tells it, so no schema is asked of all that is in it."""
    opens = F.substring(F.ltrim(raw, F.lit(" \t\r\n")), 1, 1)
    return F.when(opens.isin("{", "[") & _is_value(raw), F.when(opens == "{", "object").otherwise("array"))


def _part(key: Column, text: Column, value: Column) -> Column:
    def shown(kind: Column) -> Column:
        return F.struct(key.alias("key"), kind.alias("kind"), F.when(kind == "number", tx.let(F.try_variant_get(value, "$", "double"), number_text)).otherwise(text).alias("text"))
    # Only a scalar is asked for its schema, which for an object would be that of all that is in it.
    scalar = tx.let(F.schema_of_variant(value), lambda s: F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number"))
    kind = (F.when(text.isNull(), "null").when(text.startswith("{") & F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), "object")
            .when(text.startswith("[") & F.try_variant_get(value, "$", "array<variant>").isNotNull(), "array").otherwise(scalar))
    return tx.let(kind, shown)


def members(raw: Column) -> Column:
    """``array<struct<key,kind,text>>`` of a JSON object in document order; nested values keep compact JSON as text."""
    return F.zip_with(F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>")),
                      lambda e, v: _part(e["key"], e["value"], v))


def elements(raw: Column) -> Column:
    """The same of a JSON array; a key is the place from 0."""
    parts = F.zip_with(F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>"), lambda t, v: _part(F.lit(None).cast("string"), t, v))
    return F.transform(parts, lambda e, i: F.struct(i.cast("string").alias("key"), e["kind"].alias("kind"), e["text"].alias("text")))


def is_nested(part: Column) -> Column:
    return part["kind"].isin("object", "array")


def nesting(raw: Column) -> Column:
    """Objects and arrays that are open at once at the deepest place of a JSON text."""
    brackets = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, sign: Column) -> Column:
        return tx.let(state["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0),
                      lambda now: F.struct(now.alias("now"), F.greatest(now, state["most"]).alias("most")))
    return F.aggregate(F.split(brackets, ""), start, step, lambda state: state["most"])


def deepest(df: DataFrame, raw: str) -> int:
    """Levels that open ``raw`` whole: one number from one pass.

    A text of few opening brackets is never deeper than their count, so only the others are read sign by sign.
    """
    opens = F.length(raw) - F.length(F.translate(raw, "[{", ""))
    levels = F.when(opens <= FEW_BRACKETS, opens).otherwise(nesting(F.col(raw)))
    return df.agg(F.max(levels)).first()[0] or 0


def _opened(df: DataFrame, name: str, open_one: Callable[[Column], Column], waits: Callable[[Column], Column], levels: int) -> DataFrame:
    """``levels`` times: replace each entry of a column that waits by what ``open_one`` makes of it."""
    opened = F.flatten(F.transform(name, lambda e: F.when(waits(e), open_one(e)).otherwise(F.array(e))))
    level = F.when(F.exists(name, waits), opened).otherwise(F.col(name))
    for done in range(levels):
        df = df.withColumn(name, level)
        if done % STEP == STEP - 1 and done + 1 < levels:
            df = written(df, "opened")
    return df


def _entry(path: Column, kind: Column, text: Column) -> Column:
    return F.struct(path.alias("path"), kind.alias("kind"), text.alias("text"))


def _below(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _root(raw: Column) -> Column:
    """One entry without a path; anything but an object becomes the member ``value`` of one."""
    whole = F.when(F.ltrim(raw, F.lit(" \t\r\n")).startswith("{"), raw).otherwise(F.concat(F.lit('{"value":'), raw, F.lit("}")))
    return F.when(_is_value(raw), F.array(_entry(F.lit(""), F.lit("object"), whole)))


def _ends(rows: Column, last: bool) -> Column:
    """The last (or first) row of each run of equal ``key`` of sorted rows."""
    def edge(sorted_: Column) -> Column:
        step = 1 if last else -1
        return F.filter(sorted_, lambda x, i: F.coalesce(F.get(sorted_, i + step)["key"] != x["key"], F.lit(True)))
    return tx.let(F.sort_array(rows), edge)


def _settled(writes: Column) -> Column:
    """``writes`` (key, rank, place, value) to (key, value): the highest rank gives a key its value, the lowest place its position."""
    values = _ends(F.transform(writes, lambda w: F.struct(w["key"].alias("key"), w["rank"].alias("rank"), w["value"].alias("value"))), last=True)
    places = _ends(F.transform(writes, lambda w: F.struct(w["key"].alias("key"), w["place"].alias("place"))), last=False)
    found = F.zip_with(values, places, lambda v, p: F.struct(p["place"].alias("place"), v["key"].alias("key"), v["value"].alias("value")))
    return F.transform(F.sort_array(found), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def _last_of_each(rows: Column) -> Column:
    """(key, value) with the last value of a repeated key in the place of its first."""
    def settle(all_: Column) -> Column:
        writes = F.transform(all_, lambda x, i: F.struct(x["key"].alias("key"), i.alias("rank"), i.alias("place"), x["value"].alias("value")))
        return F.when(F.size(F.array_distinct(all_["key"])) == F.size(all_), all_).otherwise(_settled(writes))
    return tx.let(rows, settle)


def _shown(entries: Column, text: Callable[[Column], Column]) -> Column:
    return _last_of_each(F.transform(entries, lambda e: F.struct(e["path"].alias("key"), text(e).alias("value"))))


def with_identity_entries(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds (key, value) entries. Dotted keys: null is blank, arrays of scalars join by ``, ``, arrays that hold nested values stay compact JSON."""
    def open_object(e: Column) -> Column:
        return F.transform(members(e["text"]), lambda m: _entry(_below(e["path"], m["key"]), m["kind"], m["text"]))

    def text(e: Column) -> Column:
        joined = tx.let(elements(e["text"]), lambda parts: F.when(F.exists(parts, is_nested), e["text"]).otherwise(F.array_join(
            F.filter(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != ""), ", ")))
        return F.when(e["kind"] == "array", joined).when(e["kind"] == "null", "").otherwise(e["text"])
    opened = _opened(df.withColumn(name, _root(F.col(raw))), name, open_object, lambda e: e["kind"] == "object", deepest(df, raw) + 1)
    return opened.withColumn(name, _shown(F.col(name), text))


def with_eval_entries(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds (key, value) entries. Dotted keys: null vanishes, the first scalars of an array join, and only its first object is followed."""
    def open_one(e: Column) -> Column:
        below = F.filter(F.transform(members(e["text"]), lambda m: _entry(_below(e["path"], m["key"]), m["kind"], m["text"])), lambda m: m["kind"] != "null")

        def open_array(parts: Column) -> Column:
            scalars = F.filter(F.transform(F.filter(parts, lambda p: ~is_nested(p)), lambda p: tx.trimmed(F.coalesce(p["text"], F.lit("")))), lambda t: t != "")
            joined = _entry(e["path"], F.lit("string"), F.array_join(F.slice(scalars, 1, SHOWN_SCALARS), ", "))
            inner = F.slice(F.filter(parts, lambda p: p["kind"] == "object"), 1, 1)
            return F.concat(F.when(F.size(scalars) > 0, F.array(joined)).otherwise(F.filter(F.array(joined), lambda _: F.lit(False))),
                            F.transform(inner, lambda p: _entry(e["path"], F.lit("object"), p["text"])))
        return F.when(e["kind"] == "object", below).otherwise(tx.let(elements(e["text"]), open_array))
    opened = _opened(df.withColumn(name, _root(F.col(raw))), name, open_one, is_nested, deepest(df, raw) + 1)
    return opened.withColumn(name, _shown(F.col(name), lambda e: tx.trimmed(e["text"])))


def _spelled(part: Column) -> Column:
    """An element of an array as text: an array inside is joined by commas, brackets and quotes further in are left out."""
    def inner(p: Column) -> Column:
        return F.when(p["kind"] == "null", "").when(p["kind"] == "object", OBJECT_TEXT).when(p["kind"] == "array", F.translate(p["text"], '[]"', "")).otherwise(p["text"])
    return (F.when(part["kind"] == "null", "null").when(part["kind"] == "object", OBJECT_TEXT)
            .when(part["kind"] == "array", F.array_join(F.transform(elements(part["text"]), inner), ",")).otherwise(part["text"]))


def with_search_entries(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds (key, value) entries: dotted keys, and for each key's last part an alias.

    Arrays join their texts by ``; `` and number what is nested in them; blank and long texts are no facts. Every entry
    carries its places on the way down. A full key takes its last value. An alias is taken, of an object's members, from
    the last nested one that has it, else from the first plain one: so the highest list of places wins, the last place of
    a plain member counting backwards below zero.
    """
    def ranked(path: Column, kind: Column, text: Column, rank: Column) -> Column:
        return F.struct(path.alias("path"), kind.alias("kind"), text.alias("text"), rank.alias("rank"))

    def down(e: Column, place: Column) -> Column:
        return F.concat(e["rank"], F.array(place))

    def open_one(e: Column) -> Column:
        def of_array(parts: Column) -> Column:
            texts = F.filter(F.transform(parts, lambda p: _spelled(p)), lambda t: (t != "") & (F.length(t) <= LONGEST_FACT))
            own = F.filter(F.array(ranked(e["path"], F.lit("joined"), F.array_join(texts, "; "), down(e, F.lit(0)))), lambda j: (e["path"] != "") & (F.size(texts) > 0))
            return F.concat(own, F.filter(F.transform(parts, lambda p, i: ranked(_below(e["path"], p["key"]), p["kind"], p["text"], down(e, i + 1))), is_nested))
        of_object = F.transform(members(e["text"]), lambda m, i: ranked(_below(e["path"], m["key"]), m["kind"], F.when(m["kind"] == "null", "null").otherwise(m["text"]), down(e, i)))
        return F.when(e["kind"] == "object", of_object).otherwise(tx.let(elements(e["text"]), of_array))

    def written(facts: Column) -> Column:
        def writes(e: Column, i: Column) -> Column:
            leaf, last = F.substring_index(e["path"], ".", -1), F.size(e["rank"])
            alias_rank = F.concat(F.slice(e["rank"], F.lit(1), last - 1), F.array(-1 - F.get(e["rank"], last - 1)))
            full = F.struct(e["path"].alias("key"), e["rank"].alias("rank"), (2 * i).alias("place"), e["text"].alias("value"))
            alias = F.struct(leaf.alias("key"), alias_rank.alias("rank"), (2 * i + 1).alias("place"), e["text"].alias("value"))
            return F.when((leaf == "") | (leaf == e["path"]), F.array(full)).otherwise(F.array(full, alias))

        def plain(e: Column) -> Column:
            leaf = F.substring_index(e["path"], ".", -1)
            full = F.struct(e["path"].alias("key"), e["text"].alias("value"))
            return F.when((leaf == "") | ~F.contains(e["path"], F.lit(".")), F.array(full)).otherwise(F.array(full, F.struct(leaf.alias("key"), e["text"].alias("value"))))

        def settle(all_: Column) -> Column:
            once = F.size(F.array_distinct(all_["key"])) == F.size(all_)
            return F.when(once, all_).otherwise(_settled(F.flatten(F.transform(facts, writes))))
        # Places and ranks settle nothing where no key is written twice.
        return tx.let(F.flatten(F.transform(facts, plain)), settle)
    root = F.array(ranked(F.lit(""), _nested_kind(F.col(raw)), F.col(raw), F.array().cast("array<int>")))
    start = df.withColumn(name, F.when(F.col(raw).isNotNull(), F.filter(root, is_nested)))
    opened = _opened(start, name, open_one, is_nested, deepest(df, raw))
    facts = F.filter(name, lambda e: (e["kind"] == "joined") | ((e["text"] != "") & (F.length(e["text"]) <= LONGEST_FACT)))
    return opened.withColumn(name, facts).withColumn(name, written(F.col(name)))


def record_roles(raw: Column) -> Column:
    """(key, value) of the roles that an object's own members answer: the first filled member of each role.

    An array of plain values is joined; an object answers with its title or name.
    """
    def text(m: Column) -> Column:
        def joined(parts: Column) -> Column:
            return F.when(~F.exists(parts, lambda p: is_nested(p) | (p["kind"] == "null")), F.array_join(F.transform(parts, lambda p: p["text"]), ", "))

        def named(parts: Column) -> Column:
            texts = F.filter(parts, lambda p: p["kind"] == "string")
            return F.coalesce(*[tx.first_of(F.filter(texts, lambda p: p["key"] == F.lit(k)))["text"] for k in ("title", "name")])
        return F.when(m["kind"] == "string", m["text"]).when(m["kind"] == "array", tx.let(elements(m["text"]), joined)).when(m["kind"] == "object", tx.let(members(m["text"]), named))

    def role(key: Column) -> Column:
        def named(norm: Column) -> Column:
            out = F.lit(None).cast("string")
            for name, keys in ROLE_KEYS.items():
                out = F.when(norm.isin(*keys), name).otherwise(out)
            return out
        return tx.let(tx.norm_key(key), named)

    def first_of_each(found: Column) -> Column:
        roles = F.transform(found, lambda e: e["key"])
        return F.filter(found, lambda e, i: F.array_position(roles, e["key"]) == i + 1)
    # Only members with a role are asked for their kind and text.
    named = F.zip_with(F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>")),
                       lambda e, v: F.struct(role(e["key"]).alias("key"), e["value"].alias("text"), v.alias("value")))
    answers = F.transform(F.filter(named, lambda e: e["key"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), tx.let(_part(e["key"], e["text"], e["value"]), text).alias("value")))
    filled = F.filter(answers, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.when(_nested_kind(raw) == "object", tx.let(filled, first_of_each))


def entry_rows(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """One row per entry. The outer form keeps the optimizer from deriving a filter on the entries, which it would copy level into level."""
    return df.select(*keep, F.inline_outer(name)).filter("key is not null")


def _label(key: Column) -> Column:
    spaced = tx.trimmed(F.regexp_replace(F.regexp_replace(key, r"[_\-]+", " "), "([a-z])([A-Z])", "$1 $2"))
    return F.when(spaced == "", "Value").otherwise(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))


def with_outline(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds a text. Headings for nested keys, bullets for scalars, long body fields as sections of their own.

    ``path`` holds the heading's level. The last line of a part loses its trailing blanks, as parts end there.
    """
    def heading(level: Column, words: Column) -> Column:
        return _entry(level.cast("string"), F.lit("line"), F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), words))

    def ended(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: _entry(x["path"], x["kind"], F.when((i == F.size(lines) - 1) & (x["kind"] == "line"), F.regexp_replace(x["text"], r"\s+$", "")).otherwise(x["text"])))

    def open_one(e: Column) -> Column:
        level = e["path"].cast("int") + 1

        def bullet(words: Column) -> Column:
            return _entry(e["path"], F.lit("line"), F.concat(F.lit("- "), words))

        def under(words: Column, part: Column) -> Column:
            return F.array(heading(level, words), _entry(level.cast("string"), part["kind"], part["text"]))

        def member(m: Column) -> Column:
            long = (F.length(m["text"]) > LONG_TEXT) & F.regexp_replace(F.lower(m["key"]), "[^a-z0-9]+", "").isin(*BODY_KEYS)
            section = F.array(heading(level, _label(m["key"])), _entry(e["path"], F.lit("line"), F.regexp_replace(m["text"], r"\s+$", "")))
            return F.when(is_nested(m), under(_label(m["key"]), m)).when(long, section).otherwise(F.array(bullet(F.concat(_label(m["key"]), F.lit(": "), m["text"]))))

        def item(p: Column, i: Column) -> Column:
            return F.when(is_nested(p), under(F.concat(F.lit("Item "), (i + 1).cast("string")), p)).otherwise(F.array(bullet(p["text"])))

        def named(rows: Column) -> Column:
            return F.transform(rows, lambda m: F.struct(m["key"].alias("key"), m["kind"].alias("kind"), F.when(m["kind"] == "null", "null").otherwise(m["text"]).alias("text")))
        of_object = F.flatten(F.transform(F.filter(named(members(e["text"])), lambda m: m["text"] != ""), member))
        return tx.let(F.when(e["kind"] == "object", of_object).otherwise(F.flatten(F.transform(named(elements(e["text"])), item))), ended)
    value = parsed_json(raw)
    kind = _kind(value)
    opened = _opened(df.withColumn(name, F.array(_entry(F.lit("1"), kind, F.col(raw)))), name, open_one, is_nested, deepest(df, raw))
    scalar = F.when(kind == "null", "null").when(kind == "number", number_text(F.try_variant_get(value, "$", "double"))).otherwise(value.cast("string"))
    text = F.when(kind.isin("object", "array"), F.array_join(F.transform(name, lambda x: x["text"]), "\n\n")).otherwise(scalar)
    return opened.withColumn(name, F.when(F.col(raw).isNotNull(), tx.trimmed(text)))


def canonical_json(raw: Column) -> Column:
    """Compact JSON with the keys of every object in order; null for a text that is no JSON becomes ``null``."""
    return F.when(raw.isNotNull(), F.coalesce(F.to_json(parsed_json(raw)), F.lit("null")))
