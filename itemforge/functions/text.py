"""Text expressions, all evaluated inside the JVM except the Unicode fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.arrow import nfc_lower, nfkd_fold, nfkd_lower
from itemforge.functions.fixed import NAMED_ENTITIES, WS_CHARS, WS_CODES


def _blanks(*but: int) -> str:
    """A class of the trimmed code points without ``but``. Two ranges that hold letters and signs are ruled out first, as most of a text is in them."""
    return rf"[[^\x{{{0x20 if 0x20 in but else 0x21:04x}}}-~\x{{00a1}}-\x{{167f}}]&&[" + "".join(f"\\x{{{code:04x}}}" for code in WS_CODES if code not in but) + "]]"


WS, WS_INLINE, WS_EXOTIC = _blanks(), _blanks(0x0A), _blanks(0x09, 0x0A, 0x20)

# Texts that count as "no value".
EMPTY_TOKENS = ("", "null", "none", "nan", "n/a", "na")
USELESS_TOKENS = ("null", "none", "nan", "n/a")

# Phrases that say nothing was found.
NO_RESULT_PHRASES = ("no matching", "not found", "unable to return", "was not located",
                     "no records found", "could not find")
NO_RESULT_REGEX = r"(?i)no\s+(matching|records|results)|not\s+found|unable\s+to\s+return"

# Wording of a throttled answer.
RATE_LIMIT_REGEX = (r"(?i)reached.*limit.*number of requests|rate ?limit|too many requests"
                    r"|try again later|please wait")


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_empty(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*EMPTY_TOKENS)


def is_useful(c: Column) -> Column:
    """Usable as an evaluation fact: 1 to 160 characters and not null-like."""
    t = trimmed(text_or_blank(c))
    return F.length(t).between(1, 160) & ~F.lower(t).isin(*USELESS_TOKENS)


def first_of(values: Column) -> Column:
    """First element, null when there is none."""
    return F.get(values, F.lit(0))


def first_filled(columns: list[Column]) -> Column:
    """First non-empty value, trimmed; blank when all are empty."""
    if not columns:
        return F.lit("")
    return F.coalesce(*[F.when(~is_empty(c), trimmed(c)) for c in columns], F.lit(""))


def _utf16_char(code: Column) -> Column:
    unit = code % F.lit(65536)
    char = F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE")
    return F.when(unit.between(0xD800, 0xDFFF), F.lit(chr(0xFFFD))).otherwise(char)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decode_refs(c: Column, pattern: str, to_code) -> Column:
    """Replace each numeric reference by its character, keeping the text between references."""
    return F.array_join(F.zip_with(
        F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(1)),
        lambda text, code: F.concat(text, F.coalesce(_utf16_char(to_code(code)), F.lit("")))), "")


def decode_entities(c: Column) -> Column:
    named = c
    for name, char in NAMED_ENTITIES:
        named = F.replace(named, F.lit(name), F.lit(char))
    decimal = let(named, lambda x: _decode_refs(x, r"&#(\d{1,15});", lambda d: d.cast("long")))
    both = let(decimal, lambda x: _decode_refs(x, r"&#x([0-9a-fA-F]{1,12});", lambda h: F.conv(h, 16, 10).cast("long")))
    return (F.when(~F.contains(c, F.lit("&")), c)
            .when(~F.contains(c, F.lit("#")), named).otherwise(both))


def _trim_lines(c: Column) -> Column:
    """Trim every line of text whose blanks are already collapsed; only exotic blanks need a pattern."""
    plain = F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    full = F.regexp_replace(c, f"(?md)^{WS_INLINE}+|{WS_INLINE}+$", "")
    return F.when(c.rlike(WS_EXOTIC), full).otherwise(plain)


def _replaced(c: Column, signs: list[str], pattern: str, by: str) -> Column:
    """``regexp_replace`` of the texts that hold one of ``signs``; in all others the pattern changes nothing."""
    def one(x: Column) -> Column:
        found = F.contains(x, F.lit(signs[0]))
        for sign in signs[1:]:
            found = found | F.contains(x, F.lit(sign))
        return F.when(found, F.regexp_replace(x, pattern, by)).otherwise(x)
    return let(c, one)


def clean_content(c: Column) -> Column:
    """Decode entities, unify line ends, collapse blanks, trim lines, keep at most one blank line."""
    t = _replaced(decode_entities(c), ["\r"], "\r\n?", "\n")
    t = let(_replaced(t, ["  ", "\t"], "[ \t]+", " "), _trim_lines)
    return trimmed(_replaced(t, ["\n\n\n"], "\n{3,}", "\n\n"))


def _split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def humanize_field(c: Column) -> Column:
    readable = _split_camel(trimmed(F.regexp_replace(c, r"[_\-]+", " ")))
    return F.when(readable == "", c).otherwise(readable)


def humanize_json_key(c: Column) -> Column:
    return let(trimmed(_split_camel(F.regexp_replace(c, r"[_\-]+", " "))), lambda t: F.when(t == "", F.lit("Value")).otherwise(upper_first(t)))


def humanize_leaf(c: Column) -> Column:
    leaf = F.substring_index(c, ".", -1)
    leaf = F.when(leaf == "", c).otherwise(leaf)
    return F.lower(_split_camel(F.regexp_replace(leaf, "[_-]+", " ")))


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def norm_value(c: Column) -> Column:
    return F.lower(trimmed(text_or_blank(c)))


def norm_prompt(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.lower(c), f"{WS}+", " "))


def fold(c: Column) -> Column:
    """Compatibility-decompose, drop diacritics, lower. Only non-ASCII text leaves the JVM."""
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    folded = nfkd_fold(F.when(~ascii_only, c))
    return F.when(ascii_only, F.lower(F.translate(c, "^`", ""))).otherwise(folded)


def fold_keep_marks(c: Column) -> Column:
    """Compatibility-decompose and lower, keeping the combining marks."""
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(c)).otherwise(nfkd_lower(F.when(~ascii_only, c)))


def fold_composed(c: Column) -> Column:
    """Compose and lower: a letter with its mark is one sign, so the bare letter is not found in it."""
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(c)).otherwise(nfc_lower(F.when(~ascii_only, c)))


def compact(folded: Column) -> Column:
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def contains_folded(response: Column, expected: Column, with_compact: bool = True) -> Column:
    """Containment on folded texts; blank expectation always holds.

    A whole-word hit is always also a substring hit, so the word test never changes the outcome.
    """
    hit = F.contains(response, expected)
    if with_compact:
        hit = hit | F.contains(compact(response), compact(expected))
    return (expected == "") | hit


def contains_word(response: Column, expected: Column) -> Column:
    """Strict variant: the expectation must stand between non-alphanumerics."""
    padded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), expected, F.lit(r"\E(?![a-z0-9])"))
    return (expected == "") | F.rlike(response, padded)


def is_short_code(c: Column) -> Column:
    stripped = F.regexp_replace(text_or_blank(c), "[^A-Za-z0-9]", "")
    return F.length(stripped).between(2, 3) & (F.upper(stripped) == stripped)


def upper_each(c: Column) -> Column:
    """Upper case code point by code point: one without a single upper-case form (a sharp s, a ligature) stays as it is."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)), "")


def tokens(folded: Column) -> Column:
    return F.array_distinct(F.filter(F.split(folded, "[^a-z0-9.]+"), lambda t: F.length(t) > 1))


def overlap_f1(expected_tokens: Column, actual_tokens: Column) -> Column:
    """Token-set F1; both sides blank counts as full agreement."""
    n_expected, n_actual = F.size(expected_tokens), F.size(actual_tokens)
    both = F.size(F.array_intersect(expected_tokens, actual_tokens))
    precision, recall = both / n_actual, both / n_expected
    return (F.when((n_expected == 0) & (n_actual == 0), F.lit(1.0))
            .when((n_expected == 0) | (n_actual == 0) | (both == 0), F.lit(0.0))
            .otherwise(F.lit(2.0) * precision * recall / (precision + recall)))


def has_no_result_phrase(folded: Column) -> Column:
    return folded.rlike("|".join(NO_RESULT_PHRASES))


def has_no_result_wording(c: Column) -> Column:
    return c.rlike(NO_RESULT_REGEX)


def has_citation(c: Column) -> Column:
    return F.contains(c, F.lit("cite")) | c.rlike(r"\[\^\d+\^\]")


def row_references(c: Column) -> Column:
    """Every ``file.ext:row n`` as ``array<struct<file,row>>`` with the file in lower case."""
    pattern = r"([A-Za-z0-9][A-Za-z0-9._\-/]*\.[A-Za-z0-9]+):row\s+(\d+)"
    files = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    rows = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.zip_with(files, rows, lambda f, r: F.struct(
        F.lower(f).alias("file"), r.try_cast("long").alias("row")))


def fact_key(c: Column) -> Column:
    """Key before the first ``=``; null when there is none or it is blank."""
    key = trimmed(F.substring_index(c, "=", 1))
    return F.when(F.contains(c, F.lit("=")) & (key != ""), key)


def fact_value(c: Column) -> Column:
    """Value after the first ``=``; the whole text when there is no ``=``."""
    return trimmed(F.regexp_replace(c, "(?s)^[^=]*=", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def alias_list(values: Column, limit: int = 10) -> Column:
    """Letters-first aliases up to 128 characters, distinct ignoring case, first ``limit``."""
    cleaned = F.transform(values, lambda v: F.regexp_replace(trimmed(v), f"{WS}+", " "))
    kept = F.filter(cleaned, lambda v: v.rlike("^[A-Za-z][A-Za-z0-9 ]*$") & (F.length(v) <= 128))
    lowered = F.transform(kept, lambda v: F.lower(v))
    firsts = F.filter(
        F.transform(kept, lambda v, i: F.when(F.array_position(lowered, F.lower(v)) == i + 1, v)),
        lambda v: v.isNotNull())
    return F.slice(firsts, 1, limit)


def percent_encode(c: Column) -> Column:
    """Percent encoding that leaves ``A-Z a-z 0-9 - _ . ! ~ * ' ( )`` alone."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def file_stem(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=.)\.([^.]*)$", 1))


def relative_path(path: Column, root: str) -> Column:
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.rstrip("/") + "/"
    at = F.instr(unix, prefix)
    return F.when(at > 0, F.substr(unix, at + F.lit(len(prefix)))).otherwise(unix)


def title_words(c: Column) -> Column:
    """First letter of each word upper-cased, the rest untouched."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: upper_first(w)), " ")


def is_prose(c: Column) -> Column:
    """At least 80 characters with blanks, mostly letters, and no address, code or JSON blob."""
    dense = F.length(F.regexp_replace(c, f"{WS}+", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    plain = ~(c.rlike(r"(?i)^https?://\S+$")
              | c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
              | c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
              | c.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$"))
    # Letters are no blanks, so a text of blanks alone has none; each count is named once, as it reads the whole text.
    return (F.length(c) >= 80) & c.rlike(WS) & plain & (2 * letters >= F.greatest(dense, F.lit(1)))
