"""Property-name rules. Column forms for names that are data, plain forms for header metadata."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.functions.text import lower_first, upper_first

NAME_LIMIT = 32
VALID_NAME_REGEX = "^[A-Za-z][A-Za-z0-9]{0,31}$"

# Names and endings that keep a column as text.
PRESERVE_EXACT = ("year", "month", "quarter", "period", "fiscal_year", "fiscalyear", "week",
                  "date", "time", "timestamp")
PRESERVE_ENDINGS = ("id", "code", "key", "no", "num", "iso", "zip", "postal", "phone", "fax",
                    "npi", "duns", "taxonomy", "account")


def search_name(c: Column) -> Column:
    """Alphanumeric parts in camel case, first letter lowered, ``field`` in front of a digit."""
    parts = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    camel = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, lower_first(p)).otherwise(upper_first(p))), "")
    base = (F.when(camel == "", F.lit("field"))
            .when(camel.rlike("^[A-Za-z]"), camel)
            .otherwise(F.concat(F.lit("field"), upper_first(camel))))
    return F.substring(base, 1, NAME_LIMIT)


def plain_name(c: Column, blank: str = "col") -> Column:
    """Separators removed, the next character upper-cased, ``p`` in front of a digit."""
    parts = F.split(c, "[^A-Za-z0-9]+")
    camel = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(upper_first(p))), "")
    camel = F.when(camel == "", F.lit(blank)).otherwise(camel)
    return F.substring(F.when(camel.rlike("^[A-Za-z]"), camel).otherwise(F.concat(F.lit("p"), camel)), 1, NAME_LIMIT)


def search_base(name: str) -> str:
    parts = re.findall("[A-Za-z0-9]+", name)
    if not parts:
        return "field"
    base = parts[0][0].lower() + parts[0][1:] + "".join(p[0].upper() + p[1:] for p in parts[1:])
    if not base[0].isalpha():
        base = "field" + base[0].upper() + base[1:]
    return base[:NAME_LIMIT]


def plain_base(name: str, blank: str = "col") -> str:
    first, *rest = re.split("[^A-Za-z0-9]+", name)
    base = (first + "".join(p[:1].upper() + p[1:] for p in rest)) or blank
    return (base if base[:1].isalpha() else "p" + base)[:NAME_LIMIT]


def suffixed(base: str, n: int) -> str:
    return base[:NAME_LIMIT - len(str(n))] + str(n)


def unique_names(bases: list[str], taken=(), first_suffix: int = 2) -> list[str]:
    """Each base in turn, numbered from ``first_suffix`` while its name is taken."""
    used, out = set(taken), []
    for base in bases:
        name, n = base, first_suffix
        while name in used:
            name, n = suffixed(base, n), n + 1
        used.add(name)
        out.append(name)
    return out


def assign_names(taken=(), first_suffix: int = 2):
    """Array form of :func:`unique_names` for one source's ordered base names."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def assign(s: pd.Series) -> pd.Series:
        return s.map(lambda bases: unique_names(list(bases), taken, first_suffix), na_action="ignore")
    return assign


def last_segment(c: Column) -> Column:
    return F.substring_index(F.lower(c), ".", -1)


def keeps_text(c: Column) -> Column:
    """Column name that forces text whatever the values look like."""
    last = last_segment(c)
    return last.isin(*PRESERVE_EXACT) | last.rlike(f"(^|[._])({'|'.join(PRESERVE_ENDINGS)})$")


def hints_exact_match(c: Column) -> Column:
    return last_segment(c).rlike("(^|[._])(id|code|key)$")
