"""The Unicode fold, the one step the JVM has no function for, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # the richer module knows the Diacritic property
    import regex as _regex

    _MARKS = _regex.compile(r"\p{Diacritic}")
except ImportError:  # pragma: no cover
    _MARKS = re.compile("[\\^`" + "".join(map(chr, (0xA8, 0xAF, 0xB4, 0xB7, 0xB8, *range(0x300, 0x370)))) + "]")


@F.pandas_udf(T.StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: _MARKS.sub("", unicodedata.normalize("NFKD", v)).lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkd_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKD", v).lower(), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v).lower(), na_action="ignore")
