"""Defaults derived from a dataset's own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import text as tx


def with_defaults(df: DataFrame, base: Column, description: str = "Search items for the {name} dataset.") -> DataFrame:
    """Title-cased name, alphanumeric key and a description for each dataset folder name.

    ``description`` is a template with ``{name}``.
    """
    pretty = tx.trimmed(F.regexp_replace(F.regexp_replace(base, "[._-]+", " "), f"{tx.WS}+", " "))
    name = F.when(pretty == "", "My Items").otherwise(tx.title_words(pretty))
    squeezed = F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))
    key = F.substring(F.when(F.length(squeezed) < 3, F.concat(squeezed, F.lit("source"))).otherwise(squeezed), 1, 128)
    before, after = description.split("{name}", 1)
    return df.withColumns({"name": name, "source_key": key, "description": F.concat(F.lit(before), name, F.lit(after))})
