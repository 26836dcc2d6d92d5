"""Vocabulary that decides which columns carry which role."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names that mark a column as entity, year or code.
DEFAULT_KEY_FIELD_CANDIDATES = {
    "entity": ["country", "countryName", "country_name", "name", "entity", "region", "company",
               "organization", "station", "city", "state", "location"],
    "year": ["year", "date", "time_period", "period", "quarter", "month"],
    "iso": ["iso_code", "countryiso3code", "countryIso3Code", "country_id", "countryId", "id", "code"],
}

# Column roles of a long-format indicator table.
DEFAULT_LONG_COLUMNS = {
    "id": "indicatorId",
    "name": "indicatorName",
    "entity": "countryName",
    "year": "date",
    "value": "value",
    "iso": "countryiso3code",
    "label": "long-format indicators",
}


@dataclass(frozen=True)
class EnrichConfig:
    """How source columns map to roles, labels and priorities."""

    field_aliases: dict[str, str] = field(default_factory=dict)
    priority_fields: tuple[str, ...] = ()
    key_fields: dict[str, list[str]] = field(default_factory=lambda: dict(DEFAULT_KEY_FIELD_CANDIDATES))
    long_columns: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_LONG_COLUMNS))
    # Long-format grouping only happens when the caller named the long columns explicitly.
    explicit_long: bool = False

    def is_long_table(self, header: list[str]) -> bool:
        needed = {self.long_columns[role] for role in ("id", "name", "entity", "year", "value")}
        return self.explicit_long and needed <= set(header)
