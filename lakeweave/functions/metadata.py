"""Rules on catalog columns: which kind of column it is and which statistics it can have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logical column types and name parts that the rules look for.
LOCATION_TYPES = ("location", "point", "multipolygon", "polygon")
LOCATION_WORDS = ("latitude", "longitude", "geom", "geocode", "borough")
DATE_TYPES = ("calendar_date", "floating_timestamp", "date", "meta_data", "timestamp")
YEAR_TYPES = ("number", "text")
YEAR_FIELDS = ("fiscal_year", "school_year")
GEOMETRY_TYPES = ("point", "location", "polygon", "multipolygon", "line", "multiline", "multipoint")
TEXT_TYPES = ("text", "url", "email", "phone", "html")
UNQUERYABLE_ASSETS = ("filter", "href", "external", "link", "file", "chart", "map", "story")
TABULAR = "tabular"


def _lower(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _has(columns: Column, rule) -> Column:
    return F.coalesce(
        F.exists(
            columns,
            lambda c: rule(_lower(c["data_type"]), _lower(c["field_name"]), _lower(c["name"])),
        ),
        F.lit(False),
    )


def special_columns(columns: Column) -> dict[str, Column]:
    """Three flags per dataset: has a location, a date, a year column.

    ``columns`` is an array of structs with ``field_name``, ``name`` and ``data_type``.
    """
    return {
        "has_location_column": _has(
            columns,
            lambda kind, field, name: kind.isin(*LOCATION_TYPES)
            | _any(field.contains(w) for w in LOCATION_WORDS),
        ),
        "has_date_column": _has(
            columns,
            lambda kind, field, name: kind.isin(*DATE_TYPES)
            | field.contains("date")
            | name.contains("date"),
        ),
        "has_year_column": _has(
            columns,
            lambda kind, field, name: (kind.isin(*YEAR_TYPES) & field.contains("year"))
            | _any(field.contains(w) for w in YEAR_FIELDS),
        ),
    }


def is_profiled(field: Column, data_type: Column) -> Column:
    """False for computed fields and geometry, whose null counts are 0 by definition."""
    computed = field.startswith(":@") | field.startswith("@")
    return ~computed & ~F.coalesce(data_type.isin(*GEOMETRY_TYPES), F.lit(False))


def is_text_like(data_type: Column) -> Column:
    return F.coalesce(data_type.isin(*TEXT_TYPES), F.lit(False))
