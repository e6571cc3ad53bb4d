"""Null profiles, row counts and the metadata records they are attached to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import metadata as rules
from lakeweave.functions import times
from lakeweave.functions.buckets import report_row_bucket
from lakeweave.functions.text import strip
from lakeweave.operators.sketch import COLUMN_KEY


def logical_type(data_type: T.DataType) -> str:
    """Catalog type name of a Spark type."""
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "calendar_date"
    if isinstance(data_type, T.BooleanType):
        return "checkbox"
    return data_type.typeName()


def profile_table(df: DataFrame, dataset_id: str, types: dict[str, str] | None = None) -> DataFrame:
    """Row count, nulls and semantic nulls of every column, from one aggregate over the table.

    A semantic null is a null or blank cell of a text-like column; other types have none. ``types``
    overrides the logical type of a column.
    """
    fields = [
        (f.name, (types or {}).get(f.name, logical_type(f.dataType))) for f in df.schema.fields
    ]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    stats = []
    for i, (name, kind) in enumerate(fields):
        cell = F.col(f"`{name}`")
        computed = name.startswith((":@", "@"))
        profiled = not computed and kind not in rules.GEOMETRY_TYPES
        nulls, blank = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        if profiled:
            aggregates.append(F.count(cell).alias(f"present_{i}"))
            nulls = F.col("rows") - F.col(f"present_{i}")
        if profiled and kind in rules.TEXT_TYPES:
            aggregates.append(
                F.count_if(cell.isNull() | (F.trim(cell.cast("string")) == "")).alias(f"blank_{i}")
            )
            blank = F.col(f"blank_{i}")
        stats.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("type"),
                nulls.alias("nulls"),
                blank.alias("semantic_nulls"),
            )
        )
    return (
        df.agg(*aggregates)
        .select(F.lit(dataset_id).alias("dataset_id"), "rows", F.explode(F.array(*stats)).alias("s"))
        .select("dataset_id", F.col("rows").alias("row_count"), "s.*")
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile_table(df, name) for name, df in tables.items()])


def row_counts(rows: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """Rows per dataset; datasets of ``landed(dataset_id)`` without a row have 0."""
    counts = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count"))
    if landed is None:
        return counts
    known = landed.select("dataset_id").distinct()
    return known.join(counts, "dataset_id", "left").select("dataset_id", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def profile_cells(cells: DataFrame, counts: DataFrame, columns: DataFrame) -> DataFrame:
    """The same profile for a lake of landed payloads, all datasets in one job.

    ``columns(dataset_id, position, column_name, type)`` lists the columns to profile; a key that a
    record lacks is a null. Blank text is counted next to the non-null cells, so a single aggregate by
    column carries everything.
    """
    seen = (
        cells.where(F.col("value").isNotNull())
        .groupBy(*COLUMN_KEY)
        .agg(
            F.count(F.lit(1)).alias("present"),
            F.count_if(F.trim("value") == "").alias("blank"),
        )
    )
    profiled = rules.is_profiled(F.col("column_name"), F.col("type"))
    present = F.coalesce("present", F.lit(0))
    nulls = F.when(profiled, F.col("row_count") - present).otherwise(F.lit(0))
    semantic = F.when(
        profiled & rules.is_text_like(F.col("type")),
        F.col("row_count") - present + F.coalesce("blank", F.lit(0)),
    ).otherwise(F.lit(0))
    return (
        columns.join(counts, "dataset_id")
        .join(seen, COLUMN_KEY, "left")
        .select(
            "dataset_id",
            "row_count",
            "position",
            "column_name",
            "type",
            nulls.alias("nulls"),
            semantic.alias("semantic_nulls"),
        )
    )


def attach_profile(records: DataFrame, profile: DataFrame) -> DataFrame:
    """Set ``row_count`` and ``columns`` of metadata records from a profile; others stay as they are."""
    columns = profile.groupBy("dataset_id").agg(
        F.max("row_count").alias("profiled_rows"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "position",
                    F.col("column_name").alias("name"),
                    "type",
                    "nulls",
                    "semantic_nulls",
                )
            )
        ).alias("profiled"),
    )
    bare = F.transform(
        "profiled",
        lambda c: F.struct(
            c["name"].alias("name"),
            c["type"].alias("type"),
            c["nulls"].alias("nulls"),
            c["semantic_nulls"].alias("semantic_nulls"),
        ),
    )
    kept = [c for c in records.columns if c not in ("row_count", "columns")]
    return records.join(columns, "dataset_id", "left").select(
        *kept,
        F.coalesce("profiled_rows", "row_count").alias("row_count"),
        F.coalesce(bare, F.col("columns")).alias("columns"),
    )


def fill_row_count(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Counted rows where the metadata states none."""
    counted = counts.select("dataset_id", F.col("row_count").alias("counted"))
    return records.join(counted, "dataset_id", "left").select(
        *[c for c in records.columns if c != "row_count"],
        F.coalesce("row_count", "counted").alias("row_count"),
    )


def _fields(columns: Column) -> Column:
    return F.filter(columns, lambda c: F.coalesce(c["field_name"], F.lit("")) != "")


def crawl_records(raw: DataFrame) -> DataFrame:
    """Portal metadata to crawl records; null counts are still open.

    Only tabular datasets keep a column list. Assets that cannot be queried keep it without statistics
    and with the row count stated beside the metadata; ``queryable`` tells which ones wait for a profile.
    """
    tabular = F.col("view_type") == rules.TABULAR
    unqueryable = F.coalesce("asset_type", F.lit("")).isin(*rules.UNQUERYABLE_ASSETS)
    unknown = F.lit(None).cast("bigint")
    columns = F.transform(
        _fields(F.col("columns")),
        lambda c: F.struct(
            c["field_name"].alias("name"),
            c["data_type"].alias("type"),
            unknown.alias("nulls"),
            unknown.alias("semantic_nulls"),
        ),
    )
    has_columns = F.size(columns) > 0
    return raw.select(
        "domain",
        "dataset_id",
        "category",
        F.col("view_type").alias("format"),
        "tags",
        "download_count",
        "view_count",
        "created_at",
        "publication_date",
        F.col("view_last_modified").alias("updated_at"),
        F.when(tabular & unqueryable & has_columns, F.col("stated_row_count")).alias("row_count"),
        F.when(tabular & has_columns, columns).alias("columns"),
        F.coalesce(tabular & ~unqueryable & has_columns, F.lit(False)).alias("queryable"),
    )


def schema_of_records(records: DataFrame) -> DataFrame:
    """``(dataset_id, position, column_name, type)`` of the datasets waiting for a profile."""
    return (
        records.where("queryable")
        .select("dataset_id", F.posexplode("columns").alias("position", "c"))
        .select(
            "dataset_id",
            "position",
            F.col("c.name").alias("column_name"),
            F.col("c.type").alias("type"),
        )
    )


def report_records(raw: DataFrame, now: float) -> DataFrame:
    """Portal metadata to the flat records of the single-portal report."""
    updated = F.coalesce(
        F.nullif("rows_updated_at", F.lit(0)), F.nullif("data_updated_at", F.lit(0))
    )
    base = raw.select(
        "dataset_id",
        "name",
        "category",
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"),
        "view_type",
        "download_type",
        F.when(F.col("columns").isNull(), 0).otherwise(F.size("columns")).alias("n_columns"),
        F.col("row_count").try_cast("bigint").alias("row_count"),
        times.from_epoch(F.col("created_at")).alias("created_at"),
        times.from_epoch(updated).alias("updated_at"),
        "view_count",
        "download_count",
        *[flag.alias(name) for name, flag in rules.special_columns(F.col("columns")).items()],
    )
    return derive_recency(
        base.withColumn("row_count_bucket", report_row_bucket(F.col("row_count"))), now
    )


def derive_recency(records: DataFrame, now: float) -> DataFrame:
    return records.withColumns(
        {
            "created_year": F.year("created_at"),
            "updated_days_ago": times.days_since(F.col("updated_at"), now),
        }
    )


def usable_labels(labels: DataFrame) -> DataFrame:
    """Rows of a label table that name a dataset."""
    return labels.where(F.coalesce(strip(F.col("dataset_id")), F.lit("")) != "")
