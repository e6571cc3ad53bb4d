"""Columns of tabular data as one long ``cells`` table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.text import raw_text, scalar_text, written_fraction

KEPT_TYPES = (T.StringType, T.NumericType)


def read_tables(spark: SparkSession, directory: str, names) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{directory}/{name}.parquet") for name in names}


def kept_columns(df: DataFrame) -> list[T.StructField]:
    """Text and number columns in table order; booleans, dates and nested values are left out."""
    return [f for f in df.schema.fields if isinstance(f.dataType, KEPT_TYPES)]


def cells_of(df: DataFrame, dataset_id: str, row_id: str | None = None, plain: bool = True) -> DataFrame:
    """One row per cell. A table is read once however many columns it has.

    ``row_id`` names a column that gives the row order; it is carried along as ``row_id``. Without ``plain`` fractions stay as Spark writes
    them and ``fraction`` tells them apart, so that what makes the cells distinct first has fewer numbers to bring into one form.
    """
    write = scalar_text if plain else raw_text
    texts = [write(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kept_columns(df)]
    names = [f"`{f.name}`" for f in kept_columns(df)]
    order = [] if row_id is None else [F.col(f"`{row_id}`").alias("row_id")]
    carried = [] if row_id is None else ["row_id"]
    fractions = [f.name for f in kept_columns(df) if written_fraction(f.dataType)]
    told = [] if plain else [F.col("column_name").isin(fractions).alias("fraction")]
    return (
        df.select(*order, *texts)
        .unpivot(carried, names, "column_name", "value")
        .select(F.lit(dataset_id).alias("dataset_id"), *carried, "column_name", "value", *told)
    )


def cells_from_tables(tables: dict[str, DataFrame], plain: bool = True) -> DataFrame:
    parts = [cells_of(df, name, plain=plain) for name, df in tables.items() if kept_columns(df)]
    if not parts:
        raise ValueError("no table has a text or number column")
    return reduce(DataFrame.unionByName, parts)


def typed_cells(df: DataFrame, dataset_id: str) -> DataFrame:
    """The cells of `cells_of` without ``plain`` that have a value, where whole numbers are left in ``whole`` and doubles in ``real``, so that only what is distinct need be written as text.

    Made of steps that a stream can take. The table is read once.
    """
    columns, places = [F.lit(None).cast(t).alias(f"no_{t}") for t in ("string", "bigint", "double")], []
    kept = kept_columns(df)
    for k, f in enumerate(kept):
        own = F.col(f"`{f.name}`")
        kind = "bigint" if isinstance(f.dataType, T.IntegralType) else "double" if isinstance(f.dataType, T.DoubleType) else "string"
        columns.append((raw_text(own, f.dataType) if kind == "string" else F.when(~F.isnan(own), own) if kind == "double" else own.cast(kind)).alias(f"c{k}"))
        places.append(f"({', '.join(f'c{k}' if t == kind else f'no_{t}' for t in ('string', 'bigint', 'double'))}) AS `{k}`")
    # Names of columns stay out of the statement, whatever they are made of.
    cells = df.sparkSession.sql(f"SELECT * FROM {{wide}} UNPIVOT INCLUDE NULLS ((value, whole, real) FOR number IN ({', '.join(places)}))", wide=df.select(*columns))
    cells = cells.where("value is not null or whole is not null or real is not null")
    told = [F.get(F.array(*[F.lit(x) for x in own]), F.col("number").cast("int")) for own in ([f.name for f in kept], [written_fraction(f.dataType) for f in kept])]
    return cells.select(F.lit(dataset_id).alias("dataset_id"), told[0].alias("column_name"), "value", "whole", "real", told[1].alias("fraction"))


def distinct_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """The cells of tables as `cells_from_tables` gives them without ``plain``, distinct in each column, with the number of ``cells`` behind each value.

    Numbers are made distinct as numbers, the columns of one type in one step, and a column is a number until then: only what is left is written
    as text. Missing values are left out.
    """
    columns, counted = [], []
    for dataset_id, df in tables.items():
        by_type = {}
        for f in kept_columns(df):
            kind = next((t() for t in (T.LongType, T.StringType) if isinstance(f.dataType, (T.IntegralType if t is T.LongType else t))), f.dataType)
            by_type.setdefault(kind, []).append((len(columns), f.name))
            columns.append(F.struct(F.lit(dataset_id).alias("dataset_id"), F.lit(f.name).alias("column_name"), F.lit(written_fraction(f.dataType)).alias("fraction")))
        for kind, numbered in by_type.items():
            typed = df.select(*[F.col(f"`{name}`").cast(kind).alias(str(k)) for k, name in numbered])
            values = typed.unpivot([], [f"`{k}`" for k, _ in numbered], "number", "value").select(F.col("number").cast("int").alias("number"), "value")
            present = values.where(F.col("value").isNotNull() & (~F.isnan("value") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)))
            found = present.groupBy("number", "value").agg(F.count(F.lit(1)).alias("cells"))
            counted.append(found.select("number", raw_text(F.col("value"), kind).alias("value"), "cells"))
    if not columns:
        raise ValueError("no table has a text or number column")
    named = reduce(DataFrame.unionByName, counted).withColumn("column", F.get(F.array(*columns), F.col("number")))
    return named.select("column.dataset_id", "column.column_name", "value", "column.fraction", "cells")


def first_cells(df: DataFrame, dataset_id: str, order: list[str], n: int) -> DataFrame:
    """Cells of the first ``n`` rows in the order of ``order``, with ``row_id`` from 0 and the ``json_type`` of their column (``STRING`` or ``NUMBER``).

    The rows are limited before the table is taken apart. Where ``order`` does not tell rows apart, the kept columns do; rows that agree in
    those as well give the same cells.
    """
    keys = [F.col(f"`{c}`") for c in dict.fromkeys([*order, *(f.name for f in kept_columns(df))])]
    first = df.orderBy(*keys).limit(n)
    # A window without partitions over n rows at most.
    numbered = first.withColumn("row id", F.row_number().over(Window.orderBy(*keys)) - 1)
    texts = [scalar_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in kept_columns(df)]
    names = [f"`{f.name}`" for f in kept_columns(df)]
    numbers = [f.name for f in kept_columns(df) if isinstance(f.dataType, T.NumericType)]
    return (
        numbered.select("row id", *texts)
        .unpivot(["row id"], names, "column_name", "value")
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            F.col("row id").alias("row_id"),
            "column_name",
            "value",
            F.when(F.col("column_name").isin(numbers), "NUMBER").otherwise("STRING").alias("json_type"),
        )
    )
