"""Stored tables: pairs, labels, populations, line lists, matches, sketches, embeddings, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave import schemas
from lakeweave.functions.text import strip
from lakeweave.operators.joinability import PAIR_COLUMNS


def _read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Read a headered CSV by column name; columns may come in any order and others may be present."""
    header = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(header.columns))
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    return header.select(*[F.col(f"`{name}`").cast(types[name]).alias(name) for name in required])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Joinable pairs from CSV; an error names the columns that are missing."""
    return _read_csv(spark, path, schemas.PAIRS, PAIR_COLUMNS)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(*PAIR_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.LABELS, ["dataset_id", "name"])


def read_population(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(
        spark, path, schemas.POPULATION, ["domain", "city", "state/province", "population"]
    )


def write_report(records: DataFrame, path: str) -> None:
    """Flat metadata records as headered CSV."""
    records.write.mode("overwrite").option("header", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One stripped, non-empty line per row, column ``value``."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"))
    return lines.where(F.col("value") != "")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Similarity matches from a JSON array of objects."""
    return spark.read.schema(schemas.MATCHES).option("multiLine", True).json(path)


def write_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").json(path)


def write_sketches(sketches: DataFrame, path: str) -> None:
    sketches.write.mode("overwrite").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SKETCHES).parquet(path)


def append_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("append").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """All statistics in one table, a folder per statistic."""
    summary.write.mode("overwrite").partitionBy("statistic").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOMAIN_COUNTS).json(path)


def write_routed(routed: DataFrame, path: str) -> None:
    """Landed payloads in a folder per route."""
    routed.write.mode("overwrite").partitionBy("route").parquet(path)
