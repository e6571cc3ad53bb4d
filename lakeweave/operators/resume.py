"""Set logic for runs that are repeated: what is left to do, what is missing, what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_yet_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).subtract(right.select(key))


def completeness(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """``(domain, missing_count, total_count)`` of the domains that lack some expected dataset."""
    keys = ["domain", "dataset_id"]
    present = existing.select(*keys).distinct().withColumn("present", F.lit(True))
    return (
        expected.select(*keys)
        .distinct()
        .join(present, keys, "left")
        .groupBy("domain")
        .agg(
            F.count_if(F.col("present").isNull()).alias("missing_count"),
            F.count(F.lit(1)).alias("total_count"),
        )
        .where(F.col("missing_count") > 0)
    )


def merge_counts(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counts of two runs: a cached success stays, everything else takes the new value if there is one."""
    old = cached.select("domain", F.col("count").alias("old"), F.col("error").alias("old_error"))
    new = fresh.select("domain", F.col("count").alias("new"), F.col("error").alias("new_error"))
    keep = (F.col("old") >= 0) | F.col("new").isNull()
    return old.join(new, "domain", "full_outer").select(
        "domain",
        F.when(keep, F.col("old")).otherwise(F.col("new")).alias("count"),
        F.when(keep, F.col("old_error")).otherwise(F.col("new_error")).alias("error"),
    )


def keep_lines(
    lines: DataFrame,
    column: str = "value",
    include: str | None = None,
    exclude: str | None = None,
    at_start: bool = False,
) -> DataFrame:
    """Lines with ``include`` and without ``exclude``, anywhere in the line or only at its start."""
    text = F.col(column)
    found = text.startswith if at_start else text.contains
    if include is not None:
        lines = lines.where(found(include))
    if exclude is not None:
        lines = lines.where(~found(exclude))
    return lines


def titled(pages: DataFrame, title: str, phrase: str) -> DataFrame:
    """Pages whose lowered title contains ``phrase``."""
    return pages.where(F.lower(title).contains(phrase))


def new_domains(items: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Distinct domains of a catalog crawl, less those already known."""
    found = items.where(F.coalesce(F.col("domain"), F.lit("")) != "").select("domain").distinct()
    return found if seen is None else not_yet_done(found, seen, "domain")
