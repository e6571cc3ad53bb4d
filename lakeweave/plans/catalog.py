"""Catalog plans: metadata records with profiles, summaries of all domains, and the portal report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators.profile import (
    attach_profile,
    crawl_records,
    fill_row_count,
    profile_cells,
    report_records,
    row_counts,
    schema_of_records,
)
from lakeweave.operators.summary import (
    catalog_summary,
    headline_counts,
    recency_histogram,
    rollup_domains,
    semantic_coverage,
)
from lakeweave.session import materialize
from lakeweave.sources.lake import (
    cells_of_rows,
    check_metadata,
    crawl_metadata,
    portal_metadata,
    read_bodies,
)


def profiled_records(bodies: DataFrame, rows: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """Crawl records of portal documents, with row counts and null profiles of the landed rows.

    ``landed(dataset_id)`` names the datasets that have arrived, so that one without rows is told from one that is missing.

    The parsed records are stored, because both the column list and the result are taken from them.
    """
    records = materialize(crawl_records(portal_metadata(bodies)), "records")
    profile = profile_cells(
        cells_of_rows(rows, nested=True), row_counts(rows, landed), schema_of_records(records)
    )
    return attach_profile(records, profile).drop("queryable")


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """Valid crawl records among the metadata files below ``path``."""
    return crawl_metadata(check_metadata(read_bodies(spark, path, "metadata_")))


def domain_summaries(records: DataFrame, now: float) -> DataFrame:
    """All statistics per domain and in total."""
    return rollup_domains(catalog_summary(records, now))


def portal_report(raw: DataFrame, now: float, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The single-portal report; ``counts`` fills in row counts the portal does not state."""
    records = report_records(raw if counts is None else fill_row_count(raw, counts), now)
    return {
        "records": records,
        "headlines": headline_counts(records),
        "recency": recency_histogram(records),
        "coverage": semantic_coverage(records),
    }
