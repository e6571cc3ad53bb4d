"""Bucket sets and the expression that assigns a value to its bucket."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Buckets(NamedTuple):
    """``labels[i]`` covers ``edges[i]`` to ``edges[i + 1]``; a last edge of None leaves it open.

    Buckets are closed on the left, or on the right with ``closed_right``. Values outside get null.
    """

    edges: tuple
    labels: tuple
    closed_right: bool = False

    def label(self, value: Column) -> Column:
        result = None
        for low, high, label in zip(self.edges, self.edges[1:], self.labels):
            inside = value > low if self.closed_right else value >= low
            if high is not None:
                inside &= value <= high if self.closed_right else value < high
            result = F.when(inside, label) if result is None else result.when(inside, label)
        return result


# The bucket sets of the reports.
REPORT_ROWS = Buckets(
    (0, 1_000, 10_000, 100_000, 1_000_000, None), ("0–1K", "1K–10K", "10K–100K", "100K–1M", "1M+")
)
UNKNOWN = "unknown"
ROWS = Buckets(
    (0, 1_000, 10_000, 100_000, 1_000_000, 10_000_000, None),
    ("0-1K", "1K-10K", "10K-100K", "100K-1M", "1M-10M", "10M+"),
)
USES = Buckets((0, 100, 1_000, 10_000, None), ("0-100", "100-1K", "1K-10K", "10K+"))
ATTRIBUTES = Buckets(
    (0, 10, 20, 30, 40, 50, None), ("0-10", "10-20", "20-30", "30-40", "40-50", "50+")
)
SPARSENESS = Buckets(
    (0, 1, 5, 10, 25, 50, 100),
    (
        "< 1% sparse",
        "1-5% sparse",
        "5-10% sparse",
        "10-25% sparse",
        "25-50% sparse",
        "50%+ sparse",
    ),
)
RECENCY = Buckets(
    (-1, 30, 180, 365, 730, None), ("<=30d", "31-180d", "181-365d", "1-2y", "2y+"), True
)


def report_row_bucket(row_count: Column) -> Column:
    """Row bucket of the single-portal report; missing and negative counts are ``unknown``."""
    return F.coalesce(REPORT_ROWS.label(row_count), F.lit(UNKNOWN))
