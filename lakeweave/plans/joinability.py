"""Flagship plan: which columns of which tables can be joined, how well, and in which direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators.graph import (
    dataset_edges,
    dataset_nodes,
    label_table,
    top_hubs,
    top_pairs,
)
from lakeweave.operators.joinability import joinable_pairs, rank_pairs
from lakeweave.operators.sketch import build_sketches
from lakeweave.operators.stats import equal_width_histogram
from lakeweave.session import materialize
from lakeweave.sources.lake import WHOLE_BYTES, boolean_columns, cells_of_rows, read_rows, without_columns
from lakeweave.sources.tables import distinct_cells, read_tables


def lake_sketches(spark: SparkSession, directory: str, names, **options) -> DataFrame:
    """Stored sketches of all columns of the named tables."""
    cells = distinct_cells(read_tables(spark, directory, names))
    return materialize(build_sketches(cells, **options), "sketches")


def lake_pairs(
    spark: SparkSession,
    directory: str,
    names,
    js_threshold: float = 0.3,
    jc_threshold: float = 0.5,
    **options,
) -> DataFrame:
    """Joinable column pairs of the named tables, strongest first."""
    sketches = lake_sketches(spark, directory, names, **options)
    return rank_pairs(joinable_pairs(sketches, js_threshold, jc_threshold))


def landed_sketches(spark: SparkSession, path: str, min_support: int = 50, whole_bytes: int = WHOLE_BYTES, **options) -> DataFrame:
    """Stored sketches of the JSON datasets landed below ``path``."""
    # Files are split into records once; the records, which are many tasks, are what is parsed and counted.
    rows = materialize(read_rows(spark, path, whole_bytes=whole_bytes), "landed-rows")
    cells = cells_of_rows(rows)
    sketches = build_sketches(cells, min_support=min_support, **options)
    return materialize(without_columns(sketches, boolean_columns(cells, rows)), "sketches")


def join_graph(pairs: DataFrame, labels: DataFrame, n: int = 15) -> dict[str, DataFrame]:
    """The reports on a set of joinable pairs, which are made once and stored."""
    pairs = materialize(pairs, "graph-pairs")
    edges = dataset_edges(pairs)
    named = label_table(labels)
    return {
        "edges": edges,
        "hubs": top_hubs(dataset_nodes(edges), named, n),
        "pairs": top_pairs(pairs, named, n),
        "containment": equal_width_histogram(pairs, ["jc_left_in_right", "jc_right_in_left"], 30),
    }
