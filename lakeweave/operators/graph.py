"""Table-level join graph and its reports, from joinable column pairs or similarity matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.text import dataset_label, endpoint_dataset
from lakeweave.operators.profile import usable_labels

STRONG_SCORE = 0.9993


def dataset_edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges ``src < dst`` with the number of column pairs and the best estimates."""
    left, right = F.col("left_dataset"), F.col("right_dataset")
    return (
        pairs.where(left != right)
        .groupBy(F.least(left, right).alias("src"), F.greatest(left, right).alias("dst"))
        .agg(
            F.count(F.lit(1)).alias("num_joinable_columns"),
            F.max("js").alias("max_js"),
            F.max(F.greatest("jc_left_in_right", "jc_right_in_left")).alias("max_jc"),
        )
    )


def visible_edges(edges: DataFrame, min_edge_weight: float = 0.0) -> DataFrame:
    return edges.where(F.col("max_jc") >= min_edge_weight)


def dataset_nodes(edges: DataFrame) -> DataFrame:
    """Per dataset: partners, joinable columns over all partners, best containment."""
    ends = F.explode(F.array("src", "dst")).alias("dataset")
    return (
        edges.select(ends, "num_joinable_columns", "max_jc")
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("num_partners"),
            F.sum("num_joinable_columns").alias("total_joinable_columns"),
            F.max("max_jc").alias("max_jc_with_partner"),
        )
    )


def dataset_pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left_dataset", "right_dataset").agg(
        F.count(F.lit(1)).alias("num_column_pairs")
    )


def pair_counts_of_edges(edges: DataFrame) -> DataFrame:
    """`dataset_pair_counts` from edges; the left dataset of a pair sorts first, as ``src`` does."""
    return edges.select(F.col("src").alias("left_dataset"), F.col("dst").alias("right_dataset"), F.col("num_joinable_columns").alias("num_column_pairs"))


def hub_degree_of_edges(edges: DataFrame) -> DataFrame:
    """`hub_degree` from edges: each edge is one partner for either end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("dataset")).groupBy("dataset").agg(F.count(F.lit(1)).alias("num_partners"))


def hub_degree(pairs: DataFrame) -> DataFrame:
    """Distinct partners of each dataset, counted over both directions."""
    left, right = F.col("left_dataset"), F.col("right_dataset")
    directed = F.array(
        F.struct(left.alias("dataset"), right.alias("partner")),
        F.struct(right.alias("dataset"), left.alias("partner")),
    )
    return (
        pairs.select("left_dataset", "right_dataset")
        .distinct()
        .select(F.explode(directed).alias("d"))
        .select("d.*")
        .distinct()
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("num_partners"))
    )


def top(df: DataFrame, measure: str, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows with the largest ``measure``, keys as tie-break."""
    return df.orderBy(F.desc(measure), *keys).limit(n)


def label_table(labels: DataFrame) -> DataFrame:
    """``(dataset_id, label)`` from ``(dataset_id, name)``; of several names per id one is kept."""
    return (
        usable_labels(labels)
        .select("dataset_id", dataset_label(F.col("dataset_id"), F.col("name")).alias("label"))
        .groupBy("dataset_id")
        .agg(F.max("label").alias("label"))
    )


def with_label(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Add the label of the dataset in ``column``, or its id where there is none.

    The join is left to the optimizer: it broadcasts the labels while they are small and shuffles else.
    """
    named = labels.select(F.col("dataset_id").alias(column), F.col("label").alias("_label"))
    return df.join(named, column, "left").select(
        *df.columns, F.coalesce("_label", column).alias(name)
    )


def top_hubs(nodes: DataFrame, labels: DataFrame, n: int = 15) -> DataFrame:
    """Datasets with the most partners, labelled, in this order: a join keeps none, so the few rows are sorted behind it."""
    best = top(nodes, "num_partners", n, "dataset")
    return with_label(best, labels, "dataset", "label").orderBy(F.desc("num_partners"), "dataset")


def top_pairs(pairs: DataFrame, labels: DataFrame, n: int = 15) -> DataFrame:
    """Dataset pairs with the most joinable columns, labelled, in this order."""
    order = ["num_column_pairs", "left_dataset", "right_dataset"]
    best = top(dataset_pair_counts(pairs), order[0], n, *order[1:])
    labelled = with_label(best, labels, "left_dataset", "left_label")
    labelled = with_label(labelled, labels, "right_dataset", "right_label")
    return labelled.withColumn("pair", F.concat_ws(" ↔ ", "left_label", "right_label")).orderBy(F.desc(order[0]), *order[1:])


def strong_edges(matches: DataFrame, min_score: float = STRONG_SCORE) -> DataFrame:
    """Matches strong enough to draw, with the datasets of both endpoints."""
    return matches.where(F.col("score") >= min_score).select(
        "col1",
        "col2",
        "score",
        endpoint_dataset(F.col("col1")).alias("dataset1"),
        endpoint_dataset(F.col("col2")).alias("dataset2"),
    )


def endpoint_frequency(matches: DataFrame) -> DataFrame:
    """Matches per dataset; a match inside one dataset counts twice for it."""
    ends = F.array(endpoint_dataset(F.col("col1")), endpoint_dataset(F.col("col2")))
    return (
        matches.select(F.explode(ends).alias("dataset"))
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("count"))
    )
