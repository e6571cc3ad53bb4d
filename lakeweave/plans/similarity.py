"""Embedding plan: sample values, describe columns, embed them, and find the most alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lakeweave.operators.similarity import (
    MIN_SCORE,
    SAMPLES,
    TOP,
    column_texts,
    cosine_pairs,
    embed_columns,
    first_values,
    hashed_terms,
    named_vectors,
    top_matches,
)
from lakeweave.session import materialize


def alike_columns(
    cells: DataFrame,
    samples: int = SAMPLES,
    min_score: float = MIN_SCORE,
    top: int | None = TOP,
    embedder: Callable[[DataFrame], DataFrame] = hashed_terms,
) -> DataFrame:
    """Most similar column pairs of ``cells(dataset_id, row_id, column_name, value)``."""
    texts = column_texts(first_values(cells, samples))
    vectors = materialize(embed_columns(texts, embedder), "embeddings")
    return top_matches(cosine_pairs(named_vectors(vectors), min_score), top)
