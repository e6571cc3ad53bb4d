"""Columns that look alike by embedding: samples, text, vectors and the cosine similarity join."""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import column_text
from lakeweave.operators.sketch import COLUMN_KEY
from lakeweave.session import materialize

SAMPLES = 25
API_SAMPLES = 50
MIN_SCORE = 0.90
TOP = 50
# Vectors of a block and numbers in it at most, how many vectors of either block are multiplied at once, and numbers of the products that are added up at once.
BLOCK = 16_384
HELD = 1 << 22
AT_ONCE = 128
ACROSS = 4096
PIECE = 1 << 19
# A bound of what is collected and sent to all tasks; more vectors than BLOCK times this make larger cells, not other results.
MAX_PIVOTS = 4096
_SLACK = 1e-9
# The arc cosine of numbers near 1 is good to about 1e-8.
_ANGLE_SLACK = 1e-6

# Whatever is no letter, digit or character beyond ASCII.
WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

MATCH_SCHEMA = "col1 string, col2 string, score double"


def first_values(cells: DataFrame, n: int = SAMPLES) -> DataFrame:
    """``(dataset_id, column_name, samples)``: the first ``n`` values of each column in row order.

    The rank limit works inside each partition before the shuffle; a column is never gathered whole.
    """
    in_order = Window.partitionBy(*COLUMN_KEY).orderBy("row_id")
    return (
        cells.withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") <= n)
        .groupBy(*COLUMN_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
        .select(*COLUMN_KEY, F.transform("ranked", lambda r: r["value"]).alias("samples"))
    )


def falsy_to_empty(value: Column, json_type: Column) -> Column:
    """Values that do not count as a sample (0 and false, as JSON scalars) as empty text."""
    zero = (json_type != "STRING") & (value.isin("false") | (value.try_cast("double") == 0))
    return F.when(F.coalesce(zero, F.lit(False)), "").otherwise(value)


def telling_cells(cells: DataFrame) -> DataFrame:
    """Cells with a ``json_type`` in which 0 and false are empty text, so that the column's text leaves them out. They keep their place among the first values."""
    return cells.withColumn("value", falsy_to_empty(F.col("value"), F.col("json_type")))


def column_texts(samples: DataFrame) -> DataFrame:
    """``(dataset_id, column_name, text)`` to embed."""
    name = F.concat_ws(".", "dataset_id", "column_name")
    return samples.select(*COLUMN_KEY, column_text(name, F.col("samples")).alias("text"))


def hashed_terms(texts: DataFrame, size: int = 256) -> DataFrame:
    """Default embedder: unit vectors of signed word counts, without a model to download. A null text is empty; a text without words has the zero vector.

    Words are runs of letters, digits and all characters beyond ASCII, with A-Z in lower case. The first 8 hex digits of a word's MD5 digest, modulo
    twice the size, name its slot: the slots of the upper half count down, so that words which share a place cancel out on average.
    Any ``DataFrame -> DataFrame`` that adds ``embedding ARRAY<DOUBLE>`` can take its place.
    """
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, WORD_BREAK), lambda w: w != "")
    slots = F.transform(words, lambda w: (F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("bigint") % (2 * size)).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(k) for k in range(2 * size)], inputCol="_slots", outputCol="_counts")
    counted = counter.transform(texts.withColumn("_slots", slots)).withColumn("_counts", vector_to_array("_counts"))
    halves = F.slice("_counts", 1, size), F.slice("_counts", size + 1, size)
    signed = counted.withColumn("_signed", F.zip_with(*halves, lambda up, down: up - down))
    sized = signed.withColumn("_norm", F.sqrt(F.aggregate("_signed", F.lit(0.0), lambda total, x: total + x * x)))
    unit = F.transform("_signed", lambda x: F.when(F.col("_norm") > 0, x / F.nullif(F.col("_norm"), F.lit(0.0))).otherwise(F.lit(0.0)))
    return sized.withColumn("embedding", unit).drop("_slots", "_counts", "_signed", "_norm")


def embed_columns(
    texts: DataFrame, embedder: Callable[[DataFrame], DataFrame] = hashed_terms
) -> DataFrame:
    return embedder(texts).select(*COLUMN_KEY, F.col("embedding").cast("array<double>").alias("embedding"))


def named_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.concat_ws(".", *COLUMN_KEY).alias("name"), "embedding")


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors with their length. Those of length zero have no direction and those without a name have no place in an order: they match nothing and are left out."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x))
    return (
        vectors.select("name", F.col("embedding").cast("array<double>").alias("embedding"))
        .withColumn("norm", norm)
        .where((F.col("norm") > 0) & F.col("name").isNotNull())
    )


def _assign_pivots(pivots: np.ndarray, reach: float):
    """Nearest pivot of each vector, and the lower-numbered pivots whose cells it must also visit."""

    def assign(batches):
        for pdf in batches:
            for start in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[start : start + AT_ONCE]
                unit = np.stack(part["embedding"].to_numpy()) / part["norm"].to_numpy()[:, None]
                angle = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
                home = angle.argmin(axis=1)
                near = angle <= angle.min(axis=1)[:, None] + 2 * reach + _ANGLE_SLACK
                near &= np.arange(len(pivots))[None, :] < home[:, None]
                yield part.assign(
                    home=home.astype("int32"), visits=[np.flatnonzero(row).astype("int32") for row in near]
                )

    return assign


def _two_sides(batches: Iterator[pd.DataFrame]):
    """Embeddings, norms and names of the two blocks of a group, and whether they are one block, which is then held once."""
    parts = {True: [], False: []}
    for pdf in batches:
        for left, part in pdf.groupby("left"):
            parts[left].append((np.stack(part["embedding"].to_numpy()), part["norm"].to_numpy(), part["name"].to_numpy()))
        same = bool(pdf["same"].iloc[0])
    one, other = (tuple(np.concatenate(column) for column in zip(*parts[side], strict=True)) for side in (True, False))
    return one, one if same else other, same


def _score_blocks(min_score: float):
    """Scores of one block of residents against itself or another block, of residents or visitors.

    A tile of the two blocks is multiplied at once and its pairs leave in pieces, so a task holds the blocks, one tile and one piece, however many
    pairs pass.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_side, other_side, same = _two_sides(batches)
        if not (one_side and other_side):
            return
        (a, norm_a, names_a), (b, norm_b, names_b) = one_side, other_side
        piece = max(1, PIECE // a.shape[1])
        for start, across in product(range(0, len(a), AT_ONCE), range(0, len(b), ACROSS)):
            cosine = a[start : start + AT_ONCE] @ b[across : across + ACROSS].T
            cosine /= norm_a[start : start + AT_ONCE, None] * norm_b[None, across : across + ACROSS]
            near_i, near_j = np.nonzero(cosine >= min_score - _SLACK)
            for first in range(0, len(near_i), piece):
                i, j = near_i[first : first + piece] + start, near_j[first : first + piece] + across
                # Within one block every pair shows up in both orders; between blocks in one.
                keep = names_a[i] < names_b[j] if same else names_a[i] != names_b[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                exact = np.cumsum(a[i] * b[j], axis=1)[:, -1] / (norm_a[i] * norm_b[j])
                passed = exact >= min_score
                one, other, exact = names_a[i][passed], names_b[j][passed], exact[passed]
                swap = one > other
                yield pd.DataFrame({"col1": np.where(swap, other, one), "col2": np.where(swap, one, other), "score": exact})

    return score


def cosine_pairs(vectors: DataFrame, min_score: float = MIN_SCORE, block: int = BLOCK) -> DataFrame:
    """All pairs ``col1 < col2`` of ``vectors(name, embedding)`` with cosine ``>= min_score``. Exact.

    Vectors live in the cell of their nearest pivot. Two vectors within angle ``t`` of each other can be in
    different cells only if one of them is at most ``2 t`` farther from the other's pivot than from its own,
    so it visits that cell; other cells are never compared. Residents and visitors of a cell are cut into
    blocks of bounded size, and one task compares two blocks with a matrix product, however many vectors
    gather in one cell. Long vectors make smaller blocks: a block has at most `HELD` numbers. Names must be unique. ``vectors`` is read three times, so pass a stored table if it
    is costly to make.
    """
    if not 0 < min_score <= 1:
        raise ValueError(f"min_score must be above 0 and at most 1, not {min_score}")
    unit = _unit_vectors(vectors)
    total, width = unit.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    block = max(1, min(block, HELD // (width or 1)))
    wanted = max(1, min(MAX_PIVOTS, math.ceil(total / block)))
    chosen = unit.orderBy(F.xxhash64("name"), "name").limit(wanted).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], MATCH_SCHEMA)
    pivots = np.array([np.array(row["embedding"]) / row["norm"] for row in chosen])
    assigned = materialize(
        unit.mapInPandas(
            _assign_pivots(pivots, math.acos(min_score)),
            "name string, embedding array<double>, norm double, home int, visits array<int>",
        ),
        "vectors",
    )
    home = F.struct(F.col("home").alias("cell"), F.lit(True).alias("resident"))
    visits = F.transform(
        "visits", lambda v: F.struct(v.alias("cell"), F.lit(False).alias("resident"))
    )
    placed = assigned.withColumn("p", F.explode(F.concat(F.array(home), visits))).select(
        "name", "embedding", "norm", "p.*"
    )
    sizes = (
        placed.groupBy("cell")
        .agg(
            F.count_if("resident").alias("residents"), F.count_if(~F.col("resident")).alias("visitors")
        )
        .select(
            "cell",
            F.greatest(F.ceil(F.col("residents") / block), F.lit(1)).cast("int").alias("r_blocks"),
            F.ceil(F.col("visitors") / block).cast("int").alias("v_blocks"),
        )
    )
    # One row per pivot, at most MAX_PIVOTS.
    blocked = placed.join(F.broadcast(sizes), "cell").withColumn(
        "mine",
        F.when(F.col("resident"), F.pmod(F.xxhash64("name"), F.col("r_blocks"))).otherwise(
            F.col("r_blocks") + F.pmod(F.xxhash64("name"), F.col("v_blocks"))
        ).cast("int"),
    )
    last = F.col("r_blocks") + F.col("v_blocks") - 1
    left = blocked.where("resident").withColumn("other", F.explode(F.sequence("mine", last)))
    right_end = F.when(F.col("resident"), F.col("mine")).otherwise(F.col("r_blocks") - 1)
    right = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), right_end.cast("int"))))
    keys = ["cell", "low", "high"]
    same = F.col("mine") == F.col("other")
    # Fresh aliases keep the two sides apart, which come from the same table.
    payload = [F.col(c).alias(c) for c in ("cell", "name", "embedding", "norm")]
    left = left.select(*payload, F.col("mine").alias("low"), F.col("other").alias("high"), same.alias("same"), F.lit(True).alias("left"))
    right = right.where(~same).select(*payload, F.col("other").alias("low"), F.col("mine").alias("high"), F.lit(False).alias("same"), F.lit(False).alias("left"))
    return left.unionByName(right).groupBy(*keys).applyInPandas(_score_blocks(min_score), MATCH_SCHEMA)


def top_matches(matches: DataFrame, n: int | None = TOP) -> DataFrame:
    ordered = matches.orderBy(F.desc("score"), "col1", "col2")
    return ordered if n is None else ordered.limit(n)
