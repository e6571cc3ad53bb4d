"""Repeated byte strings by doubling over Spark rounds: position and rank pairs are reranked at growing offsets.

Every position starts with the 8 bytes that stand there as its rank. A round at offset ``h`` puts a position's rank beside the rank ``h`` bytes on,
counts the pairs, and gives those that occur more than once a new number as their rank at ``2h``. Positions of a unique pair are
unique for good and leave, and with them all that would need their rank. Ranks are numbers of counted pairs, so nothing is hashed and equal ranks
are equal strings. All positions pass one shuffle at the start, 24 bytes for each byte of text: `suffix_array` does the same work with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed, materialize
from lakeweave.session import discard

#: Bytes of the first rank.
FIRST = 8
#: Positions of a batch.
TOGETHER = 200_000


def _first_ranks(length: int):
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                data = np.frombuffer(raw, dtype=np.uint8)
                for a in range(0, len(data) - FIRST + 1, TOGETHER):
                    part = np.lib.stride_tricks.sliding_window_view(data[a : a + TOGETHER + FIRST - 1], FIRST)
                    rank = np.ascontiguousarray(part).view(np.int64).ravel()
                    at = np.arange(a, a + len(rank), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), key)), pa.array(at), pa.array(rank)], names=["row_key", "at", "rank"])

    return ranks


def _reranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Positions whose ``by`` occurs more than once, with its number as their rank. A hot value is combined before the count, and adaptive
    execution cuts its side of the join."""
    counted = pairs.groupBy(*by).count().where("count > 1").select(*by)
    numbered = materialize(counted.withColumn("number", F.monotonically_increasing_id()), "ranks")
    found = materialize(pairs.join(numbered, by).select("row_key", "at", F.col("number").alias("rank")), "positions")
    discard(numbered)
    return found


def repeated_positions(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, at``: the places (bytes from 0) at which a string of ``length`` bytes starts that also starts anywhere else.

    ``row_key`` numbers the rows of ``docs`` in the order of its files. Null, empty and shorter texts have none; repeated rows repeat each other.
    """
    if length < FIRST:
        raise ValueError(f"length must be at least {FIRST}")
    texts = materialize(keyed(documents_of(docs, id_col, text_col)).select("row_key", "text"), "keyed")
    first = texts.mapInArrow(_first_ranks(length), "row_key long, at long, rank long")
    alive, h = _reranked(first, ["rank"]), FIRST
    while h < length:
        step = min(h, length - h)
        ahead = alive.select("row_key", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        before, h = alive, h + step
        alive = _reranked(alive.join(ahead, ["row_key", "at"]), ["rank", "next"])
        discard(before)
    return alive.select("row_key", "at")
