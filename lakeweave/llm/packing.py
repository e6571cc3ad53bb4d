"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

A piece goes to the residual gap for which the sum of the squared counts of open bins per gap becomes smallest. Pieces
are dealt to groups of a fixed expected size and each group keeps only one count per gap, so a task's memory does not
grow with the input. What stands in bins that a group could not fill is dealt anew to fewer groups, until one is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed, materialize, small_count
from lakeweave.llm.tokens import encoder, slices, tokenizer_path

#: Pieces that a group takes.
GROUP = 16_384
#: Bins with fewer free tokens than this share are final before the last round.
NEARLY_FULL = 0.002

PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: full ones, but for the first."""
    count = max(1, -(-n // capacity))
    first = n - capacity * (count - 1)
    return [(0, first)] + [(first + capacity * k, capacity) for k in range(count - 1)]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keeps_space: bool = True) -> DataFrame:
    """The pieces of each row: whole text encoded, ``end_id`` appended, cut where longer than ``capacity``.

    A null or empty text is one piece with the end id alone. Null and repeated ids are kept, each row for itself.
    """

    def encode(batches):
        own = encoder(path, keeps_space)
        for batch in batches:
            keys, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices(texts):
                rows = []
                for k, tokens in zip(range(a, b), own.ids([t or "" for t in texts[a:b]]), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(piece_bounds(len(tokens), capacity)):
                        rows.append((keys[k], ids[k], piece, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], NAMES)

    SCHEMA = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    NAMES = ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"]
    return keyed(documents_of(docs, id_col, text_col)).select("row_key", "doc_id", "text").mapInArrow(encode, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each length, in the order given. Only counts per fill level decide."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    places = np.empty(len(lengths), dtype=np.int64)
    opened = 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        room = capacity - s
        here = count[: room + 1]
        change = 2 * (count[s:] - here) + 2
        change[room] = 1 - 2 * here[room]  # full bins are closed and not counted
        change[here == 0] = never
        change[0] = 2 * count[s] + 1 if room else 0  # a new bin
        level = int(change.argmin())
        if level:
            own = open_bins[level].pop()
            count[level] -= 1
        else:
            own = opened
            opened += 1
        bins[k], places[k] = own, level
        if level + s < capacity:
            count[level + s] += 1
            open_bins[level + s].append(own)
    return bins, places


def _pack_group(capacity: int, both_orders: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dealt", "row_key", "piece"], kind="stable", ignore_index=True)
        if both_orders:
            falling = rows.sort_values("length", ascending=False, kind="stable", ignore_index=True)
            one, other = (sum_of_squares(r["length"].to_numpy(), capacity) for r in (rows, falling))
            rows, (bins, places) = min(((rows, one), (falling, other)), key=lambda x: x[1][0].max(initial=-1))
        else:
            bins, places = sum_of_squares(rows["length"].to_numpy(), capacity)
        filled = np.bincount(bins, weights=rows["length"].to_numpy())
        return pd.DataFrame(
            {"row_key": rows["row_key"], "doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "length": rows["length"], "ids_crc32": rows["ids_crc32"], "bin": bins, "offset": places, "filled": filled[bins].astype(np.int64), "part": rows["part"]}
        )

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the columns of ``token_pieces``. Every piece is placed once.

    Ties go to the lower fill level; the order of pieces is by a hash of their key, so the result is the same each time. An empty
    input gives no row.
    """
    left = materialize(pieces, "pieces")
    closed = None
    turn = 0
    while True:
        count = left.count()
        groups = small_count(count, group)
        last = groups == 1 or turn == 60
        dealt = left.withColumn("dealt", F.xxhash64("row_key", "piece", F.lit(turn))).withColumn("part", F.pmod("dealt", F.lit(groups)))
        packed = dealt.groupBy("part").applyInPandas(_pack_group(capacity, last), PIECES + ", bin long, offset long, filled long, part long")
        packed = packed.withColumn("sequence_id", F.lit(turn << 56) + F.col("part") * (1 << 20) + F.col("bin")).drop("bin")
        if not last:
            packed = materialize(packed, f"packed-{turn}")
        full = capacity if last else int(capacity * (1 - NEARLY_FULL))
        done = packed if last else packed.where(F.col("filled") >= full)
        done = done.drop("filled", "part")
        closed = done if closed is None else closed.unionByName(done)
        if last:
            return closed
        left = packed.where(F.col("filled") < full).select(*pieces.columns)
        turn += 1


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of all documents in as few sequences of at most ``capacity`` as the rule finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and ``row_key``, which tells rows of equal or
    null id apart.
    """
    return pack_pieces(token_pieces(docs, path or tokenizer_path("byte_bpe_50k.json"), capacity, end_id, id_col, text_col), capacity)
