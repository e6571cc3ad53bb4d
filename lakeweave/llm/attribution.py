"""Token counts per section of a text, by the tokens' places.

A whole text is encoded once. Its tokens' character spans meet the spans of its sections in one sorted pass, and a token that covers
characters of several sections goes to one of them by a stated rule.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed
from lakeweave.llm.tokens import encoder, slices, tokenizer_path

RULES = ("first", "last", "most")
COUNTS = "row_key long, doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["row_key", "doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

Spans = tuple[np.ndarray, np.ndarray]


def line_sections(text: str) -> Spans:
    """A section for each line, with the line break that ends it. An empty text has none."""
    sizes = np.array([len(line) + 1 for line in text.split("\n")], dtype=np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kept = sizes > 0
    return starts[kept], ends[kept]


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and, of these, tokens that reach into another one.

    Sections are sorted and do not overlap. ``first`` takes the section of a token's first character that lies in any, ``last`` that of the
    last one, ``most`` the section with most of its characters and the earlier one of equals. A token outside all sections counts
    nowhere; a token without characters, such as the later bytes of a character, goes where its first character stands.
    """
    counts, crossing = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    if not len(starts) or not len(first):
        return counts, crossing
    end = np.maximum(end, first + 1)
    low = np.searchsorted(ends, first, side="right")  # the first section that ends behind the token's start
    high = np.searchsorted(starts, end, side="left") - 1  # the last one that starts before its end
    inside = low <= high
    low, high, first, end = low[inside], high[inside], first[inside], end[inside]
    many = low < high
    chosen = low if rule == "first" else high
    if rule == "most":
        chosen = low.copy()
        for k in np.flatnonzero(many):
            own = np.arange(low[k], high[k] + 1)
            covered = np.minimum(ends[own], end[k]) - np.maximum(starts[own], first[k])
            chosen[k] = own[covered.argmax()]
    np.add.at(counts, chosen, 1)
    np.add.at(crossing, chosen[many], 1)
    return counts, crossing


def section_tokens(docs: DataFrame, path: str | None = None, keeps_space: bool = True, rule: str = "first", sections: DataFrame | None = None, find: Callable[[str], Spans] = line_sections, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: ``row_key, doc_id, section, start, end`` (characters), ``n_tokens, n_crossing``.

    Sections are what ``find`` makes of each text, numbered from 0, or the rows of ``sections`` (``doc_id, section, start, end``), which must not
    overlap within a document; rows with nulls or without characters are left out, repeated rows count once. A null or empty text has no section from
    ``find``. Null and repeated ids are kept.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or tokenizer_path("byte_bpe_50k.json")
    own = keyed(documents_of(docs, id_col, text_col)).select("row_key", "doc_id", "text")
    if sections is None:
        own = own.withColumn("spans", F.lit(None).cast("array<struct<start:bigint,end:bigint,section:int>>"))
    else:
        spans = (
            sections.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("section").cast("int").alias("section"))
            .dropna()
            .where("start < end")
            .groupBy("doc_id")
            .agg(F.array_sort(F.collect_set(F.struct("start", "end", "section"))).alias("spans"))
        )
        own = own.join(spans, "doc_id", "left").select("row_key", "doc_id", "text", F.coalesce("spans", F.array()).alias("spans"))
    given = sections is not None

    def count(batches):
        known = encoder(path, keeps_space, True)
        for batch in batches:
            keys, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices(texts, 1_000_000):
                columns: list[list] = [[] for _ in _NAMES]
                for k, (_, first, end) in zip(range(a, b), known.spans([t or "" for t in texts[a:b]]), strict=True):
                    if given:
                        spans = batch.column(3)[k].as_py()
                        starts, ends = (np.array([s[n] for s in spans], dtype=np.int64) for n in ("start", "end"))
                        names = [s["section"] for s in spans]
                    else:
                        starts, ends = find(texts[k] or "")
                        names = range(len(starts))
                    counts, crossing = allocate(first, end, starts, ends, rule)
                    for column, values in zip(columns, ([keys[k]] * len(starts), [ids[k]] * len(starts), names, starts.tolist(), ends.tolist(), counts.tolist(), crossing.tolist()), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return own.mapInArrow(count, COUNTS)
