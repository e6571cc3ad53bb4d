"""Runs of words: stretches that repeat with one period, by online dyadic square catching.

For each level ``B = 1, 2, 4, ...`` the words read so far are cut into blocks of ``B``. A completed block starts a *catcher*. While the
next block fills up, each appended word completes a suffix of ``B`` words, and the catcher compares it with its own block. Equality catches a
square: the words repeat at the distance ``q`` of the two, ``B <= q < 2 B``. So a word advances one comparison per level, and
periods of every size are watched. The names that make a comparison one step come from the level below: the name of ``2 B`` words is
that of the names of its halves.

Squares of one distance in neighbouring blocks merge into one candidate. All blocks inside a run of three periods or more are caught, so a run
reaches less than a block beyond its candidate, and a comparison word by word over that stretch settles its ends exactly. A square inside a run of
a smaller period is a multiple of that and is not followed up.

The comparisons of a batch of texts are made a level at a time in numpy; a text takes part in a level only if a run of its periods has room in it.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed
from lakeweave.llm.tokens import slices
from lakeweave.llm.words import mixed, pair_hash

#: A run has so many periods at least, and three is the least that the catchers are sure to see.
LEAST_PERIODS = 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SHAPE = "row_key long, doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _caught(names: np.ndarray, block: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of one level: distance, first word of the first block and of the last one of each chain of squares.

    ``reach`` tells how far the known runs that start at a place or before it go; squares inside them are left out.
    """
    rows = -(-len(names) // block) - 1
    if rows < 1:
        return (np.zeros(0, np.int64),) * 3
    catcher = names[: rows * block : block]
    # The block in progress is filled up with what its catcher does not have.
    suffix = np.concatenate([names[block:], np.full(-len(names) % block, ~catcher[-1])]).reshape(rows, block)
    row, column = np.nonzero(suffix == catcher[:, None])
    first, distance = row.astype(np.int64) * block, column.astype(np.int64) + block
    fresh = reach[first] < first + distance + block
    first, distance = first[fresh], distance[fresh]
    order = np.lexsort((first, distance))
    first, distance = first[order], distance[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (distance[1:] != distance[:-1]) | (first[1:] != first[:-1] + block)
    last = np.concatenate([new[1:], [True]])[: len(first)]
    return distance[new], first[new], first[last]


def _stretches(words: np.ndarray, distance: int, low: int, high: int, least: int) -> list[tuple[int, int]]:
    """Stretches of ``least`` words or more in ``words[low:high]`` that repeat at a distance, each as long as it goes."""
    same = words[low : high - distance] == words[low + distance : high]
    edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return [(low + a, low + b + distance) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a + distance >= least]


def runs_of(texts: list[np.ndarray], least_words: int = 6, least_periods: int = 4) -> list[list[tuple[int, int, int]]]:
    """Start, length and smallest period of every run of each text, given as arrays of word numbers (0 and up), ordered by start and period."""
    if least_periods < LEAST_PERIODS:
        raise ValueError(f"least_periods must be {LEAST_PERIODS} at least")
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in order], dtype=np.int64)
    # Behind each text stands a number of its own, so that nothing reaches across.
    words = np.concatenate([part for i, k in enumerate(order) for part in (texts[k], np.array([-1 - i]))]) if texts else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    names = mixed(words.astype(np.uint64) + np.uint64(1))
    reach = np.zeros(len(words) + 1, dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    block = 1
    while True:
        # The longest texts stand first; the others have no room for a run of this level.
        taking = int(np.count_nonzero(sizes >= least_periods * block))
        if not taking:
            break
        end = int(start[taking - 1] + sizes[taking - 1])
        if block > 1:
            half = block // 2
            names = pair_hash(names[: len(names) - half], names[half:])
        names = names[: max(0, end - block + 1)]
        own = []
        for distance, first, last in zip(*(c.tolist() for c in _caught(names, block, reach)), strict=True):
            least = max(least_words, least_periods * distance)
            if last + distance + 3 * block - first - 2 < least:
                continue
            low, high = max(0, first - block), min(end, last + distance + 2 * block)
            own += [(*s, distance) for s in _stretches(words, distance, low, high, least)]
        for a, b, distance in own:
            # A stretch of several periods is found under its smallest one first or in this level.
            found[a, b] = min(distance, found.get((a, b), distance))
        if own:
            np.maximum.at(reach, [a for a, _, _ in own], [b for _, b, _ in own])
            np.maximum.accumulate(reach, out=reach)
        block *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, b), period in sorted(found.items(), key=lambda f: (f[0][0], f[1])):
        i = int(np.searchsorted(start, a, side="right")) - 1
        out[order[i]].append((a - int(start[i]), b - a, period))
    return out


def numbered(texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text, and the same words as numbers. Words end at blanks and at the bytes 9 to 13."""
    number = defaultdict(count().__next__)
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    return split, [np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]


def periodic_runs(docs: DataFrame, least_words: int = 6, least_periods: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``row_key, doc_id, n_words, runs, collapsed``.

    ``runs`` has every stretch of words with smallest period ``period`` (words that far apart are equal) that is ``least_words`` and ``least_periods``
    periods long at least and goes on at neither end, by start and period. ``collapsed`` is what is left, joined by blanks, without the words that stand
    behind the first period of any run. A null or empty text, or one of white space, has no words, no runs and an empty ``collapsed``. Null and repeated ids
    are kept, each row for itself. A text is worked on as a whole, so the longest one has to fit into a task, at some 100 bytes a word.
    """

    def find(batches):
        for batch in batches:
            keys, ids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in slices(texts, 2_000_000):
                split, numbers = numbered(texts[a:b])
                all_runs, left = runs_of(numbers, least_words, least_periods), []
                for words, own in zip(split, all_runs, strict=True):
                    if own:
                        keep = np.ones(len(words), dtype=bool)
                        for start, length, period in own:
                            keep[start + period : start + length] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    left.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                told = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in all_runs], pa.list_(RUN))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), ids.slice(a, b - a), pa.array([len(w) for w in split], pa.int64()), told, pa.array(left, pa.string())],
                    names=["row_key", "doc_id", "n_words", "runs", "collapsed"],
                )

    return keyed(documents_of(docs, id_col, text_col)).select("row_key", "doc_id", "text").mapInArrow(find, SHAPE)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run with most periods (of equal ones the first), and digests of all runs and of the collapsed text."""
    # Lengths over periods are compared as products of whole numbers; runs come ordered by start and period, so the first of equals stays.
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", nothing, lambda held, r: F.when(held.isNull() | (r["length"] * held["period"] > held["length"] * r["period"]), r).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
