"""Repeated byte strings of a corpus by distributed prefix doubling.

The rank of a position at length ``h`` is the name of the string of ``h`` bytes that starts there; the rank at ``2h`` is the name of the pair
of ranks at the position and ``h`` bytes on. Names are 64-bit and depend on the string alone, so texts double their ranks at offsets 1, 2,
4, ... on their own, and Spark sorts ranks at two lengths, half of the threshold and the threshold itself:

1. *Half length.* Each window of the threshold's length is stood for by the smallest rank among the half-length strings in it, one
   *anchor* for a run of neighbouring windows. Spark sorts the anchors by rank. An anchor of a unique rank settles its run: no window of it
   repeats. Runs that agree in the ranks of their first and last window, which cover all their bytes, settle each other: all repeat.
2. *Full length.* The windows of the few other runs are sorted by their own rank, and those of a unique rank are dropped.

A rank that occurs several times in one batch of a task is sent once, so a passage that stands in a third of all texts puts no more than one entry
per batch into a task. Two different strings get one name with a probability of about n * n / 2**65 for n names compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed, materialize
from lakeweave.llm.tokens import slices
from lakeweave.llm.words import BASE, BYTE_VALUE, mixed, pair_hash
from lakeweave.session import give_back_shuffles

#: Windows of a text that are worked on at a time, and bits for a place in such a piece.
PIECE = 1 << 20
PLACE_BITS = 22
#: Entries of a task that are compared with each other before they are sent.
TOGETHER = 400_000
#: Answers for so many neighbouring texts (a power of two) travel together.
LOT_BITS = 7
#: Verdicts on a run of windows: all repeat; all repeat and others must be compared with them; to be compared.
SETTLED, EVIDENCE, OPEN = 1, 2, 3

PACKED = "bucket int, names binary, whole binary, owners binary, places binary, sizes binary, flags binary"
_PACKED = ["bucket", "names", "whole", "owners", "places", "sizes", "flags"]
_KINDS = [np.uint64, np.uint64, np.int64, np.int32, np.uint16, np.uint8]


def doubled(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of every string of ``length`` bytes, from ranks of half the length, up to the last step, which may overlap."""
    rank, h, factor = BYTE_VALUE[data], 1, BASE
    while 2 * h <= length:
        rank = rank[:-h] + np.uint64(factor) * rank[h:]
        h *= 2
        factor = factor * factor % (1 << 64)
    if h < length:
        rank = rank[: len(data) - length + 1] + np.uint64(factor) * rank[length - h :]
    return rank


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling too."""
    h = 1
    while 2 * h <= width:
        values = np.minimum(values[:-h], values[h:])
        h *= 2
    if h < width:
        values = np.minimum(values[: len(values) - (width - h)], values[width - h :])
    return values


def pieces_of(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """Text number, place and bytes of the pieces of texts that have a window at all. Neighbouring pieces share ``length`` - 1 bytes."""
    out = []
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            out.append((k, at, text[at : at + PIECE + length - 1]))
    return out


def window_ranks(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks at half the length and at ``length``, for the pieces put in a row, and the first byte of each piece."""
    half = length // 2
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum([len(p[2]) for p in pieces])])[:-1].astype(np.int64)
    low = doubled(data, half)
    rest = length - half
    high = low[: len(data) - length + 1] * np.uint64(0x9FB21C651E98DF25) + low[rest:]
    if length % 2:
        high = high * np.uint64(BASE) + low[rest - 1 : len(low) - 1]
    return mixed(low), mixed(high), start


def runs_of(pieces: list[tuple[int, int, bytes]], length: int):
    """Runs of neighbouring windows with one anchor: rank of the anchor, name of the whole run, text number, first window, windows."""
    low, high, start = window_ranks(pieces, length)
    size = np.array([len(p[2]) for p in pieces], dtype=np.int64)
    width = length - length // 2 + 1
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((low & ~place) | np.arange(len(low), dtype=np.uint64), width) & place
    # Windows that lie in one piece: the first size - length + 1 of each.
    mark = np.zeros(len(high) + 1, dtype=np.int8)
    mark[start] = 1
    np.add.at(mark, np.minimum(start + size - length + 1, len(high)), -1)
    valid = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    ends = valid & np.concatenate([new[1:] | ~valid[1:], [True]])
    last = np.flatnonzero(ends)
    owner = np.searchsorted(start, first, side="right") - 1
    count = last - first + 1
    whole = pair_hash(pair_hash(high[first], high[last]), count.astype(np.uint64))
    text = np.array([p[0] for p in pieces])[owner]
    at = np.array([p[1] for p in pieces])[owner] + first - start[owner]
    return low[least[first].astype(np.int64)], whole, text, at, count


class Parcel:
    """Entries of a task on their way to the buckets of their names."""

    def __init__(self, buckets: int, single: bool = False):
        """``single``: names and wholes are the same, and are sent once."""
        self.buckets, self.single = buckets, single
        self.held: list[tuple] = []
        self.count = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.held.append(columns)
        self.count += len(columns[0])
        return self.count >= TOGETHER

    def send(self) -> Iterator[pa.RecordBatch]:
        """One row per bucket. Of entries with the same ``whole`` the first goes on, flagged, and the others only tell that they are settled."""
        if not self.count:
            return
        names, whole, owners, places, sizes, flags = (np.concatenate(c).astype(k) for c, k in zip(zip(*self.held, strict=True), _KINDS, strict=True))
        self.held, self.count = [], 0
        # Flag 1: known to repeat. Flag 2: nothing is left to find out, only to be passed on. Flag 4: there for others, not to be answered.
        free = np.flatnonzero((flags & 2) == 0)
        order = free[np.argsort(whole[free], kind="stable")]
        same = np.flatnonzero(whole[order][1:] == whole[order][:-1])
        flags[order[same]] |= 1
        flags[order[same + 1]] |= 3
        answered = (flags & 6) != 6
        bucket = (names % np.uint64(self.buckets)).astype(np.int32)
        order = np.flatnonzero(answered)
        order = order[np.argsort(bucket[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            base = owners[own]
            packed = [names[own].tobytes(), b"" if self.single else whole[own].tobytes(), *(pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in (np.diff(base, prepend=0), places[own], sizes[own], flags[own]))]
            yield pa.RecordBatch.from_arrays([pa.array([bucket[own[0]]], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=_PACKED)


def unpacked(batches) -> tuple[np.ndarray, ...] | None:
    """All entries that came to a task."""
    columns: list[list] = [[] for _ in _KINDS]
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(1, 7)), strict=True):
            names = np.frombuffer(row[0].as_py(), np.uint64)
            columns[0].append(names)
            columns[1].append(np.frombuffer(row[1].as_py(), np.uint64) if len(row[1].as_py()) else names)
            for k, raw in enumerate(row[2:], 2):
                kind = np.dtype(_KINDS[k])
                values = np.frombuffer(pa.decompress(raw.as_py(), len(names) * kind.itemsize, codec="zstd", asbytes=True), kind)
                columns[k].append(np.cumsum(values) if k == 2 else values)
    return tuple(np.concatenate(c) for c in columns) if columns[0] else None


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the number of each one's group, and the first of each group."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _first_pass(length: int, buckets: int):
    """Texts to anchors."""

    def send(batches):
        parcel = Parcel(buckets)
        for batch in batches:
            keys, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), batch.column(1).to_pylist()
            for a, b in slices(texts, 700_000):
                pieces = pieces_of([(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]], length)
                for part in _few(pieces):
                    names, whole, text, at, count = runs_of(part, length)
                    if parcel.add(names, whole, keys[a:b][text], at, count, np.zeros(len(names))):
                        yield from parcel.send()
        yield from parcel.send()

    return send


def _few(pieces: list, most: int = 2 * PIECE):
    """Pieces in lots whose bytes can be numbered with ``PLACE_BITS`` bits."""
    lot, size = [], 0
    for p in pieces:
        if lot and size + len(p[2]) > most:
            yield lot
            lot, size = [], 0
        lot.append(p)
        size += len(p[2])
    if lot:
        yield lot


def _sort_anchors(batches):
    """Anchors of one bucket after the other, sorted by rank and by run: which runs are settled and which are open."""
    found = unpacked(batches)
    if found is None:
        return
    names, whole, owners, places, sizes, flags = found
    verdict = np.where(flags & 2, SETTLED, 0).astype(np.int64)
    own = np.flatnonzero((flags & 2) == 0)
    if len(own):
        order = own[np.lexsort((whole[own], names[own]))]
        by_name, first_name = _groups(names[order])
        run = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
        by_run, first_run = np.cumsum(run) - 1, np.flatnonzero(run)
        n_run = np.bincount(by_run)
        repeats = (n_run > 1) | (np.maximum.reduceat(flags[order] & 1, first_run) > 0)
        others = np.bincount(by_name, weights=run) > 1  # runs of several kinds have this anchor
        is_first = np.zeros(len(order), dtype=bool)
        is_first[first_run] = True
        told = np.where(repeats[by_run], np.where(others[by_name] & is_first, EVIDENCE, SETTLED), np.where(others[by_name], OPEN, 0))
        verdict[order] = told
    kept = np.flatnonzero(verdict)
    entry = (places[kept].astype(np.int64) << 20) | (sizes[kept].astype(np.int64) << 4) | verdict[kept]
    for a in range(0, len(kept), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(owners[kept[a : a + 200_000]]), pa.array(entry[a : a + 200_000])], names=["row_key", "entry"])


def _second_pass(length: int, buckets: int):
    """Open runs to their windows. Settled runs go along as they are."""

    def send(batches):
        parcel = Parcel(buckets, single=True)
        for batch in batches:
            keys, texts, entries = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for k, text in enumerate(texts):
                entry = entries[k].values.to_numpy(zero_copy_only=False)
                place, size, verdict = entry >> 20, (entry >> 4) & 0xFFFF, entry & 15
                settled = np.flatnonzero(verdict != OPEN)
                if len(settled):
                    n = len(settled)
                    spread = mixed(place[settled].astype(np.uint64) + np.uint64(keys[k] & 0xFFFFFFFF))
                    parcel.add(spread, spread, np.full(n, keys[k]), place[settled], size[settled], np.full(n, 2))
                asked = np.flatnonzero(verdict != SETTLED)
                if len(asked):
                    raw = text.encode("utf-8", "surrogatepass")
                    # Neighbouring runs are ranked together, so that each byte is read about once.
                    order = asked[np.argsort(place[asked])]
                    stretches: list[list[int]] = []
                    for i in order.tolist():
                        a, b = int(place[i]), int(place[i] + size[i])
                        if stretches and a <= stretches[-1][1] + length and b - stretches[-1][0] <= PIECE:
                            stretches[-1][1] = max(b, stretches[-1][1])
                            stretches[-1][2].append(i)
                        else:
                            stretches.append([a, b, [i]])
                    for a, b, members in stretches:
                        _, high, _ = window_ranks([(k, a, raw[a : b + length - 1])], length)
                        for flag, kind in ((0, OPEN), (5, EVIDENCE)):
                            runs = [i for i in members if verdict[i] == kind]
                            if runs:
                                at = np.concatenate([np.arange(place[i], place[i] + size[i]) for i in runs])
                                names = high[at - a]
                                parcel.add(names, names, np.full(len(at), keys[k]), at, np.ones(len(at)), np.full(len(at), flag))
                if parcel.count >= TOGETHER:
                    yield from parcel.send()
        yield from parcel.send()

    return send


def _sort_windows(batches):
    """Windows sorted by rank: text, start and number of those that repeat, in one row for each lot of neighbouring texts."""
    found = unpacked(batches)
    if found is None:
        return
    names, _, owners, places, sizes, flags = found
    answer = (flags & 2) > 0
    own = np.flatnonzero(~answer)
    if len(own):
        order = own[np.argsort(names[own], kind="stable")]
        group, first = _groups(names[order])
        repeats = (np.bincount(group) > 1) | (np.maximum.reduceat(flags[order] & 1, first) > 0)
        answer[order] = repeats[group]
    answer &= (flags & 4) == 0
    kept = np.flatnonzero(answer)
    order = kept[np.argsort(owners[kept], kind="stable")]
    if not len(order):
        return
    rows = np.stack([owners[order], places[order].astype(np.int64), sizes[order].astype(np.int64)], axis=1)
    lot, first = _groups(rows[:, 0] >> LOT_BITS)
    ends = [*first[1:].tolist(), len(order)]
    for a in range(0, len(first), 2_000):
        packed = [pa.compress(rows[i:j].tobytes(), codec="zstd", asbytes=True) for i, j in zip(first[a : a + 2_000].tolist(), ends[a : a + 2_000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[first[a : a + 2_000], 0] >> LOT_BITS), pa.array([int(e - f) for f, e in zip(first[a : a + 2_000], ends[a : a + 2_000], strict=True)], pa.int32()), pa.array(packed, pa.binary())], names=["lot", "n", "windows"])


def _by_text(batches):
    """The answers for a lot of neighbouring texts, text by text."""
    for batch in batches:
        counts, packed = batch.column(1), batch.column(2)
        for k in range(len(batch)):
            parts = [np.frombuffer(pa.decompress(raw, n * 24, codec="zstd", asbytes=True), np.int64) for n, raw in zip(counts[k].as_py(), packed[k].as_py(), strict=True)]
            rows = np.concatenate(parts).reshape(-1, 3)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            _, first = _groups(rows[:, 0])
            pairs = rows[:, 1:].astype(np.int32)
            data = [pairs[i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(data, pa.binary())], names=["row_key", "parts"])


def _verdicts(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """The few runs that are not settled as unique, written, so that the shuffle of all anchors can go before the texts are shuffled."""
    anchors = texts.mapInArrow(_first_pass(length, buckets), PACKED).repartition("bucket")
    return materialize(anchors.mapInArrow(_sort_anchors, "row_key long, entry long"), "verdicts")


def repeated_windows(texts: DataFrame, key: str, length: int = 200, text_col: str = "text") -> DataFrame:
    """For each text with repeats the list of its repeated windows (``row_key``, ``parts``: start and number in 32 bits each).

    ``texts`` has a written, unique ``key``. All its columns go along to the second pass, so that the texts are shuffled in the same way, and so once, for
    this join and the one with the answers.
    """
    if not 16 <= length <= 4096:
        raise ValueError("length must lie between 16 and 4096")
    spark = texts.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    verdicts = _verdicts(texts.select(key, text_col), length, buckets).groupBy("row_key").agg(F.collect_list("entry").alias(f"{key}_entries"))
    give_back_shuffles(spark)
    asked = texts.join(verdicts.withColumnRenamed("row_key", key).hint("shuffle_hash"), key)
    rest = [F.col(f"`{c}`") for c in texts.columns if c not in (key, text_col)]
    windows = asked.select(key, text_col, f"{key}_entries", *rest).mapInArrow(_second_pass(length, buckets), PACKED).repartition("bucket")
    lots = windows.mapInArrow(_sort_windows, "lot long, n int, windows binary").groupBy("lot")
    held = lots.agg(F.collect_list(F.struct("n", "windows")).alias("all")).select("lot", F.col("all.n").alias("n"), F.col("all.windows").alias("windows"))
    return held.mapInArrow(_by_text, "row_key long, parts binary")


def removed_runs(parts: bytes | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (from, to) that the windows cover."""
    if not parts:
        return []
    pairs = np.frombuffer(parts, dtype=np.int32).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1 + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([new[1:], [True]])
    return list(zip(start[new].tolist(), end[last].tolist(), strict=True))


def _written(texts: DataFrame, key: str) -> DataFrame:
    # No key is null; said here, it holds for both joins, and one exchange of the texts serves both.
    return materialize(texts, "keyed").where(F.col(key).isNotNull())


def _with_parts(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    # The key is used by two scans, so it is written: splits of the input may change between them.
    texts = _written(keyed(documents_of(docs, id_col, text_col)), "row_key")
    windows = repeated_windows(texts, "row_key", length)
    return texts.join(windows.hint("shuffle_hash"), "row_key", "left").select("row_key", "doc_id", "text", "parts")


def repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What repeats in each row: ``row_key, doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256``.

    A byte is removed if a string of ``length`` bytes that covers it also starts at any other place, in the same text or another. A null text is
    empty. Null and repeated ids are kept, each row for itself; equal texts long enough remove each other whole.
    """

    def answer(batches):
        for batch in batches:
            keys, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for k, text in enumerate(texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = removed_runs(batch.column(3)[k].as_py(), length)
                left, at = hashlib.sha256(), 0
                for a, b in runs:
                    left.update(raw[at:a])
                    at = b
                left.update(raw[at:])
                rows.append((keys[k], ids[k], len(raw), sum(b - a for a, b in runs), len(runs), [{"start": a, "end": b} for a, b in runs], left.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

    columns = ["row_key", "doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    return _with_parts(docs, length, id_col, text_col).mapInArrow(answer, "row_key long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs``, with all its columns, without the repeated bytes of its column ``text``; ``n_chars``, if there is one, follows a changed text.

    A character of which a byte goes, goes. A row that had text and has none but white space left goes; null texts stay.
    """
    names = docs.columns
    key = "row_key"
    while key in {c.lower() for c in names}:
        key += "_"
    texts = _written(docs.withColumn(key, F.monotonically_increasing_id()), key)
    windows = repeated_windows(texts, key, length).select(F.col("row_key").alias(key), F.col("parts").alias(f"{key}_parts"))
    joined = texts.join(windows.hint("shuffle_hash"), key, "left")

    def cut(batches):
        for batch in batches:
            at = names.index("text")
            texts, parts = batch.column(at).to_pylist(), batch.column(len(names))
            keep, changed = np.ones(len(texts), dtype=bool), {}
            for k, text in enumerate(texts):
                runs = removed_runs(parts[k].as_py(), length)
                if text is None or not runs:
                    continue
                raw, kept, end = text.encode("utf-8", "surrogatepass"), [], 0
                for a, b in runs:
                    kept.append(raw[end:a].decode(errors="ignore"))
                    end = b
                kept.append(raw[end:].decode(errors="ignore"))
                changed[k] = "".join(kept)
                keep[k] = bool(changed[k].strip())
            batch = pa.RecordBatch.from_arrays(batch.columns[: len(names)], schema=pa.schema(list(batch.schema)[: len(names)]))
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([changed.get(k, t) for k, t in enumerate(texts)], batch.schema.field(at).type))
                if "n_chars" in names:
                    i = names.index("n_chars")
                    sizes = [len(changed[k]) if k in changed else n for k, n in enumerate(batch.column(i).to_pylist())]
                    batch = batch.set_column(i, batch.schema.field(i), pa.array(sizes, batch.schema.field(i).type))
            yield batch.filter(pa.array(keep))

    return joined.select(*[F.col(f"`{c}`") for c in names], f"{key}_parts").mapInArrow(cut, docs.schema)
