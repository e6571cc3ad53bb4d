"""SHA-1 over many short values at once, and the fold of their hashes to register banks, with numpy inside the tasks that Spark forms.

A task takes batches of ``(dataset_id, column_name, value)`` and gives one bank a column, so none of the 129 hashes of a value becomes a row. A value that
several columns have is hashed once for all of them where they come side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakeweave.functions.hashing import CARDINALITY_SEED, minhash_seeds

# The initial state and the round constants of SHA-1.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
_ROUNDS = (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)
_BLOCK_BYTES = 64
# Values of more blocks go one by one to the library's function, which then spends its time on the bytes and not on the call.
_BLOCKS = 3
# Rows that are gathered, and how many different values of them are hashed at once; bytes that are gathered, and columns whose banks are held before they are sent on.
_GATHERED = 80_000
_AT_ONCE = 40_000
_GATHERED_BYTES = 16 << 20
_HELD_COLUMNS = 1_024
_SIGN = np.uint64(1 << 63)


def _schedule(words: np.ndarray) -> np.ndarray:
    """The 80 words of the rounds from ``words`` of shape (16, values). It is linear: that of two texts laid over each other is the XOR of theirs."""
    out = np.empty((80, words.shape[1]), np.uint32)
    out[:16] = words
    for i in range(16, 80):
        mixed = out[i - 3] ^ out[i - 8] ^ out[i - 14] ^ out[i - 16]
        np.bitwise_or(mixed << np.uint32(1), mixed >> np.uint32(31), out=out[i])
    return out


def _rounds(state: list[np.ndarray], words: np.ndarray, prefix: list[int] | None) -> list[np.ndarray]:
    """One block of SHA-1 for all values; ``prefix`` is the schedule of what stands before every value in this block."""
    a, b, c, d, e = (s.copy() for s in state)
    mixed, spare = np.empty_like(a), np.empty_like(a)
    for i in range(80):
        if i < 20:
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        elif 40 <= i < 60:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_and(b, c, out=spare)
            np.bitwise_or(mixed, spare, out=mixed)
        else:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        np.add(e, mixed, out=e)
        if prefix is None:
            np.add(e, words[i], out=e)
        else:
            np.bitwise_xor(words[i], np.uint32(prefix[i]), out=mixed)
            np.add(e, mixed, out=e)
        np.add(e, np.uint32(_ROUNDS[i // 20]), out=e)
        np.left_shift(a, np.uint32(5), out=mixed)
        np.right_shift(a, np.uint32(27), out=spare)
        np.bitwise_or(mixed, spare, out=mixed)
        np.add(e, mixed, out=e)
        np.left_shift(b, np.uint32(30), out=mixed)
        np.right_shift(b, np.uint32(2), out=b)
        np.bitwise_or(b, mixed, out=b)
        a, b, c, d, e = e, a, b, c, d
    return [x + s for x, s in zip((a, b, c, d, e), state, strict=True)]


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offset: int, blocks: int) -> list[np.ndarray]:
    """Schedules, one a block, of values that begin at byte ``offset`` of their first block."""
    width = blocks * _BLOCK_BYTES
    text = np.zeros((len(starts), width), np.uint8)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text.reshape(-1)[np.repeat(np.arange(len(starts)) * width + offset, lengths) + within] = data[np.repeat(starts, lengths) + within]
    text[np.arange(len(starts)), offset + lengths] = 0x80
    text[:, -8:] = ((offset + lengths) * 8).astype(">u8").view(np.uint8).reshape(-1, 8)
    words = text.view(">u4").reshape(len(starts), blocks, 16)
    return [_schedule(np.ascontiguousarray(words[:, k].T, dtype=np.uint32)) for k in range(blocks)]


def sha1_bits(values: pa.Array, seeds: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """For each seed its place in ``seeds`` and the first 64 bits of the SHA-1 digest of the seed and each value behind it."""
    values = values.cast(pa.large_binary())
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    starts, lengths = bounds[:-1], np.diff(bounds)
    for offset in sorted({len(s) for s in seeds}):
        blocks = (offset + lengths + 8) // _BLOCK_BYTES + 1
        groups = []
        for count in range(1, _BLOCKS + 1):
            rows = np.flatnonzero(blocks == count)
            if len(rows):
                groups.append((rows, _padded(data, starts[rows], lengths[rows], offset, count), [np.full(len(rows), s, np.uint32) for s in _START]))
        long = [(int(i), data[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(blocks > _BLOCKS)]
        for place, seed in enumerate(seeds):
            if len(seed) != offset:
                continue
            lead = np.frombuffer(seed.ljust(_BLOCK_BYTES, b"\0"), ">u4").astype(np.uint32)
            prefix = _schedule(lead[:, None])[:, 0].tolist()
            bits = np.empty(len(values), np.uint64)
            for rows, schedules, state in groups:
                for k, words in enumerate(schedules):
                    state = _rounds(state, words, prefix if k == 0 else None)
                bits[rows] = (state[0].astype(np.uint64) << np.uint64(32)) | state[1]
            for i, text in long:
                digest = hashlib.sha1(seed, usedforsecurity=False)
                digest.update(text)
                bits[i] = int.from_bytes(digest.digest()[:8], "big")
            yield place, bits


def _ranks(bits: np.ndarray, precision: int) -> np.ndarray:
    """`hashing.register_rank`. A float holds each half of the bits exactly."""
    rest = bits >> np.uint64(precision)
    high, low = rest >> np.uint64(32), rest & np.uint64(0xFFFFFFFF)
    length = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])
    width = 64 - precision
    return np.where(length == 0, width, width + 1 - length)


class _Banks:
    """Register banks of the columns of a task, folded with ``min``; a register without a value is 0, since ranks are at least 1 and stored negated."""

    def __init__(self, num_hashes: int, precision: int):
        self.num_hashes, self.precision = num_hashes, precision
        self.seeds = [f"{s}:".encode() for s in [*minhash_seeds(num_hashes), CARDINALITY_SEED]]
        self.held: dict[tuple, np.ndarray] = {}

    def add(self, batch: pa.Table) -> None:
        names = [batch.column(k).combine_chunks().dictionary_encode(null_encoding="encode") for k in (0, 1)]
        datasets, columns = (n.indices.to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
        width = len(names[1].dictionary)
        codes = datasets * width + columns
        order = np.argsort(codes, kind="stable")
        found, first, counts = np.unique(codes[order], return_index=True, return_counts=True)
        keys = [(names[0].dictionary[c // width].as_py(), names[1].dictionary[c % width].as_py()) for c in found.tolist()]
        values = batch.column(2).combine_chunks().dictionary_encode()
        of_row = values.indices.to_numpy(zero_copy_only=False)[order]
        folded = np.zeros((len(found), self.num_hashes + (1 << self.precision)), np.int64)
        for place, bits in sha1_bits(values.dictionary, self.seeds):
            if place < self.num_hashes:
                folded[:, place] = (np.minimum.reduceat(bits[of_row], first) ^ _SIGN).view(np.int64)
            else:
                slots = self.num_hashes + (bits & np.uint64((1 << self.precision) - 1)).astype(np.int64)
                np.minimum.at(folded, (np.repeat(np.arange(len(found)), counts), slots[of_row]), -_ranks(bits, self.precision)[of_row])
        for key, bank in zip(keys, folded, strict=True):
            self.held[key] = np.minimum(self.held[key], bank) if key in self.held else bank.copy()

    def take(self) -> Iterator[pa.RecordBatch]:
        """What is held, as rows ``(dataset_id, column_name, slot, reg)``, which is then forgotten."""
        for (dataset, column), bank in self.held.items():
            slots = np.flatnonzero((np.arange(len(bank)) < self.num_hashes) | (bank < 0))
            text = [pa.array([name], pa.string()).take(pa.array(np.zeros(len(slots), np.int32))) for name in (dataset, column)]
            yield pa.RecordBatch.from_arrays(
                [*text, pa.array(slots.astype(np.int32)), pa.array(bank[slots])], ["dataset_id", "column_name", "slot", "reg"]
            )
        self.held = {}


def fold_sha1(num_hashes: int, precision: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: rows ``(dataset_id, column_name, value)`` of a task to the register banks of its columns."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banks, waiting, rows, size = _Banks(num_hashes, precision), [], 0, 0

        def work_off() -> None:
            gathered = pa.Table.from_batches(waiting)
            share = -(-rows // -(-pc.count_distinct(gathered.column(2)).as_py() // _AT_ONCE))
            for start in range(0, rows, share):
                banks.add(gathered.slice(start, share))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= _GATHERED or size >= _GATHERED_BYTES:
                work_off()
                waiting, rows, size = [], 0, 0
            if len(banks.held) >= _HELD_COLUMNS:
                yield from banks.take()
        if rows:
            work_off()
        yield from banks.take()

    return fold
