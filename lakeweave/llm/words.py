"""Words and byte fingerprints of many texts at once, in numpy. Every value depends on the bytes alone, never on where they stand."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Classes of bytes. A character beyond ASCII is made of bytes from 0x80 on.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but the blank and the bytes 9 to 13.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Odd multiplier of the fingerprints, its inverse modulo 2**64, and the multipliers of the mixing step.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass
class Joined:
    """Texts in a row, each ended by a byte that belongs to no word. ``start`` has each text's place; ``low`` is lower-cased (A-Z)."""

    raw: np.ndarray
    low: np.ndarray
    start: np.ndarray
    size: np.ndarray


def joined(texts: list[str], closing: bytes = b"\0") -> Joined:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    raw = np.frombuffer(closing.join(parts) + closing, dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
    return Joined(raw, LOWER[raw], start, size)


def find_words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes of a class. The byte that closes a text must not belong to it."""
    inside = kind[data].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1 at least, kept for the next call."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each run of bytes, from one pass of prefix sums."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two fingerprints in this order."""
    return mixed(a * np.uint64(BASE) + (b ^ np.uint64(MIX[1])))
