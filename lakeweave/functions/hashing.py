"""64-bit value hashes and the register slots that a column sketch is folded from.

A sketch is a bank of registers per column. Slots ``0 .. num_hashes-1`` hold the MinHash minima, slots
from ``num_hashes`` on hold the cardinality registers. All of them fold with ``min`` (ranks are stored
negated), so one hash aggregate with map-side combine builds everything in one pass.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_FAMILIES = ("sha1", "xxhash64", "md5")

# Generator seed of the MinHash family, and the seed of the cardinality hash.
FAMILY_SEED = 42
CARDINALITY_SEED = 0

# Modulus of the family that hashes a value once, and the names its factors are drawn under.
PRIME = 2**31 - 1
FACTORS = ("a", "b", "c", "d", "e", "f")

SIGN_BIT = -(2**63)


def minhash_seeds(num_hashes: int) -> list[int]:
    """Seeds of the MinHash family, one 64-bit number per position."""
    draw = random.Random(FAMILY_SEED).getrandbits
    return [draw(64) for _ in range(num_hashes)]


def factors(position: int) -> list[int]:
    """Factors of a position in 1 .. ``PRIME`` - 1, each from the digest of its name and the position."""
    return [1 + int(hashlib.md5(f"{name}:{position}".encode()).hexdigest()[:8], 16) % (PRIME - 1) for name in FACTORS]


def hashed_once(value: Column, family: str) -> Column:
    """What the positions hash: the value itself or, for ``md5``, two numbers below ``PRIME`` and 64 bits from its one digest."""
    if family != "md5":
        return value
    digits = lambda start, count: F.conv(F.substring(F.md5(value), start, count), 16, -10).cast("bigint")
    return F.struct((digits(1, 8) % PRIME).alias("low"), (digits(9, 8) % PRIME).alias("high"), digits(17, 16).alias("bits"))


def seed_list(num_hashes: int, family: str) -> list[Column]:
    """The MinHash seeds and, last, the cardinality seed, as literals."""
    if family == "md5":
        # Without factors: the bits of the digest itself.
        rows = [*(factors(k) for k in range(num_hashes)), [CARDINALITY_SEED] * len(FACTORS)]
        return [F.struct(*[F.lit(x).cast("bigint").alias(n) for n, x in zip(FACTORS, row, strict=True)]) for row in rows]
    seeds = minhash_seeds(num_hashes) + [CARDINALITY_SEED]
    if family == "sha1":
        return [F.lit(f"{s}:") for s in seeds]
    if family == "xxhash64":
        return [F.lit(s - 2**64 if s >= 2**63 else s).cast("bigint") for s in seeds]
    raise ValueError(f"hash family must be one of {HASH_FAMILIES}, not {family!r}")


def hash_bits(seed: Column, value: Column, family: str) -> Column:
    """64 hash bits of ``value``, as `hashed_once` gives it, as a BIGINT bit pattern.

    ``sha1`` reads the first 16 hex digits of the digest of ``seed:value``; ``xxhash64`` and ``md5`` are many times cheaper and serve the same
    estimators, with other signature values. ``md5`` takes one digest a value and gives each position two linear maps of it, modulo a prime;
    products of two numbers below 2**31 and their sums stay below 2**63.
    """
    if family == "md5":
        line = lambda x, y, z: (seed[x] * value["low"] + seed[y] * value["high"] + seed[z]) % PRIME
        return F.when(seed["a"] == CARDINALITY_SEED, value["bits"]).otherwise(line("a", "b", "c") * (PRIME + 1) + line("d", "e", "f"))
    if family == "sha1":
        return F.conv(F.left(F.sha1(F.concat(seed, value)), F.lit(16)), 16, -10).cast("bigint")
    return F.xxhash64(seed, value)


def unsigned_order(bits: Column) -> Column:
    """Flip the sign bit, so that signed comparison orders bit patterns as unsigned numbers."""
    return bits.bitwiseXOR(F.lit(SIGN_BIT))


def signature_hex(flipped: Column) -> Column:
    """16 hex digits of a stored MinHash value."""
    return F.lower(F.lpad(F.hex(flipped.bitwiseXOR(F.lit(SIGN_BIT))), 16, "0"))


def register_rank(bits: Column, precision: int) -> Column:
    """Position of the first 1-bit in the upper ``64 - precision`` bits; ``64 - precision`` if none."""
    width = 64 - precision
    rest = F.shiftrightunsigned(bits, precision)
    return F.when(rest == 0, F.lit(width)).otherwise(F.lit(width + 1) - F.length(F.bin(rest)))


def register_slot(position: Column, bits: Column, num_hashes: int, precision: int) -> Column:
    register = bits.bitwiseAND(F.lit((1 << precision) - 1)).cast("int")
    return F.when(position < num_hashes, position).otherwise(register + num_hashes)


def register_value(position: Column, bits: Column, num_hashes: int, precision: int) -> Column:
    return F.when(position < num_hashes, unsigned_order(bits)).otherwise(
        -register_rank(bits, precision).cast("bigint")
    )
