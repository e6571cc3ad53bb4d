"""Column sketches: MinHash signature and cardinality for every column of every table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import hashing
from lakeweave.functions.folding import fold_sha1
from lakeweave.functions.text import clean_value, plain_number
from lakeweave.schemas import REGISTERS
from lakeweave.session import materialize

COLUMN_KEY = ["dataset_id", "column_name"]
NUM_HASHES = 128
PRECISION = 10
CARDINALITY_MODES = ("registers", "exact", "approx")


def distinct_values(cells: DataFrame) -> DataFrame:
    """Cleaned values per column with the number of non-null cells behind each, made distinct as they are written.

    Where ``fraction`` tells numbers apart, values are cleaned behind the shuffle, where there are fewer of them. Two spellings of one value
    may so come as two rows, which minima do not mind and `column_values` folds. Cells that come with the number of ``cells`` behind them, as from
    `sources.tables.distinct_cells`, are distinct already. Those of `sources.tables.typed_cells` are made distinct as numbers where they are numbers.
    """
    if "real" in cells.columns:
        present = cells.where("value is not null or whole is not null or real is not null")
        typed = present.groupBy(*COLUMN_KEY, "value", "whole", "real", "fraction").agg(F.count(F.lit(1)).alias("cells"))
        written = F.coalesce("value", F.col("whole").cast("string"), F.col("real").cast("string"))
        cells = typed.select(*COLUMN_KEY, written.alias("value"), "fraction", "cells")
    text = F.when(F.col("fraction"), plain_number(F.col("value"))).otherwise(F.col("value")) if "fraction" in cells.columns else F.col("value")
    if "cells" in cells.columns:
        return cells.select(*COLUMN_KEY, clean_value(text).alias("value"), "cells")
    present = cells.where(F.col("value").isNotNull())
    if "fraction" not in cells.columns:
        return present.groupBy(*COLUMN_KEY, clean_value(text).alias("value")).agg(F.count(F.lit(1)).alias("cells"))
    raw = present.groupBy(*COLUMN_KEY, "value", "fraction").agg(F.count(F.lit(1)).alias("cells"))
    return raw.select(*COLUMN_KEY, clean_value(text).alias("value"), "cells")


def column_values(cells: DataFrame) -> DataFrame:
    """Distinct cleaned values per column with the number of non-null cells behind each.

    Minima and maxima do not change when a value repeats, so hashing starts from distinct values: one
    shuffle with map-side combine instead of 129 hashes for every cell. Blank values stay in, as the
    empty text, because they count as support; the sketch itself leaves them out.
    """
    values = distinct_values(cells)
    if "fraction" not in cells.columns:
        return values
    return values.groupBy(*COLUMN_KEY, "value").agg(F.sum("cells").alias("cells"))


def column_support(values: DataFrame) -> DataFrame:
    """Non-null cells per column."""
    return values.groupBy(*COLUMN_KEY).agg(F.sum("cells").alias("support"))


def _filled(values: DataFrame) -> DataFrame:
    """Without blank values. The condition names the count, so it stays behind the step that made the values distinct; before it, every cell would be cleaned."""
    if "cells" not in values.columns:
        return values.where(F.col("value") != "")
    return values.where(F.coalesce(F.length("value"), F.lit(0)) * F.col("cells") > 0)


def _by_value(values: DataFrame) -> DataFrame:
    """All columns that have a value side by side, so that its 129 digests are made once for all of them.

    Values cost far more to hash than to move. The number of tasks is left to adaptive execution, as each gives one bank a column.
    """
    return values.repartition("value").sortWithinPartitions("value")


def minima(values: DataFrame, num_hashes: int = NUM_HASHES, family: str = "xxhash64") -> DataFrame:
    """Slots ``0 .. num_hashes - 1`` of the register bank, for a cheap hash family: an aggregate a position, so that hashes do not become rows."""
    # A step before the positions: beside them the digest would be made for each.
    hashed = _filled(values).select(*COLUMN_KEY, hashing.hashed_once(F.col("value"), family).alias("value"))
    seeds = hashing.seed_list(num_hashes, family)[:num_hashes]
    lowest = [F.min(hashing.unsigned_order(hashing.hash_bits(seed, F.col("value"), family))).alias(f"m{k}") for k, seed in enumerate(seeds)]
    return hashed.groupBy(*COLUMN_KEY).agg(*lowest).select(*COLUMN_KEY, F.posexplode(F.array(*[f"m{k}" for k in range(num_hashes)])).alias("slot", "reg"))


def ranks(values: DataFrame, num_hashes: int = NUM_HASHES, precision: int = PRECISION, family: str = "xxhash64") -> DataFrame:
    """Slots of the register bank from ``num_hashes`` on, for a cheap hash family."""
    seed = hashing.seed_list(num_hashes, family)[num_hashes]
    hashed = _filled(values).select(*COLUMN_KEY, hashing.hashed_once(F.col("value"), family).alias("value"))
    bits, position = F.col("bits"), F.lit(num_hashes)
    return (
        hashed.select(*COLUMN_KEY, hashing.hash_bits(seed, F.col("value"), family).alias("bits"))
        .select(
            *COLUMN_KEY,
            hashing.register_slot(position, bits, num_hashes, precision).alias("slot"),
            hashing.register_value(position, bits, num_hashes, precision).alias("reg"),
        )
        .groupBy(*COLUMN_KEY, "slot")
        .agg(F.min("reg").alias("reg"))
    )


def registers(
    values: DataFrame, num_hashes: int = NUM_HASHES, precision: int = PRECISION, family: str = "sha1", by_value: bool = False
) -> DataFrame:
    """Register bank ``(dataset_id, column_name, slot, reg)`` of the columns in ``values``.

    Banks of two sets of values merge by taking the minimum per slot, see `merge_registers`. ``by_value`` shuffles the
    values once more, so that one of several columns is hashed once; without it they are hashed behind the shuffle that made them distinct. For
    other families than ``sha1``, ``values`` are read twice.
    """
    if family == "sha1":
        # 129 digests a value are more than rows can carry: a task folds its values to one bank a column.
        filled = _filled(values).select(*COLUMN_KEY, "value")
        return merge_registers((_by_value(filled) if by_value else filled).mapInArrow(fold_sha1(num_hashes, precision), REGISTERS))
    return minima(values, num_hashes, family).unionByName(ranks(values, num_hashes, precision, family))


def merge_registers(banks: DataFrame) -> DataFrame:
    """Fold several register banks into one."""
    return banks.groupBy(*COLUMN_KEY, "slot").agg(F.min("reg").alias("reg"))


def register_cardinality(inverse_powers: Column, precision: int = PRECISION) -> Column:
    """Raw register estimate; small columns are not corrected, the result is at least 1."""
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = F.lit(alpha) * F.lit(float(m**2)) / inverse_powers
    return F.greatest(F.floor(raw), F.lit(1)).cast("bigint")


def sketches_from_registers(
    banks: DataFrame, num_hashes: int = NUM_HASHES, precision: int = PRECISION
) -> DataFrame:
    """One row per column: ``signature ARRAY<BIGINT>`` and ``cardinality``."""
    slot, reg = F.col("slot"), F.col("reg")
    is_rank = slot >= num_hashes
    touched = F.count(F.when(is_rank, 1))
    powers = F.coalesce(F.sum(F.when(is_rank, F.pow(F.lit(2.0), reg))), F.lit(0.0))
    return (
        banks.groupBy(*COLUMN_KEY)
        .agg(
            F.sort_array(F.collect_list(F.when(~is_rank, F.struct(slot, reg)))).alias("minima"),
            (powers + ((1 << precision) - touched)).alias("inverse_powers"),
        )
        .select(
            *COLUMN_KEY,
            F.transform("minima", lambda m: m["reg"]).alias("signature"),
            register_cardinality(F.col("inverse_powers"), precision).alias("cardinality"),
        )
    )


def signature_rows(sketches: DataFrame) -> DataFrame:
    """Long form ``(dataset_id, column_name, position, hash)`` with the hash as 16 hex digits."""
    return sketches.select(
        *COLUMN_KEY, F.posexplode("signature").alias("position", "flipped")
    ).select(*COLUMN_KEY, "position", hashing.signature_hex(F.col("flipped")).alias("hash"))


def build_sketches(
    cells: DataFrame,
    num_hashes: int = NUM_HASHES,
    precision: int = PRECISION,
    family: str = "sha1",
    cardinality: str = "registers",
    min_support: int = 0,
    keep_empty: bool = False,
) -> DataFrame:
    """Sketch every column of ``cells(dataset_id, column_name, value)``.

    ``min_support`` drops columns with fewer non-null cells. ``keep_empty`` keeps columns whose values are
    all blank, with an all-ones signature; they are dropped otherwise, since they would all look alike.
    """
    if cardinality not in CARDINALITY_MODES:
        raise ValueError(f"cardinality must be one of {CARDINALITY_MODES}, not {cardinality!r}")
    if min_support or keep_empty or cardinality != "registers":
        # Read more than once below: the source is scanned and made distinct a single time.
        values, by_value = materialize(column_values(cells), "values"), True
    else:
        # The text of cells that come distinct has not been shuffled yet, or as a number.
        values, by_value = distinct_values(cells), "cells" in cells.columns
    if family == "sha1" or cardinality == "registers":
        banks = registers(values, num_hashes, precision, family, by_value)
    else:
        banks = minima(values, num_hashes, family)
    sketches = sketches_from_registers(banks, num_hashes, precision)
    if cardinality != "registers":
        present = values.where(F.col("value") != "")
        size = (
            F.count(F.lit(1)) if cardinality == "exact" else F.approx_count_distinct("value")
        ).cast("bigint")
        sketches = sketches.drop("cardinality").join(
            present.groupBy(*COLUMN_KEY).agg(size.alias("cardinality")), COLUMN_KEY
        )
    if not min_support and not keep_empty:
        return sketches
    kept = column_support(values).where(F.col("support") >= min_support).select(*COLUMN_KEY)
    if not keep_empty:
        return sketches.join(kept, COLUMN_KEY)
    untouched = F.lit(float(1 << precision))
    empty_size = register_cardinality(untouched, precision) if cardinality == "registers" else F.lit(1)
    return kept.join(sketches, COLUMN_KEY, "left").select(
        *COLUMN_KEY,
        F.coalesce("signature", F.array_repeat(F.lit(2**63 - 1), num_hashes)).alias("signature"),
        F.coalesce("cardinality", empty_size.cast("bigint")).alias("cardinality"),
    )
