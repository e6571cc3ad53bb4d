"""All joinable column pairs of a lake, without comparing all columns with each other.

Columns are joined through an inverted index on ``(position, hash)``. Four things keep that index from
blowing up where many columns share a value, all of them exact:

* columns with the same signature and size form one *class*; classes are joined, members are added last;
* a pair that needs ``t`` equal positions to pass must share a token outside the ``t - 1`` most frequent
  tokens of either side, so the frequent tokens are not used for it (``t`` depends on the size ratio);
* a token shared by many classes is split into blocks by size level and hash, and only pairs of blocks
  meet, so no task sees a whole hot token;
* big classes are expanded in chunk pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions.estimator import (
    coupled_estimate,
    match_count,
    matches_needed,
    matches_needed_value,
    passes,
)
from lakeweave.operators.sketch import NUM_HASHES
from lakeweave.session import materialize

# Column names of a table of pairs.
PAIR_COLUMNS = [
    "left_dataset",
    "left_column",
    "right_dataset",
    "right_column",
    "js",
    "jc_left_in_right",
    "jc_right_in_left",
]
BLOCK = 512
_MAX_LEVEL = 63
_LEVEL_STRIDE = 1 << 40


def signature_classes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split sketches into ``classes(class_id, signature, cardinality, members)`` and
    ``members(class_id, dataset_id, column_name)``.

    The id is a digest of the sketch itself, so it needs no shuffle and is the same on every attempt.
    """
    digest = F.unhex(F.md5(F.concat_ws("|", F.col("signature").cast("string"), F.col("cardinality"))))
    keyed = sketches.withColumn("class_id", digest)
    classes = keyed.groupBy("class_id", "signature", "cardinality").agg(
        F.count(F.lit(1)).alias("members")
    )
    return classes, keyed.select("class_id", "dataset_id", "column_name")


def _blocks(count: Column, block: int) -> Column:
    return F.ceil(count / F.lit(block)).cast("bigint")


def _shared_tokens(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Tokens that at least two classes share, ranked within the class from frequent to rare, and the slots of those that are split.

    A split token has its list of slots once, beside the tokens and not on each of their rows, so what is stored grows with the classes
    also where one token is in all of them.
    """
    tokens = classes.select(
        "class_id",
        "cardinality",
        F.floor(F.log2(F.col("cardinality").cast("double"))).cast("int").alias("level"),
        F.posexplode("signature").alias("position", "hash"),
    )
    frequency = (
        tokens.groupBy("position", "hash", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("position", "hash")
        .agg(F.sum("n").alias("frequency"), F.collect_list(F.struct("level", "n")).alias("levels"))
        .where(F.col("frequency") > 1)
    )
    by_frequency = Window.partitionBy("class_id").orderBy(F.desc("frequency"), "position", "hash")
    own = F.filter("levels", lambda e: e["level"] == F.col("level"))[0]["n"]
    slot = F.col("level") * F.lit(_LEVEL_STRIDE) + F.pmod(F.xxhash64("class_id"), _blocks(own, block))
    all_slots = F.flatten(
        F.transform(
            "levels",
            lambda e: F.transform(
                F.sequence(F.lit(0).cast("bigint"), _blocks(e["n"], block) - 1),
                lambda i: e["level"] * F.lit(_LEVEL_STRIDE) + i,
            ),
        )
    )
    split = F.col("frequency") > block
    shared = tokens.join(frequency, ["position", "hash"]).select(
        "class_id",
        "cardinality",
        "position",
        "hash",
        (F.row_number().over(by_frequency) - 1).alias("rank"),
        F.when(split, slot).otherwise(F.lit(0).cast("bigint")).alias("slot"),
        split.alias("split"),
    )
    return shared, frequency.where(split).select("position", "hash", all_slots.alias("slots"))


def _candidates(tokens: DataFrame, split_tokens: DataFrame, num_hashes: int, js_t: float, jc_t: float) -> DataFrame:
    """Distinct class pairs ``(x, y)``, ``x < y``, holding every pair of classes that can pass.

    Tokens that are not split meet by position and hash alone, so tables bucketed by these are joined where they lie.
    """
    needed_at = F.array(
        *[
            F.lit(matches_needed_value(2.0 ** (gap + 1), num_hashes, js_t, jc_t))
            for gap in range(_MAX_LEVEL + 1)
        ]
    )

    def useful(other: Column) -> Column:
        level = lambda s: F.floor(s / F.lit(_LEVEL_STRIDE)).cast("int")
        gap = F.abs(level(other) - level(F.col("slot")))
        return F.col("rank") >= F.get(needed_at, gap) - 1

    def own(prefix: str, *names: str) -> list[Column]:
        return [F.col(c).alias(f"{prefix}_{c}") for c in ("class_id", "cardinality", "rank", *names)]

    def whole(prefix: str) -> DataFrame:
        return tokens.where(~F.col("split")).select("position", "hash", *own(prefix))

    def dealt(prefix: str, partner: Column, low: str, high: str) -> DataFrame:
        # Broadcast while the lists are small, which is the rule; beyond that a skewed token is cut by adaptive execution, its list has one row.
        met = tokens.where("split").join(split_tokens, ["position", "hash"])
        met = met.select(*own(prefix, "slot"), "position", "hash", F.explode(F.filter(partner, useful)).alias("partner"))
        return met.select("position", "hash", F.col(low.format(prefix)).alias("low"), F.col(high.format(prefix)).alias("high"), *[f"{prefix}_{c}" for c in ("class_id", "cardinality", "rank")])

    lower = dealt("x", F.filter("slots", lambda s: s >= F.col("slot")), "{}_slot", "partner")
    upper = dealt("y", F.filter("slots", lambda s: s <= F.col("slot")), "partner", "{}_slot")
    in_order = F.col("x_class_id") < F.col("y_class_id")
    ratio = F.greatest("x_cardinality", "y_cardinality") / F.least("x_cardinality", "y_cardinality")
    enough = F.least("x_rank", "y_rank") >= matches_needed(ratio, num_hashes, js_t, jc_t) - 1
    parts = [
        whole("x").join(whole("y"), ["position", "hash"]).where(in_order & enough),
        lower.join(upper, ["position", "hash", "low", "high"]).where(((F.col("low") != F.col("high")) | in_order) & enough),
    ]
    ends = [F.least("x_class_id", "y_class_id").alias("x"), F.greatest("x_class_id", "y_class_id").alias("y")]
    return parts[0].select(*ends).unionByName(parts[1].select(*ends)).distinct()


def _class_pairs(classes: DataFrame, tokens: DataFrame, split_tokens: DataFrame, num_hashes: int, js_t: float, jc_t: float) -> DataFrame:
    def as_side(prefix: str) -> DataFrame:
        return classes.select(
            F.col("class_id").alias(prefix),
            F.col("signature").alias(f"{prefix}_signature"),
            F.col("cardinality").alias(f"{prefix}_cardinality"),
            F.col("members").alias(f"{prefix}_members"),
        )

    sizes = ["x", "y", "x_cardinality", "y_cardinality", "x_members", "y_members"]
    verified = (
        _candidates(tokens, split_tokens, num_hashes, js_t, jc_t)
        .join(as_side("x"), "x")
        .join(as_side("y"), "y")
        # A generator, so that the count is made once and not copied into every use of it.
        .select(
            *sizes,
            F.explode(F.array(match_count(F.col("x_signature"), F.col("y_signature")))).alias("matches"),
        )
    )
    alike = (
        as_side("x")
        .where(F.col("x_members") > 1)
        .select(
            "x",
            F.col("x").alias("y"),
            "x_cardinality",
            F.col("x_cardinality").alias("y_cardinality"),
            "x_members",
            F.col("x_members").alias("y_members"),
            F.lit(num_hashes).alias("matches"),
        )
    )
    estimate = coupled_estimate(
        F.col("matches") / F.lit(float(num_hashes)), F.col("x_cardinality"), F.col("y_cardinality")
    )
    return (
        verified.unionByName(alike)
        .select(
            "x",
            "y",
            "x_members",
            "y_members",
            estimate.js.alias("js"),
            estimate.jc_left.alias("jc_x"),
            estimate.jc_right.alias("jc_y"),
        )
        .where(passes(F.col("js"), F.col("jc_x"), F.col("jc_y"), js_t, jc_t))
    )


def _meet(class_pairs: DataFrame, holders: DataFrame, names: list[str], held: tuple[Column, Column], sizes: DataFrame, block: int) -> DataFrame:
    """Class pairs with what the two classes hold: columns ``names`` of ``holders``, as ``x_`` and ``y_``, of different datasets.

    A class of more than ``block`` holders, by ``sizes(class_id, n)`` and in ``held`` for the two classes of a pair, is spread over several
    chunks. Of a class with itself each pair of holders comes once.
    """
    chunked = holders.join(sizes.where(F.col("n") > block), "class_id", "left").select(
        "class_id",
        F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64(*[n for n in names if n in ("dataset_id", "column_name")]), _blocks(F.col("n"), block)))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("chunk"),
        *names,
    )

    def chunks(count: Column) -> Column:
        last = F.when(count > block, _blocks(count, block)).otherwise(F.lit(1)) - 1
        return F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))

    def as_side(prefix: str) -> DataFrame:
        return chunked.select(
            F.col("class_id").alias(prefix),
            F.col("chunk").alias(f"{prefix}_chunk"),
            *[F.col(n).alias(f"{prefix}_{n}") for n in names],
        )

    same = F.col("x") == F.col("y")
    return (
        class_pairs.withColumn("x_chunk", F.explode(chunks(held[0])))
        .withColumn("y_chunk", F.explode(chunks(held[1])))
        .where(~same | (F.col("x_chunk") <= F.col("y_chunk")))
        .join(as_side("x"), ["x", "x_chunk"])
        .join(as_side("y"), ["y", "y_chunk"])
        .where(
            (F.col("x_dataset_id") != F.col("y_dataset_id"))
            & (
                ~same
                | (F.col("x_chunk") < F.col("y_chunk"))
                | (F.col("x_dataset_id") < F.col("y_dataset_id"))
            )
        )
    )


def _expand(class_pairs: DataFrame, classes: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Class pairs to column pairs."""
    sizes = classes.select("class_id", F.col("members").alias("n"))
    met = _meet(class_pairs, members, ["dataset_id", "column_name"], (F.col("x_members"), F.col("y_members")), sizes, block)
    forward = F.col("x_dataset_id") < F.col("y_dataset_id")

    def pick(a: str, b: str) -> Column:
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    return met.select(
        pick("x_dataset_id", "y_dataset_id").alias("left_dataset"),
        pick("x_column_name", "y_column_name").alias("left_column"),
        pick("y_dataset_id", "x_dataset_id").alias("right_dataset"),
        pick("y_column_name", "x_column_name").alias("right_column"),
        "js",
        pick("jc_x", "jc_y").alias("jc_left_in_right"),
        pick("jc_y", "jc_x").alias("jc_right_in_left"),
    )


def _dataset_edges(class_pairs: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Class pairs to edges of datasets: the columns a dataset has in a class are counted first, and the counts multiplied."""
    held = materialize(members.groupBy("class_id", "dataset_id").agg(F.count(F.lit(1)).alias("columns")), "held")
    sizes = held.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    sized = class_pairs
    for side in "xy":
        sized = sized.join(sizes.select(F.col("class_id").alias(side), F.col("n").alias(f"{side}_held")), side)
    met = _meet(sized, held, ["dataset_id", "columns"], (F.col("x_held"), F.col("y_held")), sizes, block)
    return met.groupBy(F.least("x_dataset_id", "y_dataset_id").alias("src"), F.greatest("x_dataset_id", "y_dataset_id").alias("dst")).agg(
        F.sum(F.col("x_columns") * F.col("y_columns")).alias("num_joinable_columns"),
        F.max("js").alias("max_js"),
        F.max(F.greatest("jc_x", "jc_y")).alias("max_jc"),
    )


def _check_thresholds(js_threshold: float, jc_threshold: float) -> None:
    for name, value in (("js_threshold", js_threshold), ("jc_threshold", jc_threshold)):
        if not 0 < value <= 1:
            raise ValueError(f"{name} must be above 0 and at most 1, not {value}")


def _checked_class_pairs(sketches: DataFrame, js_threshold: float, jc_threshold: float, num_hashes: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    _check_thresholds(js_threshold, jc_threshold)
    classes, members = signature_classes(sketches)
    classes = materialize(classes, "classes")
    tokens, split_tokens = _shared_tokens(classes, block)
    tokens, split_tokens = materialize(tokens, "tokens"), materialize(split_tokens, "split-tokens")
    return _class_pairs(classes, tokens, split_tokens, num_hashes, js_threshold, jc_threshold), classes, members


def write_join_index(sketches: DataFrame, name: str, path: str, buckets: int = 64, block: int = BLOCK) -> None:
    """Store what all joins of these sketches need, for any thresholds: tables ``name_tokens``, ``name_split``, ``name_classes``, ``name_members``.

    Tokens are bucketed by position and hash and classes and members by class, one file a bucket below ``path``, so that
    `indexed_pairs` joins them without shuffling them again. ``buckets`` should follow the size of the lake: some hundred MB a bucket.
    An index of this name is replaced. Sketches may be empty.
    """
    classes, members = signature_classes(sketches)
    classes = materialize(classes, "classes")
    tokens, split_tokens = _shared_tokens(classes, block)
    by_token, by_class = ["position", "hash"], ["class_id"]
    for part, frame, keys in (("tokens", tokens, by_token), ("split", split_tokens, by_token), ("classes", classes, by_class), ("members", members, by_class)):
        dealt = frame.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        dealt.mode("overwrite").option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}")


def indexed_pairs(
    spark: SparkSession,
    name: str,
    js_threshold: float = 0.3,
    jc_threshold: float = 0.5,
    num_hashes: int = NUM_HASHES,
    block: int = BLOCK,
) -> DataFrame:
    """`joinable_pairs` from an index of `write_join_index`, made once and read for any thresholds."""
    _check_thresholds(js_threshold, jc_threshold)
    tokens, split_tokens, classes, members = (spark.table(f"{name}_{part}") for part in ("tokens", "split", "classes", "members"))
    pairs = _class_pairs(classes, tokens, split_tokens, num_hashes, js_threshold, jc_threshold)
    return _expand(pairs, classes, members, block)


def joinable_pairs(
    sketches: DataFrame,
    js_threshold: float = 0.3,
    jc_threshold: float = 0.5,
    num_hashes: int = NUM_HASHES,
    block: int = BLOCK,
) -> DataFrame:
    """Column pairs of different tables with ``js >= js_threshold`` or a containment ``>= jc_threshold``.

    ``sketches`` is read twice, so pass a stored table, not a plan that hashes. Classes and their shared
    tokens are stored on the way, since several joins need them. Thresholds lie in (0, 1]: at 0 every pair
    of columns would pass.
    """
    pairs, classes, members = _checked_class_pairs(sketches, js_threshold, jc_threshold, num_hashes, block)
    return _expand(pairs, classes, members, block)


def joinable_datasets(
    sketches: DataFrame,
    js_threshold: float = 0.3,
    jc_threshold: float = 0.5,
    num_hashes: int = NUM_HASHES,
    block: int = BLOCK,
) -> DataFrame:
    """The edges ``src < dst`` of `operators.graph.dataset_edges` for `joinable_pairs`, without making the column pairs.

    Columns that are alike are counted per dataset before they meet, so many columns alike make no more rows than there are dataset pairs.
    """
    pairs, _, members = _checked_class_pairs(sketches, js_threshold, jc_threshold, num_hashes, block)
    return _dataset_edges(pairs, members, block)


def rank_pairs(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Strongest pairs first, names as tie-break; ``limit`` gives a preview."""
    ordered = pairs.orderBy(
        F.desc("jc_left_in_right"), F.desc("jc_right_in_left"), F.desc("js"), *PAIR_COLUMNS[:4]
    )
    return ordered if limit is None else ordered.limit(limit)
