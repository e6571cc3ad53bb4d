"""Shards of near equal weight by k-d tree partitioning, with DataFrame operations only.

The unit is a group of equal texts, so copies never meet from different shards. A node of the tree is split at the weighted
quantile of its widest metadata dimension, as a part of the dimension's width over all units. The quantile comes from histograms that Spark counts and that are narrowed until
the border bucket weighs next to nothing; the driver sees ``BUCKETS`` sums per node, whatever the size of the input.
A group that weighs a notable part of a shard is placed first, to the lightest shard, and the tree fills the rest up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.llm.common import keyed, materialize, small_count

#: Sums per node and pass.
BUCKETS = 512
#: A group above this part of a shard, by weight or rows, is placed by itself; there are at most shards times twice its inverse.
HEAVY = 1 / 32
#: The border bucket may weigh this part of a shard.
CLOSE = 0.0005
#: Numbers that tell units of equal value apart.
TIES = 1 << 40
#: Values of a dimension beyond this are equal to it.
EDGE = 1 << 52
#: Rows that are numbered together.
NUMBERED = 65_536


@dataclass
class Node:
    """Shards ``low`` to ``high`` - 1. ``rule`` is true for the units that go left."""

    low: int
    high: int
    rule: Column | None = None
    left: Node | None = None
    right: Node | None = None

    def leaf_of(self, name) -> Column:
        if self.rule is None:
            return F.lit(name(self))
        return F.when(self.rule, self.left.leaf_of(name)).otherwise(self.right.leaf_of(name))

    def leaves(self) -> list[Node]:
        return [self] if self.rule is None else self.left.leaves() + self.right.leaves()


def _heavy_first(rows: list[tuple[bytes, int]], total: int, shards: int) -> tuple[dict[bytes, int], list[float]]:
    """Heavy groups to the lightest shard, and what is left to fill in each shard so that all end level."""
    load = [0] * shards
    placed = {}
    for digest, weight in sorted(rows, key=lambda r: (-r[1], r[0])):
        shard = min(range(shards), key=lambda s: (load[s], s))
        placed[digest] = shard
        load[shard] += weight
    rest = total - sum(load)
    level, below = 0.0, sorted(load)
    for k in range(1, shards + 1):
        level = (rest + sum(below[:k])) / k
        if k == shards or level <= below[k]:
            break
    return placed, [max(0.0, level - x) for x in load]


def _split(units: DataFrame, root: Node, nodes: list[Node], room: list[float], widths: dict[str, int], tolerance: float) -> None:
    """Gives each of ``nodes`` a rule and two children. ``widths`` are those of the dimensions over all units: a node's own widths are measured
    as parts of them, so that a dimension counts as narrower once it has been split. Equal parts go to the dimension named first."""
    dimensions = list(widths)
    at = units.withColumn("node", root.leaf_of(lambda n: n.low))
    whole = at.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)])
    found = {r["node"]: r for r in whole.collect()}
    search = {}
    for n in nodes:
        r = found.get(n.low)
        middle = (n.low + n.high) // 2
        share = sum(room[n.low : middle]) / (sum(room[n.low : n.high]) or 1)
        if r is None:
            search[n.low] = {"axis": dimensions[0], "low": 0, "high": 0, "want": 0, "done": True, "on": None}
            continue
        axis = max(dimensions, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / widths[d], -dimensions.index(d)))
        search[n.low] = {"axis": axis, "low": r[f"min_{axis}"], "high": r[f"max_{axis}"] + 1, "want": r["weight"] * share, "done": False, "on": None}
    # Each pass narrows the interval [low, high) that the border lies in; "on" is the value whose ties are told apart by hash.
    while any(not s["done"] for s in search.values()):
        cases = None
        for name, s in search.items():
            if s["done"]:
                continue
            value = F.col(s["axis"]) if s["on"] is None else F.when(F.col(s["axis"]) == s["on"], F.col("tie"))
            s["width"] = max(1, -(-(s["high"] - s["low"]) // BUCKETS))
            inside = (F.col("node") == name) & (value >= s["low"]) & (value < s["high"])
            bucket = F.floor((value - F.lit(s["low"])) / F.lit(s["width"]))
            cases = F.when(inside, bucket) if cases is None else cases.when(inside, bucket)
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in at.withColumn("bucket", cases).where("bucket is not null").groupBy("node", "bucket").agg(F.sum("weight").alias("weight")).collect():
            sums.setdefault(r["node"], []).append((r["bucket"], r["weight"]))
        for name, s in search.items():
            if s["done"]:
                continue
            below, border = 0, None
            for bucket, weight in sorted(sums.get(name, [])):
                if below + weight > s["want"]:
                    border = (bucket, weight)
                    break
                below += weight
            if border is None:
                s.update(low=s["high"], done=True)
                continue
            low = s["low"] + border[0] * s["width"]
            high = min(s["high"], low + s["width"])
            s.update(low=low, high=high, want=s["want"] - below)
            if border[1] <= tolerance:
                s.update(low=high if s["want"] * 2 > border[1] else low, done=True)
            elif high - low == 1:
                if s["on"] is None:
                    s.update(on=low, low=0, high=TIES)
                else:
                    s.update(low=high if s["want"] * 2 > border[1] else low, done=True)
    for n in nodes:
        s = search[n.low]
        middle = (n.low + n.high) // 2
        axis = F.col(s["axis"])
        n.rule = (axis < s["low"]) if s["on"] is None else (axis < s["on"]) | ((axis == s["on"]) & (F.col("tie") < s["low"]))
        n.left, n.right = Node(n.low, middle), Node(middle, n.high)


def kd_shards(docs: DataFrame, shards: int = 16, dimensions: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, doc_id, size, text_crc32, shard, slot`` of every row. ``size`` is the text's UTF-8 bytes plus 1.

    Rows of equal text, null and empty alike, share a shard; the weights of shards differ by about ``CLOSE`` of a shard unless a single group
    is heavier than a shard. ``dimensions`` are whole-number expressions over the input (a null counts as 0); by default the id and the
    size. Slots number the rows of a shard from 0 without a gap. Null and repeated ids are kept; an empty input gives no row.
    """
    own = {"first_id": F.col(f"`{id_col}`"), "size_of": F.octet_length(F.col(f"`{text_col}`").cast("string"))} if dimensions is None else dimensions
    axes = {f"axis_{k}": F.greatest(F.least(F.coalesce(c.cast("long"), F.lit(0)), F.lit(EDGE)), F.lit(-EDGE)) for k, c in enumerate(own.values())}
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = materialize(
        keyed(docs).select(
            "row_key",
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            *[c.alias(name) for name, c in axes.items()],
        ),
        "shard-rows",
    )
    units = materialize(
        rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("rows"), *[F.min(a).alias(a) for a in axes]).withColumn("tie", F.pmod(F.xxhash64("digest"), F.lit(TIES))),
        "shard-units",
    )
    total, count = units.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # At most shards / HEAVY groups can pass each of the two bounds.
    is_heavy = (F.col("weight") > total * HEAVY / shards) | (F.col("rows") > count * HEAVY / shards)
    placed, room = _heavy_first([(bytes(r[0]), r[1]) for r in units.where(is_heavy).select("digest", "weight").collect()], total, shards)
    light = units.where(~is_heavy)
    root = Node(0, shards)
    whole = light.agg(*[F.max(a) - F.min(a) for a in axes]).first()
    widths = {a: max(1, width or 0) for a, width in zip(axes, whole, strict=True)}
    while nodes := [n for n in root.leaves() if n.high - n.low > 1]:
        _split(light, root, nodes, room, widths, total * CLOSE / shards)

    spark = docs.sparkSession
    by_tree = light.select("digest", root.leaf_of(lambda n: n.low).cast("int").alias("shard"))
    by_hand = spark.createDataFrame([(bytearray(d), s) for d, s in placed.items()], "digest binary, hand int")
    marked = rows.join(F.broadcast(by_hand), "digest", "left")
    columns = ["row_key", "doc_id", "size", "text_crc32", "shard"]
    sharded = (
        marked.where("hand is not null").withColumnRenamed("hand", "shard").select(*columns)
        .unionByName(marked.where("hand is null").join(by_tree, "digest").select(*columns))
        .withColumn("deal", F.pmod(F.xxhash64("row_key"), F.lit(small_count(count, NUMBERED))))
    )
    sharded = materialize(sharded, "sharded")
    before = W.partitionBy("shard").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    starts = sharded.groupBy("shard", "deal").count().select("shard", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = sharded.withColumn("k", F.row_number().over(W.partitionBy("shard", "deal").orderBy("doc_id", "row_key")) - 1)
    return numbered.join(starts, ["shard", "deal"]).select(*columns, (F.col("base") + F.col("k")).alias("slot"))
