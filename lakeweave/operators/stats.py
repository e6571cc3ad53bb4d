"""Report statistics: histograms, trend, shares, extremes, rankings and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.summary import most_common
from lakeweave.session import materialize

# Tags that name file formats, left out of tag reports.
SKIPPED_TAG_PARTS = ("tif", "kml", "kmz", "gis")


def equal_width_histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """``(series, bin, low, high, count)``: ``bins`` equal bins from minimum to maximum per column.

    Bins are closed on the left, the last one on both sides. A series of equal values is widened by 0.5
    to both sides. There is one range per column, so the ranges can be broadcast.
    """
    values = df.unpivot([], columns, "series", "value").where(F.col("value").isNotNull())
    flat = F.col("low") == F.col("high")
    ranges = (
        values.groupBy("series")
        .agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
        .select(
            "series",
            F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        )
    )

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("high")).otherwise(
            F.col("low") + i * ((F.col("high") - F.col("low")) / F.lit(float(bins)))
        )

    guess = F.least(
        F.floor(
            (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * F.lit(float(bins))
        ).cast("int"),
        F.lit(bins - 1),
    )
    index = F.col("bin")
    settled = (
        F.when(F.col("value") < edge(index), index - 1)
        .when((F.col("value") >= edge(index + 1)) & (index < bins - 1), index + 1)
        .otherwise(index)
    )
    counts = (
        values.join(F.broadcast(ranges), "series")
        .withColumn("bin", guess)
        .withColumn("bin", settled)
        .groupBy("series", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    all_bins = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return all_bins.join(counts, ["series", "bin"], "left").select(
        "series",
        "bin",
        edge(index).alias("low"),
        edge(index + 1).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def counts_with_population(counts: DataFrame, population: DataFrame) -> DataFrame:
    """Domains that have both a dataset count and a population."""
    return counts.join(population, "domain")


def trend_line(df: DataFrame, x: str = "population", y: str = "count") -> DataFrame:
    """Least-squares line through ``log10``: one row ``slope, intercept, x_low, x_high``.

    Points that are not above 0 have no logarithm and are left out.
    """
    usable = df.where((F.col(x) > 0) & (F.col(y) > 0))
    log_x, log_y = F.log10(F.col(x).cast("double")), F.log10(F.col(y).cast("double"))
    return usable.agg(
        F.regr_slope(log_y, log_x).alias("slope"),
        F.regr_intercept(log_y, log_x).alias("intercept"),
        F.min(F.col(x).cast("double")).alias("x_low"),
        F.max(F.col(x).cast("double")).alias("x_high"),
    )


def trend_curve(line: DataFrame, points: int = 200) -> DataFrame:
    """``(point, x, y)`` along the fitted line at equal distances of ``x``."""
    step = (F.col("x_high") - F.col("x_low")) / F.lit(float(points - 1))
    x = F.when(F.col("point") == points - 1, F.col("x_high")).otherwise(
        F.col("x_low") + F.col("point") * step
    )
    return (
        line.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select(
            "point",
            "x",
            F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.log10("x")).alias("y"),
        )
    )


def shares(counts: DataFrame, digits: int, by: tuple[str, ...] = (), percent: bool = True) -> DataFrame:
    """Add the share of ``count`` in its group, rounded.

    The totals come from an aggregate that is joined back, so no task holds all keys.
    """
    scale = 100.0 if percent else 1.0
    if by:
        totals = counts.groupBy(*by).agg(F.sum("count").alias("total"))
        joined = counts.join(totals, list(by))
    else:
        totals = counts.agg(F.sum("count").alias("total"))
        # One row, joined on a constant.
        joined = counts.withColumn("one", F.lit(1)).join(
            F.broadcast(totals.withColumn("one", F.lit(1))), "one"
        )
    share = F.col("count") / F.nullif("total", F.lit(0)) * F.lit(scale)
    return joined.select(*counts.columns, F.round(share, digits).alias("share"))


def match_share(df: DataFrame, text: Column, pattern: str, digits: int = 2) -> DataFrame:
    """``(matches, count, share)``: how much of the non-null text contains a match of ``pattern``."""
    counts = (
        df.select(text.rlike(pattern).alias("matches"))
        .where(F.col("matches").isNotNull())
        .groupBy("matches")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return shares(counts, digits, percent=False)


def tabular_share(
    formats: DataFrame, min_datasets: int = 10, top: int | None = None, tabular: str = "tabular"
) -> DataFrame:
    """Percentage of tabular datasets per domain, highest first; small domains are left out.

    ``formats(domain, key, count)`` is a format frequency by domain.
    """
    share = F.col("tabular_count") / F.col("total_datasets") * F.lit(100.0)
    ordered = (
        formats.groupBy("domain")
        .agg(
            F.sum("count").alias("total_datasets"),
            F.sum(F.when(F.col("key") == tabular, F.col("count")).otherwise(0)).alias("tabular_count"),
        )
        .where((F.col("total_datasets") >= min_datasets) & (F.col("total_datasets") > 0))
        .withColumn("tabular_percentage", share)
        .orderBy(F.desc("tabular_percentage"), "domain")
    )
    return ordered if top is None else ordered.limit(top)


def series_peak(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, months, count)`` of the highest point, the earliest one on ties."""
    return series.groupBy(*by).agg(
        F.max_by("months", F.struct(F.col("count"), -F.col("months"))).alias("months"),
        F.max("count").alias("count"),
    )


def extremes(
    df: DataFrame, key: str, by_population: int = 3, by_count: int = 2
) -> DataFrame:
    """Rows with the smallest and largest population and count, each row once. The input is made once and stored."""
    stored = materialize(df, "extremes")
    parts = [
        stored.orderBy(order, key).limit(n)
        for column, n in (("population", by_population), ("count", by_count))
        for order in (F.asc(column), F.desc(column))
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def top_keys(counts: DataFrame, by: str, n: int = 3) -> DataFrame:
    """``(by, top_keys)``: the ``n`` most common keys per group, most common first.

    The rank limit is applied inside each partition before the shuffle, so a group is never gathered whole.
    """
    ranked = Window.partitionBy(by).orderBy(F.desc("count"), "key")
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
        .groupBy(by)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("ranked"))
        .select(by, F.transform("ranked", lambda r: r["key"]).alias("top_keys"))
    )


def with_serial_number(df: DataFrame, *order: str, name: str = "serial") -> DataFrame:
    """Number all rows from 1 on in the order of ``order``, which must tell all rows apart.

    Rows are range-partitioned, numbered inside their partition, and shifted by the rows of the partitions
    before. Only one row count per partition goes through a single task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    located = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "serial",
    )
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        located.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the range shuffle above.
    return (
        located.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .select((F.col("offset") + within + 1).alias(name), *df.columns)
    )


def city_report(counts: DataFrame, population: DataFrame, categories: DataFrame, n: int = 3) -> DataFrame:
    """Dataset count and most common categories per city, from few to many datasets, with serial numbers.

    ``categories(domain, key, count)`` is a category frequency by domain; cities without one get null.
    """
    rows = (
        counts_with_population(counts, population)
        .join(top_keys(categories, "domain", n), "domain", "left")
        .select("domain", "city", "count", F.col("top_keys").alias("top_categories"))
    )
    return with_serial_number(rows, "count", "domain").orderBy("serial")


def tag_weights(counts: DataFrame, log: bool = True, max_words: int | None = 100) -> DataFrame:
    """``(key, weight)`` of the tags, heaviest first, without file-format tags."""
    lowered = F.lower("key")
    named = F.lit(False)
    for part in SKIPPED_TAG_PARTS:
        named = named | lowered.contains(part)
    weight = F.ln(F.col("count") + 1) if log else F.col("count").cast("double")
    kept = most_common(counts.where(~named), max_words)
    return kept.select("key", weight.alias("weight"))


def sample_columns(
    columns: DataFrame, seed: int, max_datasets: int | None = 3, max_columns: int | None = 5
) -> DataFrame:
    """A repeatable sample of ``(dataset_id, column_name)``: some datasets, some columns of each."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), "dataset_id", F.lit("."), "column_name"))
    sampled = columns.select("dataset_id", "column_name").distinct()
    if max_datasets is not None:
        chosen = (
            sampled.select("dataset_id")
            .distinct()
            .orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "dataset_id")), "dataset_id")
            .limit(max_datasets)
        )
        sampled = sampled.join(chosen, "dataset_id", "left_semi")
    if max_columns is not None:
        within = Window.partitionBy("dataset_id").orderBy(order, "column_name")
        sampled = (
            sampled.withColumn("rank", F.row_number().over(within))
            .where(F.col("rank") <= max_columns)
            .drop("rank")
        )
    return sampled


def first_by_id(df: DataFrame, limit: int | None, *keys: str) -> DataFrame:
    """The first ``limit`` rows in key order; all of them without a limit."""
    return df if limit is None else df.orderBy(*keys).limit(limit)
