"""Catalog summaries: frequencies, bucket histograms, age series, sparseness, per domain and overall.

All counts are hash aggregates with map-side combine, so one domain holding most records does not end up
in one task. Empty buckets are made from the aggregated counts, not by joining domains with buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions import buckets as B
from lakeweave.functions.times import months_since
from lakeweave.session import materialize

# Names of the statistics and how each is ordered in a report.
FREQUENCIES = ("tag_counts", "categories", "formats", "column_types")
AGES = ("publication_age", "last_update")
BUCKETED = {
    "attribute_counts": B.ATTRIBUTES,
    "download_counts": B.USES,
    "row_counts": B.ROWS,
    "view_counts": B.USES,
    "sparseness_counts": B.SPARSENESS,
}


def frequency(df: DataFrame, key: Column, by: tuple[str, ...] = (), nulls: bool = False) -> DataFrame:
    """``(*by, key, count)``; null keys form a group of their own only with ``nulls``."""
    keyed = df.select(*by, key.alias("key"))
    if not nulls:
        keyed = keyed.where(F.col("key").isNotNull())
    return keyed.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("count"))


def tag_frequency(df: DataFrame, tags: str = "tags", by: tuple[str, ...] = ()) -> DataFrame:
    return frequency(df.select(*by, F.explode(tags).alias("tag")), F.col("tag"), by)


def column_type_frequency(df: DataFrame, columns: str = "columns", by: tuple[str, ...] = ()) -> DataFrame:
    exploded = df.select(*by, F.explode(columns).alias("c"))
    return frequency(exploded, F.col("c.type"), by)


def most_common(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Count descending, key as tie-break."""
    ordered = counts.orderBy(F.desc("count"), F.asc_nulls_last("key"))
    return ordered if limit is None else ordered.limit(limit)


def bucket_histogram(
    df: DataFrame,
    value: Column,
    spec: B.Buckets,
    by: tuple[str, ...] = (),
    outside: bool = False,
    measured: bool = False,
) -> DataFrame:
    """``(*by, ordinal, bucket, count)`` with a row for every bucket, empty ones included.

    ``outside`` adds a row with a null bucket for values in no bucket. ``measured`` leaves out groups
    without any value.
    """
    # The value gets a step of its own, so that a costly one is not made once per bucket.
    labelled = df.select(*by, value.alias("value")).select(
        *by, "value", spec.label(F.col("value")).alias("bucket")
    )
    labels = list(spec.labels) + ([None] if outside else [])
    counts = [
        F.count_if(F.col("bucket").isNull() if label is None else F.col("bucket") == label).alias(
            f"n{i}"
        )
        for i, label in enumerate(labels)
    ]
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(label).cast("string").alias("bucket"),
            F.col(f"n{i}").alias("count"),
        )
        for i, label in enumerate(labels)
    ]
    groups = labelled.groupBy(*by).agg(F.count("value").alias("values"), *counts)
    if measured:
        groups = groups.where(F.col("values") > 0)
    return groups.select(*by, F.explode(F.array(*rows)).alias("b")).select(*by, "b.*")


def attribute_count(columns: Column) -> Column:
    return F.when(columns.isNull(), 0).otherwise(F.size(columns))


def age_series(df: DataFrame, epoch_seconds: Column, now: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, months, count)`` without gaps between the youngest and the oldest age.

    Missing dates and ages below 0 are left out; a date less than a month ahead has age 0.
    """
    months = months_since(epoch_seconds, now)
    counts = (
        df.select(*by, months.alias("months"))
        .where(F.col("months") >= 0)
        .groupBy(*by, "months")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _without_gaps(counts, "months", by)


def _without_gaps(counts: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    span = counts.groupBy(*by).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    zeros = span.where(F.col("low").isNotNull()).select(
        *by,
        F.explode(F.sequence("low", "high")).alias(key),
        F.lit(0).cast("bigint").alias("count"),
    )
    return counts.unionByName(zeros).groupBy(*by, key).agg(F.sum("count").alias("count"))


def sparseness(columns: Column, row_count: Column) -> Column:
    """Mean share of semantic nulls over the columns of a dataset, in percent.

    Null without columns, without rows, or where a column has no statistics.
    """
    total = F.aggregate(
        columns,
        F.lit(0.0),
        lambda acc, c: acc + c["semantic_nulls"] / row_count * F.lit(100.0),
    )
    return F.when((F.size(columns) > 0) & (row_count > 0), total / F.size(columns))


def sparseness_histogram(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Buckets of the sparseness of the datasets that have one."""
    share = sparseness(F.col("columns"), F.col("row_count"))
    return bucket_histogram(df, share, B.SPARSENESS, by, measured=True)


def _measures(now: float) -> dict[str, Column]:
    """What the bucket and age statistics of a record are taken from."""
    return {
        "_sparseness": sparseness(F.col("columns"), F.col("row_count")),
        "_attributes": attribute_count(F.col("columns")),
        "_published": months_since(F.col("publication_date"), now),
        "_updated": months_since(F.col("updated_at"), now),
    }


def _entries() -> Column:
    """All (statistic, key) pairs one metadata record counts for."""

    def one(statistic: str, key: Column, keep: Column | None = None) -> Column:
        entry = F.array(
            F.struct(F.lit(statistic).alias("statistic"), key.cast("string").alias("key"))
        )
        nothing = F.array().cast("array<struct<statistic:string,key:string>>")
        return F.when(key.isNotNull() if keep is None else keep, entry).otherwise(nothing)

    def many(statistic: str, keys: Column) -> Column:
        present = F.filter(
            F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()
        )
        return F.transform(
            present, lambda k: F.struct(F.lit(statistic).alias("statistic"), k.alias("key"))
        )

    sparse, published, updated = (F.col(c) for c in ("_sparseness", "_published", "_updated"))
    return F.concat(
        many("tag_counts", F.col("tags")),
        one("categories", F.col("category")),
        one("formats", F.col("format")),
        many("column_types", F.transform("columns", lambda c: c["type"])),
        one("row_counts", B.ROWS.label(F.col("row_count"))),
        one("view_counts", B.USES.label(F.col("view_count"))),
        one("download_counts", B.USES.label(F.col("download_count"))),
        one("attribute_counts", B.ATTRIBUTES.label(F.col("_attributes"))),
        one("publication_age", published, published >= 0),
        one("last_update", updated, updated >= 0),
        # A measured value in no bucket keeps a null key: its domain still has the statistic.
        one("sparseness_counts", B.SPARSENESS.label(sparse), sparse.isNotNull()),
    )


def catalog_summary(records: DataFrame, now: float) -> DataFrame:
    """All statistics of all domains as ``(domain, statistic, key, count)``.

    The records are read once: each one is turned into the keys it counts for, and a single aggregate
    counts them. The counts are stored, and empty buckets and age gaps are filled in from there.
    """
    counts = materialize(
        records.withColumns(_measures(now))
        .select("domain", F.explode_outer(_entries()).alias("e"))
        .groupBy("domain", "e.statistic", "e.key")
        .agg(F.count(F.lit(1)).alias("count")),
        "summary",
    )
    always = [(s, label) for s, spec in BUCKETED.items() if s != "sparseness_counts" for label in spec.labels]
    zero = F.lit(0).cast("bigint").alias("count")

    def pairs(items) -> Column:
        return F.array(
            *[F.struct(F.lit(s).alias("statistic"), F.lit(k).alias("key")) for s, k in items]
        )

    # Every record has an attribute bucket, so these rows name all domains.
    bucket_zeros = (
        counts.where(F.col("statistic") == "attribute_counts")
        .select("domain")
        .distinct()
        .select("domain", F.explode(pairs(always)).alias("e"))
        .select("domain", "e.*", zero)
    )
    sparse_zeros = (
        counts.where(F.col("statistic") == "sparseness_counts")
        .select("domain")
        .distinct()
        .select(
            "domain",
            F.explode(pairs([("sparseness_counts", k) for k in B.SPARSENESS.labels])).alias("e"),
        )
        .select("domain", "e.*", zero)
    )
    age_zeros = (
        counts.where(F.col("statistic").isin(*AGES))
        .groupBy("domain", "statistic")
        .agg(F.min(F.col("key").cast("int")).alias("low"), F.max(F.col("key").cast("int")).alias("high"))
        .select(
            "domain",
            "statistic",
            F.explode(F.sequence("low", "high").cast("array<string>")).alias("key"),
            zero,
        )
    )
    return (
        counts.unionByName(bucket_zeros)
        .unionByName(sparse_zeros)
        .unionByName(age_zeros)
        .where(F.col("key").isNotNull())
        .groupBy("domain", "statistic", "key")
        .agg(F.sum("count").alias("count"))
    )


def rollup_domains(summary: DataFrame) -> DataFrame:
    """The summary and its sum over all domains (``is_total``, null domain) in one aggregate."""
    return (
        summary.groupingSets(
            [["domain", "statistic", "key"], ["statistic", "key"]], "domain", "statistic", "key"
        )
        .agg(F.sum("count").alias("count"), (F.grouping("domain") == 1).alias("is_total"))
        .select("domain", "statistic", "key", "count", "is_total")
    )


def report_order(summary: DataFrame) -> DataFrame:
    """Order rows as a report shows them, per statistic.

    Frequencies come by count, ages by month, buckets in their fixed order.
    """
    position = F.lit(None).cast("int")
    for statistic, spec in BUCKETED.items():
        for i, label in enumerate(spec.labels):
            position = F.when(
                (F.col("statistic") == statistic) & (F.col("key") == label), i
            ).otherwise(position)
    position = F.when(F.col("statistic").isin(*AGES), F.col("key").try_cast("int")).otherwise(position)
    return summary.withColumn("position", position).orderBy(
        F.asc_nulls_first("domain"), "statistic", F.asc_nulls_last("position"), F.desc("count"), "key"
    )


def lookup(rollup: DataFrame, statistic: str, domain: str | None = None) -> DataFrame:
    """One statistic of one domain, or of all domains; unknown names give no rows."""
    scope = F.col("is_total") if domain is None else (~F.col("is_total") & (F.col("domain") == domain))
    return rollup.where(scope & (F.col("statistic") == statistic)).select("key", "count")


HEADLINES = ("view_type", "download_type", "category")


def headline_counts(records: DataFrame, top: int = 10) -> DataFrame:
    """``(headline, key, count)``: the most common types and categories, all row buckets and years.

    Missing values count as a key of their own.
    """
    names = HEADLINES + ("row_count_bucket", "created_year")
    keys = [F.struct(F.lit(n).alias("headline"), F.col(n).cast("string").alias("key")) for n in names]
    counts = (
        records.select(F.explode(F.array(*keys)).alias("k"))
        .groupBy("k.headline", "k.key")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # A headline without a limit ranks each key by itself. So one plain limit on the rank is left, which Spark applies in each task before the shuffle.
    alone = F.when(~F.col("headline").isin(*HEADLINES), F.struct("key"))
    order = Window.partitionBy("headline", "alone").orderBy(F.desc("count"), F.asc_nulls_last("key"))
    ranked = counts.withColumn("alone", alone).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).drop("rank", "alone")


def recency_histogram(records: DataFrame) -> DataFrame:
    """Days since the last update in buckets; values in no bucket are counted under null."""
    return bucket_histogram(records, F.col("updated_days_ago"), B.RECENCY, outside=True)


# Labels of the coverage report.
FLAGS = {
    "has_location_column": "With location columns",
    "has_date_column": "With date/datetime columns",
    "has_year_column": "With year columns",
}


def semantic_coverage(records: DataFrame) -> DataFrame:
    """``(label, percent)`` for each of the three column flags."""
    means = records.agg(*[(F.avg(F.col(c).cast("double")) * 100).alias(c) for c in FLAGS])
    rows = [F.struct(F.lit(t).alias("label"), F.col(c).alias("percent")) for c, t in FLAGS.items()]
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def run_summary(counts: DataFrame) -> DataFrame:
    """Outcome of a count run over ``(domain, count, error)``; ``count`` below 0 is a failure."""
    ok = F.col("count") >= 0
    return counts.agg(
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")).contains("Timeout")).alias("timeouts"),
        F.coalesce(F.sum(F.when(ok, F.col("count"))), F.lit(0)).alias("total_datasets"),
        F.count(F.lit(1)).alias("domains"),
    )


def download_summary(attempts: DataFrame) -> DataFrame:
    """Per domain, downloads that went well, were skipped, or failed; input ``(domain, outcome)``."""
    return attempts.groupBy("domain").agg(
        *[
            F.count_if(F.col("outcome") == name).alias(name)
            for name in ("successful", "skipped", "failed")
        ]
    )


def summary_status(domains: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Status per domain of a summary run: failed with an error, nothing to read, or done.

    ``files(domain, valid)`` has a row per metadata file, ``errors(domain, error)`` a row per error; of several errors of a domain the first in
    text order is told.
    """
    found = files.groupBy("domain").agg(
        F.count(F.lit(1)).alias("files_processed"), F.count_if("valid").alias("valid_files")
    )
    joined = domains.join(found, "domain", "left")
    if errors is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        told = errors.where(F.col("error").isNotNull()).groupBy("domain").agg(F.min("error").alias("error"))
        joined = joined.join(told, "domain", "left")
    none, failed = F.col("files_processed").isNull(), F.col("error").isNotNull()
    return joined.select(
        "domain",
        F.when(failed, "failed").when(none, "skipped").otherwise("success").alias("status"),
        F.when(failed, F.col("error")).when(none, "no_metadata").alias("reason"),
        "files_processed",
        F.coalesce("valid_files", F.lit(0)).alias("valid_files"),
    )
