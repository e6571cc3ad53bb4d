"""Every operator as a query over the test tables, each over whole tables.

The tables stand in for a lake: for joinability they are the datasets themselves; for the catalog operators
each order is a dataset, its customer's nation the domain, and counts and dates come from its columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import buckets as B
from lakeweave.functions import hashing
from lakeweave.functions.text import page_title, safe_alias, safe_domain
from lakeweave.operators import graph, profile, resume, similarity, sketch, stats, summary
from lakeweave.operators.joinability import indexed_pairs, joinable_datasets, joinable_pairs, rank_pairs, write_join_index
from lakeweave.plans.catalog import domain_summaries, profiled_records
from lakeweave.plans.joinability import lake_sketches, landed_sketches
from lakeweave.plans.similarity import alike_columns
from lakeweave.session import scratch_path
from lakeweave.sources import files, lake
from lakeweave.sources.tables import cells_of, distinct_cells, first_cells, kept_columns, read_tables, typed_cells
from lakeweave.streaming import incremental

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The tables that stand in for landed JSON datasets.
LANDED = ("customer", "orders")

# 2000-01-01: some of the order dates lie ahead of it.
NOW = 946_684_800.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_sketches: dict[tuple, DataFrame] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    # Numbers get their one form behind the step that makes the cells distinct.
    return distinct_cells(read_tables(spark, d, TABLES))


def sketches(spark: SparkSession, d: str) -> DataFrame:
    """Stored sketches, built once per session and folder, as the join reports read them from a store."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _sketches:
        _sketches[key] = lake_sketches(spark, d, TABLES)
    return _sketches[key]


def forget_sketches() -> None:
    _sketches.clear()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return joinable_pairs(sketches(spark, d))


# --- columns, sketches, joinability -------------------------------------------------------------------


@query
def joinable_columns(spark, d):
    return rank_pairs(pairs(spark, d))


@query
def indexed_joinable_columns(spark, d):
    """As `joinable_columns`, from a bucketed index that serves any thresholds."""
    name = f"lake_{uuid.uuid4().hex}"
    write_join_index(sketches(spark, d), name, scratch_path(spark, "index"), buckets=8)
    return rank_pairs(indexed_pairs(spark, name))


@query
def joinable_preview(spark, d):
    return rank_pairs(pairs(spark, d), 100)


@query
def column_profile(spark, d):
    return profile.profile_tables(read_tables(spark, d, TABLES))


@query
def column_support(spark, d):
    support = sketch.column_support(sketch.column_values(cells(spark, d)))
    return support.where(F.col("support") >= 50)


@query
def clean_values(spark, d):
    values = sketch.column_values(cells(spark, d)).where(F.col("value") != "")
    return values.groupBy(*sketch.COLUMN_KEY).agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("cells").alias("cells"),
        F.min("value").alias("lowest"),
        F.sum(F.length("value")).alias("characters"),
    )


@query
def minhash_signature(spark, d):
    return sketch.signature_rows(sketches(spark, d))


@query
def register_cardinality(spark, d):
    return sketches(spark, d).select(*sketch.COLUMN_KEY, "cardinality")


@query
def column_sketches(spark, d):
    built = sketch.build_sketches(cells(spark, d), min_support=50)
    signature = F.array_join(
        F.transform("signature", lambda h: F.lower(F.lpad(F.hex(h.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))),
        ",",
    )
    return built.select(*sketch.COLUMN_KEY, signature.alias("signature"), "cardinality")


def land(rows: DataFrame, target: str, rows_a_file: int = 5_000) -> None:
    """Write rows as files of one JSON array each below the folder ``target``. No file is put together from more rows than that."""
    texts = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"), F.floor(F.monotonically_increasing_id() / rows_a_file).alias("part"))
    bodies = texts.groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("body"))
    bodies.repartition("part").write.partitionBy("part").text(target)


@query
def landed_file_sketches(spark, d):
    """Sketches of two tables that are landed as JSON files in the shared folder; the larger files are read in ranges."""
    path = scratch_path(spark, "landed")
    for name in LANDED:
        rows = table(spark, d, name)
        land(rows.select(*[f"`{f.name}`" for f in kept_columns(rows)]), f"{path}/data_{name}.json")
    built = landed_sketches(spark, path, min_support=50, whole_bytes=64 << 10)
    return built.select(*sketch.COLUMN_KEY, F.array_join(F.transform("signature", hashing.signature_hex), ",").alias("signature"), "cardinality")


@query
def exact_cardinality(spark, d):
    built = sketch.build_sketches(cells(spark, d), family="xxhash64", cardinality="exact")
    return built.select(*sketch.COLUMN_KEY, "cardinality")


@query
def fast_joinable_columns(spark, d):
    return rank_pairs(
        joinable_pairs(lake_sketches(spark, d, TABLES, family="xxhash64", cardinality="exact"))
    )


@query
def once_hashed_joinable_columns(spark, d):
    """As `fast_joinable_columns`, with one digest a value in place of Spark's own hash."""
    return rank_pairs(
        joinable_pairs(lake_sketches(spark, d, TABLES, family="md5", cardinality="exact"))
    )


# --- join graph ---------------------------------------------------------------------------------------


def edges(spark, d) -> DataFrame:
    """Edges by counting; `visible_edges` and `dataset_nodes` make them from the pairs."""
    return joinable_datasets(sketches(spark, d))


@query
def dataset_edges(spark, d):
    return edges(spark, d)


@query
def visible_edges(spark, d):
    return graph.visible_edges(graph.dataset_edges(pairs(spark, d)), 0.8)


@query
def dataset_nodes(spark, d):
    return graph.dataset_nodes(graph.dataset_edges(pairs(spark, d)))


@query
def dataset_pair_counts(spark, d):
    return graph.pair_counts_of_edges(edges(spark, d))


@query
def hub_degree(spark, d):
    return graph.top(graph.hub_degree_of_edges(edges(spark, d)), "num_partners", 15, "dataset")


def table_labels(spark, d) -> DataFrame:
    """Names for the larger tables only, so that the fallback to the id shows."""
    rows = profile.profile_tables(read_tables(spark, d, TABLES))
    return (
        rows.where((F.col("row_count") >= 300) & (F.col("position") == 0))
        .select(
            "dataset_id",
            F.concat(F.lit(" table of "), "row_count", F.lit(" rows ")).alias("name"),
        )
    )


@query
def top_hubs(spark, d):
    nodes = graph.dataset_nodes(edges(spark, d))
    return graph.top_hubs(nodes, graph.label_table(table_labels(spark, d)), 15)


@query
def top_dataset_pairs(spark, d):
    return graph.top_pairs(pairs(spark, d), graph.label_table(table_labels(spark, d)), 15)


@query
def containment_histogram(spark, d):
    return stats.equal_width_histogram(
        pairs(spark, d), ["js", "jc_left_in_right", "jc_right_in_left"], 30
    )


@query
def value_histogram(spark, d):
    return stats.equal_width_histogram(
        table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], 40
    )


# --- embeddings ---------------------------------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("label"), "label", F.lit(".v"), "vec_id").alias("name"), "embedding"
    )


def matches(spark, d) -> DataFrame:
    return similarity.cosine_pairs(vectors(spark, d), 0.3)


@query
def cosine_pairs(spark, d):
    return matches(spark, d).withColumn("score", F.round("score", 9))


@query
def top_matches(spark, d):
    return similarity.top_matches(matches(spark, d)).withColumn("score", F.round("score", 9))


@query
def strong_edges(spark, d):
    return graph.strong_edges(matches(spark, d), 0.4).withColumn("score", F.round("score", 9))


@query
def endpoint_frequency(spark, d):
    return graph.top(graph.endpoint_frequency(matches(spark, d)), "count", 10, "dataset")


# Columns that put the rows of each table in order; the other columns settle ties.
ROW_ORDER = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


def ordered_cells(spark, d, n: int) -> DataFrame:
    """Cells of the first ``n`` rows of every table."""
    parts = [first_cells(table(spark, d, name), name, order, n) for name, order in ROW_ORDER.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def column_samples(spark, d):
    samples = similarity.first_values(ordered_cells(spark, d, 25), 25)
    return samples.select(*sketch.COLUMN_KEY, F.array_join("samples", "|").alias("samples"))


def sampled_texts(spark, d) -> DataFrame:
    return similarity.column_texts(similarity.first_values(similarity.telling_cells(ordered_cells(spark, d, 50)), 50))


@query
def column_text(spark, d):
    return sampled_texts(spark, d)


@query
def column_embedding(spark, d):
    return similarity.embed_columns(sampled_texts(spark, d))


@query
def alike_by_embedding(spark, d):
    # Rounded before they are ordered, so that equal scores stay equal.
    alike = alike_columns(similarity.telling_cells(ordered_cells(spark, d, 50)), 50, 0.5, top=None)
    return similarity.top_matches(alike.withColumn("score", F.round("score", 9)))


# --- catalog ------------------------------------------------------------------------------------------


def catalog(spark, d) -> DataFrame:
    """One crawl record per order."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    joined = table(spark, d, "orders").join(customer, F.expr("o_custkey = c_custkey")).join(
        nation, F.expr("c_nationkey = n_nationkey")
    )
    based = joined.selectExpr(
        "o_orderkey",
        "o_custkey",
        "lower(n_name) || '.example.org' AS domain",
        "'o' || o_orderkey AS dataset_id",
        "nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED') AS category",
        "CASE o_orderstatus WHEN 'F' THEN 'tabular' WHEN 'O' THEN 'map' ELSE 'href' END AS format",
        """CASE WHEN o_orderkey % 13 = 0 THEN NULL
                WHEN o_orderkey % 11 = 0 THEN cast(array() AS array<string>)
                ELSE array(lower(c_mktsegment),
                           CASE WHEN o_orderstatus = 'F' THEN 'logistics' ELSE lower(substr(o_orderpriority, 3)) END)
           END AS tags""",
        "cast(floor(o_totalprice / 40) AS bigint) AS download_count",
        "cast(floor(o_totalprice / 25) AS bigint) AS view_count",
        "unix_seconds(cast(o_orderdate AS timestamp)) AS publication_date",
        "unix_seconds(cast(o_orderdate AS timestamp)) + (o_custkey % 700) * 86400 AS updated_at",
        """CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 <> 0 THEN
             cast(floor((o_totalprice / 1000) * (o_totalprice / 1000) * (o_totalprice / 1000) / 10) AS bigint)
           END AS row_count""",
    )
    return based.selectExpr(
        "domain",
        "dataset_id",
        "category",
        "format",
        "tags",
        "download_count",
        "view_count",
        "publication_date AS created_at",
        "publication_date",
        "updated_at",
        "row_count",
        """CASE WHEN format = 'tabular' AND o_custkey % 56 > 0 THEN
             transform(sequence(0, cast(o_custkey % 56 AS int) - 1), i -> named_struct(
               'name', 'c' || i,
               'type', element_at(array('text', 'number', 'calendar_date', 'point'), cast((o_orderkey + i) % 4 AS int) + 1),
               'nulls', row_count * (i % 7) div 10,
               'semantic_nulls', row_count * (((o_orderkey % 60) * (i % 3)) % 101) div 100))
           END AS columns""",
    )


@query
def catalog_records(spark, d):
    return catalog(spark, d).select(
        "domain",
        "dataset_id",
        "category",
        "format",
        F.array_join("tags", ",").alias("tags"),
        "download_count",
        "view_count",
        "updated_at",
        "row_count",
        summary.attribute_count(F.col("columns")).alias("attributes"),
        F.round(summary.sparseness(F.col("columns"), F.col("row_count")), 6).alias("sparseness"),
    )


BY_DOMAIN = ("domain",)


@query
def tag_frequency(spark, d):
    return summary.tag_frequency(catalog(spark, d), by=BY_DOMAIN)


@query
def category_frequency(spark, d):
    return summary.most_common(summary.frequency(catalog(spark, d), F.col("category")))


@query
def format_frequency(spark, d):
    return summary.frequency(catalog(spark, d), F.col("format"), BY_DOMAIN)


@query
def column_type_frequency(spark, d):
    return summary.column_type_frequency(catalog(spark, d), by=BY_DOMAIN)


@query
def row_buckets(spark, d):
    return summary.bucket_histogram(catalog(spark, d), F.col("row_count"), B.ROWS, BY_DOMAIN)


@query
def view_buckets(spark, d):
    return summary.bucket_histogram(catalog(spark, d), F.col("view_count"), B.USES, BY_DOMAIN)


@query
def download_buckets(spark, d):
    return summary.bucket_histogram(catalog(spark, d), F.col("download_count"), B.USES, BY_DOMAIN)


@query
def attribute_buckets(spark, d):
    attributes = summary.attribute_count(F.col("columns"))
    return summary.bucket_histogram(catalog(spark, d), attributes, B.ATTRIBUTES, BY_DOMAIN)


@query
def report_row_buckets(spark, d):
    bucket = B.report_row_bucket(F.col("row_count"))
    return summary.frequency(catalog(spark, d), bucket)


@query
def publication_age(spark, d):
    return summary.age_series(catalog(spark, d), F.col("publication_date"), NOW, BY_DOMAIN)


@query
def update_age(spark, d):
    return summary.age_series(catalog(spark, d), F.col("updated_at"), NOW, BY_DOMAIN)


@query
def age_peak(spark, d):
    series = summary.age_series(catalog(spark, d), F.col("publication_date"), NOW, BY_DOMAIN)
    return stats.series_peak(series, BY_DOMAIN)


@query
def sparseness_buckets(spark, d):
    return summary.sparseness_histogram(catalog(spark, d), BY_DOMAIN)


@query
def catalog_summary(spark, d):
    return summary.catalog_summary(catalog(spark, d), NOW)


@query
def domain_rollup(spark, d):
    return domain_summaries(catalog(spark, d), NOW)


@query
def overall_report(spark, d):
    totals = domain_summaries(catalog(spark, d), NOW).where("is_total").drop("is_total")
    return summary.report_order(totals)


@query
def summary_lookup(spark, d):
    rolled = domain_summaries(catalog(spark, d), NOW)
    one = summary.lookup(rolled, "formats", "nation_3.example.org")
    every = summary.lookup(rolled, "formats")
    return one.withColumn("scope", F.lit("domain")).unionByName(
        every.withColumn("scope", F.lit("all"))
    )


def portal(spark, d) -> DataFrame:
    """One portal document per order."""
    return table(spark, d, "orders").selectExpr(
        "'o' || o_orderkey AS dataset_id",
        "'Order ' || o_orderkey AS name",
        "nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED') AS category",
        "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE array(lower(o_orderstatus), lower(o_orderpriority)) END AS tags",
        "CASE o_orderstatus WHEN 'F' THEN 'tabular' WHEN 'O' THEN 'map' END AS view_type",
        "CASE WHEN o_custkey % 2 = 0 THEN 'csv' END AS download_type",
        "CASE WHEN o_orderkey % 5 > 0 THEN cast(o_custkey * o_custkey - 9 AS string) ELSE 'many' END AS row_count",
        "unix_seconds(cast(o_orderdate AS timestamp)) AS created_at",
        "CASE WHEN o_orderkey % 4 > 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) + (o_custkey % 900) * 43200 ELSE 0 END AS rows_updated_at",
        "CASE WHEN o_orderkey % 8 > 0 THEN unix_seconds(cast(o_orderdate AS timestamp)) END AS data_updated_at",
        "cast(floor(o_totalprice) AS bigint) AS view_count",
        "cast(floor(o_totalprice / 3) AS bigint) AS download_count",
        """CASE WHEN o_orderkey % 10 > 0 THEN filter(array(
             named_struct('field_name', 'Latitude_' || o_custkey, 'name', 'Lat', 'data_type', 'number', 'keep', o_custkey % 5 = 0),
             named_struct('field_name', 'where', 'name', NULL, 'data_type', 'Point', 'keep', o_custkey % 7 = 0),
             named_struct('field_name', 'shipped', 'name', 'Ship DATE', 'data_type', NULL, 'keep', o_orderkey % 3 = 0),
             named_struct('field_name', 'day', 'name', 'd', 'data_type', 'calendar_date', 'keep', o_orderkey % 7 = 0),
             named_struct('field_name', 'year_built', 'name', 'y', 'data_type', CASE WHEN o_custkey % 2 = 0 THEN 'number' ELSE 'url' END, 'keep', o_orderkey % 4 = 1),
             named_struct('field_name', 'School_Year', 'name', 's', 'data_type', 'url', 'keep', o_orderkey % 6 = 5),
             named_struct('field_name', 'status', 'name', 'Status', 'data_type', 'text', 'keep', true)),
             c -> c.keep) END AS columns""",
    )


@query
def report_records(spark, d):
    records = profile.report_records(portal(spark, d), NOW)
    return records.withColumns(
        {
            "created_at": F.unix_seconds("created_at"),
            "updated_at": F.unix_seconds("updated_at"),
        }
    )


@query
def headline_counts(spark, d):
    return summary.headline_counts(profile.report_records(portal(spark, d), NOW))


@query
def recency_buckets(spark, d):
    return summary.recency_histogram(profile.report_records(portal(spark, d), NOW))


@query
def semantic_coverage(spark, d):
    covered = summary.semantic_coverage(profile.report_records(portal(spark, d), NOW))
    return covered.withColumn("percent", F.round("percent", 6))


# --- domain counts and reports ------------------------------------------------------------------------


def count_run(spark, d) -> DataFrame:
    """Customers per nation as the dataset count of a domain; some domains failed."""
    failed = F.expr("n_nationkey % 7 = 3")
    return (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
        .groupBy("n_nationkey", "n_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lower("n_name"), F.lit(".example.org")).alias("domain"),
            F.when(failed, F.lit(-1).cast("bigint")).otherwise(F.col("n")).alias("count"),
            F.when(failed, F.lit("Timeout after 60s")).alias("error"),
        )
    )


def repeat_run(spark, d) -> DataFrame:
    """Suppliers per nation as the counts of a later run over other domains as well."""
    return (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
        .groupBy("n_nationkey", "n_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lower("n_name"), F.lit(".example.org")).alias("domain"),
            F.expr("CASE WHEN n_nationkey = 10 THEN cast(-1 AS bigint) ELSE n END").alias("count"),
            F.expr("CASE WHEN n_nationkey = 10 THEN 'refused' END").alias("error"),
        )
    )


def population(spark, d) -> DataFrame:
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
        .where("n_nationkey % 10 <> 9")
        .groupBy("n_name")
        .agg(F.sum(F.expr("cast(round(o_totalprice * 100) AS bigint)")).alias("population"))
        .select(
            F.concat(F.lower("n_name"), F.lit(".example.org")).alias("domain"),
            F.initcap("n_name").alias("city"),
            "population",
        )
    )


@query
def run_summary(spark, d):
    return summary.run_summary(count_run(spark, d))


@query
def merge_counts(spark, d):
    return resume.merge_counts(count_run(spark, d), repeat_run(spark, d))


@query
def download_summary(spark, d):
    outcome = "CASE o_orderstatus WHEN 'F' THEN 'successful' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS outcome"
    attempts = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
        .selectExpr("'n' || c_nationkey AS domain", outcome)
    )
    return summary.download_summary(attempts)


def expected_ids(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "'n' || c_nationkey AS domain", "'c' || c_custkey AS dataset_id"
    )


def existing_ids(spark, d) -> DataFrame:
    return (
        table(spark, d, "orders")
        .where("o_orderstatus = 'F' AND o_totalprice < 60000")
        .join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
        .selectExpr("'n' || c_nationkey AS domain", "'c' || c_custkey AS dataset_id")
    )


@query
def completeness(spark, d):
    return resume.completeness(expected_ids(spark, d), existing_ids(spark, d))


@query
def not_yet_done(spark, d):
    return resume.not_yet_done(expected_ids(spark, d), existing_ids(spark, d), "dataset_id")


@query
def id_difference(spark, d):
    return resume.id_difference(expected_ids(spark, d), existing_ids(spark, d), "dataset_id")


@query
def counts_with_population(spark, d):
    return stats.counts_with_population(
        count_run(spark, d).select("domain", "count"), population(spark, d)
    )


@query
def trend_line(spark, d):
    line = stats.trend_line(counts_with_population(spark, d))
    return line.select(
        F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "x_low", "x_high"
    )


@query
def trend_curve(spark, d):
    curve = stats.trend_curve(stats.trend_line(counts_with_population(spark, d)))
    return curve.select("point", F.round("x", 3).alias("x"), F.round("y", 6).alias("y"))


@query
def count_extremes(spark, d):
    return stats.extremes(counts_with_population(spark, d), "domain")


@query
def format_share(spark, d):
    return stats.shares(summary.frequency(catalog(spark, d), F.col("format"), BY_DOMAIN), 1, BY_DOMAIN)


@query
def row_share(spark, d):
    histogram = summary.bucket_histogram(catalog(spark, d), F.col("row_count"), B.ROWS)
    return stats.shares(histogram, 2)


@query
def match_share(spark, d):
    return stats.match_share(table(spark, d, "documents"), F.col("text"), "[T|t]re")


@query
def tabular_share(spark, d):
    return stats.tabular_share(summary.frequency(catalog(spark, d), F.col("format"), BY_DOMAIN))


@query
def top_categories(spark, d):
    counts = summary.frequency(catalog(spark, d), F.col("category"), BY_DOMAIN)
    top = stats.top_keys(counts, "domain", 3)
    return top.select("domain", F.array_join("top_keys", ",").alias("top_keys"))


@query
def city_report(spark, d):
    categories = summary.frequency(catalog(spark, d), F.col("category"), BY_DOMAIN)
    report = stats.city_report(
        count_run(spark, d).select("domain", "count"), population(spark, d), categories
    )
    return report.withColumn("top_categories", F.array_join("top_categories", ","))


@query
def tag_weights(spark, d):
    counts = summary.tag_frequency(catalog(spark, d))
    return stats.tag_weights(counts).withColumn("weight", F.round("weight", 9))


@query
def name_words(spark, d):
    words = summary.tag_frequency(
        table(spark, d, "part").select(F.split("p_name", " ").alias("tags"))
    )
    return stats.tag_weights(words, log=False, max_words=10)


@query
def sampled_columns(spark, d):
    return stats.sample_columns(cells(spark, d), seed=123)


@query
def first_datasets(spark, d):
    return stats.first_by_id(catalog(spark, d).select("dataset_id", "domain"), 200, "dataset_id")


# --- pages and domains --------------------------------------------------------------------------------

HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"


@query
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", page_title(F.col("html")).alias("title"))


@query
def pages_by_title(spark, d):
    titled = table(spark, d, "pages").select("page_id", "url", page_title(F.col("html")).alias("title"))
    return resume.titled(titled, "title", "th").select("page_id", "url")


@query
def distinct_domains(spark, d):
    items = table(spark, d, "pages").selectExpr(f"{HOST} AS domain")
    return resume.new_domains(items)


@query
def unseen_domains(spark, d):
    items = table(spark, d, "pages").selectExpr(f"{HOST} AS domain", "page_id", "url")
    seen = items.where("url LIKE '%ref=%'").select("domain").distinct()
    return resume.new_domains(items, seen)


@query
def lines_by_prefix(spark, d):
    return resume.keep_lines(
        table(spark, d, "pages").select("url"), "url", include="http://", exclude="http://www.", at_start=True
    )


@query
def lines_by_substring(spark, d):
    return resume.keep_lines(table(spark, d, "pages").select("url"), "url", include=".example.", exclude="page=")


@query
def safe_names(spark, d):
    return table(spark, d, "pages").select(
        "page_id", safe_alias(F.col("url")).alias("field"), safe_domain(F.col("url")).alias("domain")
    )


# --- landed payloads ----------------------------------------------------------------------------------


def payloads(spark, d) -> DataFrame:
    """One landed payload per event; its body depends on type and size of the event."""
    return table(spark, d, "events").selectExpr(
        "'e' || event_id AS dataset_id",
        "CASE WHEN value > 200 THEN 500 ELSE 200 END AS status",
        """CASE event_type
             WHEN 'error' THEN '{"error": true, "message": "e' || event_id || '"}'
             WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN '[]' WHEN event_id % 3 = 1 THEN ' [{}, {}]' ELSE props END
             WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'gateway timeout' ELSE '[' || props END
             ELSE '[{}, ' || props || ', {"user": ' || user_id || ', "type": "' || event_type || '", "k": null}]'
           END AS body""",
    )


@query
def payload_routes(spark, d):
    return lake.route_payloads(payloads(spark, d)).select("dataset_id", "route")


def landed_rows(spark, d) -> DataFrame:
    return lake.rows_of(lake.route_payloads(payloads(spark, d)).where("route = 'accepted'"))


@query
def record_schemas(spark, d):
    return lake.record_schemas(landed_rows(spark, d)).select(
        "dataset_id", F.array_join("fields", ",").alias("fields")
    )


@query
def landed_cells(spark, d):
    return lake.cells_of_rows(landed_rows(spark, d)).where("value IS NOT NULL").drop("json_type")


@query
def landed_row_counts(spark, d):
    return profile.row_counts(landed_rows(spark, d))


def portal_documents(spark, d) -> DataFrame:
    """One portal document per event, as JSON text."""
    return table(spark, d, "events").selectExpr(
        "event_type AS domain",
        "'e' || event_id AS dataset_id",
        """'{"category": "' || event_type || '", "viewType": "' || CASE WHEN event_id % 4 = 3 THEN 'map' ELSE 'tabular' END
           || '", "assetType": "' || CASE WHEN event_id % 6 = 1 THEN 'filter' ELSE 'dataset' END
           || '", "rowCount": ' || event_id || ', "viewCount": ' || user_id
           || ', "metadata": {"rowCount": "' || (event_id + 1000000) || '"}'
           || ', "columns": [{"fieldName": "k", "dataTypeName": "number"}, {"fieldName": "type", "dataTypeName": "text"},'
           || ' {"fieldName": ":@region", "dataTypeName": "text"}, {"name": "none"}]}' AS body""",
    )


@query
def profiled_catalog(spark, d):
    landed = lake.route_payloads(payloads(spark, d)).where("route IN ('accepted', 'empty')")
    records = profiled_records(portal_documents(spark, d), landed_rows(spark, d), landed)
    return records.select(
        "domain",
        "dataset_id",
        "format",
        "row_count",
        F.array_join(
            F.transform(
                "columns",
                lambda c: F.concat_ws(
                    "/",
                    c["name"],
                    c["type"],
                    F.coalesce(c["nulls"].cast("string"), F.lit("?")),
                    F.coalesce(c["semantic_nulls"].cast("string"), F.lit("?")),
                ),
            ),
            " ",
        ).alias("columns"),
    )


@query
def portal_records(spark, d):
    """Times as whole and fractional numbers, as ISO text and as text nobody can read; two different row counts."""
    documents = table(spark, d, "events").selectExpr(
        "event_type AS domain",
        "'e' || event_id AS dataset_id",
        """'{"createdAt": ' || CASE event_id % 3 WHEN 0 THEN cast(unix_seconds(cast(ts AS timestamp)) AS string)
                WHEN 1 THEN '"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || 'Z"' ELSE unix_seconds(cast(ts AS timestamp)) || '.5' END
           || ', "rowsUpdatedAt": ' || CASE event_id % 5 WHEN 0 THEN '""' WHEN 1 THEN (unix_seconds(cast(ts AS timestamp)) + 60) || '' WHEN 2 THEN '"soon"'
                WHEN 3 THEN 'null' ELSE '0' END
           || ', "dataUpdatedAt": "' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || '+00:00"'
           || CASE WHEN event_id % 2 = 0 THEN ', "metadata": {"rowCount": "' || event_id * 2 || '"}' ELSE '' END
           || ', "rowCount": ' || event_id || ', "viewType": "tabular", "assetType": "filter", "columns": [{"fieldName": "k"}]}' AS body""",
    )
    raw = lake.portal_metadata(documents)
    crawled = profile.crawl_records(raw).select("dataset_id", F.col("row_count").alias("crawl_rows"))
    reported = profile.report_records(raw, NOW).select(
        "dataset_id", F.unix_seconds("created_at").alias("created_at"), F.unix_seconds("updated_at").alias("updated_at"), "row_count"
    )
    return reported.join(crawled, "dataset_id")


@query
def strict_routes(spark, d):
    """What follows a value, and text that looks like nothing, decide the route as well."""
    bodies = table(spark, d, "events").selectExpr(
        "'e' || event_id AS dataset_id",
        "200 AS status",
        """element_at(array('[{"a": 1}] trailing', '["0"]', '[0, "", false, null, {}, [], 0.0]', '{"error": "false"}', '{"error": 0}',
                            '[1]] x', '[[null]]', '[1]} x', '[1],[2]'), cast(event_id % 9 AS int) + 1) AS body""",
    )
    return lake.route_payloads(bodies).select("dataset_id", "route")


@query
def number_keys(spark, d):
    """One text for a number, whatever type it is stored in; beyond 10 million and 10 to the 15th."""
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "1000000000000000 + o_orderkey * 1000 AS whole", "12345678 + o_orderkey AS part"
    )
    typed = rows.selectExpr(
        "id", "whole AS a", "cast(whole AS double) AS b", "cast(whole AS decimal(30, 4)) AS c",
        "cast(part + 0.5 AS double) AS d", "cast(part + 0.5 AS decimal(20, 3)) AS e", "cast(1 / (part * 100.0) AS double) AS tiny",
    )
    texts = cells_of(typed, "t", "id").where("column_name <> 'id'").groupBy("row_id").pivot("column_name", ["a", "b", "c", "d", "e", "tiny"]).agg(F.first("value"))
    documents = rows.selectExpr("cast(id AS string) AS dataset_id", "0 AS row_id", """'{"f": ' || cast(cast(whole AS double) AS string) || ', "g": ' || (part + 0.5) || '00}' AS row""")
    found = lake.cells_of_rows(documents).groupBy(F.col("dataset_id").cast("bigint").alias("row_id")).pivot("column_name", ["f", "g"]).agg(F.first("value"))
    exponent = F.col("tiny").rlike("[eE]")
    return texts.join(found, "row_id").select("row_id", "a", "b", "c", "d", "e", "f", "g", exponent.alias("exponent"))


def metadata_files(spark, d) -> DataFrame:
    """One metadata file per turn of a conversation; some are broken."""
    return table(spark, d, "conversations").selectExpr(
        "role AS domain",
        "conv_id || '-' || turn AS dataset_id",
        """CASE (conv_id + turn) % 7
             WHEN 0 THEN 'null' WHEN 1 THEN '{}' WHEN 2 THEN '[]' WHEN 3 THEN '{"category": '
             ELSE '{"category": "' || role || '", "format": "tabular", "viewCount": ' || turn || '}' END AS body""",
    )


@query
def metadata_states(spark, d):
    return lake.check_metadata(metadata_files(spark, d)).drop("body")


@query
def metadata_issues(spark, d):
    return lake.metadata_issues(lake.check_metadata(metadata_files(spark, d)))


@query
def metadata_records(spark, d):
    records = lake.crawl_metadata(lake.check_metadata(metadata_files(spark, d)))
    return records.select("domain", "dataset_id", "category", "format", "view_count")


@query
def summary_status(spark, d):
    files = lake.check_metadata(metadata_files(spark, d)).select(
        "domain", (F.col("state") == "valid").alias("valid")
    )
    domains = table(spark, d, "events").select(F.col("event_type").alias("domain")).distinct()
    roles = table(spark, d, "conversations").select(F.col("role").alias("domain")).distinct()
    errors = table(spark, d, "conversations").where("role = 'system'").select(
        F.col("role").alias("domain"), F.concat(F.lit("refused turn "), "turn").alias("error")
    )
    return summary.summary_status(domains.unionByName(roles), files, errors)


# --- incremental runs ---------------------------------------------------------------------------------


def _stream(spark, d, name) -> DataFrame:
    return incremental.table_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema)


@query
def streamed_domains(spark, d):
    store, progress = scratch_path(spark, "domains"), scratch_path(spark, "progress")
    stream = _stream(spark, d, "pages").selectExpr(f"{HOST} AS domain")
    incremental.update_domains(stream, store, progress)
    return spark.read.parquet(store)


@query
def streamed_sketches(spark, d):
    store = scratch_path(spark, "registers")
    # One stream of all tables: a batch hashes a value that several tables have once.
    streams = [typed_cells(_stream(spark, d, name), name) for name in TABLES]
    incremental.update_registers(reduce(DataFrame.unionByName, streams), store, scratch_path(spark, "progress"))
    built = incremental.stored_sketches(spark, store)
    return built.select(
        *sketch.COLUMN_KEY,
        F.concat_ws(
            ",", F.transform("signature", lambda h: F.lower(F.lpad(F.hex(h.bitwiseXOR(F.lit(-(2**63)))), 16, "0")))
        ).alias("signature"),
        "cardinality",
    )


@query
def streamed_embeddings(spark, d):
    store, progress = scratch_path(spark, "embeddings"), scratch_path(spark, "progress")
    stream = _stream(spark, d, "documents").selectExpr(
        "'d' || doc_id AS dataset_id", "'text' AS column_name", "text"
    )
    incremental.update_embeddings(stream, store, progress)
    return incremental.stored_embeddings(spark, store)


# --- stores: written to the shared folder and read back ------------------------------------------------


@query
def stored_pairs(spark, d):
    path = scratch_path(spark, "pairs")
    files.write_pairs(pairs(spark, d), path)
    return files.read_pairs(spark, path)


@query
def stored_labels(spark, d):
    path = scratch_path(spark, "labels")
    rows = table(spark, d, "part").selectExpr("p_brand AS other", "p_name AS name", "'p' || p_partkey AS dataset_id")
    files.write_report(rows, path)
    return files.read_labels(spark, path)


@query
def stored_population(spark, d):
    path = scratch_path(spark, "population")
    rows = population(spark, d).withColumn("state/province", F.concat(F.lit('a, "b" '), "city"))
    files.write_report(rows, path)
    return files.read_population(spark, path).withColumnRenamed("state/province", "state")


@query
def stored_lines(spark, d):
    path = scratch_path(spark, "lines")
    urls = table(spark, d, "pages").selectExpr("explode(array(concat('  ', url, ' '), '   ')) AS value")
    files.write_lines(urls, path)
    return files.read_lines(spark, path)


@query
def stored_matches(spark, d):
    path = scratch_path(spark, "matches")
    # The top matches, as the one JSON array that is exchanged.
    top = similarity.top_matches(matches(spark, d)).agg(F.to_json(F.collect_list(F.struct("col1", "col2", "score"))).alias("value"))
    files.write_lines(top, path)
    return files.read_matches(spark, path).withColumn("score", F.round("score", 9))


@query
def stored_sketches(spark, d):
    path = scratch_path(spark, "stored-sketches")
    files.write_sketches(sketches(spark, d), path)
    return sketch.signature_rows(files.read_sketches(spark, path))


@query
def stored_embeddings(spark, d):
    path = scratch_path(spark, "stored-embeddings")
    rows = table(spark, d, "embeddings").selectExpr(
        "'label' || label AS dataset_id", "'v' || vec_id AS column_name", "cast(embedding AS array<double>) AS embedding"
    )
    for part in (0, 1):
        files.append_embeddings(rows.where(F.substring("column_name", 2, 20).cast("bigint") % 2 == part), path)
    return files.read_embeddings(spark, path).select(
        *sketch.COLUMN_KEY, F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total")
    )


@query
def stored_summary(spark, d):
    path = scratch_path(spark, "summary")
    files.write_summary(summary.catalog_summary(catalog(spark, d), NOW), path)
    return files.read_summary(spark, path)


@query
def stored_counts(spark, d):
    path = scratch_path(spark, "counts")
    files.write_counts(count_run(spark, d), path)
    return files.read_counts(spark, path)


@query
def stored_routes(spark, d):
    path = scratch_path(spark, "routes")
    files.write_routed(lake.route_payloads(payloads(spark, d)), path)
    return spark.read.parquet(path).select("dataset_id", "route")


@query
def schemas_with_fallback(spark, d):
    """Field lists of landed records, else of the portal's documents."""
    found = lake.schemas_or_metadata(lake.record_schemas(landed_rows(spark, d)), lake.portal_metadata(portal_documents(spark, d)))
    return found.select("dataset_id", F.array_join("fields", ",").alias("fields"))
