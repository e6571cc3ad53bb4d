import pytest
from pyspark.sql import functions as F

from lakeweave import schemas
from lakeweave.functions import buckets as B
from lakeweave.functions import times
from lakeweave.operators import profile, summary

NOW = 1_700_000_000.0
MONTH = 30.44 * 86_400


def records(spark, rows):
    return spark.createDataFrame(rows, schemas.CRAWL_RECORDS)


def record(domain, dataset, **values):
    fields = (
        "category format tags download_count view_count created_at publication_date updated_at "
        "row_count columns"
    ).split()
    return (domain, dataset, *[values.get(f) for f in fields])


def column(name, kind, nulls=0, semantic=0):
    return (name, kind, nulls, semantic)


def counts(frame, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in frame.collect()}


@pytest.mark.parametrize(
    "spec, value, label",
    [
        (B.ROWS, 0, "0-1K"),
        (B.ROWS, 999, "0-1K"),
        (B.ROWS, 1000, "1K-10K"),
        (B.ROWS, 10_000_000, "10M+"),
        (B.ROWS, -1, None),
        (B.ROWS, None, None),
        (B.SPARSENESS, 0, "< 1% sparse"),
        (B.SPARSENESS, 1, "1-5% sparse"),
        (B.SPARSENESS, 99.9, "50%+ sparse"),
        (B.SPARSENESS, 100, None),
        (B.RECENCY, 30, "<=30d"),
        (B.RECENCY, 31, "31-180d"),
        (B.RECENCY, -1, None),
        (B.RECENCY, 5000, "2y+"),
    ],
)
def test_bucket_edges(spark, spec, value, label):
    frame = spark.range(1).select(F.lit(value).cast("double").alias("v"))
    assert frame.select(spec.label(F.col("v")).alias("b")).first().b == label


def test_report_buckets(spark):
    frame = spark.createDataFrame([(None,), (-5,), (0,), (999,), (1000,), (10**6,)], "n bigint")
    labels = [r.b for r in frame.select(B.report_row_bucket(F.col("n")).alias("b")).collect()]
    assert labels == ["unknown", "unknown", "0–1K", "0–1K", "1K–10K", "1M+"]


def test_empty_buckets_and_age_gaps(spark):
    rows = [
        record("a", "1", row_count=5, publication_date=int(NOW - 5.5 * MONTH), columns=[]),
        record("a", "2", row_count=None, publication_date=int(NOW - 2.5 * MONTH)),
        record("a", "3", publication_date=int(NOW + 10 * 86_400)),
        record("a", "4", publication_date=int(NOW + 70 * 86_400)),
        record("b", "5", publication_date=None),
    ]
    frame = records(spark, rows)
    ages = counts(summary.age_series(frame, F.col("publication_date"), NOW, ("domain",)), "domain", "months")
    assert ages == {("a", 0): 1, ("a", 1): 0, ("a", 2): 1, ("a", 3): 0, ("a", 4): 0, ("a", 5): 1}
    rows_by = counts(
        summary.bucket_histogram(frame, F.col("row_count"), B.ROWS, ("domain",)), "domain", "bucket"
    )
    assert rows_by["a", "0-1K"] == 1 and rows_by["b", "10M+"] == 0 and len(rows_by) == 12


def test_summary_of_all_statistics(spark):
    rows = [
        record(
            "a",
            "1",
            category="x",
            format="tabular",
            tags=["t", "t", None],
            view_count=100,
            download_count=99,
            updated_at=int(NOW - MONTH),
            row_count=10,
            columns=[column("p", "text", 0, 10), column("q", "text", 0, 10)],
        ),
        record("b", "2", tags=[], columns=None),
        record("b", "3", row_count=0, columns=[column("p", "number")]),
    ]
    frame = records(spark, rows)
    found = counts(summary.catalog_summary(frame, NOW), "domain", "statistic", "key")
    assert found["a", "tag_counts", "t"] == 2
    assert found["a", "column_types", "text"] == 2
    assert found["a", "view_counts", "100-1K"] == 1 and found["a", "view_counts", "0-100"] == 0
    assert found["a", "last_update", "1"] == 1
    # Fully blank: measured, but in no bucket. The domain shows the empty buckets all the same.
    sparse = {k[2]: v for k, v in found.items() if k[1] == "sparseness_counts"}
    assert set(sparse) == set(B.SPARSENESS.labels) and set(sparse.values()) == {0}
    assert {k[0] for k in found if k[1] == "sparseness_counts"} == {"a"}
    assert found["b", "attribute_counts", "0-10"] == 2
    rolled = summary.rollup_domains(summary.catalog_summary(frame, NOW))
    total = counts(rolled.where("is_total"), "statistic", "key")
    assert total["attribute_counts", "0-10"] == 3
    assert counts(summary.lookup(rolled, "formats", "a"), "key") == {("tabular",): 1}
    assert summary.lookup(rolled, "formats", "nowhere").count() == 0
    assert summary.lookup(rolled, "nothing").count() == 0
    ordered = summary.report_order(rolled.where("is_total AND statistic = 'view_counts'")).collect()
    assert [r.key for r in ordered] == list(B.USES.labels)


def test_sparseness_needs_statistics(spark):
    rows = [
        record("a", "1", row_count=10, columns=[("p", "text", None, None)]),
        record("a", "2", row_count=None, columns=[column("p", "text")]),
        record("a", "3", row_count=4, columns=[column("p", "text", 0, 1), column("q", "number", 3, 0)]),
    ]
    frame = records(spark, rows)
    share = summary.sparseness(F.col("columns"), F.col("row_count"))
    assert [r.s for r in frame.orderBy("dataset_id").select(share.alias("s")).collect()] == [None, None, 12.5]


def test_recency(spark):
    frame = spark.createDataFrame([(None,), (-3,), (0,), (30,), (731,)], "updated_days_ago int")
    found = counts(summary.recency_histogram(frame), "bucket")
    assert found[(None,)] == 2 and found["<=30d",] == 2 and found["2y+",] == 1 and found["1-2y",] == 0


def test_run_summary(spark):
    rows = [("a", 5, None), ("b", -1, "Timeout after 60s"), ("c", -1, "refused"), ("d", 0, None)]
    row = summary.run_summary(spark.createDataFrame(rows, schemas.DOMAIN_COUNTS)).first()
    assert row.asDict() == {
        "successful": 2,
        "failed": 2,
        "timeouts": 1,
        "total_datasets": 5,
        "domains": 4,
    }
    none = summary.run_summary(spark.createDataFrame([], schemas.DOMAIN_COUNTS)).first()
    assert none.total_datasets == 0 and none.domains == 0


def test_times(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES (parse_json('1700000000')), (parse_json('"2023-11-14T22:13:20Z"')), (parse_json('0')),
           (parse_json('""')), (parse_json('"soon"')), (parse_json('true')), (parse_json('1e300')), (NULL) AS t(v)"""
    )
    seconds = frame.select(F.unix_seconds(times.from_variant(F.col("v"))).alias("s")).collect()
    assert [r.s for r in seconds] == [1_700_000_000, 1_700_000_000] + [None] * 6
    moment = spark.range(1).select(F.timestamp_seconds(F.lit(int(NOW) - 86_399)).alias("m"))
    assert moment.select(times.days_since(F.col("m"), NOW).alias("d")).first().d == 0
    assert moment.select(times.days_since(F.col("m"), NOW - 86_400).alias("d")).first().d == -1


def test_profile_rules(spark):
    frame = spark.createDataFrame(
        [(" ", 1, "x", "p", "c"), (None, None, None, None, None), ("a", 2, "", "q", "d")],
        "t string, n int, `:@region` string, loc string, url string",
    )
    rows = profile.profile_table(frame, "d", {"loc": "point", "url": "url"}).collect()
    assert {r.column_name: (r.nulls, r.semantic_nulls) for r in rows} == {
        "t": (1, 2),
        "n": (1, 0),
        ":@region": (0, 0),
        "loc": (0, 0),
        "url": (1, 1),
    }
    assert {r.row_count for r in rows} == {3}


def test_row_count_from_data(spark):
    frame = records(spark, [record("a", "1", row_count=7), record("a", "2"), record("a", "3")])
    counted = spark.createDataFrame([("1", 9), ("2", 4)], "dataset_id string, row_count bigint")
    filled = {r.dataset_id: r.row_count for r in profile.fill_row_count(frame, counted).collect()}
    assert filled == {"1": 7, "2": 4, "3": None}
