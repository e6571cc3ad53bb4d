import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave import schemas
from lakeweave.operators import graph, resume, stats
from lakeweave.operators.joinability import PAIR_COLUMNS


def test_serial_numbers_over_partitions(spark):
    values = list(range(5000))
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(v // 50, v) for v in values], "a int, b int").repartition(13)
    rows = stats.with_serial_number(frame, "a", "b").collect()
    assert sorted((r.serial, r.b) for r in rows) == [(v + 1, v) for v in range(5000)]


def test_histogram_equals_numpy(spark):
    draw = np.random.default_rng(3)
    values = np.round(draw.normal(size=2000), 1)
    frame = spark.createDataFrame([(float(v), 4.0) for v in values], "v double, flat double")
    rows = stats.equal_width_histogram(frame, ["v", "flat"], 40).collect()
    for name, data in (("v", values), ("flat", np.full(2000, 4.0))):
        count, edges = np.histogram(data, bins=40)
        mine = sorted((r.bin, r["count"], r.low, r.high) for r in rows if r.series == name)
        assert [m[1] for m in mine] == count.tolist()
        assert [m[2] for m in mine] == pytest.approx(edges[:-1]) and mine[-1][3] == edges[-1]


def test_trend_equals_least_squares(spark):
    rows = [(10**i, 3 * i + 2) for i in range(2, 9)] + [(500, -1), (600, 0)]
    frame = spark.createDataFrame(rows, "population bigint, count bigint")
    line = stats.trend_line(frame).first()
    usable = [r for r in rows if r[1] > 0]
    slope, intercept = np.polyfit(*(np.log10([r[i] for r in usable]) for i in (0, 1)), 1)
    assert (line.slope, line.intercept) == pytest.approx((slope, intercept))
    curve = stats.trend_curve(stats.trend_line(frame)).orderBy("point").collect()
    assert [r.x for r in curve] == pytest.approx(np.linspace(100, 10**8, 200))


def test_extremes_once(spark):
    frame = spark.createDataFrame([(f"d{i}", i, i) for i in range(4)], "domain string, population bigint, count bigint")
    assert sorted(r.domain for r in stats.extremes(frame, "domain").collect()) == ["d0", "d1", "d2", "d3"]


def test_tag_parts_are_substrings(spark):
    frame = spark.createDataFrame([("logistics", 9), ("GIS", 5), ("parks", 1), ("kmz", 3)], "key string, count bigint")
    rows = stats.tag_weights(frame).collect()
    assert [(r.key, r.weight) for r in rows] == [("parks", pytest.approx(np.log(2)))]


def test_shares(spark):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 0)], "g string, key string, count bigint")
    rows = {(r.g, r.key): r.share for r in stats.shares(frame, 1, ("g",)).collect()}
    assert rows == {("a", "x"): 33.3, ("a", "y"): 66.7, ("b", "x"): None}
    text = spark.createDataFrame([("a Tree",), ("|ree",), ("x",), (None,)], "t string")
    found = {r.matches: r.share for r in stats.match_share(text, F.col("t"), "[T|t]ree").collect()}
    assert found == {True: 0.67, False: 0.33}


def test_sample_is_repeatable(spark):
    rows = [(f"d{i}", f"c{j}") for i in range(9) for j in range(9)]
    frame = spark.createDataFrame(rows, "dataset_id string, column_name string")
    first = sorted(stats.sample_columns(frame, 123).collect())
    assert first == sorted(stats.sample_columns(frame.repartition(5), 123).collect())
    assert len({r.dataset_id for r in first}) == 3 and len(first) == 15
    assert stats.sample_columns(frame, 1, None, None).count() == 81


def test_city_without_categories(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 2), ("x", 9)], "domain string, count bigint")
    people = spark.createDataFrame([("a", "A", 10), ("b", "B", 20)], "domain string, city string, population bigint")
    categories = spark.createDataFrame(
        [("a", k, n) for k, n in (("p", 1), ("q", 3), ("r", 3), ("s", 2))], "domain string, key string, count bigint"
    )
    rows = stats.city_report(counts, people, categories).collect()
    assert [(r.serial, r.city, r.top_categories) for r in rows] == [(1, "B", None), (2, "A", ["q", "r", "s"])]


def pairs(spark, rows):
    return spark.createDataFrame([r + (0.5, 0.6, 0.7) for r in rows], PAIR_COLUMNS)


def test_graph(spark):
    frame = pairs(spark, [("a", "x", "b", "y"), ("b", "z", "a", "x"), ("a", "x", "a", "y"), ("a", "x", "c", "y")])
    edges = {(r.src, r.dst): r.num_joinable_columns for r in graph.dataset_edges(frame).collect()}
    assert edges == {("a", "b"): 2, ("a", "c"): 1}
    nodes = {r.dataset: (r.num_partners, r.total_joinable_columns) for r in graph.dataset_nodes(graph.dataset_edges(frame)).collect()}
    assert nodes == {"a": (2, 3), "b": (1, 2), "c": (1, 1)}
    labels = spark.createDataFrame([("a", " Roads "), ("b", " "), ("c", "c"), (None, "x"), (" ", "y")], schemas.LABELS)
    named = {r.dataset_id: r.label for r in graph.label_table(labels).collect()}
    assert named == {"a": "Roads (a)", "b": "b", "c": "c"}
    best = graph.top_pairs(frame.where("left_dataset <> right_dataset"), graph.label_table(labels)).collect()
    assert best[0].pair == "Roads (a) ↔ b"


def test_endpoints(spark):
    frame = spark.createDataFrame([("a.x.y", "a.z", 0.9993), ("a.x", "b.y", 0.9992)], schemas.MATCHES)
    assert {r.dataset: r["count"] for r in graph.endpoint_frequency(frame).collect()} == {"a": 3, "b": 1}
    assert [(r.dataset1, r.dataset2) for r in graph.strong_edges(frame).collect()] == [("a", "a")]


def test_merge_counts(spark):
    old = spark.createDataFrame([("a", 3, None), ("b", -1, "Timeout"), ("c", -1, "x")], schemas.DOMAIN_COUNTS)
    new = spark.createDataFrame([("a", 9, None), ("b", 4, None), ("d", -1, "y")], schemas.DOMAIN_COUNTS)
    rows = {r.domain: (r["count"], r.error) for r in resume.merge_counts(old, new).collect()}
    assert rows == {"a": (3, None), "b": (4, None), "c": (-1, "x"), "d": (-1, "y")}


def test_lines(spark):
    frame = spark.createDataFrame([("data.a",), ("www.data.b",), ("data.county",)], "value string")
    assert [r.value for r in resume.keep_lines(frame, include="data.", at_start=True).collect()] == ["data.a", "data.county"]
    assert [r.value for r in resume.keep_lines(frame, exclude="county").collect()] == ["data.a", "www.data.b"]


def test_domains(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "domain string")
    seen = spark.createDataFrame([("b",)], "domain string")
    assert [r.domain for r in resume.new_domains(frame, seen).collect()] == ["a"]
