import json

import pytest
from pyspark.sql import functions as F

from lakeweave import schemas
from lakeweave.functions import metadata, text
from lakeweave.operators import profile
from lakeweave.operators.joinability import PAIR_COLUMNS
from lakeweave.operators.sketch import build_sketches
from lakeweave.plans.catalog import portal_report, profiled_records, stored_records
from lakeweave.plans.joinability import join_graph, landed_sketches
from lakeweave.operators.joinability import joinable_pairs
from lakeweave.session import scratch_path
from lakeweave.sources import files, lake
from lakeweave.sources.tables import cells_from_tables

BODIES = {
    "accepted": [
        '[{"borough": "QUEENS", "n": 1, "loc": {"x": 1}}, {"n": 2.0, "f": 2.5, "borough": " x", "z": true}, {}, null]',
        '[{"b": 1}, [1, 2]]',
        '[{"error": true}]',
    ],
    "empty": ["[]", " [{}, {}]", "[null, {}]"],
    "error": ['{"error": true, "message": "m"}', '{"error": "denied"}'],
    "not_json": ["<html>", '[{"a": 1},', ""],
    "not_array": ['{"a": 1}', "null", '{"error": false}', "5"],
}


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_PAYLOADS)


def test_routes(spark):
    rows = [(f"{route}{i}", 200, body) for route, bodies in BODIES.items() for i, body in enumerate(bodies)]
    rows += [("error9", 500, "[]"), ("not_json9", 200, None)]
    for row in lake.route_payloads(raw(spark, rows)).collect():
        assert row.route == row.dataset_id[:-1], row
    path = scratch_path(spark, "routed")
    files.write_routed(lake.route_payloads(raw(spark, rows)), path)
    assert spark.read.parquet(path).where("route = 'empty'").count() == 3


def test_cells(spark):
    rows = lake.rows_of(raw(spark, [("a", 200, BODIES["accepted"][0])]))
    cells = {(r.row_id, r.column_name): (r.value, r.json_type) for r in lake.cells_of_rows(rows).collect()}
    assert cells == {
        (0, "borough"): ("QUEENS", "STRING"),
        (0, "n"): ("1", "BIGINT"),
        (1, "borough"): (" x", "STRING"),
        (1, "n"): ("2", "DECIMAL"),
        (1, "f"): ("2.5", "DECIMAL"),
        (1, "z"): ("true", "BOOLEAN"),
    }
    nested = lake.cells_of_rows(rows, nested=True).where("column_name = 'loc'").first()
    assert json.loads(nested.value) == {"x": 1}
    assert lake.record_schemas(rows).first().fields == ["borough", "n", "loc"]


def test_boolean_columns(spark):
    body = '[{"yes": true, "some": true, "mix": true}, {"yes": false, "mix": "x"}]'
    rows = lake.rows_of(raw(spark, [("a", 200, body)]))
    dropped = lake.boolean_columns(lake.cells_of_rows(rows), rows)
    assert [r.column_name for r in dropped.collect()] == ["yes"]


def test_fields_from_metadata(spark):
    found = spark.createDataFrame([("a", ["k"])], "dataset_id string, fields array<string>")
    portal = spark.createDataFrame(
        [("a", [("z", "", "")]), ("b", [("p", "", ""), (None, "", ""), ("q", "", "")]), ("c", [])],
        "dataset_id string, columns array<struct<field_name: string, name: string, data_type: string>>",
    )
    rows = {r.dataset_id: r.fields for r in lake.schemas_or_metadata(found, portal).collect()}
    assert rows == {"a": ["k"], "b": ["p", "q"]}


@pytest.fixture
def landed(tmp_path):
    """Two portals: datasets with a shared key, broken and empty ones, and metadata next to them."""
    for domain in ("one.example.org", "two.example.org"):
        (tmp_path / domain).mkdir()
    keys = [f"K{i}" for i in range(60)]
    (tmp_path / "one.example.org" / "data_aaaa-1.json").write_text(
        json.dumps([{"key": k, "flag": True, "note": "" if i % 2 else "n"} for i, k in enumerate(keys)])
    )
    (tmp_path / "two.example.org" / "data_bbbb-2.json").write_text(
        json.dumps([{"ref": f" {k.lower()}"} for k in keys])
    )
    (tmp_path / "two.example.org" / "data_cccc-3.json").write_text("[{")
    (tmp_path / "two.example.org" / "data_dddd-4.json").write_text("[]")
    document = {"category": "c", "format": "tabular", "viewCount": 3, "rowCount": 9, "columns": []}
    (tmp_path / "one.example.org" / "metadata_aaaa-1.json").write_text(json.dumps(document))
    for i, body in enumerate(["null", "{}", "[]", '{"a'])  :
        (tmp_path / "two.example.org" / f"metadata_x{i}.json").write_text(body)
    return str(tmp_path)


def test_landed_lake_to_graph(spark, landed):
    sketches = landed_sketches(spark, landed)
    assert {(r.dataset_id, r.column_name) for r in sketches.collect()} == {
        ("aaaa-1", "key"),
        ("aaaa-1", "note"),
        ("bbbb-2", "ref"),
    }
    pairs = joinable_pairs(sketches)
    row = pairs.first()
    assert (row.left_column, row.right_column, row.js) == ("key", "ref", 1.0) and pairs.count() == 1
    labels = spark.createDataFrame([("aaaa-1", "Keys")], schemas.LABELS)
    reports = join_graph(pairs, labels)
    assert reports["pairs"].first().pair == "Keys (aaaa-1) ↔ bbbb-2"
    assert reports["hubs"].count() == 2 and reports["containment"].count() == 60


def test_metadata_files(spark, landed):
    checked = lake.check_metadata(lake.read_bodies(spark, landed, "metadata_"))
    assert {r.state for r in checked.where("domain = 'two.example.org'").collect()} == {
        "empty",
        "not_object",
        "corrupt",
    }
    issues = lake.metadata_issues(checked).collect()
    assert [(r.domain, r.empty_files, r.corrupt_files, r.files) for r in issues] == [("two.example.org", 2, 1, 4)]
    record = stored_records(spark, landed).first()
    assert (record.domain, record.dataset_id, record.view_count, record.row_count) == ("one.example.org", "aaaa-1", 3, 9)


def portal_bodies(spark, documents):
    rows = [("p", name, json.dumps(d)) for name, d in documents.items()]
    return spark.createDataFrame(rows, "domain string, dataset_id string, body string")


def test_profiled_records(spark):
    columns = [
        {"fieldName": "a-b", "dataTypeName": "text"},
        {"fieldName": "n", "dataTypeName": "number"},
        {"fieldName": ":@region", "dataTypeName": "text"},
        {"fieldName": "place", "dataTypeName": "point"},
        {"name": "no field"},
    ]
    documents = {
        "d": {"viewType": "tabular", "assetType": "dataset", "columns": columns, "viewLastModified": 7},
        "f": {"viewType": "tabular", "assetType": "filter", "rowCount": 5, "columns": columns[:1]},
        "m": {"viewType": "map", "columns": columns},
    }
    body = '[{"a-b": " ", "n": null}, {"a-b": "v", "n": 1}, {"place": {"x": 1}}]'
    rows = lake.rows_of(raw(spark, [("d", 200, body)]))
    found = {r.dataset_id: r for r in profiled_records(portal_bodies(spark, documents), rows).collect()}
    assert found["d"].row_count == 3 and found["d"].updated_at == 7
    assert [tuple(c) for c in found["d"].columns] == [
        ("a-b", "text", 1, 2),
        ("n", "number", 2, 0),
        (":@region", "text", 0, 0),
        ("place", "point", 0, 0),
    ]
    assert found["f"].row_count == 5 and [tuple(c) for c in found["f"].columns] == [("a-b", "text", None, None)]
    assert found["m"].columns is None and found["m"].row_count is None


def test_portal_report(spark):
    documents = {
        "a": {
            "name": "A",
            "tags": ["x", "y"],
            "createdAt": 1_500_000_000,
            "rowsUpdatedAt": 0,
            "dataUpdatedAt": 1_600_000_000,
            "metadata": {"rowCount": "12"},
            "columns": [{"fieldName": "the_geom", "name": "Update Date", "dataTypeName": "number"}],
        },
        "b": {"name": "B", "metadata": {"rowCount": "many"}},
        "c": {"name": "C"},
    }
    counts = spark.createDataFrame([("b", 1500), ("a", 99)], "dataset_id string, row_count bigint")
    report = portal_report(lake.portal_metadata(portal_bodies(spark, documents)), 1_600_086_399.0, counts)
    rows = {r.dataset_id: r for r in report["records"].collect()}
    assert (rows["a"].tags, rows["a"].row_count, rows["a"].row_count_bucket) == ("x,y", 12, "0–1K")
    assert (rows["a"].created_year, rows["a"].updated_days_ago, rows["a"].n_columns) == (2017, 0, 1)
    assert (rows["a"].has_location_column, rows["a"].has_date_column, rows["a"].has_year_column) == (True, True, False)
    assert (rows["b"].row_count_bucket, rows["c"].row_count_bucket) == ("1K–10K", "unknown")
    assert rows["c"].tags == "" and rows["c"].n_columns == 0 and rows["c"].has_date_column is False
    assert report["coverage"].count() == 3 and report["recency"].count() == 6
    path = scratch_path(spark, "report")
    files.write_report(report["records"], path)
    assert spark.read.option("header", True).csv(path).count() == 3


def test_special_columns_without_columns(spark):
    kind = "array<struct<field_name: string, name: string, data_type: string>>"
    frame = spark.createDataFrame([(None,), ([],), ([(None, None, None)],)], f"columns {kind}")
    flags = metadata.special_columns(F.col("columns"))
    for row in frame.select(*[c.alias(n) for n, c in flags.items()]).collect():
        assert not any(row)


def test_page_titles(spark):
    pages = [
        ('<title lang="x"> A\n title </title>', "A\n title"),
        ('<META content="City Data" name="title"><title>no</title>', "City Data"),
        ("<meta name='title' content='It''s'><title>t</title>", "It"),
        ('<meta name="description" content="d"><title>t</title>', "t"),
        ("<p>none</p>", ""),
        ('<meta name="title" content=""><title>t</title>', ""),
    ]
    frame = spark.createDataFrame(pages, "html string, title string")
    for row in frame.select("title", text.page_title(F.col("html")).alias("t")).collect():
        assert row.t == row.title


def test_names(spark):
    frame = spark.createDataFrame([(":@a-b.c", "data.x y/é")], "f string, d string")
    row = frame.select(text.safe_alias(F.col("f")).alias("f"), text.safe_domain(F.col("d")).alias("d")).first()
    assert (row.f, row.d) == ("__a_b.c", "data.x_y__")


def test_round_trips(spark):
    base = scratch_path(spark, "files")
    pairs = spark.createDataFrame([("a,1", 'x"y', "b", "z", 0.1, 1 / 3, 1.0)], schemas.PAIRS)
    files.write_pairs(pairs, f"{base}/pairs")
    assert files.read_pairs(spark, f"{base}/pairs").collect() == pairs.collect()
    spark.createDataFrame([("a", 1)], "left_dataset string, js int").write.option("header", True).csv(f"{base}/bad")
    with pytest.raises(ValueError, match="jc_left_in_right"):
        files.read_pairs(spark, f"{base}/bad")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_pairs(spark, f"{base}/missing")
    lines = spark.createDataFrame([(" a\t",), ("",), ("b",)], "value string")
    files.write_lines(lines, f"{base}/lines")
    assert sorted(r.value for r in files.read_lines(spark, f"{base}/lines").collect()) == ["a", "b"]
    cells = spark.createDataFrame([("a", "x", "v")], "dataset_id string, column_name string, value string")
    sketches = build_sketches(cells)
    files.write_sketches(sketches, f"{base}/sketches")
    assert files.read_sketches(spark, f"{base}/sketches").collect() == sketches.collect()
    vectors = spark.createDataFrame([("a", "x", [0.5, 1.5])], schemas.EMBEDDINGS)
    files.append_embeddings(vectors, f"{base}/vectors")
    files.append_embeddings(vectors, f"{base}/vectors")
    assert files.read_embeddings(spark, f"{base}/vectors").count() == 2
    summary = spark.createDataFrame([("d", "formats", "k", 1), ("d", "tag_counts", "t", 2)], schemas.SUMMARY)
    files.write_summary(summary, f"{base}/summary")
    assert files.read_summary(spark, f"{base}/summary").where("statistic = 'formats'").first()["count"] == 1
    counts = spark.createDataFrame([("d", -1, "Timeout"), ("e", 3, None)], schemas.DOMAIN_COUNTS)
    files.write_counts(counts, f"{base}/counts")
    assert sorted(files.read_counts(spark, f"{base}/counts").collect()) == sorted(counts.collect())


def test_small_tables(spark, tmp_path):
    (tmp_path / "pops.csv").write_text("domain,city,state/province,population\nd,C,S,12\n")
    assert files.read_population(spark, str(tmp_path / "pops.csv")).first().population == 12
    (tmp_path / "labels.csv").write_text("name,other,dataset_id\nRoads,1,a\n")
    assert tuple(files.read_labels(spark, str(tmp_path / "labels.csv")).first()) == ("a", "Roads")
    (tmp_path / "matches.json").write_text('[\n{"col1": "a.x", "col2": "b.y", "score": 0.99}\n]')
    assert files.read_matches(spark, str(tmp_path / "matches.json")).first().score == 0.99
    page = {"results": [{"metadata": {"domain": "d"}, "resource": {"id": "1"}}, {"metadata": {}}]}
    pages = spark.createDataFrame([(json.dumps(page),)], "body string")
    assert [r.domain for r in lake.catalog_domains(pages).collect()] == ["d", None]


def test_cells_of_tables(spark):
    frame = spark.sql(
        "SELECT 1 AS i, 900D AS whole, 1.5D AS part, double('NaN') AS nan, 'x' AS s, true AS b, now() AS t, array(1) AS a"
    )
    cells = {r.column_name: r.value for r in cells_from_tables({"d": frame}).collect()}
    assert cells == {"i": "1", "whole": "900", "part": "1.5", "nan": None, "s": "x"}
    with pytest.raises(ValueError):
        cells_from_tables({"d": spark.sql("SELECT true AS b")})
    assert set(PAIR_COLUMNS) == {c.split()[0] for c in schemas.PAIRS.split(", ")}
    assert profile.logical_type(frame.schema["t"].dataType) == "calendar_date"


ARRAYS = {
    "plain": [{"a": k, "b": f"value {k}"} for k in range(300)],
    "quotes": [{"a": 'he said "}" or "{" \\\\', "b": "\\\\\"}, {"}, {"c": "[}]}"}, {"d": "é\u2028}"}] * 40,
    "nested": [{"a": {"b": [{"c": 1}, {"d": {}}], "e": []}}, {}, {"f": [[{"g": "}"}]]}] * 30,
    "mixed": [1, "}", None, {"a": 1}, [{"b": 2}, 3], 2.5, {"c": "x"}, "tail", []],
    "one": [{"a": "x" * 5000 + "}" * 500}],
    "scalars": [1, 2, "three"],
    "empty": [],
}


def test_split_rows_equal_whole_rows(spark, tmp_path):
    """Files in ranges of a few hundred bytes against the same files read whole."""
    for name, rows in ARRAYS.items():
        (tmp_path / f"data_{name}.json").write_text(json.dumps(rows, indent=None if len(name) % 2 else 1))
    (tmp_path / "data_folder.json").mkdir()
    (tmp_path / "data_folder.json" / "part-0.json").write_text(json.dumps(ARRAYS["nested"]))
    for name, body in {"cut": '[{"a": 1}, {"b": ', "open": '[{"a": "x}]', "object": '{"a": [{"b": 1}]}', "none": "", "more": '[{"a": 1}] x', "deep": '[{"a": 1}}]'}.items():
        (tmp_path / f"data_{name}.json").write_text(body)
    (tmp_path / "metadata_plain.json").write_text("[{}]")
    told = lambda rows: sorted((r.dataset_id, r.row_id, r.row) for r in rows.collect())
    whole = told(lake.read_rows(spark, str(tmp_path), whole_bytes=1 << 20))
    assert {(r[0], r[1]) for r in whole} >= {(n, k) for n, rows in ARRAYS.items() for k in range(len(rows))}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        split = told(lake.read_rows(spark, str(tmp_path), whole_bytes=-1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sound = set(ARRAYS) | {"folder"}
    assert [r for r in split if r[0] in sound] == [r for r in whole if r[0] in sound]
    assert {r[0] for r in split} <= sound
