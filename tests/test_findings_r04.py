"""What the review of round 4 found."""

import random
import time
from decimal import Decimal

import numpy as np
import pytest

import corpus_pipeline
from lakeweave.llm import jaccard_join
from lakeweave.llm.common import in_files, placed
from lakeweave.operators.sketch import build_sketches, column_values, distinct_values
from lakeweave.plans import showcase
from lakeweave.session import CLEANUP, materialize, scratch_path
from lakeweave.sources.tables import cells_of, typed_cells
from lakeweave.streaming import incremental


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_shuffles_go_with_the_step_that_needed_them(spark, tmp_path):
    before = shuffle_files(spark)
    made = spark.range(1000).repartition(7, "id")
    step = materialize(made, "test")
    late = time.time() + 20
    while shuffle_files(spark) - before and time.time() < late:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP) == "false"
    assert step.count() == made.count() == 1000


def texts_of(rng, n):
    return [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(n)]


@pytest.fixture
def steps(monkeypatch):
    """The frames that the join and the stage write, by label."""
    seen = []

    def write(df, label):
        seen.append((label, df))
        return materialize(df, label)

    monkeypatch.setattr(jaccard_join, "materialize", write)
    monkeypatch.setattr(corpus_pipeline, "materialize", write)
    return seen


def test_texts_in_files_are_not_written_or_shuffled_by_the_join(spark, tmp_path, steps):
    texts = texts_of(random.Random(1), 20)
    rows = [(k, texts[k % 20]) for k in range(50)] + [(50, texts[3] + " end"), (None, texts[4]), (51, None), (52, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    found = jaccard_join.jaccard_components(spark.read.parquet(f"{tmp_path}/docs"))
    ids = {r.doc_id: r.component_id for r in found.collect()}
    assert ids == {**{k: k % 20 for k in range(50)}, 50: 3, None: 4, 51: 51, 52: 52}
    assert all("text" not in df.columns for _, df in steps)
    sets = dict(steps)["sets"]
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_write_no_text_and_keep_rows_of_any_names(spark, tmp_path, steps):
    texts = texts_of(random.Random(2), 12)
    rows = [(k % 4, texts[k % 12], "own", -1, "f") for k in range(36)] + [(None, texts[0], "own", -1, "f"), (7, "", "own", -1, "f"), (7, "", "own", -1, "f"), (8, None, "own", -1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, place int, file string")
    wanted = sorted([(k % 4, texts[k]) for k in range(12)] + [(7, ""), (7, ""), (8, "None")])
    made = corpus_pipeline.near_duplicates(spark, docs, "")
    assert made.columns == docs.columns
    assert sorted((r.doc_id, str(r.text) if r.text is None else r.text) for r in made.collect()) == wanted
    docs.repartition(5).write.parquet(f"{tmp_path}/docs")
    steps.clear()
    made = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert made.columns == docs.columns
    assert sorted((r.doc_id, str(r.text) if r.text is None else r.text) for r in made.collect()) == wanted
    assert {(r.row_key, r.place, r.file) for r in made.collect()} == {("own", -1, "f")}
    assert all("text" not in df.columns for _, df in steps)


def test_only_rows_of_files_are_known_by_their_place(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert in_files(docs) and in_files(docs.where("doc_id > 3").select("text"))
    assert not in_files(docs.unionByName(docs)) and not in_files(docs.join(docs.select("doc_id"), "doc_id")) and not in_files(docs.limit(3))
    assert not in_files(docs.selectExpr("doc_id", "explode(array(1, 2)) AS text")) and not in_files(docs.where("rand() < 0.5"))
    assert not in_files(spark.range(3)) and not in_files(spark.read.parquet(f"{tmp_path}/docs", f"{tmp_path}/docs"))
    docs.write.json(f"{tmp_path}/json")
    assert not in_files(spark.read.json(f"{tmp_path}/json"))
    assert placed(docs).select("file", "place").distinct().count() == 100


def test_marks_hold_every_name(spark):
    names = spark.range(-3000, 3000).selectExpr("xxhash64(id) AS name")
    marks = jaccard_join.Marks(names)
    own = np.array([r.name for r in names.collect()], dtype=np.int64)
    other = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 100_000)
    assert marks.has(own).all() and marks.has(other).mean() < 0.01
    assert not jaccard_join.Marks(names.limit(0)).has(own).any()


ODD = "`a.{b}` string, `c d` double, e float, f decimal(12,3), g bigint, h int, i boolean, j array<int>"
ODD_ROWS = [
    (" 1.0 ", 1.0, 0.5, Decimal("1.500"), 7, 7, True, [1]),
    ("x", float("nan"), 0.1, Decimal("2.000"), None, -7, False, None),
    (None, None, None, None, None, None, None, None),
    ("", 1e20, float("nan"), Decimal("1.500"), 7, 0, None, []),
    ("1", 0.0, 1e-7, None, 2**60, 7, None, []),
    ("null", -2.5, 3.0, Decimal("-0.001"), 0, 7, None, []),
]


def test_typed_cells_are_the_cells(spark):
    table = spark.createDataFrame(ODD_ROWS * 2, ODD)
    rows = lambda cells: sorted(tuple(r) for r in column_values(cells).collect())
    assert rows(typed_cells(table, "t")) == rows(cells_of(table, "t", plain=False))
    # Numbers are numbers up to the step that makes them distinct.
    plan = distinct_values(typed_cells(table.select("g", "`c d`"), "t"))._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("\n", plan.index("Aggregate")) :]
    assert "Expand" in before and "as string" not in before


def test_a_stream_of_typed_cells(spark):
    base = scratch_path(spark, "stream")
    table = spark.createDataFrame(ODD_ROWS, ODD)
    table.drop("i", "j").coalesce(1).write.parquet(f"{base}/in")
    read = spark.read.parquet(f"{base}/in")
    stream = typed_cells(incremental.table_stream(spark, f"{base}/in", read.schema), "t")
    incremental.update_registers(stream, f"{base}/store", f"{base}/progress")
    assert sorted(incremental.stored_sketches(spark, f"{base}/store").collect()) == sorted(build_sketches(cells_of(table, "t")).collect())


def test_one_stream_takes_all_tables(spark, monkeypatch):
    """So that a value of several tables is hashed once, and small tables do not wait for each other."""
    seen, update = [], incremental.update_registers
    monkeypatch.setattr(incremental, "update_registers", lambda stream, *a: seen.append(stream) or update(stream, *a))
    found = showcase.QUERIES["streamed_sketches"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and seen[0].isStreaming and {"whole", "real"} <= set(seen[0].columns)
    assert {r.dataset_id for r in found.collect()} == set(showcase.TABLES)
