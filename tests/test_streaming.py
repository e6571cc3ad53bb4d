import pytest

from lakeweave.operators.sketch import build_sketches
from lakeweave.session import scratch_path
from lakeweave.streaming import incremental as inc

CELLS = "dataset_id string, column_name string, value string"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema, files=1):
    return inc.file_stream(spark, folder, schema, files_per_batch=files)


def test_sketches_grow_with_the_lake(spark):
    base = scratch_path(spark, "stream")
    parts = [
        [("a", "x", str(i)) for i in range(60)],
        [("a", "x", str(i)) for i in range(40, 120)] + [("b", "y", " Q ")],
        [("b", "y", "q"), ("c", "z", "1")],
    ]
    for part in parts[:2]:
        arrive(spark, f"{base}/in", part, CELLS)
    inc.update_registers(stream(spark, f"{base}/in", CELLS), f"{base}/store", f"{base}/progress")
    arrive(spark, f"{base}/in", parts[2], CELLS)
    for _ in range(2):  # The second run finds nothing new.
        inc.update_registers(stream(spark, f"{base}/in", CELLS), f"{base}/store", f"{base}/progress")
    whole = spark.createDataFrame([row for part in parts for row in part], CELLS)
    assert sorted(inc.stored_sketches(spark, f"{base}/store").collect()) == sorted(build_sketches(whole).collect())


def test_banks_are_folded_in_levels(spark):
    base = scratch_path(spark, "stream")
    parts = [[("a", "x", str(i)), ("a", f"c{i % 3}", str(i * i))] for i in range(9)]
    for part in parts:
        arrive(spark, f"{base}/in", part, CELLS)
        inc.update_registers(stream(spark, f"{base}/in", CELLS), f"{base}/store", f"{base}/progress", fan=2)
    # Nine batches: one bank of eight and one of one are read, whatever parts are still there.
    names = [path.rsplit("/", 1)[1] for path in inc.register_banks(spark, f"{base}/store")]
    assert names == ["batches=0-7", "batches=8-8"]
    whole = spark.createDataFrame([row for part in parts for row in part], CELLS)
    wanted = sorted(build_sketches(whole).collect())
    assert sorted(inc.stored_sketches(spark, f"{base}/store").collect()) == wanted
    # A second checkpoint over the same files adds banks of its own and changes no sketch.
    inc.update_registers(stream(spark, f"{base}/in", CELLS, files=5), f"{base}/store", f"{base}/progress2", fan=2)
    assert len(inc.register_banks(spark, f"{base}/store")) > 2
    assert sorted(inc.stored_sketches(spark, f"{base}/store").collect()) == wanted


def test_a_batch_run_again_is_counted_once(spark, monkeypatch):
    base = scratch_path(spark, "stream")
    parts = [[("a", "x", str(i))] for i in range(4)]
    for part in parts[:3]:
        arrive(spark, f"{base}/in", part, CELLS)
    inc.update_registers(stream(spark, f"{base}/in", CELLS), f"{base}/store", f"{base}/progress", fan=2)
    arrive(spark, f"{base}/in", parts[3], CELLS)
    fold, calls = inc.merge_registers, []

    def breaks(banks):
        calls.append(1)
        if len(calls) == 2:  # The bank of two batches is written, the one of four is not.
            raise RuntimeError("lost")
        return fold(banks)

    monkeypatch.setattr(inc, "merge_registers", breaks)
    with pytest.raises(Exception, match="lost"):
        inc.update_registers(stream(spark, f"{base}/in", CELLS), f"{base}/store", f"{base}/progress", fan=2)
    monkeypatch.setattr(inc, "merge_registers", fold)
    whole = spark.createDataFrame([row for part in parts for row in part], CELLS)
    assert sorted(inc.stored_sketches(spark, f"{base}/store").collect()) == sorted(build_sketches(whole).collect())
    inc.update_registers(stream(spark, f"{base}/in", CELLS), f"{base}/store", f"{base}/progress", fan=2)
    names = [path.rsplit("/", 1)[1] for path in inc.register_banks(spark, f"{base}/store")]
    assert names == ["batches=0-3"]
    assert sorted(inc.stored_sketches(spark, f"{base}/store").collect()) == sorted(build_sketches(whole).collect())


def test_nothing_stored_is_an_empty_result(spark):
    assert inc.stored_sketches(spark, scratch_path(spark, "stream")).count() == 0


def test_batches_read_nothing_their_checkpoint_wrote(spark, monkeypatch):
    base = scratch_path(spark, "stream")
    schema = "dataset_id string, column_name string, text string"
    seen = []
    other = inc._other_runs
    monkeypatch.setattr(inc, "_other_runs", lambda *a: seen.append(other(*a)) or seen[-1])
    rows = [[("a", "x", "zeta"), ("a", "x", None), ("a", "x", "alpha"), (None, "n", None)], [("a", "x", "aa"), (None, "n", "late"), ("b", "y", "z")]]
    for part in rows:
        arrive(spark, f"{base}/in", part, schema)
        inc.update_embeddings(stream(spark, f"{base}/in", schema), f"{base}/store", f"{base}/progress")
    assert seen == [None, None]
    found = {(r.dataset_id, r.column_name): r.embedding for r in inc.stored_embeddings(spark, f"{base}/store").collect()}
    assert {("a", "x"), ("b", "y")} <= set(found)
    from lakeweave.operators.similarity import embed_columns

    wanted = embed_columns(spark.createDataFrame([("a", "x", "alpha")], schema)).collect()[0].embedding
    assert found["a", "x"] == wanted


def test_embedded_columns_are_skipped(spark):
    base = scratch_path(spark, "stream")
    schema = "dataset_id string, column_name string, text string"
    arrive(spark, f"{base}/in", [("a", "x", "one two"), ("a", "y", "three")], schema)
    inc.update_embeddings(stream(spark, f"{base}/in", schema), f"{base}/store", f"{base}/progress")
    arrive(spark, f"{base}/in", [("a", "x", "other"), ("a", "z", "late"), ("b", "x", "one two")], schema)
    inc.update_embeddings(stream(spark, f"{base}/in", schema), f"{base}/store", f"{base}/progress")
    rows = {(r.dataset_id, r.column_name): r.embedding for r in inc.stored_embeddings(spark, f"{base}/store").collect()}
    assert set(rows) == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")}
    assert rows["a", "x"] == rows["b", "x"]
    # A new checkpoint folder over the same store embeds nothing a second time and loses nothing.
    inc.update_embeddings(stream(spark, f"{base}/in", schema), f"{base}/store", f"{base}/progress2")
    assert inc.stored_embeddings(spark, f"{base}/store").count() == len(rows)


def test_a_dataset_split_over_batches_keeps_all_columns(spark):
    base = scratch_path(spark, "stream")
    schema = "dataset_id string, column_name string, text string"
    for column in "xyz":
        arrive(spark, f"{base}/in", [("a", column, f"text {column}"), ("a", "shared", "b" if column == "x" else "c")], schema)
    inc.update_embeddings(stream(spark, f"{base}/in", schema, files=1), f"{base}/store", f"{base}/progress")
    found = [(r.dataset_id, r.column_name) for r in inc.stored_embeddings(spark, f"{base}/store").collect()]
    assert sorted(found) == [("a", "shared"), ("a", "x"), ("a", "y"), ("a", "z")]


def test_domains_once_over_runs(spark):
    base = scratch_path(spark, "stream")
    for rows in ([("a",), ("b",), ("a",)], [("b",), (None,), ("",), ("c",)]):
        arrive(spark, f"{base}/in", rows, "domain string")
        inc.update_domains(stream(spark, f"{base}/in", "domain string"), f"{base}/store", f"{base}/progress")
    found = [r.domain for r in spark.read.parquet(f"{base}/store").collect()]
    assert sorted(found) == ["a", "b", "c"]


def test_streamed_embeddings_equal_a_batch(spark):
    from lakeweave.operators.similarity import embed_columns
    from lakeweave.plans import showcase

    folder = "/root/testdata/sf0.001"
    texts = showcase.table(spark, folder, "documents").selectExpr(
        "'d' || doc_id AS dataset_id", "'text' AS column_name", "text"
    )
    streamed = showcase.QUERIES["streamed_embeddings"](spark, folder)
    assert sorted(streamed.collect()) == sorted(embed_columns(texts).collect())


def test_alike_columns_equal_brute_force(spark):
    from lakeweave.operators import similarity as sim
    from lakeweave.plans import showcase
    from test_similarity import brute

    folder = "/root/testdata/sf0.001"
    rows = sim.named_vectors(showcase.QUERIES["column_embedding"](spark, folder)).collect()
    wanted = brute({r["name"]: r.embedding for r in rows}, 0.5)
    found = {(r.col1, r.col2): r.score for r in showcase.QUERIES["alike_by_embedding"](spark, folder).collect()}
    # More pairs pass than are shown: the shown ones are right, and none of the others is higher.
    assert len(wanted) > sim.TOP == len(found)
    assert all(abs(score - wanted[pair]) < 1e-8 for pair, score in found.items())
    assert max(score for pair, score in wanted.items() if pair not in found) <= min(found.values()) + 1e-8
