"""The physical plans that the scale of the library rests on."""

from pyspark.sql import functions as F

from lakeweave.operators import similarity, sketch, stats, summary
from lakeweave.sources.tables import cells_of

D = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_only_kept_columns_are_read(spark):
    text = plan(cells_of(spark.read.parquet(f"{D}/embeddings.parquet"), "embeddings"))
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in text
    assert text.count("FileScan") == 1
    text = plan(cells_of(spark.read.parquet(f"{D}/lineitem.parquet"), "lineitem"))
    assert "l_shipdate" not in text.split("ReadSchema")[1] and "Exchange" not in text


def test_registers_combine_before_the_shuffle(spark):
    cells = cells_of(spark.read.parquet(f"{D}/orders.parquet"), "orders")
    text = plan(sketch.registers(sketch.column_values(cells)))
    assert "partial_min" in text and text.count("HashAggregate") == 4
    assert "SortAggregate" not in text and "BatchEvalPython" not in text


def test_texts_are_shuffled_once(spark):
    table = spark.read.parquet(f"{D}/orders.parquet")
    for plain in (True, False):
        text = plan(sketch.build_sketches(cells_of(table, "orders", plain=plain)))
        shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        # The text is named by its grouping expression where it is cleaned before.
        assert sum("value#" in line or "_groupingexpression" in line for line in shuffles) == 1
        assert "REPARTITION_BY_NUM" not in text


def test_top_keys_are_limited_before_the_shuffle(spark):
    counts = summary.frequency(
        spark.read.parquet(f"{D}/orders.parquet"), F.col("o_orderpriority"), ("o_custkey",)
    )
    assert "WindowGroupLimit" in plan(stats.top_keys(counts, "o_custkey"))


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{D}/orders.parquet")
    frame = summary.frequency(orders.where("o_totalprice > 1000"), F.col("o_orderstatus"))
    text = plan(frame)
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in text


def test_no_cross_joins_in_the_cosine_join(spark):
    vectors = spark.read.parquet(f"{D}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("name"), "embedding"
    )
    text = plan(similarity.cosine_pairs(vectors, 0.3))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_support_and_sketch_scan_the_source_once(spark):
    cells = cells_of(spark.read.parquet(f"{D}/orders.parquet"), "orders")
    text = plan(sketch.build_sketches(cells, min_support=50))
    assert "orders.parquet" not in text and text.count("FileScan") == 2
