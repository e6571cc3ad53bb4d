import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import similarity as sim
from lakeweave.plans.similarity import alike_columns


def brute(vectors, min_score):
    found = {}
    names = sorted(vectors)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = np.array(vectors[a]), np.array(vectors[b])
            norm = np.linalg.norm(x) * np.linalg.norm(y)
            if norm and x @ y / norm >= min_score:
                found[a, b] = x @ y / norm
    return found


def clustered(seed, count, dims=12, noise=0.35):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dims))
    # A third of all vectors gathers in one cluster.
    home = np.where(draw.random(count) < 0.33, 0, draw.integers(0, 5, count))
    rows = centres[home] + noise * draw.normal(size=(count, dims))
    return {f"d{i % 9}.c{i}": [float(x) for x in row] for i, row in enumerate(rows)}


@pytest.mark.parametrize("block, noise", [(16, 0.15), (40, 0.5), (1024, 0.35)])
@pytest.mark.parametrize("min_score", [0.9, 0.6])
def test_equals_all_pairs(spark, block, noise, min_score):
    vectors = clustered(block, 300, noise=noise)
    vectors["z.zero"] = [0.0] * 12
    vectors["y.copy"] = vectors["d0.c0"]
    frame = spark.createDataFrame(list(vectors.items()), "name string, embedding array<double>")
    pairs = sim.cosine_pairs(frame, min_score, block).collect()
    found = {(r.col1, r.col2): r.score for r in pairs}
    wanted = brute(vectors, min_score)
    assert len(found) == len(pairs) and set(found) == set(wanted)
    assert found == pytest.approx(wanted)


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "name string, embedding array<float>")
    assert sim.cosine_pairs(empty).collect() == []
    zero = spark.createDataFrame([("a", [0.0])], "name string, embedding array<float>")
    assert sim.cosine_pairs(zero).collect() == []
    with pytest.raises(ValueError):
        sim.cosine_pairs(empty, 0)


def cells(spark, rows):
    return spark.createDataFrame(
        rows, "dataset_id string, row_id int, column_name string, value string, json_type string"
    )


def test_samples_and_text(spark):
    rows = [("d", i, "c", str(i), "BIGINT") for i in range(40)]
    rows += [("d", 3, "s", "", "STRING"), ("d", 1, "s", "b", "STRING"), ("d", 2, "s", None, "VOID")]
    rows += [("d", 9, "s", "false", "BOOLEAN"), ("d", 8, "s", "0", "STRING")]
    frame = cells(spark, rows)
    frame = frame.withColumn("value", sim.falsy_to_empty(F.col("value"), F.col("json_type")))
    texts = {r.column_name: r.text for r in sim.column_texts(sim.first_values(frame, 5)).collect()}
    assert texts["c"] == "Column: d.c. Sample values: 1, 2, 3, 4"
    assert texts["s"] == "Column: d.s. Sample values: b, 0"


def test_samples_are_limited_before_the_shuffle(spark):
    frame = cells(spark, [("d", 1, "c", "v", "STRING")])
    plan = sim.first_values(frame, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_alike_columns(spark):
    rows = [("a", i, "city", v, "STRING") for i, v in enumerate(["Queens", "Bronx", "Kings"])]
    rows += [("b", i, "city", v, "STRING") for i, v in enumerate(["Queens", "Bronx", "Kings"])]
    rows += [("c", i, "n", str(i * 37), "BIGINT") for i in range(3)]
    matches = alike_columns(cells(spark, rows), min_score=0.6).collect()
    assert [(r.col1, r.col2) for r in matches] == [("a.city", "b.city")]


def test_top_matches(spark):
    frame = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.95), ("a", "d", 0.95)], sim.MATCH_SCHEMA)
    assert [r.col2 for r in sim.top_matches(frame, 2).collect()] == ["c", "d"]


def test_hashed_terms_by_the_rule(spark):
    """Words, slots and signs written out again, on odd texts; null and wordless texts have the zero vector."""
    texts = [None, "", " ,. ", "Straße A-Z a_z 9", "x " * 500 + "Y", "İ, x\u0301"]
    frame = spark.createDataFrame([("d", str(k), t) for k, t in enumerate(texts)], "dataset_id string, column_name string, text string")
    found = {int(r.column_name): r.embedding for r in sim.embed_columns(frame).collect()}
    for k, text in enumerate(texts):
        wanted = np.zeros(256)
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for word in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower):
            slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 512
            wanted[slot % 256] += 1 if slot < 256 else -1
        norm = np.linalg.norm(wanted)
        assert found[k] == pytest.approx(list(wanted / norm if norm else wanted))
