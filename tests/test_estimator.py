import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from lakeweave.functions.estimator import (
    coupled_estimate,
    matches_needed_value,
    outside_overlap,
    signature_jaccard,
)


def test_signature_jaccard(spark):
    rows = [([1, 2, 3, 4], [1, 2, 0, 0], 0.5), ([], [], 0.0), ([1], [1], 1.0)]
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, j double")
    for row in frame.select("j", signature_jaccard(F.col("a"), F.col("b")).alias("e")).collect():
        assert row.e == row.j
    with pytest.raises(Exception, match="same length"):
        spark.createDataFrame([([1], [1, 2])], "a array<bigint>, b array<bigint>").select(
            signature_jaccard(F.col("a"), F.col("b"))
        ).collect()


def test_against_plain(spark):
    cases = [
        (m, a, b) for m in (0, 1, 5, 64, 127, 128) for a in (1, 737, 740, 5000) for b in (1, 740, 99_999)
    ]
    frame = spark.createDataFrame(cases, "m int, a bigint, b bigint")
    estimate = coupled_estimate(F.col("m") / F.lit(128.0), F.col("a"), F.col("b"))
    for r in frame.select("m", "a", "b", *[c.alias(n) for n, c in zip(("js", "l", "r"), estimate)]).collect():
        assert (r.js, r.l, r.r) == pytest.approx(plain.estimate(r.m, 128, r.a, r.b), rel=1e-12, abs=1e-12)
    none = frame.where("m = 0").select(
        outside_overlap(F.lit(0.0), F.col("a"), F.col("b")).alias("o"), F.least("a", "b").alias("s")
    )
    assert all(r.o == r.s for r in none.collect())


@settings(max_examples=300, deadline=None)
@given(
    matches=st.integers(1, 128),
    small=st.integers(1, 10**6),
    ratio=st.floats(1, 10**4),
    js_t=st.floats(0.01, 1),
    jc_t=st.floats(0.01, 1),
)
def test_no_pass_below_the_needed_matches(matches, small, ratio, js_t, jc_t):
    large = max(small, int(small * ratio))
    js, left, right = plain.estimate(matches, 128, small, large)
    if js >= js_t or left >= jc_t or right >= jc_t:
        assert matches >= matches_needed_value(large / small, 128, js_t, jc_t)
