import random

import pytest

import plain
from lakeweave.operators import graph
from lakeweave.operators.joinability import (
    PAIR_COLUMNS,
    _candidates,
    _shared_tokens,
    joinable_datasets,
    joinable_pairs,
    rank_pairs,
    signature_classes,
)
from lakeweave.operators.sketch import build_sketches
from lakeweave.session import materialize

SCHEMA = "dataset_id string, column_name string, signature array<bigint>, cardinality bigint"


def run(spark, sketches, js_t=0.3, jc_t=0.5, num_hashes=128, block=512):
    rows = [(ds, col, sig, size) for (ds, col), (sig, size) in sketches.items()]
    frame = materialize(spark.createDataFrame(rows, SCHEMA), "test")
    pairs = joinable_pairs(frame, js_t, jc_t, num_hashes, block).collect()
    found = {tuple(r[c] for c in PAIR_COLUMNS[:4]): tuple(r[c] for c in PAIR_COLUMNS[4:]) for r in pairs}
    assert len(found) == len(pairs)
    return found


def agree(found, wanted):
    assert set(found) == set(wanted)
    for pair, values in wanted.items():
        assert found[pair] == pytest.approx(values, rel=1e-12)


def random_sketches(seed, columns, num_hashes, pool, sizes):
    """Signatures over few hashes, so that tokens are shared, hot, and columns repeat each other."""
    draw = random.Random(seed)
    sketches = {}
    for i in range(columns):
        key = (f"d{i % 17}", f"c{i}")
        if sketches and draw.random() < 0.3:
            sketches[key] = draw.choice(list(sketches.values()))
            continue
        size = draw.choice(sizes)
        hot = draw.random()
        signature = [
            0 if draw.random() < hot * 0.5 else draw.randrange(1, pool) for _ in range(num_hashes)
        ]
        sketches[key] = (signature, size)
    return sketches


@pytest.mark.parametrize("block", [2, 7, 512])
@pytest.mark.parametrize(
    "js_t, jc_t, sizes",
    [
        (0.3, 0.5, [700, 740, 800, 1500, 6000, 50_000, 10_000_000]),
        (0.6, 0.9, [1, 2, 3, 1000]),
        (1.0, 1.0, [5, 50, 500]),
        (0.05, 0.05, [740, 741, 100_000]),
    ],
)
def test_equals_all_pairs(spark, block, js_t, jc_t, sizes):
    sketches = random_sketches(block * 31 + int(js_t * 100), 120, 32, 6, sizes)
    agree(
        run(spark, sketches, js_t, jc_t, 32, block), plain.joinable(sketches, js_t, jc_t)
    )


def edges_of(spark, sketches, js_t, jc_t, num_hashes, block):
    rows = [(ds, col, sig, size) for (ds, col), (sig, size) in sketches.items()]
    frame = materialize(spark.createDataFrame(rows, SCHEMA), "test")
    counted = joinable_datasets(frame, js_t, jc_t, num_hashes, block)
    paired = graph.dataset_edges(joinable_pairs(frame, js_t, jc_t, num_hashes, block))
    return sorted(counted.collect()), sorted(paired.collect()), counted


def test_counted_edges_equal_those_of_pairs(spark):
    counted, paired, _ = edges_of(spark, random_sketches(3, 100, 32, 6, [700, 740, 1500, 6000]), 0.3, 0.5, 32, 4)
    assert counted and counted == paired


def test_edges_of_many_copies_make_no_column_pairs(spark):
    """A third of all columns are alike, most of them in one dataset: rows that meet are dataset pairs, not column pairs."""
    sketches = {(f"d{i % 6}" if i < 40 else "d0", f"c{i}"): ([1] * 16, 100) for i in range(120)}
    sketches |= {(f"e{i}", "x"): ([1] * 8 + [2 + i] * 8, 100) for i in range(3)}
    counted, paired, frame = edges_of(spark, sketches, 0.3, 0.5, 16, 2)
    assert counted == paired and sum(r.num_joinable_columns for r in counted) > 1_000
    columns = _joined_rows(frame)
    assert columns < 100


def _joined_rows(frame):
    """Rows that come out of the last join of a plan."""
    frame.collect()
    node = frame._jdf.queryExecution().executedPlan()
    found = []

    def walk(n):
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(n.executedPlan())
        if name.endswith("QueryStage") or "QueryStage" in name:
            return walk(n.plan())
        if "Join" in name:
            found.append(n.metrics().apply("numOutputRows").value())
        for k in range(n.children().size()):
            walk(n.children().apply(k))

    walk(node)
    return found[0]


def test_slot_lists_are_held_once_a_token(spark):
    """One token in all columns: its slots stand in one row, and the rows of the tokens have none."""
    rows = [(f"d{i}", "c", [0, 10 + i // 2], 740 + i % 60) for i in range(200)]
    classes, _ = signature_classes(spark.createDataFrame(rows, SCHEMA))
    tokens, split = _shared_tokens(materialize(classes, "test"), 16)
    assert "slots" not in tokens.columns
    assert [(r.position, r.hash, len(r.slots) > 4) for r in split.collect()] == [(0, 0, True)]


def test_copies_are_spread(spark):
    """Most columns are copies of one: one class, expanded in chunks."""
    same = ([1] * 16, 100)
    sketches = {(f"d{i}", f"c{j}"): same for i in range(30) for j in range(3)}
    sketches["e", "x"] = ([1] * 8 + [2] * 8, 100)
    agree(run(spark, sketches, 0.3, 0.5, 16, 4), plain.joinable(sketches))


def test_subset_is_found_by_direction(spark):
    big = [f"v{i}" for i in range(4000)]
    cells = [("a", "all", v) for v in big] + [("b", "half", v) for v in big[::2]]
    frame = spark.createDataFrame(cells, "dataset_id string, column_name string, value string")
    row = joinable_pairs(materialize(build_sketches(frame), "test")).first()
    assert row.jc_left_in_right == pytest.approx(0.5, abs=0.12)
    assert row.jc_right_in_left == pytest.approx(1.0, abs=0.12)
    assert row.js == pytest.approx(0.5, abs=0.12)


def test_estimates_hold_together(spark):
    sketches = random_sketches(5, 80, 32, 4, [700, 900, 4000])
    sizes = {key: value[1] for key, value in sketches.items()}
    for (ld, lc, rd, rc), (js, left, right) in run(spark, sketches, 0.1, 0.1, 32).items():
        assert 0 <= js <= 1 and left <= 1 + 1e-9 and right <= 1 + 1e-9
        assert left * sizes[ld, lc] == pytest.approx(right * sizes[rd, rc])
        assert ld < rd


def test_nothing_joinable(spark):
    sketches = {("a", "x"): ([1] * 8, 10), ("b", "y"): ([2] * 8, 10), ("a", "z"): ([1] * 8, 10)}
    assert run(spark, sketches, num_hashes=8) == {}


def test_thresholds_must_be_positive(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for js_t, jc_t in ((0, 0.5), (0.3, 0), (1.5, 0.5)):
        with pytest.raises(ValueError):
            joinable_pairs(frame, js_t, jc_t)


def test_ranking(spark):
    rows = [
        ("a", "x", "b", "y", 0.5, 0.9, 0.1),
        ("a", "x", "c", "y", 0.5, 0.9, 0.8),
        ("a", "w", "c", "y", 0.5, 0.9, 0.8),
    ]
    frame = spark.createDataFrame(rows, PAIR_COLUMNS)
    assert [(r.left_column, r.right_dataset) for r in rank_pairs(frame).collect()] == [
        ("w", "c"),
        ("x", "c"),
        ("x", "b"),
    ]
    assert rank_pairs(frame, 1).count() == 1


def test_hot_tokens_make_few_candidates(spark):
    """Columns of one size that all share a fifth of their tokens cannot pass and are not even candidates."""
    draw = random.Random(9)
    rows = []
    for i in range(400):
        signature = [0 if draw.random() < 0.15 else draw.getrandbits(60) for _ in range(128)]
        rows.append((f"d{i}", "c", signature, 740 + i % 60))
    classes, _ = signature_classes(spark.createDataFrame(rows, SCHEMA))
    classes = materialize(classes, "test")
    tokens = [materialize(part, "test") for part in _shared_tokens(classes, 64)]
    assert _candidates(*tokens, 128, 0.3, 0.5).count() < 40
    # With low thresholds nearly all of the 79,800 pairs have to be looked at.
    assert _candidates(*tokens, 128, 0.01, 0.01).count() > 70_000


@pytest.mark.parametrize("family", ["sha1", "xxhash64", "md5"])
def test_columns_of_all_hash_families(spark, family):
    draw = random.Random(4)
    cells = [
        (f"t{i % 4}", f"c{i}", str(draw.randrange(50 * (1 + i % 6)))) for i in range(12) for _ in range(400)
    ]
    frame = spark.createDataFrame(cells, "dataset_id string, column_name string, value string")
    built = build_sketches(frame, family=family, cardinality="exact")
    rows = built.collect()
    sketches = {(r.dataset_id, r.column_name): (r.signature, r.cardinality) for r in rows}
    wanted = plain.joinable(sketches)
    assert wanted
    agree(run(spark, sketches), wanted)


def test_an_index_serves_any_thresholds_without_a_shuffle_of_its_tokens(spark):
    import re
    import uuid

    from lakeweave.operators.joinability import indexed_pairs, write_join_index
    from lakeweave.session import scratch_path

    # One value in all columns, so that its tokens are split at blocks of 4; neighbours share most values, every third column is a copy.
    rows = [(f"d{i % 7}", f"c{i}", v) for i in range(40) for v in ["all", *(str(k) for k in range(i - i % 3, i - i % 3 + 12))]]
    sketches = materialize(build_sketches(spark.createDataFrame(rows, "dataset_id string, column_name string, value string")), "sketches")
    name = f"index_{uuid.uuid4().hex}"
    write_join_index(sketches, name, scratch_path(spark, "index"), buckets=3, block=4)
    for thresholds in ((0.3, 0.5), (0.7, 0.9), (1.0, 1.0)):
        wanted = sorted(joinable_pairs(sketches, *thresholds).collect())
        assert wanted and sorted(indexed_pairs(spark, name, *thresholds, block=4).collect()) == wanted
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = indexed_pairs(spark, name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert re.search(r"SortMergeJoin \[position#\d+, hash#\d+L?\]", plan)
    assert not re.search(r"hashpartitioning\(position#\d+, hash#\d+L?, \d+\)", plan)
    # An index of no sketches has no pairs.
    write_join_index(sketches.limit(0), name, scratch_path(spark, "index"), buckets=3)
    assert indexed_pairs(spark, name).count() == 0
