import pytest

import plain
from lakeweave.functions.hashing import minhash_seeds
from lakeweave.operators.sketch import (
    build_sketches,
    column_values,
    merge_registers,
    registers,
    signature_rows,
    sketches_from_registers,
)

# Raw register estimates of v0 .. v{n-1}.
GOLDEN_SIZES = {0: 737, 1: 738, 5: 740, 50: 760, 200: 839, 500: 998, 1000: 1321, 2000: 2064, 5000: 4739, 20000: 18928}


def cells(spark, columns):
    rows = [(ds, col, v) for (ds, col), values in columns.items() for v in values]
    return spark.createDataFrame(rows, "dataset_id string, column_name string, value string")


def test_seeds():
    seeds = minhash_seeds(128)
    assert seeds[:3] == [2053695854357871005, 13679192365072849617, 4517457392071889495]
    assert seeds[-1] == 6695813289279580209


def test_sizes(spark):
    columns = {("d", f"n{n}"): [f"v{i}" for i in range(n)] for n in GOLDEN_SIZES if n}
    columns["d", "n0"] = [" "]
    built = build_sketches(cells(spark, columns), keep_empty=True).collect()
    assert {r.column_name: r.cardinality for r in built} == {f"n{n}": c for n, c in GOLDEN_SIZES.items()}


def test_matches_plain_python(spark):
    columns = {
        ("a", "x"): ["Queens", " queens\t", "BRONX", None, "", " ", "É é", "ß", "日本"],
        ("a", "y"): [str(i % 40) for i in range(200)],
        ("b", "y"): ["one"],
        ("b", "z"): [" tab\x1c", "a b", "a  b"],
    }
    built = build_sketches(cells(spark, columns)).collect()
    assert len(built) == 4
    for row in built:
        values = plain.clean(columns[row.dataset_id, row.column_name])
        assert [(h ^ -(2**63)) % 2**64 for h in row.signature] == plain.signature(values)
        assert row.cardinality == plain.cardinality(values)
    long_form = signature_rows(build_sketches(cells(spark, columns))).where("column_name = 'x'").collect()
    assert {r.position: int(r.hash, 16) for r in long_form} == dict(
        enumerate(plain.signature(plain.clean(columns["a", "x"])))
    )


def test_blank_columns(spark):
    columns = {("a", "x"): [" "] * 50, ("b", "y"): ["\t"] * 60, ("c", "z"): ["v"]}
    assert {r.dataset_id for r in build_sketches(cells(spark, columns)).collect()} == {"c"}
    kept = {r.dataset_id: r for r in build_sketches(cells(spark, columns), keep_empty=True).collect()}
    assert set(kept) == {"a", "b", "c"}
    assert kept["a"].signature == [2**63 - 1] * 128 and kept["a"].cardinality == 737


def test_support_counts_cells_before_cleaning(spark):
    columns = {
        ("a", "below"): ["v"] * 49 + [None] * 10,
        ("a", "at"): ["v"] * 20 + [" "] * 30,
    }
    built = build_sketches(cells(spark, columns), min_support=50).collect()
    assert [r.column_name for r in built] == ["at"]


@pytest.mark.parametrize("family", ["sha1", "xxhash64"])
def test_sizes_by_counting(spark, family):
    columns = {("a", "x"): [str(i) for i in range(300)], ("b", "y"): ["A", "a ", "b"]}
    for mode in ("exact", "approx"):
        built = build_sketches(cells(spark, columns), family=family, cardinality=mode).collect()
        sizes = {r.column_name: r.cardinality for r in built}
        assert sizes["y"] == 2 and abs(sizes["x"] - 300) <= (0 if mode == "exact" else 30)
    with pytest.raises(ValueError):
        build_sketches(cells(spark, columns), family=family, cardinality="guess")


@pytest.mark.parametrize("family", ["sha1", "xxhash64"])
def test_registers_merge(spark, family):
    first = {("a", "x"): [str(i) for i in range(100)]}
    second = {("a", "x"): [str(i) for i in range(50, 180)], ("b", "y"): ["q"]}
    both = {("a", "x"): first["a", "x"] + second["a", "x"], ("b", "y"): ["q"]}
    banks = registers(column_values(cells(spark, first)), family=family).unionByName(
        registers(column_values(cells(spark, second)), family=family)
    )
    merged = sketches_from_registers(merge_registers(banks)).collect()
    whole = build_sketches(cells(spark, both), family=family).collect()
    assert sorted(merged) == sorted(whole)
