"""Doubling over Spark rounds against all strings of a small corpus."""

import random
from collections import Counter

import pytest

from lakeweave.llm import prefix_doubling
from lakeweave.llm.common import materialize


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    return sorted((k, i) for k, r in enumerate(raw) for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1)


@pytest.mark.parametrize("length", [8, 33, 200])
def test_positions_of_repeats(spark, length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts += [texts[0], None, "", "ab", "x" * 300, "\0" * 20, f"{word()} {shared} {word()}", f"{shared} {word()} {shared}", "y" * length, "y" * length]
    # One file, so that the keys are the places.
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "test")
    found = sorted((r.row_key, r["at"]) for r in prefix_doubling.repeated_positions(docs, length).collect())
    assert found == brute(texts, length)


def test_no_rows_and_short_lengths(spark):
    empty = materialize(spark.createDataFrame([], "doc_id long, text string"), "test")
    assert prefix_doubling.repeated_positions(empty).collect() == []
    with pytest.raises(ValueError):
        prefix_doubling.repeated_positions(empty, 7)
