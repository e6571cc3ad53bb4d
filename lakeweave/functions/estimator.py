"""Coupled Jaccard / containment estimate from a match count and two cardinalities.

Overlap, Jaccard similarity and both containments are tied together by the two set sizes. With ``j`` the
share of equal signature positions, the overlap is ``j * (min + max) / (1 + j)``; it cannot exceed the
smaller set, and where the estimate does, the overlap is set to the smaller set and all three follow.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND_TOLERANCE = 1e-12
_SLACK = 1e-6


class Estimate(NamedTuple):
    js: Column
    jc_left: Column
    jc_right: Column


def match_count(left_signature: Column, right_signature: Column) -> Column:
    """Number of equal positions of two signatures of the same length; other lengths are an error."""
    equal = F.zip_with(left_signature, right_signature, lambda a, b: F.when(a == b, 1).otherwise(0))
    matches = F.aggregate(equal, F.lit(0), lambda total, hit: total + hit)
    return F.when(F.size(left_signature) == F.size(right_signature), matches).otherwise(
        F.raise_error(F.lit("signatures must have the same length")).cast("int")
    )


def signature_jaccard(left_signature: Column, right_signature: Column) -> Column:
    size = F.size(left_signature)
    return F.when(
        size > 0, match_count(left_signature, right_signature) / F.nullif(size, F.lit(0))
    ).otherwise(F.lit(0.0))


def outside_overlap(js_hat: Column, left_size: Column, right_size: Column) -> Column:
    """Part of the smaller set that lies outside the overlap."""
    smaller, larger = F.least(left_size, right_size), F.greatest(left_size, right_size)
    return (smaller - js_hat * larger) / (F.lit(1.0) + js_hat)


def coupled_estimate(js_hat: Column, left_size: Column, right_size: Column) -> Estimate:
    left, right = left_size.cast("double"), right_size.cast("double")
    smaller, larger = F.least(left, right), F.greatest(left, right)
    overlap = smaller - outside_overlap(js_hat, left, right)
    too_large = (overlap / left > smaller / left + BOUND_TOLERANCE) | (
        overlap / right > smaller / right + BOUND_TOLERANCE
    )
    bounded = F.when(too_large, smaller).otherwise(overlap)
    return Estimate(
        F.when(too_large, smaller / larger).otherwise(js_hat), bounded / left, bounded / right
    )


def passes(js: Column, jc_left: Column, jc_right: Column, js_threshold: float, jc_threshold: float) -> Column:
    """Joinable: similar enough, or one side sufficiently contained in the other. Bounds inclusive."""
    return (js >= js_threshold) | (jc_left >= jc_threshold) | (jc_right >= jc_threshold)


def _share_needed(ratio, js_threshold, jc_threshold, lowest):
    return lowest(js_threshold, jc_threshold / (1.0 + ratio - jc_threshold))


def matches_needed(ratio: Column, num_hashes: int, js_threshold: float, jc_threshold: float) -> Column:
    """Fewest equal positions with which sets of size ratio ``ratio >= 1`` can pass."""
    share = _share_needed(ratio, F.lit(js_threshold), F.lit(jc_threshold), F.least)
    return F.greatest(F.ceil(share * num_hashes - _SLACK), F.lit(1)).cast("int")


def matches_needed_value(ratio: float, num_hashes: int, js_threshold: float, jc_threshold: float) -> int:
    """`matches_needed` for a plain number."""
    share = _share_needed(ratio, js_threshold, jc_threshold, min)
    return max(1, math.ceil(share * num_hashes - _SLACK))
