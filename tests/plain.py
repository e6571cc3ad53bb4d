"""Plain-Python restatement of the sketch and the estimate, for small columns."""

import hashlib
import math
import random

_generator = random.Random(42)
SEEDS = [_generator.getrandbits(64) for _ in range(128)]


def hash64(seed, value):
    return int.from_bytes(hashlib.sha1(f"{seed}:{value}".encode()).digest()[:8], "big")


def clean(values):
    return {v.strip().lower() for v in values if v is not None and v.strip()}


def signature(values, seeds=SEEDS):
    return [min((hash64(s, v) for v in values), default=2**64 - 1) for s in seeds]


def cardinality(values):
    ranks = {}
    for value in values:
        bits = hash64(0, value)
        rest = bits >> 10
        rank = 54 if rest == 0 else 55 - rest.bit_length()
        ranks[bits & 1023] = max(ranks.get(bits & 1023, 0), rank)
    total = sum(2.0**-r for r in ranks.values()) + (1024 - len(ranks))
    return max(1, math.floor(0.7213 / (1 + 1.079 / 1024) * 1024**2 / total))


def estimate(matches, count, size_l, size_r):
    j = matches / count
    small, large = min(size_l, size_r), max(size_l, size_r)
    common = j * (small + large) / (1 + j)
    if common > small * (1 + 1e-12):
        common, j = small, small / large
    return j, common / size_l, common / size_r


def joinable(sketches, js_t=0.3, jc_t=0.5):
    """``{(ds, col): (signature, size)}`` to ``{pair: (js, jc_l, jc_r)}``."""
    found = {}
    keys = sorted(sketches)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if a[0] == b[0]:
                continue
            (sig_a, size_a), (sig_b, size_b) = sketches[a], sketches[b]
            matches = sum(x == y for x, y in zip(sig_a, sig_b))
            js, left, right = estimate(matches, len(sig_a), size_a, size_b)
            if js >= js_t or left >= jc_t or right >= jc_t:
                found[a + b] = (js, left, right)
    return found
