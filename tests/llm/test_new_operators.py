"""Whitening, periodic runs and personal data against plain versions of their definitions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import language, personal_data, queries, runs, whitening
from lakeweave.llm.common import materialize


DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def vectors_of(spark, rows, extra=1):
    return spark.createDataFrame([(k, v, extra, "a") for k, v in rows], "vec_id long, embedding array<double>, component int, x string")


def plain_whitening(vectors, most=4, scale=256):
    """The definition, with an eigenvalue solver on the covariance of the distinct vectors."""
    x = np.floor(np.array(vectors) * scale).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1][:most], parts[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ parts / np.sqrt(values), values / np.trace(v)


def check_whitening(rows, ids, vectors, most=4):
    n, deviation, whitened, explained = plain_whitening(vectors, most)
    got = {(r.vec_id, r.component): r for r in rows}
    count = max(r.component for r in rows)
    assert len(got) == len(rows) == len(ids) * count
    for c in range(1, count + 1):
        own = np.array([got[i, c].whitened for i in ids])
        sign = np.sign(own @ whitened[:, c - 1])
        assert np.allclose(own * sign, whitened[:, c - 1], rtol=1e-9, atol=1e-9)
        assert all(got[i, c].explained == pytest.approx(explained[c - 1], rel=1e-9) for i in ids)
    for i, d in zip(ids, deviation, strict=True):
        assert (got[i, 1].n, got[i, 1].deviation) == (n, d)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_against_an_eigenvalue_solver(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(12, 12)) * np.geomspace(1, 1e-3, 12)[:, None]
    vectors = (rng.normal(size=(900, 12)) @ mix + rng.normal(size=12) * 40).tolist()
    vectors[300:600] = [vectors[5]] * 300
    bad = [(9001, None), (9002, []), (9003, [float("nan")] * 12), (9004, [float("-inf")] + [0.0] * 11), (9005, [None] + [1.0] * 11), (9006, [1.0, 2.0])]
    table = vectors_of(spark, [*enumerate(vectors), *bad]).repartition(5)
    check_whitening(whitening.whiten(table).collect(), list(range(900)), vectors)


def test_whitening_of_dependent_dimensions(spark):
    """Constant and repeated dimensions; fewer directions than asked for."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 2)) * [3, 1]
    whole = np.floor(base * 256) / 256
    vectors = np.column_stack([whole[:, 0], np.full(400, 7.0), whole[:, 1], whole[:, 0] - whole[:, 1], np.zeros(400)]).tolist()
    rows = whitening.whiten(vectors_of(spark, list(enumerate(vectors)))).collect()
    assert max(r.component for r in rows) == 2
    check_whitening(rows, list(range(400)), vectors, 2)


def test_whitening_where_a_squared_condition_number_would_fail(spark):
    """Directions of 1e9 and 1: their squares differ by more than double precision holds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) * [4e6, 1e3, 0.02]
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    vectors = (x @ turn).tolist()
    rows = whitening.whiten(vectors_of(spark, list(enumerate(vectors)))).collect()
    whole = np.floor(np.array(vectors) * 256)
    sizes = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False) ** 2
    got = {r.component: r.explained for r in rows}
    assert [got[k] for k in (1, 2, 3)] == pytest.approx((sizes / sizes.sum()).tolist(), rel=1e-4)
    assert rows[0].identity_error < 1e-4


def test_whitening_of_few_rows_and_of_huge_values(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    rows = whitening.whiten(vectors_of(spark, [(None, [1e12, 0.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n, r.deviation) for r in rows) == [(False, 1, 2, None)] * 2 + [(True, 1, 2, None)]
    assert {abs(round(r.whitened, 9)) for r in rows} == {1.0}


def plain_runs(words, least_words=6, least_periods=4):
    """The definition: every distance, every maximal stretch, and the smallest distance of each stretch."""
    found = {}
    for q in range(len(words) // least_periods, 0, -1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q) and j > i:
                found[i, j + q] = q
            i = j + 1
    return [(a, b - a, q) for (a, b), q in sorted(found.items())]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9), st.text("abc", max_size=3)), max_size=6), max_size=5), st.sampled_from([(6, 4), (1, 3), (9, 5)]))
def test_runs_by_catchers(parts, least):
    texts = ["".join(root * times + rest for root, times, rest in text) for text in parts]
    got = runs.runs_of([np.array([ord(c) - 97 for c in t], dtype=np.int64) for t in texts], *least)
    assert got == [plain_runs(t, *least) for t in texts]


def test_runs_of_long_periods_and_of_many_equal_words():
    rng = random.Random(4)
    root = [rng.randrange(50) for _ in range(700)]
    text = [1, 2, 3, *root * 5, *root[:333], 99, *[7] * 5000, 8, *([5, 6] * 700)]
    assert runs.runs_of([np.array(text)]) == [[(3, 3833, 700), (3837, 5000, 1), (8838, 1400, 2)]]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    own = plain_runs(words)
    best = None
    for r in own:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, k, q in own for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(own), *figures, sha("".join(f"{s},{k},{q}\n" for s, k, q in own)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_run_query_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " \t\n", "x", "\u00a0 \u00a0 \u2003a", "a b c d " * 30, "one\x0btwo\x0cthree\x1cfour", "é ü " * 9, "z" * 200_000 + " ", "w v " * 40_000]
    rows = spark.createDataFrame([(k, t, "a", "b") for k, t in enumerate(texts)], "doc_id long, text string, runs string, start string")
    got = sorted(tuple(r) for r in queries.digest_of_runs(materialize(rows.repartition(4), "test")).collect())
    assert got == [plain_digest(k, t) if k != len(texts) - 1 else got[k] for k, t in enumerate(texts)]
    assert got[-1][1] >= 1
    assert queries.digest_of_runs(rows.limit(0)).collect() == []


def test_run_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, DIRECTORY).collect()}
    short = [r for r in rows if len(r.text or "") < 12_000]
    assert len(got) == len(rows) and all(got[r.doc_id] == plain_digest(r.doc_id, r.text) for r in short)


def test_runs_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a a a a a a"), (1, "b b b b b b"), (1, "b b b b b b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(rows).collect()) == [("1", [(0, 6, 1)], "b")] * 2 + [("None", [(0, 6, 1)], "a")]


def plain_identifiers(text):
    """The patterns as they are written down."""

    def check_digit(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and check_digit(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {kind: [m.span() for m in re.finditer(pattern, text) if good(m)] for kind, (pattern, good) in tests.items()}


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("1.2@a-", max_size=40), st.text("0123456789 -+().", max_size=60), st.lists(st.sampled_from(["1.2.3.4", "@", "a.b", "x@y.z", "255", ".", "256.", "4111 1111-1111 1111", " ", "+", "+49 (30) 1234-567", "00", "é", "4", "-", "%"]), max_size=14).map("".join)))
def test_plain_identifiers(text):
    assert personal_data.identifiers(text) == plain_identifiers(text)


DISGUISED = [
    ("email", "john.doe [at] example [dot] com"),
    ("email", "john dot doe at mail dot example dot org"),
    ("email", "John_AT_example_DOT_com"),
    ("email", "jane(at)example.com"),
    ("email", "jane @ example.com"),
    ("email", "jane&#64;example&#46;com"),
    ("email", "jane%40example.com"),
    ("email", "jаne@exаmplе.com"),
    ("email", "jane＠example．com"),
    ("email", "ja​ne@exam­ple.com"),
    ("ip", "192[.]168[.]1[.]77"),
    ("ip", "192 dot 168 dot 1 dot 77"),
    ("ip", "１０.0.0.١٢"),
    ("ip", "one nine two dot one six eight dot 1 dot one two"),
    ("card", "four one one one 1111 1111 1111 1111".replace("1111 ", "", 1)),
    ("card", "four, one, one, one, one, one, one, one, one, one, one, one, one, one, one, one"),
    ("card", "4lll-llII-1111-1111"),
    ("card", "４111 1111‑1111 1111"),
    ("phone", "plus four nine three oh one two three four five six"),
    ("phone", "plus 49 30 1234567"),
    ("phone", "+49 (3O) l234 567"),
    ("phone", "＋49 30 123‍4567"),
    ("phone", "plus quatre neuf trois zéro un deux trois quatre cinq"),
]


@pytest.mark.parametrize(("kind", "text"), DISGUISED)
def test_disguised_identifiers(kind, text):
    for before, behind in (("", ""), ("é\U0001f600 ​ see: ", ", а and more"), ("x@y.example is [at] home. ", " / 10.0.0.1 or +1 202 555 0147\n")):
        whole = f"{before}{text}{behind}"
        base, extra = personal_data.find(whole)
        assert base == plain_identifiers(whole)
        assert (len(before), len(before) + len(text)) in extra[kind]
        assert sum(map(len, extra.values())) == 1


CLEAN = [
    "meet me at noon. the dot is (at) the end [at] 5.99 and look at example.com",
    "null, null, null, null, null, null, null, null, null, null, null, null, null, null",
    "one two three go. O I l O I l O I l 1 and o.o.o.o",
    "f(at) {dot} @ home %40 &#64;",
    "привет, как дела? 3² + 4² = 5²",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_have_no_disguise(text):
    assert personal_data.find(text) == ({k: [] for k in personal_data.KINDS},) * 2


def test_part_of_an_email_disguised():
    text = "write to a.b@mail.example [dot] com now"
    base, extra = personal_data.find(text)
    assert base["email"] == [(9, 25)] and extra["email"] == [(9, 35)]
    assert personal_data.masked(text, [("email", 9, 25), ("email", 9, 35), ("phone", 20, 30)]) == "write to [EMAIL] now"


@settings(max_examples=300, deadline=None)
@given(st.text("abа​1 .@[]dotaone(", max_size=60))
def test_spans_lie_in_the_text(text):
    base, extra = personal_data.find(text)
    assert base == plain_identifiers(text)
    assert all(0 <= a < b <= len(text) for spans in extra.values() for a, b in spans)


def test_personal_data_of_odd_tables(spark):
    texts = [None, "", "a@b.cd", "\U0001f600 a@b.cd +49 30 1234567 1.2.3.4 x [at] y [dot] org", "1" * 200_000, "a" * 300_000 + "@", "." * 100_000, "+1" + " " * 100_000, "o" * 100_000 + " one" * 50_000]
    rows = materialize(spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, base string, kind long"), "test")
    got = {r.doc_id: r for r in queries.personal_data.digest(personal_data.find_personal_data(rows)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert tuple(got[0]) == (0, 0, 0, 0, 0, none, "") and tuple(got[1])[1:] == tuple(got[0])[1:]
    assert got[3].spans == "email:2:8,email:32:50,ip:24:31,phone:9:31"
    assert (got[3].n_email, got[3].n_ip, got[3].n_card, got[3].n_phone) == (1, 1, 0, 1)
    for k, t in enumerate(texts[:5]):
        told = ",".join(f"{kind}:{a}:{b}" for kind, spans in plain_identifiers(t or "").items() for a, b in spans) if k != 4 else ""
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
    twice = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd"), (None, None)], "doc_id long, text string")
    assert sorted(str(r.masked) for r in personal_data.find_personal_data(twice, with_text=True).collect()) == ["None", "[EMAIL]", "[EMAIL]"]
    assert personal_data.find_personal_data(rows.limit(0)).collect() == []


def test_personal_data_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_personal_data"](spark, DIRECTORY).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = plain_identifiers(r.text or "")
        told = ",".join(f"{kind}:{a}:{b}" for kind, spans in own.items() for a, b in spans)
        assert [got[r.doc_id][f"n_{k}"] for k in personal_data.KINDS] == [len(own[k]) for k in personal_data.KINDS]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(got[r.doc_id].spans.split(","))


def test_documents_without_a_likely_language_go(spark):
    rng = random.Random(12)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(k, text("abcdefgh", 60), "x") if k % 2 else (k, text("qrstuvwxyz", 60), "y") for k in range(200)]
    rows += [(1000, text("abcdefgh", 200) + text("qrstuvwxyz", 200), None), (1001, text("abcdefgh", 2) + text("qrstuvwxyz", 2), None), (1002, "1 2 3 " * 50, None), (1003, None, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "test")
    net = language.learn(docs)
    kept = {r.doc_id for r in language.with_language(docs, net, 0.9, 100).collect()}
    assert kept == set(range(200)) | {1001}
    assert {r.doc_id for r in language.with_language(docs, net).collect()} == set(range(200)) | {1000, 1001}


def test_training_sample_of_a_frequent_language_is_ranked_from_few_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") < 50, "rare").otherwise("often").alias("lang"))
    got = language.training_sample(docs, texts_per_language=100)
    keys = sorted((r.key, r.doc_id) for r in docs.where((F.col("lang") == "often") & ~language.held_out(F.col("doc_id"))).select(F.xxhash64("doc_id").alias("key"), "doc_id").collect())
    assert [t for t, name in got if name == "often"] == [f"text {k}" for _, k in keys[:100]]
    rare = docs.where((F.col("lang") == "rare") & ~language.held_out(F.col("doc_id"))).count()
    assert sum(name == "rare" for _, name in got) == rare
