"""Sharding, neighbours, chat logs and the pipeline; the queries against their SQL on whole tables."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from lakeweave.llm import chat, language, neighbours, sharding
from lakeweave.llm.common import materialize
from lakeweave.llm.queries import QUERIES, SQL

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, DIRECTORY), connect(DIRECTORY), SQL[name]) is None


def shards_of(spark, rows, **more):
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, shard string, weight string").repartition(3), "test")
    return docs, sharding.kd_shards(docs, **more).collect()


def test_shards_are_level_and_keep_copies_together(spark):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choices("abcdeé", k=rng.randint(0, 400))), "x", "y") for k in range(3000)]
    rows += [(5000 + k, rows[11][1], "x", "y") for k in range(150)] + [(6000, None, "", ""), (6001, "", "", ""), (None, "same id", "", ""), (None, "same id", "", "")]
    _, got = shards_of(spark, rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[raw].add(r.shard)
    assert set(load) == set(range(16)) and max(load.values()) / min(load.values()) < 1.03
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards_with_a_third_in_one_group_and_of_few_rows(spark):
    rows = [(k, "hot" * 30, "", "") for k in range(300)] + [(k, f"cold {k}" * 9, "", "") for k in range(300, 900)]
    _, got = shards_of(spark, rows, shards=4)
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    # The group is heavier than a shard: it has one for itself, and the others are level.
    hot = {r.shard for r in got if r.doc_id < 300}
    assert len(hot) == 1 and load[hot.pop()] == 300 * 91
    rest = sorted(load.values())[:3]
    assert len(load) == 4 and rest[2] / rest[0] < 1.05
    assert len(shards_of(spark, [(1, "a", "", "")])[1]) == 1
    assert shards_of(spark, [])[1] == []


def test_shards_split_the_widest_dimension(spark):
    """A square is halved across, then along: the width that counts is the part of the whole width that is left."""
    rows = [(a * 24 + b, f"{a:02d} {b:02d} text", a, b) for a in range(24) for b in range(24)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, a long, b long"), "test")
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, 4, {"a": F.col("a"), "b": F.col("b") * 1000}).collect()}
    for shard in range(4):
        inside = [(a, b) for k, _, a, b in rows if got[k] == shard]
        for k in range(2):
            values = [p[k] for p in inside]
            assert max(values) - min(values) <= 13


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    vectors = [(centres[k % 20] + rng.normal(size=12) * 0.4).tolist() for k in range(4000)]
    for k in range(700, 1400):
        vectors[k] = vectors[700]
    rows = [(k, v, 1) for k, v in enumerate(vectors)]
    odd = [(9000, None, 1), (9100, [0.0] * 12, 1), (9200, [float("nan")] * 12, 1), (9300, [1.0, None] * 6, 1), (9400, [1.0], 1), (None, vectors[5], 1), (4, vectors[4], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in neighbours.neighbours(table).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x, found, all_ = np.array(vectors), 0, 0
    assert set(got) == set(range(0, 4000, 100))
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(d)), d))[:10]
        own.sort()
        assert [o[0] for o in own] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], rel=1e-12, abs=1e-12) for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        found += len({o[1] for o in own} & set(true.tolist()))
        all_ += 10
    assert found / all_ >= 0.9


def test_neighbours_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 3.0]), (8, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.neighbours(table).orderBy("rank").collect()] == [(0, 1, 7, 1.0), (0, 2, 8, 1.0)]
    assert neighbours.neighbours(table.where("vec_id < 0")).collect() == []


EVENTS = [
    # A message that is streamed, edited, and streamed on.
    (1, "m1", 1, "open", "user", None),
    (1, "m1", 2, "delta", None, "wrong"),
    (1, "m1", 5, "edit", None, "right"),
    (1, "m1", 6, "delta", None, "!"),
    # Regenerated: the first answer goes.
    (1, "m2", 3, "open", "assistant", "first "),
    (1, "m2", 4, "delta", None, "try"),
    (1, "m2", 7, "regenerate", None, None),
    (1, "m2", 8, "delta", None, "second <|im_end|> "),
    (1, "m2", 9, "delta", None, "&lt; [INST]"),
    # Removed, and removed but brought back.
    (1, "m3", 10, "open", "user", "gone"),
    (1, "m3", 11, "remove", None, None),
    (1, "m4", 12, "open", "user", "gone"),
    (1, "m4", 13, "remove", None, None),
    (1, "m4", 14, "edit", None, "back"),
    (1, "m4", 15, "ping", "x", "unknown kinds change nothing"),
    # A kind that is not listed makes no message, names no role and takes no place.
    (1, "m7", 0, "ping", "x", "nothing"),
    (2, "m8", -5, "ping", "x", None),
    (2, "m8", 3, "open", "user", "late"),
    (2, "m9", 1, None, "y", "none"),
    # Without an opening, null texts, a role of two lines, a null conversation.
    (None, "m5", 1, "delta", None, None),
    (2, "m6", None, "open", "assis\ntant", "\n"),
]


def test_events_fold_and_render(spark):
    log = spark.createDataFrame(EVENTS, "conv_id long, message string, seq long, kind string, role string, text string").repartition(4)
    messages = chat.fold_events(log)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in messages.collect()}
    assert got == {
        (1, "m1"): ("user", "right!"),
        (1, "m2"): ("assistant", "second <|im_end|> &lt; [INST]"),
        (1, "m4"): ("user", "back"),
        (None, "m5"): ("", ""),
        (2, "m6"): ("assis\ntant", "\n"),
        (2, "m8"): ("user", "late"),
    }
    assert {r.message: r.first_seq for r in messages.where("conv_id = 2").collect()} == {"m6": None, "m8": 3}
    rows = {r.conv_id: r for r in chat.read_back(chat.render(messages)).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "right!"), ("assistant", "second <|im_end|> &lt; [INST]"), ("user", "back")]
    assert rows[1].formatted.count("<|im_end|>") == 3 and "[INST]" not in rows[1].formatted
    assert rows[1].learned == ["second <|im_end|> &lt; [INST]"]
    assert [tuple(t) for t in rows[2].turns] == [("assis\ntant", "\n"), ("user", "late")] and rows[2].learned == []
    assert chat.fold_events(log.where("conv_id = 99")).collect() == []


def test_turns_with_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, None, None, None), (2, 0, "assistant", None)]
    turns = spark.createDataFrame([(*r, "m") for r in rows], "conv_id long, turn long, role string, text string, message string")
    turns = materialize(turns.repartition(3), "test")
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.render(chat.fold_events(chat.events_of_turns(turns))))).collect()}
    told = "\n\nuser\na\nuser\nb\nassistant\nx\nassistant\nx\n"
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (5, hashlib.sha256(told.encode()).hexdigest(), 2)
    assert got[1].loss_sha256 == hashlib.sha256(b"xx").hexdigest()
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())


@pytest.fixture(scope="module")
def pipeline_docs(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(70), text(12)
    clean = [text(80) for _ in range(12)]
    rows = [(k, t, "en") for k, t in enumerate(clean)]
    rows += [(100, clean[0], "en"), (101, clean[1] + " more", "en")]
    rows += [(200, f"{text(60)} {passage} {text(40)}", "en"), (201, f"{text(50)} {passage} {text(60)}", "en")]
    rows += [(300, f"{text(40)} {item} {text(40)}", "en"), (301, f"{item} end", "en"), (400, None, "en"), (401, "1234 !", "en"), (402, "", None), (None, text(50), None)]
    where = str(tmp_path_factory.mktemp("docs"))
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), "own", 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept int")
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, dict((i, t) for i, t, _ in rows), passage, item


def test_stages_keep_clean_documents_and_catch_the_others(spark, pipeline_docs):
    where, texts, passage, item = pipeline_docs
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, where)
        assert out.columns == columns
        out.write.parquet(f"{where}/stage{k}")
        docs = spark.read.parquet(f"{where}/stage{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(12)) | {None}
    assert set(seen["language_id"]) == clean | {100, 101, 200, 201, 300, 301}
    assert set(seen["near_duplicates"]) == clean | {200, 201, 300, 301}
    left = seen["repeated_passages"]
    assert all(left[k].text == texts[k] for k in [*clean, 300, 301])
    assert all(passage[20:-20] not in left[k].text and left[k].n_chars == len(left[k].text) for k in (200, 201))
    last = seen["benchmark_spans"]
    assert set(last) == clean | {200, 201, 300}
    assert item not in last[300].text and len(last[300].text) == last[300].n_chars == len(texts[300]) - len(item) - 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()
    assert {r.doc_id for r in packed} == set(last)


def test_near_duplicates_when_the_splits_change_between_jobs(spark, tmp_path, monkeypatch):
    """As if executors left and came back: every job finds the input in other splits than the job before."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(20)]
    spark.createDataFrame([(k, texts[k % 20]) for k in range(60)], "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    turn = iter(range(1000))

    def resplit(df, label):
        out = materialize(df, label)
        spark.conf.set("spark.sql.files.minPartitionNum", "1" if next(turn) % 2 else "64")
        return out

    monkeypatch.setattr(corpus_pipeline.jaccard_join, "materialize", resplit)
    try:
        kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        few = sorted((r.doc_id, r.text) for r in kept.collect())
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        many = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert few == many == list(enumerate(texts))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_without_any_label(spark, tmp_path):
    rows = [(1, "clean words of one document", None), (2, "und noch ein anderes", None), (3, "12 - !", None), (4, None, None), (5, "", None)]
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}


def test_language_holds_out_by_the_id(spark):
    rows = [r.doc_id for r in spark.range(200).withColumnRenamed("id", "doc_id").where(language.held_out(F.col("doc_id"))).collect()]
    assert rows == [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
