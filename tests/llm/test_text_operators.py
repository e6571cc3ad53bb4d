"""Operators on texts against brute force: repeats, Jaccard join, decontamination, tokens, packing, codes, attribution, language."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeweave.llm import attribution, dac, decontaminate, jaccard_join, language, packing, suffix_array, tokens, words
from lakeweave.llm.common import materialize
from lakeweave.llm.tokens import WordEncoder, tokenizer_path

LETTERS = "the of and in ment tion re en le on éa ß ü, . da".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts):
    """Documents in three files, with columns whose names clash with those the operators make."""
    rows = [(k, t, 1, "x", "y") for k, t in enumerate(texts)]
    return materialize(spark.createDataFrame(rows, "doc_id long, text string, piece int, row_key string, class string").repartition(3), "test")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    shared = prose(rng, 60)
    texts = base + base[:9] * 2 + [f"{prose(rng, 20)} {shared} {prose(rng, 15)}" for _ in range(12)]
    for k in range(90):  # near copies, more than are paired at once
        own = shared.split() * 2
        own[rng.randrange(len(own))] = f"w{k}"
        texts.append(" ".join(own))
    texts += [None, None, "", "   ", "ab", "ab", "one two", "one two", "x" * 900, "\0" * 300, "é" * 400, prose(rng, 9000)]
    return texts


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(hit)))
        kept = bytes(c for c, h in zip(r, hit, strict=True) if not h)
        out.append((len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 33])
def test_repeats(spark, corpus, length):
    rows = suffix_array.repeats(frame(spark, corpus), length).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[k] for k in range(len(corpus))] == brute_repeats(corpus, length)


def test_repeats_over_piece_borders(monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", 37)
    rng = random.Random(1)
    text = bytes(rng.choices(range(97, 101), k=3000))
    names, whole, owner, at, count = suffix_array.runs_of(suffix_array.pieces_of([text, text], 64), 64)
    assert count.sum() == 2 * (len(text) - 63)
    covered = sorted((int(o), int(a) + i) for o, a, c in zip(owner, at, count, strict=True) for i in range(c))
    assert covered == [(o, p) for o in (0, 1) for p in range(len(text) - 63)]


@given(st.lists(st.binary(min_size=0, max_size=60), max_size=4), st.integers(16, 40))
@settings(max_examples=60, deadline=None)
def test_ranks_tell_strings_apart(texts, length):
    pieces = suffix_array.pieces_of(texts, length)
    if not pieces:
        return
    _, high, start = suffix_array.window_ranks(pieces, length)
    by_string = {}
    for (_, _, raw), s in zip(pieces, start.tolist(), strict=True):
        for i in range(len(raw) - length + 1):
            by_string.setdefault(raw[i : i + length], set()).add(int(high[s + i]))
    assert all(len(v) == 1 for v in by_string.values())
    assert len({v for s in by_string.values() for v in s}) == len(by_string)


def test_repeats_of_an_empty_table_and_of_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.repeats(empty).collect() == []
    rows = suffix_array.repeats(spark.createDataFrame([(None, "a" * 250), (1, "b" * 10), (1, "b" * 10)], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(10, 0), (10, 0), (250, 250)]


def brute_components(texts, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(k) for k in range(len(sets))]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 60)])
def test_jaccard_components(spark, corpus, width, percent):
    rows = jaccard_join.jaccard_components(frame(spark, corpus), width, percent).collect()
    sizes, roots = brute_components(corpus, width, percent)
    assert [r.n_shingles for r in sorted(rows, key=lambda r: r.doc_id)] == sizes
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == roots


def test_jaccard_components_when_the_splits_change_between_jobs(spark, corpus, monkeypatch):
    """As if executors left after the classes were named, and later jobs find the input in other splits."""
    docs = frame(spark, corpus[:20] + corpus[60:])

    def resplit(df, label):
        out = materialize(df, label)
        if label == "classes":
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(jaccard_join, "materialize", resplit)
    try:
        rows = jaccard_join.jaccard_components(docs, 2, 60).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    sizes, roots = brute_components(corpus[:20] + corpus[60:], 2, 60)
    assert [(r.n_shingles, r.component_id) for r in sorted(rows, key=lambda r: r.doc_id)] == list(zip(sizes, roots, strict=True))


def test_jaccard_of_an_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).collect() == []
    rows = jaccard_join.jaccard_components(spark.createDataFrame([(None, "a b c d e"), (5, "A b c d e"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, str(r.component_id)) for r in rows) == [(0, "None"), (2, "5"), (2, "5")]


def test_linked_sets_share_what_the_second_order_asks_for():
    n = np.arange(1, 3000)
    for percent in range(1, 101):
        assert (jaccard_join.shared_least(n, percent) <= jaccard_join.needed_overlap(n, n, percent)).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = {r["class"]: r.root for r in jaccard_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100}


def brute_hits(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = {}
    for name, t in items:
        w = split(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(w) for w in wins}
    out = []
    for t in texts:
        w, hit, names = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= own
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("short", [[], ["the of"], ["the of", "and"]])
@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_BYTES, 400])
def test_contamination(spark, corpus, short, limit):
    rng = random.Random(9)
    items = [(str(k), prose(rng, rng.randint(10, 40))) for k in range(25)]
    items += [("25", corpus[3]), ("26", corpus[3]), ("27", ""), ("28", None), *[(str(30 + k), t) for k, t in enumerate(short)]]
    texts = corpus[:100] + [f"{prose(rng, 5)} {t.upper()} x" for _, t in items[:20]] + [" ".join(items[1][1].split()[2:13]), " ".join(items[2][1].split()[:9]), None]
    bench = spark.createDataFrame([(int(n), t) for n, t in items], "item_id long, text string")
    rows = decontaminate.find_contamination(frame(spark, texts), bench, automaton_bytes=limit).collect()
    got = {r.doc_id: (r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), list(r["items"])) for r in rows}
    assert [got[k] for k in range(len(texts))] == brute_hits(texts, items, 10)


def test_decontaminate_cuts_and_drops(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"clean words before, {item.upper()}. And many more clean words after it, so that it stays in", f"{item} x", "clean", None]
    rows = decontaminate.decontaminate(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {0: "clean words before, . And many more clean words after it, so that it stays in", 2: "clean", 3: None}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, texts), empty).count() == 4


def test_decontaminate_with_several_automata_equals_one(spark):
    words = [f"w{k}" for k in range(24)]
    items = [(1, " ".join(words[:15])), (2, " ".join(words[9:])), *[(3 + k, " ".join(f"p{k}x{i}" for i in range(12))) for k in range(6)]]
    apart = " ".join(f"{items[2 + k][1]} {' '.join(f'c{k}x{i}' for i in range(5))}" for k in range(6))
    texts = [f"{' '.join(f'a{k}' for k in range(30))} {' '.join(words)} {' '.join(f'b{k}' for k in range(30))}", apart, "clean", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    told = lambda found: {r.doc_id: (r.text, r.row_key, r["class"]) for r in found.collect()}
    one = {0: texts[0].replace(f" {' '.join(words)}", ""), 2: "clean", 3: None}
    rows = decontaminate.decontaminate(docs, bench, automaton_bytes=120)
    assert rows.columns == docs.columns
    assert told(rows) == {k: (t, "x", "y") for k, t in one.items()} == told(decontaminate.decontaminate(docs, bench, automaton_bytes=10**6))


odd_text = st.text(alphabet=st.sampled_from("ab é\n .,'<|>sßΣ́ 　\x1c1_-\tñ"), max_size=40)


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_equals_the_tokenizer(name, keeps):
    plain, spans = (WordEncoder(tokenizer_path(name), keeps, o) for o in (False, True))

    @given(st.lists(odd_text, max_size=5))
    @settings(max_examples=150, deadline=None)
    def check(texts):
        texts = [*texts, "a <|endoftext|> b", "it's <|endoftext|>'s ok."]
        for text, ids, (same, first, end) in zip(texts, plain.ids(texts), spans.spans(texts), strict=True):
            want = plain.tokenizer.encode(text, add_special_tokens=False)
            assert ids.tolist() == same.tolist() == want.ids
            assert list(zip(first.tolist(), end.tolist(), strict=True)) == want.offsets

    check()


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_with_every_letter(name, keeps):
    """Each character of the basic plane in front of and behind punctuation, line breaks, digits and marks."""
    own = WordEncoder(tokenizer_path(name), keeps)
    # Of the ideographs and syllables, which are all letters of one kind, one in 37.
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xF900 and (not 0x3400 <= c < 0xD800 or c % 37 == 0)]
    for behind in (",", "\nb,", "7", "\u0301!"):
        texts = [f"x{c}{behind} {behind}{c} a{c}" for c in chars]
        want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = [ids.tolist() for ids in own.ids(texts)]
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_of_slices_and_of_a_full_dictionary(name, keeps, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    own = WordEncoder(tokenizer_path(name), keeps)
    texts = [None, "", "TAKSİ, BELKİ! yarın", "a b. c", " a", "x" * 5000 + " y" * 5000, "", "क़, ड़!"]
    column = pa.chunked_array([pa.array(texts)]).combine_chunks().slice(1, 7)
    for _ in range(2):
        ids, lengths = own.flat_ids(column)
        want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert [own.flat_ids(pa.array([], pa.string()))[k].tolist() for k in (0, 1)] == [[], []]
    assert list(tokens.slices_of(pa.array(["ab", None, "c", "", "defghij", "k"]), 3)) == [(0, 3), (3, 5), (5, 6)]


def test_packing(spark, corpus):
    capacity = 256
    rows = packing.pack_documents(frame(spark, corpus), capacity=capacity).collect()
    encoder = WordEncoder(tokenizer_path("byte_bpe_50k.json"), True)
    pieces = Counter()
    for k, text in enumerate(corpus):
        ids = np.append(encoder.ids([text or ""])[0], np.uint32(0)).astype("<u4")
        for piece, (start, length) in enumerate(packing.piece_bounds(len(ids), capacity)):
            pieces[(k, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= capacity
    assert len(places) <= 1.08 * sum(r.length for r in rows) / capacity + 1


def test_packing_in_several_rounds(spark, corpus):
    pieces = packing.token_pieces(frame(spark, corpus), tokenizer_path("byte_bpe_50k.json"), 512)
    rows = packing.pack_pieces(pieces, 512, group=25).collect()
    assert Counter((r.row_key, r.piece) for r in rows) == Counter((r.row_key, r.piece) for r in pieces.collect())
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 512
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_piece_bounds():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]
    assert packing.piece_bounds(1, 4) == [(0, 1)]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.sampled_from([3, 8, 11, 16]))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip(ids, bits):
    segment = dac.Segment(dac.encode_segment(np.array(ids, dtype=np.uint32), np.array([len(ids)]), [None], bits))
    assert segment.ids().tolist() == ids
    assert [segment.id_at(i) for i in range(0, len(ids), 7)] == ids[::7]
    assert segment.doc_ids == [None]


def test_codes_of_documents(spark, corpus, tmp_path):
    docs = frame(spark, corpus)
    dac.write_codes(docs, f"{tmp_path}/codes", segment_ids=500)
    rows = dac.stored_documents(dac.read_codes(spark, f"{tmp_path}/codes")).collect()
    encoder = WordEncoder(tokenizer_path("word_bpe_49k.json"), False)
    at, want = 0, {}
    for k, text in enumerate(corpus):
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want
    dac.write_codes(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none")
    assert dac.stored_documents(dac.read_codes(spark, f"{tmp_path}/none")).collect() == []


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens(spark, rule):
    texts = ["one\ntwo\n\n  three", "", None, "no break", "\n\n", "é\nß"]
    rows = attribution.section_tokens(frame(spark, texts), rule=rule).collect()
    encoder = WordEncoder(tokenizer_path("byte_bpe_50k.json"), True)
    for k, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
        assert [(text or "")[r.start : r.end] for r in own] == lines
        want = Counter()
        for a, b in encoder.tokenizer.encode(text or "", add_special_tokens=False).offsets:
            held = [sum(1 for i in range(a, max(b, a + 1)) if r.start <= i < r.end) for r in own]
            touched = [i for i, n in enumerate(held) if n]
            if touched:
                want[touched[0] if rule == "first" else touched[-1] if rule == "last" else max(touched, key=lambda i: (held[i], -i))] += 1
        assert [r.n_tokens for r in own] == [want[i] for i in range(len(own))]


def test_section_tokens_of_given_sections(spark):
    docs = spark.createDataFrame([(1, "hello wide world"), (2, "a"), (None, "b")], "doc_id long, text string")
    sections = spark.createDataFrame([(1, 7, 0, 5), (1, 8, 5, 16), (1, 8, 5, 16), (2, None, 0, 1), (3, 1, 0, 4)], "doc_id long, section int, start long, end long")
    rows = attribution.section_tokens(docs, sections=sections).collect()
    assert sorted((r.doc_id, r.section, r.n_tokens) for r in rows) == [(1, 7, 1), (1, 8, 2)]
    with pytest.raises(ValueError, match="rule"):
        attribution.section_tokens(docs, rule="half")


def test_language(spark):
    rng = random.Random(2)
    words_of = {"aa": "the of and ing tion".split(), "bb": "über schön straße nicht".split()}
    rows = [(k, " ".join(rng.choices(words_of[lang], k=rng.randint(4, 90))), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 - !", "aa"), (1003, "the of and the of", None), (None, "nicht über schön", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_languages(docs).collect()}
    assert [got[k][0] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003][0] == "aa" and got[None][0] == "bb"
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = [k for k, _, lang in rows if lang and k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k][0] == rows[k][2] for k in kept) >= 0.95 * len(kept)
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_every_label_is_learnt(spark):
    rows = [(k, f"text {k % 70} " * 9, f"l{k % 70}") for k in range(700)] + [(1000, "a text", "und"), (1001, "a text", "und"), (1003, "a text", "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    sample = language.training_sample(docs, texts_per_language=3, chars_per_text=5)
    assert {x for _, x in sample} == {f"l{k}" for k in range(70)}
    assert max(Counter(x for _, x in sample).values()) == 3 and max(len(t) for t, _ in sample) == 5


def test_tables_of_the_network_equal_its_filters():
    rng = np.random.default_rng(1)
    net = language.ByteNetwork.fresh(["a", "b", "c"], rng)
    x = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    vectors, pooled = net.embedding[x], []
    for w, kernel, bias in zip(language.WIDTHS, net.filters, net.bias, strict=True):
        response = [vectors[:, i : i + w].reshape(5, -1) @ kernel for i in range(language.WINDOW - w + 1)]
        pooled.append(np.max(response, axis=0) + bias)
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.dense_bias
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(net.tables().predict(x), want, atol=1e-4)


def test_gradients_of_the_network():
    rng = np.random.default_rng(4)
    net = language.ByteNetwork.fresh(["a", "b"], rng)
    x, y = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1, 0])
    loss = lambda: -np.log(net.tables().predict(x)[np.arange(6), y]).mean()
    for p, g in zip(net.parameters(), net.step(x, y), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 0.005
        up = loss()
        p[k] = old - 0.005
        down = loss()
        p[k] = old
        assert (up - down) / 0.01 == pytest.approx(g[k], rel=0.2, abs=1e-3)


def test_word_hashes_do_not_depend_on_the_place():
    data = words.joined(["one two", "", "two one  two"])
    first, end = words.find_words(data.low, words.ALNUM)
    h = words.word_hashes(data.low, first, end).tolist()
    assert h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]
