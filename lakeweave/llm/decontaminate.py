"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton is built over the words of all items. A document's words run through it, and the longest match that ends at each word is
known at any time. A match of ``window`` words or more covers a window of some item; an item shorter than that counts as a whole.

Only stretches of a document in which every pair of neighbouring words may also stand in an item can hold a match. A table of hashed
pairs finds these stretches; the automaton, which compares the words themselves, reads them and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed, materialize
from lakeweave.llm.tokens import slices
from lakeweave.llm.words import ALNUM, find_words, joined, pair_hash, word_hashes

#: Bytes of item text in one automaton. More items are spread over several automata, each sent to all tasks in turn.
AUTOMATON_BYTES = 8_000_000

HITS = "row_key long, doc_id long, n_words long, longest long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_HITS = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


@dataclass
class SuffixAutomaton:
    """States of all substrings of all items, over words."""

    window: int
    follow: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _state(self, follow: dict, link: int, length: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _copy_for(self, p: int, w: bytes, q: int) -> int:
        """The state of the strings ``p`` + ``w``: ``q`` itself, or a copy of it with the longer strings left out."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.follow[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.follow[p].get(w) == q:
            self.follow[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.follow[last]:
            return self._copy_for(last, w, self.follow[last][w])
        own, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.follow[p]:
            self.follow[p][w] = own
            p = self.link[p]
        if p >= 0:
            self.link[own] = self._copy_for(p, w, self.follow[p][w])
        return own

    def finish(self, items: list[tuple[str, list[bytes]]]) -> SuffixAutomaton:
        """For each state, where its ``window``-word suffix is; which items have it; which short items end there."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.window_state = [0] * len(order)
        for v in order:
            if self.length[v] >= self.window:
                up = self.link[v]
                self.window_state[v] = v if self.length[up] < self.window else self.window_state[up]
        self.window_items: dict[int, set[str]] = {}
        self.whole: dict[int, tuple[int, set[str]]] = {}
        for item, words in items:
            v = 0
            for k, w in enumerate(words):
                v = self.follow[v][w]
                if k + 1 >= self.window:
                    self.window_items.setdefault(self.window_state[v], set()).add(item)
            if 0 < len(words) < self.window:
                self.whole.setdefault(v, (len(words), set()))[1].add(item)
        # The nearest state on the way to the root that is a short item.
        self.short = [-1] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.short[v] = up if up in self.whole else self.short[up]
        return self

    def matches(self, words: list[bytes]):
        """For each match that counts: its first and last word and the items. For each word also the longest match, at the end."""
        v = length = longest = 0
        found: list[tuple[int, int, set[str]]] = []
        for i, w in enumerate(words):
            while v and w not in self.follow[v]:
                v = self.link[v]
                length = self.length[v]
            if w in self.follow[v]:
                v = self.follow[v][w]
                length += 1
            longest = max(longest, length)
            if length >= self.window:
                found.append((i - self.window + 1, i, self.window_items[self.window_state[v]]))
            if self.whole and v:
                u = v if v in self.whole else self.short[v]
                while u >= 0:
                    n, items = self.whole[u]
                    if n <= length:
                        found.append((i - n + 1, i, items))
                    u = self.short[u]
        return found, longest


def item_words(text: str | None) -> list[bytes]:
    """Words of one text, lower-cased: runs of digits, a-z and characters beyond ASCII."""
    data = joined([text or ""])
    first, end = find_words(data.low, ALNUM)
    raw = data.low.tobytes()
    return [raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]


@dataclass
class Detector:
    """An automaton with the table of the hashed pairs (or words, if an item is a single word) that occur in it."""

    automaton: SuffixAutomaton
    gram: int
    least: int
    table: np.ndarray

    @staticmethod
    def of(items: list[tuple[str, str | None]], window: int) -> Detector:
        known = [(name, item_words(text)) for name, text in items]
        known = [(name, words) for name, words in known if words]
        automaton = SuffixAutomaton(window)
        for _, words in known:
            automaton.add(words)
        shortest = min((min(len(w), window) for _, w in known), default=window)
        gram = min(2, shortest)
        hashes = [np.zeros(0, np.uint64)]
        for _, words in known:
            low = joined([b" ".join(words).decode("utf-8", "surrogatepass")]).low
            h = word_hashes(low, *find_words(low, ALNUM))
            hashes.append(h if gram == 1 else pair_hash(h[:-1], h[1:]))
        hashes = np.unique(np.concatenate(hashes))
        bits = max(16, int(len(hashes) * 64).bit_length())
        table = np.zeros(1 << bits, dtype=bool)
        table[hashes >> np.uint64(64 - bits)] = True
        return Detector(automaton.finish(known), gram, shortest - gram + 1, table)

    def scan(self, texts: list[str]):
        """For each text: words, longest match, spans of hit words with their bytes, item names."""
        data = joined(texts)
        first, end = find_words(data.low, ALNUM)
        hashes = word_hashes(data.low, first, end)
        owner = np.searchsorted(data.start, first, side="right") - 1
        counts = np.bincount(owner, minlength=len(texts))
        bits = np.uint64(64 - (len(self.table).bit_length() - 1))
        if self.gram == 1:
            may = self.table[hashes >> bits]
            alike = np.ones(max(0, len(first) - 1), dtype=bool)
        else:
            may = self.table[pair_hash(hashes[:-1], hashes[1:]) >> bits]
            alike = np.ones(max(0, len(may) - 1), dtype=bool)
            may &= owner[1:] == owner[:-1]
        if self.gram == 1 and len(first):
            alike = owner[1:] == owner[:-1]
        hits: dict[int, list] = {}
        if len(may):
            # Stretches: neighbouring grams that may occur, in one text.
            opens = may & ~np.concatenate([[False], may[:-1] & alike])
            closes = may & ~np.concatenate([may[1:] & alike, [False]])
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            keep = b - a + 1 >= self.least
            raw = data.low.tobytes()
            base = np.concatenate([[0], np.cumsum(counts)])
            for s, e in zip(a[keep].tolist(), (b[keep] + self.gram).tolist(), strict=True):
                words = [raw[x:y] for x, y in zip(first[s:e].tolist(), end[s:e].tolist(), strict=True)]
                found, longest = self.automaton.matches(words)
                k = int(owner[s])
                hits.setdefault(k, []).append((longest, [(s + f - int(base[k]), s + t - int(base[k]), names) for f, t, names in found]))
        for k in range(len(texts)):
            longest, spans, names = 0, [], set()
            for n, found in hits.get(k, ()):
                longest = max(longest, n)
                for f, t, items in sorted(found, key=lambda x: x[:2]):
                    names |= items
                    if spans and f <= spans[-1][1] + 1:
                        spans[-1][1] = max(spans[-1][1], t)
                    else:
                        spans.append([f, t])
            at, own = int(data.start[k]), int(counts[:k].sum()) if spans else 0
            yield int(counts[k]), longest, [{"first": f, "last": t, "start": int(first[own + f]) - at, "end": int(end[own + t]) - at} for f, t in spans], sorted(names)


def _detect(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Detector.of(items, window))

    def scan(batches):
        own = sent.value
        for batch in batches:
            keys, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices(texts, 1_000_000):
                rows = [(keys[k], ids[k], *found) for k, found in zip(range(a, b), own.scan([t or "" for t in texts[a:b]]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return docs.mapInArrow(scan, HITS)


def _merge(parts: DataFrame) -> DataFrame:
    """One row per document from its rows of several automata: spans united, names put together."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    nothing = F.array().cast("array<struct<first:int,last:int,start:int,end:int>>")

    def unite(held, s):
        last = F.element_at(held, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = (F.size(held) > 0) & (s["first"] <= F.coalesce(last["last"], F.lit(-2)) + 1)
        return F.when(touches, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(held, F.array(s)))

    return (
        parts.groupBy("row_key")
        .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), spans.alias("all_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("row_key", "doc_id", "n_words", "longest", F.aggregate("all_spans", nothing, unite).alias("spans"), "items")
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: ``row_key, doc_id, n_words, longest, spans, items``.

    ``longest`` is the longest match in words within stretches that can hold a hit. ``spans`` are the maximal runs of hit words, with first and last word and the bytes
    from ``start`` to ``end``. ``items`` are the ids, as text, of the items with a window in the document, sorted. A null text has no words; a null item id
    is the empty string; equal item ids are one item. Items beyond ``automaton_bytes`` are dealt to several automata, each bounded by that size plus its
    largest item, and the documents are read once for each.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + total // automaton_bytes
    own = keyed(documents_of(docs, id_col, text_col)).select("row_key", "doc_id", "text")
    if parts == 1:
        return _detect(own, _part(items, 0, 1), window)
    return _merge(_detect_all(own, items, parts, window))


def _part(items: DataFrame, part: int, parts: int) -> list[tuple[str, str | None]]:
    """The items of one automaton of several."""
    rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
    return [tuple(r) for r in rows.distinct().collect()]


def _detect_all(own: DataFrame, items: DataFrame, parts: int, window: int) -> DataFrame:
    """One row per document and automaton."""
    whole = _detect(own, _part(items, 0, parts), window)
    for part in range(1, parts):
        whole = whole.unionByName(_detect(own, _part(items, part, parts), window))
    return whole


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"] + 1))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, item_col: str = "item_id", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents with their hit spans cut out; a document of which more than ``max_coverage`` of the words is hit goes.

    Keeps the columns of ``docs``, which has a column ``text``; a column ``n_chars``, if there is one, follows the new text. A cut leaves one space. Rows
    without a hit stay as they are, null texts among them. With several automata (``automaton_bytes``) the spans of all of them are found in the text
    as it came and united; then each document is judged and cut once, as with one automaton.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + total // automaton_bytes
    if parts == 1:
        sent = docs.sparkSession.sparkContext.broadcast(Detector.of(_part(items, 0, 1), window))
        return docs.mapInArrow(_cutter(docs.columns, max_coverage, sent), docs.schema)
    key = "row_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    # The key goes through several scans, so it is written beside the texts.
    held = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    # The answers name no document by its id here; a table needs none.
    own = held.select(F.col(key).alias("row_key"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _merge(_detect_all(own, items, parts, window).where(F.size("spans") > 0))
    found = found.select(F.col("row_key").alias(key), F.struct("n_words", "spans").alias(f"{key}_found"))
    return held.join(found, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], f"{key}_found").mapInArrow(_cutter(docs.columns, max_coverage), docs.schema)


def _cutter(names: list[str], max_coverage: float, sent=None):
    """Judges and cuts batches of documents: by the detector that was sent, or by ``n_words`` and ``spans`` in the column behind the documents' own."""

    def known(batch, texts):
        if sent is None:
            for k, found in enumerate(batch.column(len(names)).to_pylist()):
                if found:
                    yield k, found["n_words"], found["spans"]
            return
        for a, b in slices(texts, 1_000_000):
            for k, (n_words, _, spans, _) in zip(range(a, b), sent.value.scan([t or "" for t in texts[a:b]]), strict=True):
                if spans:
                    yield k, n_words, spans

    def cut(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            changed: dict[int, str] = {}
            for k, n_words, spans in known(batch, texts):
                if sum(s["last"] - s["first"] + 1 for s in spans) > max_coverage * n_words:
                    keep[k] = False
                    continue
                raw, parts, at = texts[k].encode(), [], 0
                for s in spans:
                    parts.append(raw[at : s["start"]].decode().rstrip())
                    at = s["end"]
                parts.append(raw[at:].decode().lstrip())
                changed[k] = " ".join(p for p in parts if p)
            batch = batch.select(range(len(names)))
            if changed:
                texts = [changed.get(k, t) for k, t in enumerate(texts)]
                batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
                if "n_chars" in names:
                    i = names.index("n_chars")
                    old = batch.column(i).to_pylist()
                    batch = batch.set_column(i, batch.schema.field(i), pa.array([len(texts[k]) if k in changed else n for k, n in enumerate(old)], batch.schema.field(i).type))
            yield batch.filter(pa.array(keep))

    return cut
