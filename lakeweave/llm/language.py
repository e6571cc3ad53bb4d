"""Language of whole texts by a convolutional network over bytes, written and trained in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter keeps its largest response and a softmax
layer turns these into probabilities. A text's probabilities are the mean over all its windows, from the first byte to the last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed
from lakeweave.llm.tokens import slices

UNKNOWN = "und"
#: Bound of the training sample unless another is given: so many texts of each language, and so many characters of each text. Every label is learnt.
TEXTS_PER_LANGUAGE = 600
CHARS_PER_TEXT = 1024

WINDOW = 256
EMBEDDING = 8
FILTERS = 16
WIDTHS = (2, 3, 4)

PREDICTED = "row_key long, doc_id long, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the checksum of the id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def windows_of(data: bytes) -> np.ndarray:
    """The windows of one text: one after another, the last one moved back to end with the text; a short text is padded with zeros."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) <= WINDOW:
        return np.pad(raw, (0, WINDOW - len(raw)))[None, :]
    whole = raw[: len(raw) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return whole if len(raw) % WINDOW == 0 else np.vstack([whole, raw[-WINDOW:]])


@dataclass
class ByteNetwork:
    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width * EMBEDDING, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    @staticmethod
    def fresh(labels: list[str], rng: np.random.Generator) -> ByteNetwork:
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        embedding = rng.standard_normal((256, EMBEDDING)).astype(np.float32)
        return ByteNetwork(labels, embedding, [normal(w * EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS, len(labels)), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.dense, self.dense_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy of a batch of windows."""
        n = len(x)
        vectors = self.embedding[x]
        views, best, pooled = [], [], []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(vectors, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBEDDING)
            response = view @ kernel
            at = response.argmax(axis=1)
            views.append(view)
            best.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + bias)
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.dense + self.dense_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.dense.T) * (raw > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_bias = [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = np.take_along_axis(views[k], best[k][:, :, None], axis=1)
            d_filters.append(np.einsum("nf,nfd->df", g, seen))
            d_bias.append(g.sum(axis=0))
            into = np.einsum("nf,df->nfd", g, self.filters[k]).reshape(n, FILTERS, w, EMBEDDING)
            for j in range(w):
                np.add.at(d_embedding, np.take_along_axis(x, best[k] + j, axis=1), into[:, :, j])
        return [d_embedding, *d_filters, *d_bias, hidden.T @ p, p.sum(axis=0)]

    def tables(self) -> ByteTables:
        return ByteTables(self)


class ByteTables:
    """The trained network for prediction. The products of embedding and filter are looked up by pairs of bytes instead of being multiplied anew."""

    def __init__(self, net: ByteNetwork):
        self.labels = net.labels
        self.dense, self.dense_bias = net.dense, net.dense_bias
        self.parts = []
        for w, kernel, bias in zip(WIDTHS, net.filters, net.bias, strict=True):
            one = [net.embedding @ kernel[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            pairs = [(j, (one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            single = [(w - 1, one[w - 1])] if w % 2 else []
            self.parts.append((w, pairs, single, bias))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for w, pairs, single, bias in self.parts:
            n = WINDOW - w + 1
            response = None
            for j, table in pairs:
                found = table.take(pair[:, j : j + n], axis=0)
                response = found if response is None else np.add(response, found, out=response)
            for j, table in single:
                response += table.take(x[:, j : j + n], axis=0)
            pooled.append(response.max(axis=1) + bias)
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.dense_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, seed: int = 7) -> ByteNetwork | None:
    """A network fitted to labelled texts with Adam; None without any text. Windows are cut at random places and lengths."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = ByteNetwork.fresh(names, rng)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in labels])
    held = [[np.zeros_like(p) for p in net.parameters()] for _ in range(2)]
    turn = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(raw)), max(1, len(raw) // 64)):
            x = np.zeros((len(part), WINDOW), dtype=np.uint8)
            for k, i in enumerate(part):
                size = int(rng.integers(24, WINDOW + 1)) if rng.random() < 0.4 else WINDOW
                at = int(rng.integers(0, max(1, len(raw[i]) - size + 1)))
                piece = np.frombuffer(raw[i][at : at + size], dtype=np.uint8)
                x[k, : len(piece)] = piece
            turn += 1
            for p, g, m, v in zip(net.parameters(), net.step(x, y[part]), *held, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= np.float32(0.01) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + np.float32(1e-7))
    return net


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, chars_per_text: int = CHARS_PER_TEXT) -> list[tuple[str, str]]:
    """Texts and languages to learn from: up to ``texts_per_language`` rows of each language that occurs, chosen by a hash of the id, and ``chars_per_text``
    characters of each. The label ``und`` says that no language is known, so it is no language to learn."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (F.char_length(F.trim("text")) > 0) & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.char_length("text") - chars_per_text, F.lit(1))).cast("int") + 1
    piece = F.substr("text", place, F.lit(chars_per_text))
    order = W.partitionBy("lang").orderBy("key", "doc_id", "text")
    keys = rows.withColumn("key", F.xxhash64("doc_id"))
    # Of a frequent language only rows with small keys are ranked, about four times as many as are wanted, so that no task gets all of them. One row a
    # label is broadcast; the driver holds many more of each.
    share = F.least(F.lit(1.0), F.lit(4.0 * texts_per_language) / F.count("*"))
    limits = rows.groupBy("lang").agg((F.lit(-(2.0**63)) + F.lit(2.0**64) * share).alias("limit"))
    keys = keys.join(F.broadcast(limits), "lang").where(F.col("key") <= F.col("limit"))
    chosen = keys.select("lang", "doc_id", piece.alias("text"), "key").withColumn("k", F.row_number().over(order)).where(F.col("k") <= texts_per_language)
    return [(r["text"], r["lang"]) for r in chosen.orderBy("lang", "k").collect()]


def identify(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, doc_id, lang_pred, score`` of each row. A text that is null or has no letter is ``und`` with score 0, and so is any text without a network."""
    sent = docs.sparkSession.sparkContext.broadcast(None if net is None else net.tables())

    def predict(batches):
        tables = sent.value
        for batch in batches:
            keys, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in slices(texts, 400_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(ids[a:b], pa.int64()), *_answers(tables, texts[a:b])], names=["row_key", "doc_id", "lang_pred", "score"])

    return keyed(documents_of(docs, id_col, text_col)).select("row_key", "doc_id", "text").mapInArrow(predict, PREDICTED)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _answers(tables: ByteTables | None, texts: list[str | None]) -> list[pa.Array]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    asked = [k for k, t in enumerate(texts) if tables is not None and has_letter(t)]
    if asked:
        windows = [windows_of(texts[k].encode("utf-8", "surrogatepass")) for k in asked]
        sizes = np.array([len(w) for w in windows])
        rows = np.vstack(windows)
        p = np.vstack([tables.predict(rows[i : i + 64]) for i in range(0, len(rows), 64)]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(p, starts, axis=0) / sizes[:, None]
        for k, row in zip(asked, mean, strict=True):
            best = int(row.argmax())
            names[k], scores[k] = tables.labels[best], min(1.0, float(row[best]))
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]


def with_language(docs: DataFrame, net: ByteNetwork | None, least_score: float = 0.0, short: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose column ``text`` has a language.

    A text answered with ``und`` has none, and neither has one of ``short`` characters or more whose best language scores less than ``least_score``; shorter texts say
    too little to be judged by their score. Without a network, all texts with a letter stay, since then nothing tells languages apart. The rows stay
    where they are, so they need no key.
    """
    sent = docs.sparkSession.sparkContext.broadcast(None if net is None else net.tables())
    at = docs.columns.index("text")

    def keep(batches):
        tables = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts, 400_000):
                own = texts[a:b]
                if tables is None:
                    good = [has_letter(t) for t in own]
                else:
                    names, scores = (x.to_pylist() for x in _answers(tables, own))
                    good = [n != UNKNOWN and (len(t) < short or p >= least_score) for n, p, t in zip(names, scores, own, strict=True)]
                yield batch.slice(a, b - a).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, chars_per_text: int = CHARS_PER_TEXT) -> ByteNetwork | None:
    """A network trained on the rows that may be learnt from; None without any."""
    sample = training_sample(docs, id_col, text_col, lang_col, texts_per_language, chars_per_text)
    return train([t for t, _ in sample], [x for _, x in sample])


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, chars_per_text: int = CHARS_PER_TEXT) -> DataFrame:
    """Trains on the rows that may be learnt from, with every label among them, and predicts all rows. The last two bound the sample of each label."""
    return identify(docs, learn(docs, id_col, text_col, lang_col, texts_per_language, chars_per_text), id_col, text_col)
