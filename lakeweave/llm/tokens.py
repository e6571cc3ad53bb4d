"""Token ids of whole texts with the public tokenizer files; each distinct word is encoded once per worker.

Both vocabularies cut a text at a space between two visible characters before they merge anything, so the ids of a text are
the ids of its space-separated words, one after another. They also cut between letters and the punctuation behind them and
around a single line break, so a word is put together from parts. What counts as letters is what the vocabulary's normaliser makes of them: it turns
some letters into a letter and a mark, and a mark belongs to the punctuation behind it.

Arrow splits the texts of a slice and numbers their distinct words. Only these are looked up, or encoded if they are new; the ids of all words are then
gathered from one table by numpy. Texts with other uses of the space (two in a row, at an end, beside a line break) are encoded whole where the vocabulary
keeps spaces; where it drops them, texts are split at all white space of ASCII.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and parts of words, that a worker remembers; a dictionary starts anew beyond that.
REMEMBERED = 1_200_000
#: Both files have this special token. New parts are encoded so many in one string, with the token between them.
SEPARATOR = "<|endoftext|>"
LOT = 24
#: Punctuation that is cut off the end of a word of letters.
PUNCTUATION = "!\"#$%&()*+,-./:;=?@'"
#: Place of words whose texts are encoded whole.
LOOSE = -1


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Rows of many entries, one entry after the other; an entry is a number."""

    def __init__(self, width: int):
        self.rows = np.zeros((1 << 12, width), dtype=np.uint32)
        self.bounds = np.zeros(1 << 10, dtype=np.int64)
        self.count = 0

    def add(self, entries: list[bytes]) -> range:
        """Numbers of new entries."""
        new = np.frombuffer(b"".join(entries), dtype=np.uint32).reshape(-1, self.rows.shape[1])
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // (4 * self.rows.shape[1])
        first, filled = self.count, int(self.bounds[self.count])
        self.count += len(entries)
        if self.count >= len(self.bounds):
            self.bounds = np.resize(self.bounds, max(2 * len(self.bounds), self.count + 1))
        if filled + len(new) > len(self.rows):
            self.rows = np.resize(self.rows, (max(2 * len(self.rows), filled + len(new)), self.rows.shape[1]))
        self.rows[filled : filled + len(new)] = new
        self.bounds[first + 1 : self.count + 1] = filled + np.cumsum(sizes)
        return range(first, self.count)

    def entry(self, k: int) -> bytes:
        return self.rows[self.bounds[k] : self.bounds[k + 1]].tobytes()

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of entries, one after the other, and how many each has. A loose entry has none."""
        first = self.bounds[entries]
        sizes = np.where(entries == LOOSE, 0, self.bounds[entries + 1] - first)
        ends = np.cumsum(sizes)
        places = np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.rows[places], sizes


class WordEncoder:
    """Encodes texts to ids. ``keeps_space`` tells whether a word carries the space before it.

    With ``offsets`` an entry of the table holds first and end character of each token after its id.
    """

    def __init__(self, path: str, keeps_space: bool, offsets: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.offsets = offsets
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self._forget()

    def _forget(self) -> None:
        self.table = Table(3 if self.offsets else 1)
        self.parts: dict[str, bytes] = {}
        self.first: dict[str, int] = {}
        self.later = {} if self.keeps_space else self.first

    def _letters(self, stem: str) -> bool:
        """Whether the vocabulary sees letters alone."""
        if not stem.isalpha():
            return False
        normalizer = self.tokenizer.normalizer
        return stem.isascii() or normalizer is None or normalizer.normalize_str(stem).isalpha()

    def _rows(self, encoding) -> np.ndarray:
        ids = np.array(encoding.ids, dtype=np.uint32)
        if not self.offsets:
            return ids
        return np.column_stack([ids, np.array(encoding.offsets, dtype=np.uint32).reshape(-1, 2)])

    def _whole(self, text: str) -> bytes:
        return self._rows(self.tokenizer.encode(text, add_special_tokens=False)).tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Entries of parts without a special token in them, at the cost of one call."""
        lots = [parts[k : k + LOT] for k in range(0, len(parts), LOT)]
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        out: list[bytes] = []
        for lot, found in zip(lots, encode([SEPARATOR.join(lot) for lot in lots], add_special_tokens=False), strict=True):
            rows = self._rows(found)
            cuts = np.flatnonzero((rows if rows.ndim == 1 else rows[:, 0]) == self.separator)
            if self.offsets:
                sizes = np.array([len(p) + len(SEPARATOR) for p in lot[:-1]], dtype=np.int64)
                base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)
                rows[:, 1:] -= np.repeat(base, np.diff(np.concatenate([[0], cuts + 1, [len(rows)]])))[:, None]
            data, width = rows.tobytes(), 4 if rows.ndim == 1 else 12
            ends = (cuts * width).tolist()
            starts = [0, *(e + width for e in ends)]
            out.extend(data[a:b] for a, b in zip(starts, [*ends, len(data)], strict=True))
        return out

    def _entry(self, part: str) -> bytes:
        """The entry of a part that comes up rarely."""
        if part not in self.parts:
            if len(self.parts) > REMEMBERED // 8:
                self.parts.clear()
            self.parts[part] = self._whole(part)
        return self.parts[part]

    def _put_together(self, word: str, prefix: str) -> bytes:
        """The entry of a word that is more than letters: line by line if it has line breaks between visible characters."""
        lines = word.split("\n")
        if len(lines) == 1 or any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return self._entry(prefix + word)
        pieces = []
        for k, line in enumerate(lines):
            stem = line.rstrip(PUNCTUATION)
            before = "" if k else prefix
            pieces += ["\n"] * (k > 0)
            pieces += [before + stem, line[len(stem) :]] if len(stem) < len(line) and self._letters(stem) else [before + line]
        if self.offsets:
            return self._moved(pieces)
        return b"".join(map(self._entry, pieces))

    def _learn(self, words: list[str], known: dict[str, int], prefix: str) -> None:
        """Enters the words that are not known yet."""
        letters, ended, other = {}, [], []
        for w in words:
            if w in known:
                continue
            stem = w.rstrip(PUNCTUATION)
            if not self._letters(stem):
                other.append(w)
            elif len(stem) == len(w):
                letters[w] = None
            else:
                ended.append((w, stem))
        letters.update(dict.fromkeys(stem for _, stem in ended if stem not in known))
        known.update(zip(letters, self.table.add(self._encode_parts([prefix + w for w in letters])), strict=True))
        made = []
        for word, stem in ended:
            first, rest = self.table.entry(known[stem]), word[len(stem) :]
            made.append(self._moved([prefix + stem, rest], first) if self.offsets else first + self._entry(rest))
        known.update(zip((w for w, _ in ended), self.table.add(made), strict=True))
        loose = [w for w in other if self.keeps_space and (not w or w[0].isspace() or w[-1].isspace())]
        known.update(dict.fromkeys(loose, LOOSE))
        other = [w for w in other if w not in known]
        known.update(zip(other, self.table.add([self._put_together(w, prefix) for w in other]), strict=True))

    def _moved(self, pieces: list[str], first: bytes | None = None) -> bytes:
        """Entries of parts in a row with the offsets moved to where they stand."""
        out, at = [], 0
        for k, p in enumerate(pieces):
            rows = np.frombuffer(self._entry(p) if k or first is None else first, np.uint32).reshape(-1, 3).copy()
            rows[:, 1:] += np.uint32(at)
            out.append(rows.tobytes())
            at += len(p)
        return b"".join(out)

    def _entries(self, words: pa.Array, known: dict[str, int], prefix: str) -> np.ndarray:
        """Entries of words, each distinct one looked up once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(distinct, known, prefix)
        places = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return places[coded.indices.to_numpy(zero_copy_only=False)]

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all texts (null: empty), one after the other, and how many each text has."""
        if max(len(self.first), len(self.later)) > REMEMBERED:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return self.table.rows[:0], np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ") if self.keeps_space or self.offsets else pc.ascii_split_whitespace(texts)
        words, bounds = split.flatten(), split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        if self.keeps_space:
            # Every text has a first word, be it an empty one.
            opens = np.zeros(len(words), dtype=bool)
            opens[bounds[:-1]] = True
            entries = np.empty(len(words), dtype=np.int64)
            entries[opens] = self._entries(words.filter(pa.array(opens)), self.first, "")
            entries[~opens] = self._entries(words.filter(pa.array(~opens)), self.later, " ")
        else:
            entries = self._entries(words, self.first, "")
        rows, sizes = self.table.gather(entries)
        if self.offsets:
            chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            base = np.cumsum(chars) - chars
            base -= np.repeat(base[np.minimum(bounds[:-1], len(base) - 1)], np.diff(bounds))
            if self.keeps_space:
                base[~opens] -= 1
            rows[:, 1:] += np.repeat(base, sizes).astype(np.uint32)[:, None]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        lengths = np.diff(ends)
        loose = np.unique(np.searchsorted(bounds, np.flatnonzero(entries == LOOSE), side="right") - 1)
        if len(loose):
            pieces, at = [], 0
            for k in loose.tolist():
                own = np.frombuffer(self._whole(texts[k].as_py()), dtype=np.uint32).reshape(-1, rows.shape[1])
                pieces += [rows[at : ends[k]], own]
                at, lengths[k] = ends[k + 1], len(own)
            rows = np.concatenate([*pieces, rows[at:]])
        return rows, lengths

    def flat_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has; ``encode(text, add_special_tokens=False)`` gives the same."""
        rows, lengths = self._encoded(texts)
        return rows[:, 0], lengths

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        rows, lengths = self.flat_ids(pa.array(texts, pa.large_string()))
        return np.split(rows, np.cumsum(lengths)[:-1]) if len(texts) else []

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and first and end character of each token in the text."""
        rows, lengths = self._encoded(pa.array(texts, pa.large_string()))
        parts = np.split(rows, np.cumsum(lengths)[:-1]) if len(texts) else []
        return [(p[:, 0], p[:, 1].astype(np.int64), p[:, 2].astype(np.int64)) for p in parts]


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool, offsets: bool = False) -> WordEncoder:
    """One encoder for each worker process, kept between batches and tasks."""
    return WordEncoder(path, keeps_space, offsets)


def slices(texts: list, most_chars: int = 4_000_000):
    """Runs of rows of about so many characters, so that a batch of long texts is worked off in parts."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= most_chars:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices_of(texts: pa.Array, most_bytes: int = 4_000_000):
    """As ``slices``, by the bytes of an Arrow column."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(held[start - 1]) if start else 0
        end = min(len(texts), int(np.searchsorted(held, before + most_bytes)) + 1)
        yield start, end
        start = end
