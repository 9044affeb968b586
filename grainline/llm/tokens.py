"""Token ids of many whole texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text with a space before white space, or a space at its end, is encoded as a whole.
UNSAFE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|$)"
#: Words that a worker remembers with their ids, about 100 bytes each, and bytes of text encoded at once.
REMEMBERED, BATCH_BYTES = 300_000, 8 << 20
#: The same where a worker has to leave room for others' work: a fifth more time, 100 MB less.
LITTLE = (150_000, 2 << 20)

_encoders: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """A byte-level BPE tokenizer whose words start at a space.

    The pattern of these vocabularies never joins what stands before a space to a visible character
    after it, so a text may be cut there: its ids are those of its words, each with its space. Words
    are found and made distinct by Arrow; only words not yet remembered go to the library. Texts where
    a space precedes white space, or that hold the string of an added token, go to it whole. The ids are
    those of the plain call with add_special_tokens=False, which reads such a string as that token.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for w, i in self.tokenizer.get_vocab().items() if w[0] == "\u0120"]] = True
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.lengths = np.empty(1 << 20, np.uint32), 0, np.zeros(remembered, np.int64)
        self.starts = np.zeros(remembered, np.int64)

    @staticmethod
    def of(path: str, remembered: int = REMEMBERED) -> Encoder:
        """This worker's encoder for the file."""
        key = path, remembered
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(path, remembered)
        return _encoders[key]

    def _fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has.

        Of a word that starts with its only space, the first id and no other starts with a space.
        """
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        spaced = [w for w in words if w[:1] == " "]
        heads = [w for w in words if w[:1] != " "]
        if words[: len(spaced)] != spaced:
            raise ValueError("words with a space come first")
        blocks = [spaced[i : i + 1000] for i in range(0, len(spaced), 1000)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(blocks, is_pretokenized=True, add_special_tokens=False)]
        begins = np.flatnonzero(self.spaced[np.concatenate(found)]) if found else np.empty(0, np.int64)
        if len(begins) != len(spaced):
            raise ValueError("the vocabulary joins what stands before a space to what follows")
        lengths = np.diff(np.append(begins, sum(map(len, found))))
        ends = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]
        return np.concatenate([*found, *ends]), np.concatenate([lengths, np.array([len(x) for x in ends], np.int64)])

    def _remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        room = len(self.starts) - len(self.known)
        if room <= 0:
            return
        words, lengths = words[:room], lengths[:room]
        n, ids = len(self.known), ids[: lengths.sum()]
        while self.ends + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.ends : self.ends + len(ids)] = ids
        self.lengths[n : n + len(words)] = lengths
        self.starts[n : n + len(words)] = self.ends + np.cumsum(lengths) - lengths
        self.ends += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; no text is unsafe."""
        lists = pc.split_pattern(texts, " ")
        firsts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        unique = [f" {w}" for w in coded.dictionary.to_pylist()]
        # the first word of a text has no space before it
        heads = flat.take(pa.array(firsts)).dictionary_encode()
        index[firsts] = len(unique) + heads.indices.to_numpy(zero_copy_only=False)
        unique += heads.dictionary.to_pylist()
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in unique), np.int64, len(unique))
        new = np.flatnonzero(at < 0)
        fresh_words = [unique[i] for i in new]
        fresh, fresh_lengths = self._fresh(fresh_words)
        base = self.ends
        starts, lengths = self.starts[at], self.lengths[at]
        lengths[new] = fresh_lengths
        starts[new] = base + np.cumsum(fresh_lengths) - fresh_lengths
        pool = np.concatenate([self.ids[:base], fresh])
        n = lengths[index]
        ends = np.cumsum(n)
        ids = pool[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        self._remember(fresh_words, fresh, fresh_lengths)
        counts = np.add.reduceat(n, firsts) if len(firsts) else np.empty(0, np.int64)
        return ids, counts

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, uint32; null is read as empty."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False).astype(bool)
        for content in self.added:
            unsafe |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False).astype(bool)
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        safe = np.flatnonzero(~unsafe)
        if len(safe):
            ids, counts = self._words(texts.take(pa.array(safe)))
            for i, x in zip(safe, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = x
        for i in np.flatnonzero(unsafe):
            out[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """The rows of the batches in order, some megabytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= most:
                held.append(batch.slice(at, i + 1 - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if found.num_chunks != 1 else found.chunk(0)
