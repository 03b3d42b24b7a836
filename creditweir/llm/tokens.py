"""Whole-text token ids with a public tokenizer, each distinct word encoded once.

The vocabulary file splits texts at white space and never merges across it, so a
text's ids are the ids of its white-space words in order. Letters A-Z are lowered
before (the tokenizer does so itself), and a run of ASCII punctuation after a letter
a-z is split off, where the tokenizer always splits. Texts that hold ``<|`` could
contain a special token; they are encoded whole by the library.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from creditweir.llm.words import Words, from_bytes, split_words, text_bytes

#: Words that are one pre-token for certain: letters only, or ASCII punctuation only.
WHOLE = re.compile("[a-zß-öø-ÿ]+|[!,.;:?#$%&*|]+")
CACHED_WORDS = 300_000
JOINED = 20_000
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_MARK[list(b"!,.;:?#$%&*|")] = True


class Encoder:
    """Encodes string arrays; remembers the ids of words up to a bound, then starts afresh."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[ends] = True
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begins = np.zeros(1 << 20, np.int64)
        self.counts = np.zeros(1 << 20, np.int32)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray):
        first, n = len(self.known), len(words)
        while first + n > len(self.begins):
            self.begins, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.counts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.counts[first : first + n] = counts
        self.begins[first : first + n] = self.used + np.cumsum(counts) - counts
        self.known.update(zip(words, range(first, first + n)))
        self.used += len(ids)

    def _learn(self, words: list[str]):
        whole = [w for w in words if WHOLE.fullmatch(w)]
        for i in range(0, len(whole), JOINED):
            part = whole[i : i + JOINED]
            ids = np.array(self._whole([" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) != len(part):  # a vocabulary without word ends
                raise ValueError("the tokenizer does not mark word ends")
            self._add(part, ids, np.diff(ends, prepend=-1))
        mixed = [w for w in words if not WHOLE.fullmatch(w)]
        for i in range(0, len(mixed), JOINED):
            part = mixed[i : i + JOINED]
            lists = self._whole(part)
            flat = np.fromiter((x for ids in lists for x in ids), np.uint32)
            self._add(part, flat, np.array([len(x) for x in lists], np.int32))

    def _rows(self, vocabulary: pa.Array) -> np.ndarray:
        words = vocabulary.to_pylist()
        if len(self.known) + len(words) > CACHED_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and where each text starts."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        words = split_words(_split_marks(pc.ascii_lower(plain)))
        rows = self._rows(words.vocabulary)
        ids, starts = self._gather(words, rows, end_id)
        if special.any():
            parts = [ids[a:b] for a, b in zip(starts, starts[1:])]
            for i in np.flatnonzero(special):
                parts[i] = np.array([*self._whole([texts[int(i)].as_py()])[0], end_id], np.uint32)
            ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, starts

    def _gather(self, words: Words, rows: np.ndarray, end_id: int):
        begins, counts = self.begins[rows][words.codes], self.counts[rows][words.codes].astype(np.int64)
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        per_text = words.per_text(counts)
        starts = np.concatenate([[0], np.cumsum(per_text + 1)])
        source = np.repeat(begins - before, counts)
        source += np.arange(total)
        ids = np.full(total + len(per_text), end_id, np.uint32)
        place = np.arange(total) + np.repeat(np.arange(len(per_text)), per_text)
        ids[place] = self.flat[source]
        return ids, starts


def _split_marks(texts: pa.Array) -> pa.Array:
    """A space between a letter a-z and the punctuation that follows it."""
    offsets, data = text_bytes(texts)
    if len(data) < 2:
        return texts
    cuts = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    spread = np.full(len(data) + len(cuts), ord(" "), np.uint8)
    kept = np.ones(len(spread), bool)
    kept[cuts + np.arange(len(cuts))] = False
    spread[kept] = data
    return from_bytes(offsets + np.searchsorted(cuts, offsets, side="left"), spread)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so tasks that share a worker share its words."""
    return Encoder(path)


@lru_cache(maxsize=1)
def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
