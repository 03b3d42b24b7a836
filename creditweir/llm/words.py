"""Words of Arrow text batches as integer codes; shared by the text operators.

A batch is cut into slices of bounded bytes, and each slice names every distinct
word once, so per-word work is done on the vocabulary and spread by numpy.
"""

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000


class Words(NamedTuple):
    codes: np.ndarray  # one code per word, in text order
    starts: np.ndarray  # first word of each text, with the total at the end
    vocabulary: pa.Array

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per word over each text."""
        totals = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return totals[self.starts[1:]] - totals[self.starts[:-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last
    # A worker outlives its tasks; what a batch needed goes back to the system.
    pa.default_memory_pool().release_unused()
    trim = _heap_trim()
    if trim:
        trim(0)


@lru_cache(maxsize=1)
def _heap_trim():
    """The C library's call that returns freed pages, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with nulls as empty texts, as a string array that starts at offset 0."""
    return pa.concat_arrays([pc.fill_null(batch.column(column).cast(pa.string()), "")])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def from_bytes(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))
    )


def split_words(texts: pa.Array) -> Words:
    """Words between runs of space and U+0009 to U+000D."""
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.dictionary_encode()
    codes, vocabulary = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    blank = pc.index(vocabulary, "").as_py()
    if blank >= 0:
        keep = codes != blank
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return Words(codes, starts, vocabulary)


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, the same in every task."""
    return pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False), categorize=False)


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def text_index(starts: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
