"""Operator 8: benchmark passages in training text by a positional inverted index.

``build_index`` cuts the documents into segments of bounded bytes and writes one row
per segment, as bytes: its sorted terms and, per term, the ascending positions of the term over
the segment's documents (which lie ``GAP`` positions apart, so no phrase spans two).
The index is spread by documents: a search needs no shuffle, whatever the frequency of
a word. ``search`` looks up phrases in every segment: lists are taken from the rarest
term on, shifted by the term's offset in the phrase, and intersected; ``slop`` above 0
gives proximity matches, where each term may stand that far from its place.

Phrases go to the tasks in parts of at most ``PART_WORDS`` words; further parts are
further passes over the index, so no benchmark is too large. Null or empty texts have
no words and are never hit; empty tables give empty results. Repeated rows are judged
each for itself, and items with equal windows are all named. Other columns are not read.
"""

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import LARGE_ROWS, cut, small_batches, tidy
from creditweir.llm.words import Words, from_bytes, slices, split_words, text_bytes, text_index, texts_of

GAP = 64
PART_WORDS = 500_000
#: Words of one row of a long benchmark item; rows overlap by a window less one word.
PIECE = 4_000
#: A segment's row holds these columns as bytes of an Arrow stream: Spark's reader takes hundreds of MB of heap for long arrays.
SEGMENT = ["uids", "doc_ids", "starts", "sizes", "terms", "counts", "positions"]
INDEX = "segment binary"
FOUND = "uid long, doc_id long, n_words long, begins array<int>, ends array<int>, items array<string>"

# Separators are U+0000-002F, U+003A-0060 and U+007B-007F after A-Z are lowered.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = ord(" ")


def plain_words(texts: pa.Array) -> Words:
    """Lower-cased words of ASCII letters and digits and of all characters beyond ASCII."""
    offsets, data = text_bytes(texts)
    return split_words(from_bytes(offsets, _PLAIN[data]))


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of (doc_id, text)."""

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                words = plain_words(texts_of(part, "text"))
                sizes = np.diff(words.starts)
                starts = words.starts[:-1] + np.arange(len(sizes)) * GAP
                place = np.arange(len(words.codes)) + text_index(words.starts) * GAP
                by_name = pc.array_sort_indices(words.vocabulary).to_numpy()
                rank = np.empty(len(by_name), np.int64)
                rank[by_name] = np.arange(len(by_name))
                term = rank[words.codes]
                order = np.argsort(term, kind="stable")
                counts = np.bincount(term, minlength=len(by_name))
                steps = np.diff(place[order], prepend=0)
                first = np.cumsum(counts) - counts
                steps[first] = place[order][first]  # each list starts from zero
                lists = [row + np.arange(len(sizes)), part.column("doc_id"), starts.astype(np.int32), sizes.astype(np.int32),
                         words.vocabulary.take(pa.array(by_name)), counts.astype(np.int32)]
                row += len(sizes)
                # Bytes of equal weight side by side: the high ones are nearly all zero.
                packed = np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
                columns = [_one_list(x if isinstance(x, pa.Array) else pa.array(x)) for x in lists]
                row_of = pa.record_batch([*columns, pa.array([packed], pa.binary())], names=SEGMENT)
                yield pa.record_batch([pa.array([_to_bytes(row_of)], pa.binary())], names=["segment"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(narrow.mapInArrow(run, INDEX), **LARGE_ROWS)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _to_bytes(row: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


class Phrases(NamedTuple):
    terms: list[str]  # every distinct word
    phrases: list[list[int]]  # numbers of words
    items: list[list[str]]  # the items that hold the phrase


class _Segment:
    """Positions of the phrases' terms in one segment."""

    def __init__(self, row: pa.RecordBatch, terms: pa.Array):
        values = {name: row.column(name)[0].values for name in row.schema.names if name != "positions"}
        self.uids, self.doc_ids, self.starts, self.sizes = (values[c] for c in ("uids", "doc_ids", "starts", "sizes"))
        counts = values["counts"].to_numpy()
        ends = np.cumsum(counts)
        packed = np.frombuffer(row.column("positions")[0].as_buffer(), np.uint8)
        steps = np.ascontiguousarray(packed.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        at = pc.index_in(terms, values["terms"]).fill_null(-1).to_numpy()
        none = np.zeros(0, np.int64)
        self.lists = [np.cumsum(steps[ends[k] - counts[k] : ends[k]]) if k >= 0 else none for k in at]
        self.known = at >= 0
        self.sizes_of = np.array([len(x) for x in self.lists])

    def find(self, phrase: list[int], slop: int) -> np.ndarray:
        """Start positions of a phrase, from the rarest term's list."""
        if not self.known[phrase].all():
            return np.zeros(0, np.int64)
        order = np.argsort(self.sizes_of[phrase], kind="stable")
        found = self.lists[phrase[order[0]]] - order[0]
        for offset in order[1:]:
            if not len(found):
                break
            other = self.lists[phrase[offset]]
            wanted = found + offset
            right = np.searchsorted(other, wanted - slop)
            near = other[np.minimum(right, len(other) - 1)]
            found = found[np.abs(near - wanted) <= slop]
        return found


def search(index: DataFrame, parts: list[Phrases], slop: int = 0, every: bool = True) -> DataFrame:
    """Per document: merged hit intervals of word positions, and items; unhit documents too if ``every``."""

    def run_part(phrases: Phrases, first: bool):
        def run(batches):
            terms = pa.array(phrases.terms, pa.string())
            wanted = [np.array(p) for p in phrases.phrases]
            for batch in batches:
                for packed in batch.column("segment"):
                    segment = _Segment(pa.ipc.open_stream(packed.as_buffer()).read_next_batch(), terms)
                    yield _judge(segment, wanted, phrases.items, slop, first and every)

        return run

    passes = [index.mapInArrow(run_part(p, i == 0), FOUND) for i, p in enumerate(parts)]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    merged = out.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("begins")).alias("begins"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged if len(parts) > 1 else out


def _judge(segment: _Segment, wanted, items, slop: int, every: bool) -> pa.RecordBatch:
    starts, sizes = segment.starts.to_numpy(), segment.sizes.to_numpy()
    spans, named = defaultdict(list), defaultdict(set)
    for phrase, owners in zip(wanted, items):
        for position in segment.find(phrase, slop).tolist():
            doc = int(np.searchsorted(starts, max(position, 0), side="right")) - 1
            begin = position - int(starts[doc])
            spans[doc].append((max(0, begin - slop), min(int(sizes[doc]), begin + len(phrase) + slop)))
            named[doc].update(owners)
    chosen = range(len(starts)) if every else sorted(spans)
    begins, ends = [], []
    for doc in chosen:
        merged = merge(spans.get(doc, []))
        begins.append([a for a, _ in merged])
        ends.append([b for _, b in merged])
    take = pa.array(list(chosen), pa.int64())
    return pa.record_batch(
        [
            segment.uids.take(take), segment.doc_ids.take(take), segment.sizes.take(take).cast(pa.int64()),
            pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
            pa.array([sorted(named.get(doc, ())) for doc in chosen], pa.list_(pa.string())),
        ],
        names=["uid", "doc_id", "n_words", "begins", "ends", "items"],
    )


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals with the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, window: int = 10) -> list[Phrases]:
    """All windows of (item_id, text), in parts of bounded size; at least one part."""

    def split(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = plain_words(texts_of(part, "text"))
                names = words.vocabulary.to_pylist()
                rows = []
                for item, a, b in zip(part.column("item_id").to_pylist(), words.starts, words.starts[1:]):
                    for i in range(a, max(a + 1, b - window + 1), PIECE):
                        piece = [names[c] for c in words.codes[i : min(b, i + PIECE + window - 1)]]
                        if piece:
                            rows.append((item, piece, len(piece)))
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
                           pa.array([r[2] for r in rows], pa.int64())]
                yield pa.record_batch(columns, names=["item_id", "words", "size"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(named.mapInArrow(split, "item_id string, words array<string>, size long"))
    total = pieces.agg(F.sum("size")).first()[0] or 0
    count = max(1, -(-total // PART_WORDS))
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(count))
    return [_phrases(pieces.where(part == k).drop("size").collect(), window) for k in range(count)]


def _phrases(rows, window: int) -> Phrases:
    numbers: dict[str, int] = {}
    owners: dict[tuple, set] = defaultdict(set)
    for item, piece in rows:
        coded = [numbers.setdefault(w, len(numbers)) for w in piece]
        for i in range(max(1, len(coded) - window + 1)):
            owners[tuple(coded[i : i + window])].add(item or "")
    keys = sorted(owners)
    return Phrases(list(numbers), [list(k) for k in keys], [sorted(owners[k]) for k in keys])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(uid, doc_id, n_words, begins, ends, items) for every document."""
    with small_batches(docs.sparkSession):
        return tidy(search_all)(docs, benchmark, window)


def search_all(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    return search(build_index(docs), benchmark_parts(benchmark, window))


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items per document."""
    # Parts can overlap where several held a hit: count each position once.
    length = F.aggregate(
        F.array_sort(F.arrays_zip("begins", "ends")),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["begins"], s["upto"]))).alias("hit"),
            F.greatest(s["upto"], x["ends"]).alias("upto"),
        ),
    )["hit"].cast("long")
    return found.select(
        "doc_id",
        "n_words",
        length.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("begins") > 0).alias("contaminated"),
    )
