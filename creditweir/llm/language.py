"""Operator 7: language by bit-sliced Bloom filters of n-grams.

Training counts the letter n-grams of all labelled texts per language (combined in the
tasks, then summed). An n-gram belongs to a language that gives it at least ``MIN_SHARE``
of its n-grams and ``RELATIVE`` of the largest share any language gives it; since shares
add up to one, a language has at most 1 / MIN_SHARE n-grams, which bounds the model.
The filter has one row per position and one bit per language in it: the rows of an
n-gram's ``HASHES`` positions, combined by AND, are the mask of all languages that hold
the n-gram. A text's bits are counted per language, lowered by the false positives that
the filter's fill makes likely, and the largest share decides.

Texts that are null or have no letter are ``und`` with score 0, and so are all texts if
nothing could be learned. Ties go to the language with more training n-grams. Repeated
rows are judged alike; rows with a null id take part in training. Very long texts are
counted whole. Other columns are not read.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweir.llm.scratch import cut, scratch
from creditweir.llm.words import mix, slices, split_words, texts_of

SIZES = (2, 3, 4)
HASHES = 3
MIN_SHARE, RELATIVE = 1e-5, 0.05
#: Filter rows per n-gram of the largest language; at most about 3.2 million rows.
ROWS_PER_GRAM = 32
#: Distinct n-grams that a task holds before it hands them on.
HELD = 500_000
#: Bytes of text whose n-grams are held at a time; they need about a hundred times as much.
SLICE = 1_500_000


def gram_keys(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the letter n-grams of every word, and the word each belongs to."""
    lowered = pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"[^\p{L}]+", " ")
    padded = pc.binary_join_element_wise(" ", pc.utf8_trim(lowered, " "), " ", "")
    spoken = pc.not_equal(padded, "  ")
    points = np.frombuffer("".join(pc.if_else(spoken, padded, "").to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.if_else(spoken, pc.utf8_length(padded), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    keys, owners = [], []
    for size in SIZES:
        if len(points) < size:
            continue
        n = len(points) - size + 1
        inside = owner[:n] == owner[size - 1 :]
        for k in range(1, size - 1):  # n-grams do not span two words
            inside &= points[k : k + n] != 32
        key = np.full(n, size, np.uint64)
        for k in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n])
        if size == 2:
            inside &= (points[:n] != 32) & (points[1 : 1 + n] != 32)
        keys.append(key[inside])
        owners.append(owner[:n][inside])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


class _Counts:
    """n-gram counts of one task: per language sorted distinct keys and how often each came."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, name: str, keys: np.ndarray, n: np.ndarray):
        self.parts.setdefault(name, []).append((keys, n))
        self.size += len(keys)

    def merge(self):
        """Adds up equal keys; one language at a time is held twice."""
        self.size = 0
        for name, parts in self.parts.items():
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys)
            keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.parts[name] = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
            self.size += len(first)

    def batches(self):
        """All counts as Arrow batches; nothing is held afterwards."""
        self.merge()
        for name, [(keys, n)] in self.parts.items():
            yield pa.record_batch([pa.repeat(pa.scalar(name), len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])
        self.parts, self.size = {}, 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over the whole texts of (text, lang)."""

    def run(batches):
        held = _Counts()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = split_words(texts_of(part, "text"))
                if not len(words.codes):
                    continue
                lang = part.column("lang").dictionary_encode()
                of_word = np.repeat(lang.indices.to_numpy(), np.diff(words.starts))
                keys, owner = gram_keys(words.vocabulary)
                distinct, place = np.unique(keys, return_inverse=True)
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    times = np.bincount(words.codes[of_word == i], minlength=len(words.vocabulary))
                    n = np.bincount(place, weights=times[owner], minlength=len(distinct)).astype(np.int64)
                    held.add(name, distinct[n > 0], n[n > 0])
                if held.size > HELD:
                    held.merge()
                    if held.size > HELD // 2:
                        yield from held.batches()
        yield from held.batches()

    return docs.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    languages: list[str]
    bits: np.ndarray  # rows x ceil(languages / 8), one bit per language
    false_rate: np.ndarray  # per language


def positions(keys: np.ndarray, rows: int) -> np.ndarray:
    """HASHES filter rows for each key."""
    seeds = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mix(keys[:, None] + seeds) % np.uint64(rows)).astype(np.int64)


def train(docs: DataFrame) -> Model:
    """Learns from every row of (text, lang) with both present."""
    with scratch():
        return _train(docs)


def _train(docs: DataFrame) -> Model:
    counts = cut(gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")))
    # One row per language, not per text.
    totals = sorted(((r["n"], r["lang"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    languages = [name for _, name in totals]
    if not languages:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0))
    share = F.col("n") / F.element_at(F.create_map(*[x for n, name in totals for x in (F.lit(name), F.lit(float(n)))]), F.col("lang"))
    number = F.element_at(F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))]), F.col("lang"))
    shares = counts.select("key", number.alias("language"), share.alias("share"))
    largest = shares.groupBy("key").agg(F.max("share").alias("top")).where(F.col("top") >= MIN_SHARE)
    kept = cut(
        shares.join(largest, "key").where((F.col("share") >= MIN_SHARE) & (F.col("share") >= RELATIVE * F.col("top"))).select("key", "language")
    )
    most = kept.groupBy("language").count().agg(F.max("count")).first()[0] or 1
    rows = most * ROWS_PER_GRAM

    def place(batches):
        for batch in batches:
            at = positions(batch.column("key").to_numpy().view(np.uint64), rows)
            language = np.repeat(batch.column("language").to_numpy(), HASHES)
            yield pa.record_batch(
                [pa.array(at.ravel()), pa.array((language // 8).astype(np.int32)), pa.array((1 << (language % 8)).astype(np.int32))],
                names=["row", "byte", "mask"],
            )

    filter_rows = kept.mapInArrow(place, "row long, byte int, mask int").groupBy("row", "byte").agg(F.bit_or("mask").alias("mask"))
    # At most 1 / MIN_SHARE x HASHES entries a language.
    table = filter_rows.toPandas()
    bits = np.zeros((rows, -(-len(languages) // 8)), np.uint8)
    bits[table["row"], table["byte"]] = table["mask"]
    fill = np.unpackbits(bits, axis=1, bitorder="little")[:, : len(languages)].mean(axis=0)
    return Model(languages, bits, fill**HASHES)


def masks(model: Model, keys: np.ndarray) -> np.ndarray:
    """Per key the languages that hold it, as 0 and 1."""
    at = positions(keys, len(model.bits))
    found = model.bits[at[:, 0]]
    for k in range(1, HASHES):
        found &= model.bits[at[:, k]]
    return np.unpackbits(found, axis=1, bitorder="little")[:, : len(model.languages)]


def judge(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    words = split_words(texts)
    if not model.languages or not len(words.codes):
        return ["und"] * len(texts), np.zeros(len(texts))
    keys, owner = gram_keys(words.vocabulary)
    total = words.per_text(np.bincount(owner, minlength=len(words.vocabulary))[words.codes])
    # Masks of distinct n-grams only.
    distinct, back = np.unique(keys, return_inverse=True)
    found = masks(model, distinct)[back]
    corrected = np.empty((len(texts), len(model.languages)))
    for i, rate in enumerate(model.false_rate):
        hits = words.per_text(np.bincount(owner, weights=found[:, i], minlength=len(words.vocabulary)).astype(np.int64)[words.codes])
        corrected[:, i] = np.maximum(0.0, hits - rate * total) / ((1 - rate) * np.maximum(total, 1))
    best = corrected.argmax(axis=1)
    score = np.clip(corrected[np.arange(len(texts)), best], 0, 1)
    names = [model.languages[b] if t else "und" for b, t in zip(best, total)]
    return names, np.where(total > 0, score, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred and score; reads the text only, keeps every column."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    handed = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MIN_SHARE

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names, score = judge(handed.value, texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array(names, pa.string()), pa.array(score)],
                    names=[*(f.name for f in kept), "lang_pred", "score"],
                )

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(f.name for f in kept)).mapInArrow(run, schema)


def in_fold(fold: int):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == fold
