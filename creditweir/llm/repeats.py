"""Operator 11: passages that occur more than once, found with suffix arrays.

A window is a string of ``length`` bytes within one text. Windows that are equal must
meet, so each is dealt by its smallest gram (a fifth of its length, smallest by hash, the
last of equals): equal windows choose the same gram at the same place in them. Successive
windows that choose the same gram form a segment, the bytes that they cover.

1. Grams are counted; a segment whose gram was chosen only once holds no repeated window.
2. Segments alike in all their bytes are counted before they meet (a key of their gram and
   a digest of their bytes), so copies, however many, are one row.
3. A gram with one segment left has copies only, and all of its windows occur again. The
   texts of other segments are fetched, one for each digest, and sorted by suffix array
   (``suffixes``): windows that are equal stand side by side, and count as often as their
   segments occur. Grams are sorted by the first place that one of their segments has, so
   near copies of a text share arrays of about ``PACK`` bytes, and segments that follow
   each other in a text are joined there. A window of which one half occurs only once in
   such an array is left out of it.
4. A gram with more than ``GROUP`` bytes of different segments (a line that many texts
   share, each with other words around it) is not sorted by one task: its windows are
   counted by their hash, over all tasks.
5. Repeated windows go back to their texts as spans of bytes.

Nothing is capped: every window of every text takes part. Keys and digests are 64 bits
each and act together; text ids are 96 bits of a digest, so rows alike share theirs.

Null texts are empty. Texts shorter than ``length`` keep all their bytes. Very long texts
are cut into overlapping chunks, of which none hides a window. Repeated rows, ids and null
ids are judged row by row; rows alike remove each other's bytes, as the rule says. Other
columns are not read. Empty tables give an empty result.
"""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut, tidy
from creditweir.llm.suffixes import suffix_array
from creditweir.llm.words import mix, slices, text_bytes, texts_of

LENGTH = 200
#: Bytes hashed at a time.
CHUNK = 1 << 20
#: Bytes of segments in one suffix array; bytes of different segments that one gram may bring to a task.
PACK, GROUP = 1 << 15, 1 << 20
#: Bytes of a text whose grams are sorted in one task.
STRETCH = 1024
FACTORS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
PLACE_BITS = 24
LEVEL = 3


@lru_cache(maxsize=1)
def _tables() -> list[np.ndarray]:
    return [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(f)) | np.uint64(1) for f in FACTORS]


@lru_cache(maxsize=4)
def _powers(factor: int, size: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, factor, np.uint64))])


class Rolling:
    """Hashes of any stretch of some bytes, from sums up to each byte."""

    def __init__(self, data: np.ndarray, family: int):
        factor, size = FACTORS[family], 1 << max(10, (len(data)).bit_length())
        self.back = _powers(pow(factor, -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_tables()[family][data] * _powers(factor, size)[: len(data)], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.back[begins] + (ends - begins).astype(np.uint64))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(MASK))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def chunks(offsets: np.ndarray, length: int, chunk: int = CHUNK):
    """(text, first byte, last byte) of stretches that hold every window once, grouped to about ``chunk`` bytes."""
    out, held = [], 0
    for text, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        while b - a >= length:
            end = min(b, a + chunk + length - 1)
            out.append((text, a, end))
            held += end - a
            a = end - length + 1
            if held >= chunk:
                yield out
                out, held = [], 0
    if out:
        yield out


def gram_size(length: int) -> int:
    return max(1, length // 5)


def segments(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, first window (byte of the text), number of windows, gram and digest of every segment."""
    gram = gram_size(length)
    found = []
    for parts in chunks(offsets, length):
        begins = np.array([a for _, a, _ in parts])
        sizes = np.array([b - a for _, a, b in parts])
        local = np.concatenate([[0], np.cumsum(sizes)])
        bytes_ = np.concatenate([data[a:b] for _, a, b in parts])
        grams, whole = Rolling(bytes_, 0), Rolling(bytes_, 1)
        at = np.arange(len(bytes_) - gram + 1)
        keys = grams.of(at, at + gram)
        low = np.uint64((1 << PLACE_BITS) - 1)
        chosen = low - (smallest((keys & ~low) | (low - at.astype(np.uint64)), length - gram + 1) & low)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(chosen)]
        windows = np.flatnonzero(at[: len(chosen)] + length <= local[part + 1])
        place, part = chosen[windows].astype(np.int64), part[windows]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
        first = windows[new]
        count = np.diff(np.append(np.flatnonzero(new), len(windows)))
        part = part[new]
        text = np.array([t for t, _, _ in parts])[part]
        # Windows are numbered from the place of their gram, so equal segments hold equal windows.
        digest = mix(whole.of(first, first + count - 1 + length) + (place[new] - first).astype(np.uint64))
        found.append((text, first - local[part] + begins[part] - offsets[text], count, keys[place[new]], digest))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def text_ids(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of a digest of every text."""
    digests = b"".join(hashlib.blake2b(data[a:b].tobytes(), digest_size=12).digest() for a, b in zip(offsets, offsets[1:]))
    parts = np.frombuffer(digests, np.dtype([("u", "<i8"), ("v", "<i4")]))
    return parts["u"], parts["v"]


def _gram_counts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, data = text_bytes(texts_of(part, "text"))
                keys, n = np.unique(segments(offsets, data, length)[3], return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _placed(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, data = text_bytes(texts_of(part, "text"))
                u, v = text_ids(offsets, data)
                text, first, count, key, digest = segments(offsets, data, length)
                columns = [key.view(np.int64), digest.view(np.int64), u[text], v[text], first, count.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["key", "digest", "u", "v", "first", "windows"])

    return docs.mapInArrow(run, "key long, digest long, u long, v int, first long, windows int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, u, v, n_bytes, packed): texts with their ids, compressed for the way."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, u long, v int, n_bytes long, packed binary"

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, data = text_bytes(texts_of(part, "text"))
                u, v = text_ids(offsets, data)
                packed = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
                columns = [part.column("doc_id"), pa.array(u), pa.array(v), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "u", "v", "n_bytes", "packed"])

    return docs.mapInArrow(run, schema)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def repeated(contents: list[bytes], times: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows occur more than once in all of them, by one suffix array.

    ``times`` holds, for every window of a piece, how often it stands in the texts.
    """
    sizes = np.array([len(c) + 1 for c in contents])
    begins = np.cumsum(sizes) - sizes
    symbols = np.ones(int(sizes.sum()) + 1, np.int64)  # 1 ends a piece
    symbols[-1] = 0
    weight = np.zeros(len(symbols))
    for begin, content, own in zip(begins, contents, times):
        symbols[begin : begin + len(content)] = np.frombuffer(content, np.uint8).astype(np.int64) + 2
        weight[begin : begin + len(own)] = own
    order = suffix_array(symbols)
    order = order[weight[order] > 0]
    # Windows that are equal are neighbours; symbols are compared, not hashes.
    small = symbols.astype(np.int16)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 4096):
        own = np.arange(a, min(a + 4096, len(order)))
        reach = np.arange(length)
        same[own] = (small[order[own][:, None] + reach] == small[order[own - 1][:, None] + reach]).all(axis=1)
    kind = np.cumsum(~same)
    again = np.zeros(len(symbols), bool)
    again[order] = np.bincount(kind, weights=weight[order])[kind] > 1
    return [again[begin : begin + len(own)] for begin, own in zip(begins, times)]


def promising(contents: list[bytes], times: list[np.ndarray], length: int) -> list[np.ndarray]:
    """As ``repeated``; a window of which a half occurs once in all pieces is not sorted, as it cannot occur twice."""
    sizes = np.array([len(c) for c in contents])
    counts = np.array([len(t) for t in times])
    begins, ends = np.cumsum(sizes) - sizes, np.cumsum(counts)
    hashes = Rolling(np.frombuffer(b"".join(contents), np.uint8), 0)
    at = np.repeat(begins - (ends - counts), counts) + np.arange(int(counts.sum()))
    weight, open_ = np.concatenate(times), np.ones(len(at), bool)
    half = -(-length // 2)
    for shift in (0, length - half):
        _, kind = np.unique(hashes.of(at + shift, at + shift + half), return_inverse=True)
        open_ &= np.bincount(kind, weights=weight)[kind] > 1
    parts, pieces, weights = [], [], []
    for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
        for a, b in runs(open_[end - n : end]):
            parts.append((end - n + a, end - n + b + 1))
            pieces.append(contents[i][a : b + length])
            weights.append(times[i][a : b + 1])
    again = np.zeros(len(at), bool)
    for (a, b), flags in zip(parts, repeated(pieces, weights, length) if parts else ()):
        again[a:b] = flags
    return [again[end - n : end] for end, n in zip(ends.tolist(), counts.tolist())]


def joined(rows: list[dict], length: int) -> list[np.ndarray]:
    """The repeated windows of each segment; segments that follow each other in a text are sorted as one piece."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["u"], rows[i]["v"], rows[i]["first"]))
    contents, times, parts, end = [], [], [], None
    for i in order:
        r = rows[i]
        if end == (r["u"], r["v"], r["first"]):
            contents[-1][-1] = contents[-1][-1][: 1 - length] if length > 1 else contents[-1][-1]
        else:
            contents.append([])
            times.append([])
            parts.append([])
        contents[-1].append(r["content"])
        times[-1].append(np.full(r["windows"], r["times"], np.int64))
        parts[-1].append(i)
        end = r["u"], r["v"], r["first"] + r["windows"]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(rows)
    for own, flags in zip(parts, promising([b"".join(c) for c in contents], [np.concatenate(t) for t in times], length)):
        at = 0
        for i in own:
            out[i] = flags[at : at + rows[i]["windows"]]
            at += rows[i]["windows"]
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


RUNS = "key long, digest long, low int, high int"


def _as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _sorted_runs(contents: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the segments of small grams."""
    names, kinds = ["key", "digest", "low", "high"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def judged(held: list[dict]) -> pa.RecordBatch:
        found = joined(held, length)
        return _as_batch([(r["key"], r["digest"], a, b) for r, flags in zip(held, found) for a, b in runs(flags)], names, kinds)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "content"):
                for row in part.to_pylist():
                    if held and size >= PACK and held[-1]["key"] != row["key"]:
                        yield judged(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row["content"])
        if held:
            yield judged(held)

    # All segments of a gram have its leader, so they stay together; a long text is dealt in stretches.
    stretch = F.floor(F.col("leader.first") / STRETCH)
    placed = contents.repartition("leader.u", "leader.v", stretch).sortWithinPartitions("leader", "key")
    return placed.drop("leader", "crowded").mapInArrow(run, RUNS)


def _counted_runs(contents: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the segments of crowded grams, by two hashes of every window."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "content"):
                sizes = part.column("windows").to_numpy().astype(np.int64)
                joined = pa.concat_arrays([part.column("content")])
                offsets = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1].astype(np.int64)
                data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
                row = np.repeat(np.arange(len(sizes)), sizes)
                window = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = offsets[row] + window
                hashes = [Rolling(data, family).of(at, at + length).view(np.int64) for family in (0, 1)]
                own = [part.column(c).take(pa.array(row)) for c in ("key", "digest", "times")]
                yield pa.record_batch([*own, *map(pa.array, hashes), pa.array(window.astype(np.int32))], names=["key", "digest", "times", "a", "b", "window"])

    windows = cut(contents.mapInArrow(run, "key long, digest long, times long, a long, b long, window int"))
    again = windows.groupBy("a", "b").agg(F.sum("times").alias("all")).where(F.col("all") > 1).drop("all")
    kept = windows.join(again, ["a", "b"], "left_semi")
    # A segment has fewer windows than ``length``.
    step = F.transform("at", lambda x, i: F.struct((x - i).alias("run"), x.alias("x")))
    listed = kept.groupBy("key", "digest").agg(F.array_sort(F.collect_set("window")).alias("at"))
    spread = listed.select("key", "digest", F.explode(step).alias("s")).groupBy("key", "digest", "s.run")
    return spread.agg(F.min("s.x").alias("low"), F.max("s.x").alias("high")).select("key", "digest", "low", "high")


_WANTED = "key long, digest long, windows int, times long, crowded boolean, leader struct<u:long,v:int,first:long>, u long, v int, first long"


def _contents(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The wanted segments with the bytes of one occurrence."""
    names = [f.split()[0] for f in _WANTED.split(", ")]
    wanted = wanted.groupBy("u", "v").agg(F.collect_list(F.struct(*(F.col(n) for n in names))).alias("wanted"))
    # One of the rows alike in text; copies go before the shuffle.
    once = texts.groupBy("u", "v").agg(F.first("packed").alias("packed"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "packed"):
                lists = part.column("wanted")
                segments_ = lists.flatten()
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                text_of = np.repeat(np.arange(len(sizes)), sizes).tolist()
                texts_ = [unpacked(packed) for packed in part.column("packed").to_pylist()]
                places = zip(text_of, segments_.field("first").to_pylist(), segments_.field("windows").to_pylist())
                content = pa.array([texts_[t][first : first + n - 1 + length] for t, first, n in places], pa.binary())
                yield pa.RecordBatch.from_arrays([*segments_.flatten(), content], names=[*names, "content"])

    return cut(once.join(wanted, ["u", "v"]).select("packed", "wanted").mapInArrow(run, f"{_WANTED}, content binary"))


def spans(docs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(u, v, spans): the stretches of each text whose windows occur again, not yet merged."""
    often = _gram_counts(docs, length).where("n > 1").select("key")
    placed = cut(_placed(docs, length).join(often, "key", "left_semi"))
    place = F.min(F.struct("u", "v", "first")).alias("p")
    kinds = cut(placed.groupBy("key", "digest").agg(F.first("windows").alias("windows"), F.count("*").alias("times"), place))
    size = F.sum(F.col("windows") + (length - 1)).alias("bytes")
    variants = kinds.groupBy("key").agg(F.count("*").alias("variants"), size, F.min("p").alias("leader"))
    several = variants.where("variants > 1").select("key", (F.col("bytes") > GROUP).alias("crowded"), "leader")
    wanted = kinds.join(several, "key").select("key", "digest", "windows", "times", "crowded", "leader", "p.u", "p.v", "p.first")
    contents = _contents(wanted, texts, length)
    copies = kinds.join(several, "key", "left_anti").select("key", "digest", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))
    sorted_ = _sorted_runs(contents.where(~F.col("crowded")), length)
    counted = _counted_runs(contents.where("crowded").select("key", "digest", "windows", "times", "content"), length)
    found = cut(copies.unionByName(sorted_).unionByName(counted))
    begin, end = (F.col("first") + F.col("low")).alias("begin"), (F.col("first") + F.col("high") + length).alias("end")
    # Rows alike in text bring the same spans.
    hit = placed.join(found, ["key", "digest"]).select("u", "v", begin, end).distinct()
    return hit.groupBy("u", "v").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(found):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


@tidy
def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the spans removed from each text of (doc_id, text), and the bytes that stay."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = packed_texts(docs)
    found = spans(docs.select("text"), texts, length)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary"

    def run(batches):
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "packed"):
                removed, kept = [], []
                for packed, own in zip(part.column("packed").to_pylist(), part.column("spans").to_pylist()):
                    text, cuts = unpacked(packed), merged([(s["begin"], s["end"]) for s in own or ()])
                    edges = [0, *(x for cut_ in cuts for x in cut_), len(text)]
                    removed.append(cuts)
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                columns = [part.column("doc_id"), part.column("n_bytes"), pa.array(removed, kind), pa.array(kept, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "n_bytes", "removed", "kept"])

    joined = texts.join(found, ["u", "v"], "left").select("doc_id", "n_bytes", "packed", "spans")
    return joined.mapInArrow(run, schema)


def digest(result: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return result.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
