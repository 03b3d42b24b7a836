"""Operator 5: near copies by fast similarity sketching, banding and exact verification.

A text is the set of its distinct word shingles. Its sketch has ``BINS`` coordinates:
in round i every element is hashed to one bin and the bin keeps its smallest value,
ordered by round first, until every bin holds something (after ``BINS`` hashed rounds,
round BINS + k places all elements in bin k, so every coordinate fills). The share of
equal coordinates has the concentration of that many independent minima, for sets of any
size. ``BANDS`` bands of ``ROWS`` coordinates give candidates: a pair at similarity 0.8
shares none with probability 1e-8.

Equal sets form one class first, so copies are never paired. Links between classes are
decided on full sets, in two rounds. Round 1 compares each class with the pivot of each
of its bands, the class with most company (a star, not all pairs), and keeps what the
class lacks of the pivot's set and has beyond it. With P the pivot's size, two members of
a band share P less what either lacks, plus what both have beyond it: round 2 needs these
differences only, and no text. It compares the members of a band that are not yet in one
component, block by block, exactly, and hands on the links that join two components, so
a block gives fewer rows than it has members. Members of a band's largest component do
not meet each other. What round 2 leaves out is connected already, so components lose no
link. Texts meet their pivot's; a class with many partners is split over salted groups,
each with one copy of its text.

Null texts and texts without words have an empty set and link with nothing; a text with
fewer words than a shingle is one element. Repeated ids are judged row by row. Null ids
are allowed; a component of null ids alone has a null component id. Empty tables give
an empty result. Other columns are not read.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.components import components
from creditweir.llm.scratch import cut, tidy
from creditweir.llm.words import mix, slices, split_words, texts_of, word_hashes

BANDS, ROWS = 60, 6
BINS = BANDS * ROWS
#: Sets that are sketched at a time.
SKETCHED_SETS = 1024
#: Partners of one class that are confirmed in one group; members of a band compared in one block.
GROUP, BLOCK = 500, 1024
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SKETCHED = "uid long, doc_id long, text_hash long, n long, digest binary, keys array<long>"


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII lower case."""
    words = split_words(pc.ascii_lower(texts))
    hashed = word_hashes(words.vocabulary)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = max(0, len(hashed) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n])
    out = []
    for a, b in zip(words.starts.tolist(), words.starts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:  # the whole sequence is the one element; its length keeps it apart
            value = np.array([b - a], np.uint64)
            for h in hashed[a:b]:
                value = mix(value * np.uint64(0xD6E8FEB86659FD93) + h)
            out.append(value)
        else:
            out.append(rolled[:0])
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Coordinates of the sets (rows); empty sets keep an empty row."""
    table = np.full((len(sets), BINS), _EMPTY, np.uint64)
    active = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    flat = table.reshape(-1)
    elements = np.concatenate([sets[i] for i in active]) if len(active) else np.zeros(0, np.uint64)
    owner = np.repeat(active, [len(sets[i]) for i in active])
    for round_ in range(2 * BINS):
        if not len(active):
            break
        h = mix(elements + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64) if round_ < BINS else round_ - BINS
        value = (np.uint64(round_) << np.uint64(53)) | (mix(h) >> np.uint64(11))
        np.minimum.at(flat, owner * BINS + place, value)
        open_ = (table[active] == _EMPTY).any(axis=1)
        if not open_.all():
            still = np.zeros(len(sets), bool)
            still[active[open_]] = True
            keep = still[owner]
            active, elements, owner = active[open_], elements[keep], owner[keep]
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row; its last six bits are the band."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(table), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, r : BANDS * ROWS : ROWS])
    return (keys & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)


def digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """One written row per document; texts are read once."""

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part, "text"), width)
                keys = []
                for i in range(0, len(sets), SKETCHED_SETS):
                    keys += list(band_keys(sketch(sets[i : i + SKETCHED_SETS])).view(np.int64))
                uid = row + np.arange(len(sets))
                row += len(sets)
                filled = [len(s) > 0 for s in sets]
                yield pa.record_batch(
                    [
                        pa.array(uid), part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array([k if f else None for k, f in zip(keys, filled)], pa.list_(pa.int64())),
                    ],
                    names=["uid", "doc_id", "text_hash", "n", "digest", "keys"],
                )

    return cut(docs.mapInArrow(run, SKETCHED))


TESTED = "a long, b long, na long, nb long, link boolean, lacks binary, beyond binary"


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with the sizes of their full sets, whether they link, and what b lacks of a and has beyond it."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    salts = F.ceil(F.col("partners") / GROUP).cast("int")
    members = pairs.join(sizes, "a").select(
        "a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), F.lit(1).alias("side"), F.col("b").alias("cid")
    )
    firsts = sizes.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("cid"))
    wanted = members.unionByName(firsts)
    either = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    needed = either.join(classes, "cid")
    # The hash of the text keeps other rows with this id away; the digest decides.
    same_row = needed["least"].eqNullSafe(docs["doc_id"]) & (needed["text_hash"] == docs["text_hash"])
    found = needed.join(docs, same_row).select("cid", "digest", "text")
    texts = cut(found)
    rows = wanted.join(texts, "cid").repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "cid")

    def run(batches):
        current, held, last = None, None, None
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part, "text"), width)
                judged = []
                for r, own in zip(part.select(["a", "salt", "side", "cid", "digest"]).to_pylist(), sets):
                    if digest(own) != r["digest"]:
                        continue
                    group = (r["a"], r["salt"])
                    if r["side"] == 0:
                        current, held, last = group, own, None
                    elif current == group and last != r["cid"]:  # repeated rows bring a text twice
                        last = r["cid"]
                        beyond = own[~np.isin(own, held, assume_unique=True)]
                        lacks = held[~np.isin(held, own, assume_unique=True)]
                        common = len(own) - len(beyond)
                        link = 100 * common >= percent * (len(held) + len(beyond))
                        judged.append((r["a"], r["cid"], len(held), len(own), link, lacks.tobytes(), beyond.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                columns = [pa.array([x[i] for x in judged], kind) for i, kind in enumerate(kinds)]
                yield pa.record_batch(columns, names=["a", "b", "na", "nb", "link", "lacks", "beyond"])

    return cut(rows.mapInArrow(run, TESTED))


class _Differences:
    """Sets of numbers, one for each member, and how many each shares with one of them."""

    def __init__(self, packed: list[bytes]):
        sets = [np.frombuffer(p, np.uint64) for p in packed]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes, self.ends = codes, np.cumsum(self.sizes)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.marks = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)

    def shared(self, i: int) -> np.ndarray:
        own = self.codes[self.ends[i] - self.sizes[i] : self.ends[i]]
        self.marks[own] = True
        out = np.bincount(self.owner, weights=self.marks[self.codes], minlength=len(self.sizes)).astype(np.int64)
        self.marks[own] = False
        return out


def joining_links(frame: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between members of a block that join their components, no more than that takes."""
    pivot = frame["base"].max()
    frame = frame[frame["base"].notna() | (frame["cid"] == frame["first"])]
    if len(frame) < 2 or not pivot == pivot:
        return []
    cid = frame["cid"].to_numpy()
    _, root = np.unique(frame["comp"].to_numpy(), return_inverse=True)
    lacks, beyond = _Differences(list(frame["lacks"])), _Differences(list(frame["beyond"]))
    kept = int(pivot) - lacks.sizes
    size = kept + beyond.sizes
    far = 1 - kept / (int(pivot) + beyond.sizes)
    reach = 1 - percent / 100 + 1e-9  # the Jaccard distance keeps the triangle inequality
    out = []
    for i in np.flatnonzero(root != np.bincount(root).argmax()).tolist():
        near = (root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        near &= np.abs(far - far[i]) <= reach
        if not near.any():
            continue
        common = kept - lacks.sizes[i] + lacks.shared(i) + beyond.shared(i)
        for j in np.flatnonzero(near & (100 * common >= percent * (size + size[i] - common))).tolist():
            if root[j] != root[i]:
                out.append((min(cid[i], cid[j]), max(cid[i], cid[j])))
                root[root == root[j]] = root[i]
    return out


def _blocks(percent: int):
    def run(frames):
        waiting = None
        for frame in frames:
            frame = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            last = (frame["key"] == frame["key"].iloc[-1]) & (frame["i"] == frame["i"].iloc[-1]) & (frame["j"] == frame["j"].iloc[-1])
            waiting, ready = frame[last], frame[~last]
            found = [p for _, group in ready.groupby(["key", "i", "j"], sort=False) if len(group) > 1 for p in joining_links(group, percent)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if waiting is not None:
            yield pd.DataFrame(joining_links(waiting, percent), columns=["a", "b"], dtype="int64")

    return run


def links_apart(keys: DataFrame, comp: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Links that join two components, between classes that share a band."""
    labelled = keys.join(comp, keys["cid"] == comp["node"], "left").select(*keys.columns, F.coalesce("label", "cid").alias("comp"))
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("largest"), F.sum("members").alias("all"), F.count("*").alias("parts"))
    mixed = mixed.where("parts > 1").select("key", F.col("largest.comp").alias("hub"), F.col("largest.members").alias("inside"), "all")
    inside, outside = (F.ceil(n / BLOCK).cast("int") for n in (F.col("inside"), F.col("all") - F.col("inside")))
    of_hub = F.col("comp") == F.col("hub")
    # Blocks of other members come first; those of the largest component meet these, not each other.
    own = F.when(of_hub, outside + F.pmod(F.xxhash64("cid"), inside)).otherwise(F.pmod(F.xxhash64("cid"), outside)).cast("int")
    met = F.explode(F.sequence(F.lit(0), outside - 1 + F.when(of_hub, 0).otherwise(inside))).alias("other")
    known = tested.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "a", "na", "nb", "lacks", "beyond")
    forward, self_ = F.col("a") == F.col("first"), F.col("first") == F.col("cid")
    nothing = F.lit(b"")
    members = (
        labelled.join(mixed, "key")
        .withColumns({"low": F.least("first", "cid"), "high": F.greatest("first", "cid")})
        .join(known, ["low", "high"], "left")
        .select(
            "key", "cid", "first", "comp",
            F.when(forward, F.col("na")).otherwise(F.col("nb")).alias("base"),
            F.when(self_, nothing).when(forward, F.col("lacks")).otherwise(F.col("beyond")).alias("lacks"),
            F.when(self_, nothing).when(forward, F.col("beyond")).otherwise(F.col("lacks")).alias("beyond"),
            own.alias("own"), met,
        )
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("own", "other")
    )
    spread = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cut(spread.mapInPandas(_blocks(percent), "a long, b long"))


@tidy
def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = sketched(docs, width)
    filled = rows.where("digest IS NOT NULL")
    # The smallest id of a class, and the text of a row that has it.
    hash_ = F.min_by("text_hash", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("text_hash")
    class_ids = cut(filled.groupBy("digest").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least"), hash_))
    firsts = class_ids.select("cid").join(filled.select("uid", "keys"), F.col("cid") == F.col("uid"))
    exploded = firsts.select("cid", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    keys = cut(exploded.join(shared, "key"))  # only bands that hold two classes or more
    company = keys.groupBy("cid").agg(F.sum("members").alias("company"))
    pivots = keys.join(company, "cid").groupBy("key").agg(F.max(F.struct("company", "cid"))["cid"].alias("first"))
    keys = cut(keys.join(pivots, "key").drop("members"))

    low, high = F.least("first", "cid").alias("low"), F.greatest("first", "cid").alias("high")
    pairs = keys.where("first != cid").groupBy(low, high).agg(F.min(F.struct("first", "cid")).alias("p")).select("p.first", "p.cid").toDF("a", "b")
    tested = compared(cut(pairs), class_ids, docs, width, percent)
    links = tested.where("link").select("a", "b")
    links = links.unionByName(links_apart(keys, components(links), tested, percent))

    joined = class_ids.join(components(links), F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = joined.join(smallest, "label").select("digest", "component_id")
    result = rows.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
