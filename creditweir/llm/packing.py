"""Operator 10: best-fit packing by a grouping genetic algorithm on islands.

Pieces of at most ``capacity`` tokens are dealt evenly into blocks; each block is a
packing problem of bounded size that several islands solve side by side. A member of
an island's population is a packing (a bin per piece). Crossover takes well-filled
bins of one parent whole, drops the other parent's bins that share a piece with them,
and best-fits the displaced pieces. Between epochs each island sends its elite to the
next island of its block. Islands stop at the lower bound (Martello and Toth's L2).
Sparse bins of all blocks are then dissolved and packed again across blocks.

Only piece lengths take part; texts and ids stay where they are. Null texts are empty
(one end id). An empty table gives no rows. Rows that repeat are packed each for
itself, since every row has an id of its own. Other columns are not read.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut, tidy
from creditweir.llm.tokens import encoder
from creditweir.llm.words import slices, texts_of

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 4, 6
#: Bins filled less than this share are dissolved for the last round.
SPARSE = 0.98


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Token pieces of every document; only longer documents are cut."""

    def split(batches):
        encode, row = encoder(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = encode.encode(texts_of(part, "text"), end_id)
                counts = np.diff(starts)
                each = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), each)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                begin = number * capacity
                length = np.minimum(capacity, counts[doc] - begin)
                data, at = ids.astype("<u4", copy=False), starts[doc] + begin
                sums = [zlib.crc32(data[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
                uid = row + np.arange(len(doc))
                row += len(doc)
                columns = [pa.array(uid), part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)),
                           pa.array(begin), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.record_batch(columns, names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(narrow.mapInArrow(split, PIECES))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """L2: no packing has fewer bins."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    upto, weight = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)
    large = len(lengths) - upto[capacity - k]
    half = capacity // 2
    middle = upto[capacity - k] - upto[half]
    room = middle * capacity - (weight[capacity - k] - weight[half])
    below = np.where(k > 0, weight[np.maximum(k - 1, 0)], 0)
    rest = np.maximum(0, weight[half] - below - room)
    return int((large + middle + -(-rest // capacity)).max())


class _Bins:
    """Open bins by free room; the fullest bin that takes a piece is found by bits."""

    def __init__(self, capacity: int):
        self.capacity, self.bits = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_: int, room: int):
        if room > 0:
            self.by_room[room].append(bin_)
            self.bits |= 1 << room

    def take(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if not fits:
            return -1, self.capacity
        room = length + (fits & -fits).bit_length() - 1
        found = self.by_room[room]
        bin_ = found.pop()
        if not found:
            self.bits &= ~(1 << room)
        return bin_, room


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Places the pieces of ``order`` in turn; ``bins`` has -1 for pieces without a bin."""
    open_ = _Bins(capacity)
    placed = np.flatnonzero(bins >= 0)
    used = np.bincount(bins[placed], weights=lengths[placed]).astype(np.int64) if len(placed) else np.zeros(0, np.int64)
    for b in np.flatnonzero((used > 0) & (used < capacity)).tolist():
        open_.put(b, capacity - int(used[b]))
    following, chosen = len(used), []
    for length in lengths[order].tolist():
        b, room = open_.take(length)
        if b < 0:
            b, following = following, following + 1
        chosen.append(b)
        open_.put(b, room - length)
    bins = bins.copy()
    bins[order] = chosen
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones: smaller is better."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return len(fill), -float(np.mean(fill * fill))


def cross(lengths, first, second, capacity, rng) -> np.ndarray:
    """Bins of ``first`` after it has taken in well-filled bins of ``second``."""
    fill = np.bincount(second, weights=lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 3), replace=False)] = True
    taken = chosen[second]
    hit = np.zeros(first.max() + 1, bool)
    hit[first[taken]] = True
    # One sparse bin goes as well, so that the number of bins can fall.
    own = np.bincount(first, weights=lengths)
    hit[rng.choice(np.argsort(own)[: max(2, len(own) // 50)])] = True
    child = np.where(taken, second + first.max() + 1, np.where(hit[first], -1, first))
    loose = np.flatnonzero(child < 0)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    return best_fit(lengths, order, child, capacity)


def seeds(lengths, capacity, rng, size: int) -> list[np.ndarray]:
    """Best fit by falling length, then by lengths shaken a little more each time."""
    none = np.full(len(lengths), -1, np.int64)
    out = []
    for k in range(size):
        order = np.argsort(-(lengths * (1 + rng.uniform(-0.1, 0.1, len(lengths)) * k)), kind="stable")
        out.append(best_fit(lengths, order, none, capacity))
    return out


def evolve(lengths, population, capacity, rng) -> list[np.ndarray]:
    """Generations of one island; the best POPULATION members stay, best first."""
    bound = lower_bound(lengths, capacity)

    def rank(members):
        return sorted(members, key=lambda m: fitness(lengths, m, capacity))[:POPULATION]

    population = rank(population)
    for _ in range(GENERATIONS):
        if int(population[0].max()) + 1 <= bound or len(population) < 2:
            break
        children = []
        for i in range(len(population)):
            mate = population[int(rng.integers(len(population) - 1))] if i else population[-1]
            if mate is population[i]:
                mate = population[-1] if i < len(population) - 1 else population[0]
            children.append(cross(lengths, population[i], mate, capacity, rng))
        population = rank(population + children)
    return population


STATE = "block long, island int, bins int, bound int, uids array<long>, lengths array<int>, members array<array<int>>"


def _island_step(capacity: int, epoch: int):
    def step(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                lengths = np.asarray(r.lengths, np.int64)
                rng = np.random.default_rng([abs(int(r.block)), int(r.island), epoch])
                members = [np.asarray(m, np.int32) for m in r.members]
                if not members:
                    members = seeds(lengths, capacity, rng, POPULATION if r.island else 1)
                    if not r.island and int(members[0].max()) + 1 > lower_bound(lengths, capacity):
                        members += seeds(lengths, capacity, rng, POPULATION)[1:]
                members = evolve(lengths, members, capacity, rng)
                rows.append((r.block, r.island, int(members[0].max()) + 1, lower_bound(lengths, capacity), r.uids, r.lengths, members))
            yield pd.DataFrame(rows, columns=["block", "island", "bins", "bound", "uids", "lengths", "members"])

    return step


def _spread(df: DataFrame, blocks: int) -> DataFrame:
    """A block is seconds of work, so blocks are dealt over the tasks, not merged into few."""
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(blocks, max(at_least, 8 * int(df.sparkSession.sparkContext.defaultParallelism)))), "block", "island")


def pack_round(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(uid, block, bin, offset, length, fill) for (uid, length), packed block by block."""
    blocks = max(1, -(-items.count() // BLOCK))
    # uid is unique, so blocks are even whatever the lengths or documents are.
    block = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks))
    grouped = (
        items.select(block.alias("block"), F.struct("uid", F.col("length").cast("int").alias("length")).alias("item"))
        .groupBy("block")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths"))
    )
    empty = F.array().cast("array<array<int>>")
    state = grouped.select("block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "uids", "lengths", empty.alias("members"))
    state = cut(_spread(state, blocks * ISLANDS).mapInPandas(_island_step(capacity, 0), STATE))
    for epoch in range(1, EPOCHS):
        # Elite migration along the ring of a block's islands; solved blocks rest.
        best = state.groupBy("block").agg(F.min("bins").alias("least"), F.max("bound").alias("bound"))
        busy = best.where("least > bound").select("block")
        moving = state.join(busy, "block", "left_semi")
        elite = moving.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("members", 1, 1).alias("elite"))
        joined = moving.join(elite, ["block", "island"]).select(
            "block", "island", "uids", "lengths", F.concat("elite", "members").alias("members")
        )
        evolved = _spread(joined, blocks * ISLANDS).mapInPandas(_island_step(capacity, epoch), STATE)
        state = cut(state.join(busy, "block", "left_anti").unionByName(evolved))
    best = state.groupBy("block").agg(
        F.min_by(F.struct("uids", "lengths", F.col("members")[0].alias("bin")), F.struct("bins", "island")).alias("best")
    )

    def place(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):
                bins, lengths = np.asarray(r.best["bin"]), np.asarray(r.best["lengths"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                fill = np.bincount(bins, weights=lengths).astype(np.int64)
                offset = np.empty(len(bins), np.int64)
                offset[order] = ends - lengths[order] - (np.cumsum(fill) - fill)[bins[order]]
                yield pd.DataFrame({"uid": np.asarray(r.best["uids"]), "block": r.block, "bin": bins.astype(np.int32), "offset": offset, "length": lengths, "fill": fill[bins]})

    return cut(best.mapInPandas(place, "uid long, block long, bin int, offset long, length long, fill long"))


@tidy
def pack(table: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a unique ``uid`` and a ``length`` of 1 to ``capacity``.

    Rows of full length are sequences by themselves. Round 0 packs the others, round 1
    the rows of its sparse bins again, so blocks share their last bins.
    """
    small = table.where(F.col("length") < capacity).select("uid", "length")
    first = pack_round(small, capacity, 0)
    sparse = F.col("fill") < F.lit(int(capacity * SPARSE))
    second = pack_round(first.where(sparse).select("uid", "length"), capacity, 1)

    def numbered(placed, round_):
        number = (F.lit(2 * round_ + 1) * F.lit(1 << 60)) + F.col("block") * F.lit(1 << 20) + F.col("bin")
        return placed.select("uid", number.alias("sequence_id"), "offset")

    bins = numbered(first.where(~sparse), 0).unionByName(numbered(second, 1))
    full = table.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    return table.where(F.col("length") < capacity).join(bins, "uid").unionByName(full)
