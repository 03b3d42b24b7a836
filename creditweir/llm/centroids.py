"""Operator 13: integer k-means whose nearest centroid is found by Orchard's search.

Every centroid has a list of the others, sorted by their distance from it. A vector holds
a candidate and walks the candidate's list: a closer centroid (or one as close with a
smaller number) becomes the candidate and its list is walked from the start; centroids
that were looked at are marked and not measured again; the walk stops at a neighbour
strictly further from the candidate than twice the vector's distance. Whatever lies
beyond is strictly further from the vector, so ties are never lost. All vectors of a
batch take their steps together.

Components are integers (floor of ``SCALE`` times the component) and all arithmetic is
exact: in 64 bits where that suffices, in unbounded integers where a batch holds larger
values. A task hands on one sum for each centroid and component, in limbs of 30 bits, so
neither a hot cluster nor a large value overflows, and the driver sees k x dimensions
numbers a round. The source is read once per round; nothing else is written but the
final assignment.

Vectors that are null, of another length, or with a null or non-finite component are
left out. Null ids stay, and hash as an empty id. Equal hashes (repeated ids) are ordered
by their components. With fewer vectors than ``k`` all become centroids; an empty table
gives an empty result. A distance or sum beyond 64 bits is given as the largest long.
Other columns are not read.
"""

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut, tidy
from creditweir.session import small_table

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Squared distances of integers up to this bound fit 64 bits with room for four times their value.
EXACT = 1 << 25
LIMB = 30
ROWS_AT_ONCE = 4096
LARGEST = (1 << 63) - 1


class Vectors(NamedTuple):
    rows: np.ndarray  # positions of the kept rows in the batch
    values: np.ndarray  # kept x dimensions, int64, or Python integers where they are large


def integers(column: pa.Array, dimensions: int, scale: int) -> Vectors:
    """The kept vectors of a list column as integers."""
    column = column.cast(pa.list_(pa.float64()))
    right = pc.equal(pc.list_value_length(column), dimensions).fill_null(False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    flat = column.take(pa.array(rows)).flatten()
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)
    finite = np.isfinite(values).all(axis=1)
    rows, values = rows[finite], values[finite]
    if not len(values) or np.abs(values).max() * scale < EXACT:
        return Vectors(rows, np.floor(values * scale).astype(np.int64))
    # Python's ratio of a double is exact, so neither the product nor the floor rounds.
    exact = [[scale * n // d for n, d in (x.as_integer_ratio() for x in row)] for row in values.tolist()]
    return Vectors(rows, np.array(exact, object).reshape(len(rows), dimensions))


def squares(differences: np.ndarray) -> np.ndarray:
    if differences.dtype == object:
        return (differences * differences).sum(axis=1)
    return np.einsum("ij,ij->i", differences, differences)


class Orchard:
    """Centroids with their neighbour lists."""

    def __init__(self, centroids: list[list[int]]):
        small = max((abs(x) for c in centroids for x in c), default=0) < EXACT
        self.points = np.array(centroids, np.int64 if small else object)
        apart = [squares(self.points - p) for p in self.points]
        order = [np.argsort(a, kind="stable") for a in apart]
        self.lists = np.array([o[o != i] for i, o in enumerate(order)], np.int64).reshape(len(centroids), -1)
        self.reach = np.array([a[near] for a, near in zip(apart, self.lists)], self.points.dtype).reshape(self.lists.shape)

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance of every row, and how many distances were measured."""
        if values.dtype != self.points.dtype:
            values = values.astype(object)
        points = self.points if self.points.dtype == values.dtype else self.points.astype(object)
        n = len(values)
        best = np.zeros(n, np.int64)
        far = squares(values - points[0])
        measured = n
        seen = np.zeros((n, len(points)), bool)
        seen[:, 0] = True
        step = np.zeros(n, np.int64)
        active = np.arange(n) if len(points) > 1 else np.zeros(0, np.int64)
        while len(active):
            at = best[active], step[active]
            # Beyond twice the distance: four times in squares.
            active = active[~(self.reach[at] > 4 * far[active]).astype(bool)]
            other = self.lists[best[active], step[active]]
            fresh = ~seen[active, other]
            looked, other = active[fresh], other[fresh]
            seen[looked, other] = True
            distance = squares(values[looked] - points[other])
            measured += len(looked)
            closer = ((distance < far[looked]) | ((distance == far[looked]) & (other < best[looked]))).astype(bool)
            step[active] += 1
            moved = looked[closer]
            best[moved], far[moved], step[moved] = other[closer], distance[closer], 0
            active = active[step[active] < self.lists.shape[1]]
        return best, far, measured


def limbs(total: int) -> list[int]:
    """Signed limbs of 30 bits, lowest first."""
    sign, rest, out = (-1 if total < 0 else 1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out or [0]


def _sums(vectors: DataFrame, centroids: list[list[int]], dimensions: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each non-empty cluster."""

    def run(batches):
        orchard = Orchard(centroids)
        counts, totals = [0] * len(centroids), [[0] * dimensions for _ in centroids]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                values = integers(batch.column(0).slice(first, ROWS_AT_ONCE), dimensions, scale).values
                best, _, _ = orchard.nearest(values)
                for c in np.unique(best).tolist():
                    own = values[best == c]
                    counts[c] += len(own)
                    totals[c] = [a + b for a, b in zip(totals[c], own.sum(axis=0).tolist())]
        out = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        out += [(c, d, k, x) for c, n in enumerate(counts) if n for d, total in enumerate(totals[c]) for k, x in enumerate(limbs(total))]
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.record_batch(columns, names=["cluster", "dimension", "limb", "total"])

    parts = vectors.mapInArrow(run, "cluster int, dimension int, limb int, total long")
    # At most k x dimensions x limbs rows, whatever the input.
    found = parts.groupBy("cluster", "dimension", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums: dict[int, tuple[int, list[int]]] = {}
    counts = {r["cluster"]: int(r["total"]) for r in found if r["dimension"] < 0}
    for c, n in counts.items():
        sums[c] = n, [0] * dimensions
    for r in found:
        if r["dimension"] >= 0:
            sums[r["cluster"]][1][r["dimension"]] += int(r["total"]) << (LIMB * r["limb"])
    return sums


def first_centroids(vectors: DataFrame, k: int, dimensions: int, scale: int) -> list[list[int]]:
    """The kept vectors with the smallest sha256 of their id."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    right = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.where(right).select(F.sha2(name, 256).alias("hash"), "embedding").orderBy("hash", "embedding").limit(k)
    rows = [r["embedding"] for r in chosen.collect()]  # k rows
    return integers(pa.array(rows, pa.list_(pa.float64())), dimensions, scale).values.tolist()


@tidy
def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of (vec_id, embedding)."""
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = first_centroids(vectors, k, dimensions, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _sums(vectors.select("embedding"), centroids, dimensions, scale).items():
            centroids[c] = [x // n for x in total]

    def run(batches):
        orchard = Orchard(centroids) if centroids else None
        for batch in batches:
            for first in range(0, batch.num_rows if orchard else 0, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                rows, values = integers(part.column("embedding"), dimensions, scale)
                best, far, _ = orchard.nearest(values)
                ids = part.column("vec_id").take(pa.array(rows))
                distances = pa.array([min(int(x), LARGEST) for x in far], pa.int64())
                yield pa.record_batch([ids, pa.array(best.astype(np.int32)), distances], names=["vec_id", "cluster", "distance"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    assigned = cut(vectors.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long"))
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(exact).collect()}  # k rows
    inertia = min(sum(totals.values()), LARGEST)
    described = [
        (c, min(total, LARGEST), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, total in sorted(totals.items())
    ]
    table = small_table(vectors.sparkSession, described, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(table), "cluster")  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
