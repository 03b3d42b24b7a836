"""Integer k-means against exact integers in Python."""

import hashlib
import math
import random

import numpy as np

from creditweir.llm import centroids


def plain(rows, k, rounds, dimensions, scale):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else scale * int(x) for x in v]) for i, v in rows if v and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    points = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((apart(v, p), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        of = [c for _, c in assign()]
        for c in set(of):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            points[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    top = (1 << 63) - 1
    inertia = {c: sum(min(d, top) for d, o in found if o == c) for _, c in found}
    total = min(sum(inertia.values()), top)
    named = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i is None, i or 0), c, min(d, top), min(inertia[c], top), total, named[c]) for (i, _), (d, c) in zip(kept, found))


def compare(spark, rows, kind="double", **settings):
    schema = f"vec_id long, embedding array<{kind}>, cluster string, distance int"
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], schema)
    options = {"k": 4, "rounds": 3, "dimensions": 3, "scale": 64} | settings
    got = centroids.cluster(df, **options).collect()
    ids = lambda i: (i is None, i or 0)
    assert sorted((ids(r[0]), *tuple(r)[1:]) for r in got) == plain(rows, **options)


def test_random_ties_nulls_and_repeats(spark):
    random.seed(1)
    rows = [(i, [random.randint(-2, 2) / 64 for _ in range(3)]) for i in range(300)]
    rows += [(None, [0.1, 0.2, 0.3]), (None, None), (7, [0.1, None, 0.2]), (8, [0.1, float("nan"), 0.2]), (9, [float("inf"), 0.0, 0.0])]
    rows += [(10, []), (11, [0.1, 0.2]), (12, [0.0] * 4), (3, [1.0, 1.0, 1.0]), *rows[:40]]
    compare(spark, rows)
    compare(spark, rows, k=1)
    compare(spark, rows[:3], k=16)


def test_large_components(spark):
    rows = [(i, [x * 1e30, -x * 3e18, x * 1e-3]) for i, x in enumerate([1.0, -1.0, 2.5, 7.0, 0.0, 1.0, 1.5])]
    compare(spark, rows)
    compare(spark, rows + [(20 + i, [0.1 * i, 0.2, 0.3]) for i in range(30)])


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []


def test_walk_measures_fewer_distances():
    """Far centroids are skipped, and the answers stay those of all distances."""
    rng = np.random.default_rng(2)
    spots = rng.integers(-1000, 1000, (64, 8))
    values = (spots[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    best, far, measured = centroids.Orchard(spots.tolist()).nearest(values)
    all_ = ((values[:, None, :] - spots[None]) ** 2).sum(axis=2)
    assert (best == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()
    assert measured < 0.5 * all_.size
