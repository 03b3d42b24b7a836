"""Lookups in literal edges, and counts of many cells in one aggregate."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bin_of(value, edges: list):
    """Number of the bin [edge, next edge) that holds a value, by halving; the last bin is closed at the top.

    Null for nulls, NaN and values outside the edges.
    """

    def search(low: int, high: int):
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(edges[middle]), search(low, middle)).otherwise(search(middle, high))

    inside = ~F.isnan(value) & (value >= F.lit(edges[0])) & (value <= F.lit(edges[-1]))
    return F.when(inside, search(0, len(edges) - 1))


def binned(df: DataFrame, values: dict, edges: dict, by: tuple = (), keep: dict = {}) -> DataFrame:
    """(*by, *keep, b0, b1, ...): the bin of every feature's value, in the order of ``edges``, and columns by name."""
    features = list(edges)
    drawn = df.select(*by, *[c.alias(name) for name, c in keep.items()], *[values[f].cast("double").alias(f"v{i}") for i, f in enumerate(features)])
    return drawn.select(*by, *keep, *[bin_of(F.col(f"v{i}"), edges[f]).alias(f"b{i}") for i, f in enumerate(features)])


def cell_counts(bins: DataFrame, edges: dict, by: tuple = (), missing: bool = False, logged: bool = False) -> DataFrame:
    """(*by, feature, bin, n) of the columns b0, b1, ...; values without a bin count only if ``missing``, with a null bin.

    A row becomes one small number a feature, which is summed where it is made: a task
    hands on one row a group and cell. (One counter a cell in a single row was measured
    too: its plan of hundreds of columns took longer than the whole count.) With
    ``logged``, ``bins`` holds flags l0, l1, ...: features that no row of a group logged
    are left out, and ``n_rows`` is the group's row count.
    """
    codes, features, numbers = [], [], []
    for p, (feature, e) in enumerate(edges.items()):
        first, inner = len(features), len(e) - 1
        code = F.col(f"b{p}") + first
        if missing:
            code = F.coalesce(code, F.lit(first + inner))
        if logged:
            code = F.when(F.col(f"l{p}"), code).otherwise(first + inner + 1)
        codes.append(code)
        # Behind a feature's bins come the cells of no bin and of rows that did not log it.
        features += [feature] * (inner + 2)
        numbers += [*range(inner), None, None]
    counted = bins.select(*by, F.explode(F.array(*codes)).alias("cell")).filter("cell IS NOT NULL").groupBy(*by, "cell").agg(F.count("*").alias("n"))
    named = counted.select(*by, F.get(F.array(*map(F.lit, features)), "cell").alias("feature"), F.get(F.array(*[F.lit(n).cast("int") for n in numbers]), "cell").alias("bin"), "n", "cell")
    if not logged:
        return named.drop("cell")
    # A few rows a group from here on.
    unlogged = [i for i, n in enumerate(numbers) if n is None and i and numbers[i - 1] is None]
    of_feature = Window.partitionBy(*by, "feature")
    heard = F.sum(F.when(~F.col("cell").isin(unlogged), F.col("n"))).over(of_feature)
    return named.withColumns({"n_rows": F.sum("n").over(of_feature), "heard": heard}).filter("heard > 0").drop("cell", "heard")


def batch_counts(df: DataFrame, edges: dict, by: tuple = ()) -> DataFrame:
    """(*by, feature, bin, n) of the columns named by ``edges``; values without a bin are left out.

    For tables with many features: as expressions their searches make a method of the JVM's that
    is too long to be compiled. Here Arrow batches are searched, with the bins of ``bin_of``;
    a row becomes a list of cells, which are counted as in ``cell_counts``.
    """
    features = [f for f, e in edges.items() for _ in e[1:]]
    numbers = [i for e in edges.values() for i in range(len(e) - 1)]
    bounds = [np.array(e, dtype=float) for e in edges.values()]
    drawn = df.select(*by, *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(edges)])

    def placed(batches):
        for batch in batches:
            cells, first = np.full((batch.num_rows, len(bounds)), -1, dtype=np.int32), 0
            for i, bound in enumerate(bounds):
                value = batch.column(len(by) + i).to_numpy(zero_copy_only=False)  # nulls as NaN
                inside = (value >= bound[0]) & (value <= bound[-1])
                cells[inside, i] = first + np.searchsorted(bound[1:-1], value[inside], "right")
                first += len(bound) - 1
            known = cells >= 0
            ends = np.concatenate([[0], np.cumsum(known.sum(axis=1))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[known]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], lists], names=[*by, "cells"])

    schema = T.StructType([*drawn.schema[: len(by)], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    counted = drawn.mapInArrow(placed, schema).select(*by, F.explode("cells").alias("cell")).groupBy(*by, "cell").agg(F.count("*").alias("n"))
    return counted.select(*by, F.get(F.array(*map(F.lit, features)), "cell").alias("feature"), F.get(F.array(*map(F.lit, numbers)), "cell").alias("bin"), "n")
