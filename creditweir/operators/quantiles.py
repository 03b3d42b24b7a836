"""Exact, linearly interpolated quantiles by narrowing brackets.

``percentile`` would gather every distinct value of a column in one task. Here
a sketch first brackets each wanted rank; one more pass counts the rows around
the brackets exactly and tallies only the few values inside them. A bracket
that still holds many distinct values is narrowed again, so the result is exact
at any size while only counts and short value lists reach the driver.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.session import cut

SKETCH_ACCURACY = 10000
MAX_LISTED_VALUES = 20000


@dataclass(frozen=True)
class Zone:
    """A single value, or an open interval that may be unbounded (None).

    Values of ``listed`` intervals are tallied one by one, others only counted.
    """

    low: float
    high: float
    listed: bool
    is_point: bool = False

    def holds(self, value):
        if self.is_point:
            return value == self.low
        above = F.lit(True) if self.low is None else value > self.low
        return above if self.high is None else above & (value < self.high)


def _number(column: str):
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _profile(df: DataFrame, wanted: dict) -> dict:
    """Row count, and a sketch value for each wanted fraction, per column."""
    aggregates = []
    for column, fractions in wanted.items():
        aggregates.append(F.count(_number(column)).alias(f"n:{column}"))
        aggregates.append(
            F.percentile_approx(_number(column), [float(f) for f in fractions], SKETCH_ACCURACY).alias(f"s:{column}")
        )
    row = df.agg(*aggregates).first()
    return {c: (row[f"n:{c}"], row[f"s:{c}"]) for c in wanted}


def _zones(ranges: list) -> list:
    """Cut the real line at both ends of every bracket.

    Each end is a zone of its own, so a zone that has to be cut again always
    loses at least one value and the narrowing comes to an end.
    """
    points = sorted({end for bracket in ranges for end in bracket})
    zones = [Zone(None, points[0], False)]
    for point, following in zip(points, [*points[1:], None]):
        zones.append(Zone(point, point, True, True))
        listed = following is not None and any(low <= point and high >= following for low, high in ranges)
        zones.append(Zone(point, following, listed))
    return zones


def _tally(df: DataFrame, zones: dict) -> DataFrame:
    """(column_name, zone, value, n), written once; the value only in listed zones.

    Other zones collapse to one row an Arrow batch and column before the shuffle, and so does any
    value that repeats. There are a few zones per wanted rank and column.
    """
    columns = list(zones)
    drawn = df.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    points = [np.array([z.low for z in zones[c] if z.is_point], dtype=float) for c in columns]
    listed = [np.array([z.listed for z in zones[c]]) for c in columns]

    def zone_of(value, points):
        """2k between the points k - 1 and k, 2k + 1 on the point k (counted from 0)."""
        return np.searchsorted(points, value) + np.searchsorted(points, value, "right")

    def count(batches):
        for batch in batches:
            found = []
            for i in range(len(columns)):
                value = batch.column(i).to_numpy(zero_copy_only=False)  # nulls as NaN
                value = value[~np.isnan(value)]
                zone = zone_of(value, points[i])
                is_listed = listed[i][zone]
                rows = np.bincount(zone[~is_listed], minlength=len(listed[i]))
                counted = np.flatnonzero(rows)
                single, times = np.unique(value[is_listed], return_counts=True)
                zone = np.concatenate([counted, zone_of(single, points[i])])
                value = np.concatenate([np.full(len(counted), np.nan), single])
                found.append((np.full(len(zone), i), zone, value, np.concatenate([rows[counted], times])))
            position, zone, value, n = (np.concatenate(arrays) for arrays in zip(*found))
            arrays = [pa.array(position, pa.int32()), pa.array(zone, pa.int32()), pa.array(value, mask=np.isnan(value)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["position", "zone", "value", "n"])

    placed = drawn.mapInArrow(count, "position int, zone int, value double, n bigint")
    counted = placed.groupBy("position", "zone", "value").agg(F.sum("n").alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return cut(counted.select(F.get(names, F.col("position")).alias("column_name"), "zone", "value", "n"))


def _ranks(n: int, probability: float) -> tuple:
    """The two 0-based ranks around a quantile and the weight of the upper one."""
    position = probability * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _zone_counts(tally: DataFrame) -> dict:
    """{(column, zone): (rows, distinct listed values)}."""
    counts = tally.groupBy("column_name", "zone").agg(F.sum("n").alias("n"), F.count("value").alias("n_values"))
    return {(r["column_name"], r["zone"]): (r["n"], r["n_values"]) for r in counts.collect()}


def _listed_values(rows: list) -> dict:
    """{(column, zone): sorted [(value, rows)]} of collected tally rows."""
    values = {}
    for r in rows:
        if r["value"] is not None:
            values.setdefault((r["column_name"], r["zone"]), []).append((r["value"], r["n"]))
    return {key: sorted(pairs) for key, pairs in values.items()}


def _place(ranks: set, zones: list, column: str, counts: dict) -> list:
    """(rank, zone, rank within the zone) for the wanted ranks of a column."""
    below, starts = 0, []
    for number in range(len(zones)):
        n = counts.get((column, number), (0, 0))[0]
        if n:
            starts.append((below, number))
        below += n
    out = []
    for rank in ranks:
        start, number = max(s for s in starts if s[0] <= rank)
        out.append((rank, number, rank - start))
    return out


def _order_statistics(df: DataFrame, ranges: dict, targets: dict) -> dict:
    """Exact value at each target rank: {(column, rank): value}."""
    found, wanted = {}, {c: set(r) for c, r in targets.items() if r}
    while wanted:
        zones = {c: _zones(ranges[c]) for c in wanted}
        tally = _tally(df, zones)
        # The tally is short unless a bracket is still crowded.
        rows = tally.limit(MAX_LISTED_VALUES + 1).collect()
        short = len(rows) <= MAX_LISTED_VALUES
        if short:
            counts = {}
            for r in rows:
                n, n_values = counts.get((r["column_name"], r["zone"]), (0, 0))
                counts[(r["column_name"], r["zone"])] = (n + r["n"], n_values + (r["value"] is not None))
        else:
            counts = _zone_counts(tally)
        ready, again = {}, {}
        for column, ranks in wanted.items():
            for rank, number, offset in _place(ranks, zones[column], column, counts):
                n, n_values = counts[(column, number)]
                if zones[column][number].listed and n_values <= MAX_LISTED_VALUES:
                    ready.setdefault((column, number), []).append((rank, offset))
                else:
                    again.setdefault((column, number), []).append((rank, offset, n))
        if ready and not short:
            rows = tally.filter(F.concat_ws(":", "zone", "column_name").isin([f"{z}:{c}" for c, z in ready])).collect()
        values = _listed_values(rows)
        for (column, number), asked in ready.items():
            for rank, offset in asked:
                found[(column, rank)] = _at_offset(values[(column, number)], offset)
        ranges, wanted = _narrowed(df, zones, again)
    return found


def _at_offset(values: list, offset: int):
    seen = 0
    for value, n in values:
        seen += n
        if offset < seen:
            return value
    raise AssertionError("a rank lies beyond its zone")


def _narrowed(df: DataFrame, zones: dict, crowded: dict) -> tuple:
    """New brackets inside the zones that were only counted or are still crowded, all in one aggregate."""
    if not crowded:
        return {}, {}
    sketches = []
    for i, ((column, number), asked) in enumerate(crowded.items()):
        value = _number(column)
        fractions = [f for _, offset, n in asked for f in _bracket_fractions(offset / max(n - 1, 1))]
        inside = F.when(zones[column][number].holds(value), value)
        sketches.append(F.percentile_approx(inside, [float(f) for f in fractions], SKETCH_ACCURACY).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    ranges, wanted = {}, {}
    for i, ((column, _), asked) in enumerate(crowded.items()):
        sketch = row[f"s{i}"]
        ranges.setdefault(column, []).extend(zip(sketch[::2], sketch[1::2]))
        wanted.setdefault(column, set()).update(rank for rank, _, _ in asked)
    return ranges, wanted


def _bracket_fractions(probability: float) -> list:
    margin = 2.0 / SKETCH_ACCURACY
    return [max(0.0, probability - margin), min(1.0, probability + margin)]


def exact_quantiles(df: DataFrame, probabilities: dict) -> dict:
    """Quantiles per column: {column: [value, ...]}; None for an empty column.

    ``probabilities`` maps each column to its wanted probabilities. Nulls and
    NaN are left out. Interpolation is linear between neighbouring ranks.
    """
    wanted = {c: [f for p in ps for f in _bracket_fractions(p)] for c, ps in probabilities.items()}
    sketches = _profile(df.select(*probabilities), wanted)
    ranges, targets = {}, {}
    for column, ps in probabilities.items():
        n, sketch = sketches[column]
        if not n:
            continue
        ranges[column] = list(zip(sketch[::2], sketch[1::2]))
        targets[column] = {rank for p in ps for rank in _ranks(n, p)[:2]}
    values = _order_statistics(df.select(*probabilities), ranges, targets)
    out = {}
    for column, ps in probabilities.items():
        n = sketches[column][0]
        if not n:
            out[column] = [None] * len(ps)
            continue
        quantiles = []
        for p in ps:
            low, high, weight = _ranks(n, p)
            a, b = values[(column, low)], values[(column, high)]
            quantiles.append(a if a == b else a + (b - a) * weight)
        out[column] = quantiles
    return out
