"""Reference profiles, histograms and the population stability index (PSI)."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.columns import drift_status
from creditweir.operators.longform import batch_counts, binned, cell_counts
from creditweir.operators.quantiles import exact_quantiles
from creditweir.session import cut, small_table

MAX_PROFILE_ROWS = 100_000

PROFILE_SCHEMA = (
    "feature string, bin int, lower_edge double, upper_edge double, reference_share double, "
    "n_reference bigint, mean double, std double"
)


def edges_from_quantiles(quantiles: list) -> list:
    """Distinct quantiles with open outer ends; a constant gets one bin."""
    known = sorted({q for q in quantiles if q is not None})
    if len(known) < 2:
        return [-math.inf, math.inf]
    return [-math.inf, *known[1:-1], math.inf]


def quantile_edges(df: DataFrame, features: list, bins: int = fv.DRIFT_BINS) -> dict:
    """Bin edges per feature at equally spaced exact quantiles."""
    steps = [i / bins for i in range(bins + 1)]
    found = exact_quantiles(df, {f: steps for f in features})
    return {f: edges_from_quantiles(found[f]) for f in features}


def edge_table(spark: SparkSession, edges: dict) -> DataFrame:
    """(feature, bin, lower_edge, upper_edge): as many rows as there are bins."""
    rows = [(f, i, e[i], e[i + 1]) for f, e in edges.items() for i in range(len(e) - 1)]
    if len(rows) > MAX_PROFILE_ROWS:
        raise ValueError(f"{len(rows)} bins are too many for a profile")
    return small_table(spark, rows, "feature string, bin int, lower_edge double, upper_edge double")


def edges_of(profile: DataFrame) -> dict:
    """Edges per feature from a stored profile, which is small by construction."""
    rows = profile.select("feature", "bin", "lower_edge", "upper_edge").limit(MAX_PROFILE_ROWS + 1).collect()
    if len(rows) > MAX_PROFILE_ROWS:
        raise ValueError("the profile holds too many bins")
    out = {}
    for r in sorted(rows, key=lambda r: (r["feature"], r["bin"])):
        out.setdefault(r["feature"], [r["lower_edge"]]).append(r["upper_edge"])
    return out


def bin_counts(df: DataFrame, edges: dict, by: tuple = ()) -> DataFrame:
    """(*by, feature, bin, n) for all features in one pass and one shuffle."""
    return batch_counts(df, edges, by)


def _per_feature(counts: DataFrame, by: tuple = ()) -> DataFrame:
    """(*by, feature, total, cells): the counts of a feature's bins as one map, so that they are computed once."""
    cell = F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))
    return counts.groupBy(*by, "feature").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(cell)).alias("cells"))


def _in_cell():
    return F.coalesce(F.try_element_at("cells", F.col("bin")), F.lit(0))


def reference_profile(df: DataFrame, features: list, bins: int = fv.DRIFT_BINS) -> DataFrame:
    """Edges, shares, count, mean and standard deviation per feature, long form.

    The features are written once; four passes read them.
    """
    spark = df.sparkSession
    df = cut(df.select(*[F.col(f).cast("double").alias(f) for f in features]))
    edges = quantile_edges(df, features, bins)
    counts = _per_feature(bin_counts(df, edges))
    # One row a value, not one aggregate of every feature, whose method would be too long to be compiled.
    long = df.select(F.posexplode(F.array(*[F.col(f) for f in features])).alias("position", "value"))
    moments = long.groupBy("position").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).select(
        F.get(F.array(*map(F.lit, features)), "position").alias("feature"), "mean", "std"
    )
    total = F.greatest(F.coalesce(F.col("total"), F.lit(0)), F.lit(1))
    # Every side here has one row per bin or per feature.
    return (
        edge_table(spark, edges)
        .join(counts, "feature", "left")
        .join(moments, "feature", "left")
        .select(
            "feature",
            "bin",
            "lower_edge",
            "upper_edge",
            (_in_cell() / total).alias("reference_share"),
            total.cast("bigint").alias("n_reference"),
            "mean",
            "std",
        )
    )


def _term(current, reference):
    floor = F.lit(fv.EMPTY_SHARE)
    c = F.when(current == 0, floor).otherwise(current)
    r = F.when(reference == 0, floor).otherwise(reference)
    return (c - r) * F.ln(c / r)


def psi_by_feature(profile: DataFrame, current: DataFrame, by: tuple = ()) -> DataFrame:
    """PSI per feature (and ``by`` group) of current bin counts against a profile.

    ``current`` is (*by, feature, bin, n). Features without a single counted
    value in ``current`` give 0, as does an empty reference.
    """
    frame = profile.select("feature", "bin", "reference_share", "n_reference").join(_per_feature(current, by), "feature")
    # An empty side has null shares, so its sum is null and its PSI 0.
    share = F.try_divide(_in_cell(), F.col("total"))
    return frame.groupBy(*by, "feature").agg(
        F.coalesce(F.sum(_term(share, F.col("reference_share"))), F.lit(0.0)).alias("psi"),
        F.max("n_reference").alias("n_reference"),
        F.max("total").alias("n_current"),
    )


def psi_between(reference: DataFrame, current: DataFrame, column: str, edges: list = None,
                bins: int = fv.DRIFT_BINS) -> float:
    """PSI of one column between two samples; either side empty gives 0."""
    if edges is None:
        edges = quantile_edges(reference, [column], bins)[column]
    spark = reference.sparkSession
    ref = _per_feature(bin_counts(reference.select(column), {column: edges}))
    share = (_in_cell() / F.col("total")).alias("reference_share")
    profile = edge_table(spark, {column: edges}).join(ref, "feature", "left").select("feature", "bin", share, F.col("total").alias("n_reference"))
    row = psi_by_feature(profile, bin_counts(current.select(column), {column: edges})).first()
    if row is None or row["n_reference"] is None:
        return 0.0
    return float(row["psi"])


def with_status(psi: DataFrame, warn: float = fv.DRIFT_WARN, alert: float = fv.DRIFT_ALERT) -> DataFrame:
    return psi.withColumn("drift_status", drift_status(F.col("psi"), warn, alert))


def logged_bin_counts(log: DataFrame, profile: DataFrame, by: tuple = ()) -> DataFrame:
    """(*by, feature, bin, n, n_rows) from logged JSON feature vectors.

    A feature counts as logged when any vector in the group carries its key;
    others are left out. ``n_rows`` is the number of log rows in the group.
    """
    edges = edges_of(profile)
    read = log.select(*by, F.from_json("feature_vector", "map<string,double>").alias("vector"))
    flags = {f"l{i}": F.coalesce(F.map_contains_key("vector", F.lit(f)), F.lit(False)) for i, f in enumerate(edges)}
    bins = binned(read, {f: F.try_element_at("vector", F.lit(f)) for f in edges}, edges, by, flags)
    return cell_counts(bins, edges, by, missing=True, logged=True)


def logged_psi(log: DataFrame, profile: DataFrame, by: tuple = (), min_rows: int = fv.DRIFT_MIN_ROWS) -> DataFrame:
    """PSI per logged feature; groups with too few log rows give nothing."""
    counts = logged_bin_counts(log, profile, by).filter(F.col("n_rows") >= min_rows)
    binned = counts.withColumn("n", F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0))
    return psi_by_feature(profile, binned.select(*by, "feature", "bin", "n"), by)


def skipped_features(log: DataFrame, profile: DataFrame, by: tuple = (), min_rows: int = fv.DRIFT_MIN_ROWS) -> DataFrame:
    """(*by, feature, n_rows): profiled features whose key no vector of the group carries, so ``logged_psi`` leaves them out.

    Groups with too few log rows are not judged and give nothing, as there. One aggregate
    of a flag per profiled feature, combined before the shuffle.
    """
    names = list(edges_of(profile))
    vector = F.from_json("feature_vector", "map<string,double>")
    read = log.select(*by, vector.alias("vector"))
    seen = [F.max(F.coalesce(F.map_contains_key("vector", F.lit(f)), F.lit(False))).alias(f"s{i}") for i, f in enumerate(names)]
    groups = read.groupBy(*by).agg(F.count("*").alias("n_rows"), *seen).filter(F.col("n_rows") >= min_rows)
    flags = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("seen")) for i, f in enumerate(names)])
    return groups.select(*by, "n_rows", F.inline(flags)).filter("not seen").select(*by, "feature", "n_rows")
