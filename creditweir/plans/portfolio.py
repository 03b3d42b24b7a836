"""Portfolio reports over the star schema."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv


def portfolio_summary(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count("*").alias("total_applicants"),
        F.avg("is_serious_delinquency").alias("default_rate"),
        *[F.count_if(F.col("dataset_split") == s).alias(f"{s}_rows") for s in fv.SPLITS],
    )


def _by_keys(fact: DataFrame, keys: list) -> DataFrame:
    """Sums per dimension key; labels are attached to the few result rows."""
    return fact.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("is_serious_delinquency").alias("n_bad"),
        F.count("is_serious_delinquency").alias("n_labelled"),
    )


def _rates(grouped: DataFrame, labels: list) -> DataFrame:
    rate = F.round(F.try_divide(F.sum("n_bad"), F.sum("n_labelled")), 4)
    return grouped.groupBy(*labels).agg(F.sum("n").alias("n"), rate.alias("default_rate"))


def segment_default_rates(fact: DataFrame, profiles: DataFrame, incomes: DataFrame) -> DataFrame:
    """Default rate by severity and income band, highest first."""
    keys = ["delinquency_profile_key", "income_band_key"]
    joined = (
        _by_keys(fact, keys)
        .join(profiles.select("delinquency_profile_key", "severity_label"), "delinquency_profile_key")
        .join(incomes.select("income_band_key", "band_label"), "income_band_key")
    )
    return _rates(joined, ["severity_label", "band_label"]).orderBy(F.desc_nulls_first("default_rate"))


def default_rate_by_severity(fact: DataFrame, profiles: DataFrame) -> DataFrame:
    joined = _by_keys(fact, ["delinquency_profile_key"]).join(
        profiles.select("delinquency_profile_key", "severity_label"), "delinquency_profile_key"
    )
    return _rates(joined, ["severity_label"]).orderBy(F.desc_nulls_first("default_rate"))


def default_rate_by_income_band(fact: DataFrame, incomes: DataFrame) -> DataFrame:
    joined = _by_keys(fact, ["income_band_key"]).join(
        incomes.select("income_band_key", "band_label", "sort_order"), "income_band_key"
    )
    return _rates(joined, ["band_label", "sort_order"]).orderBy("sort_order")


def top_segments(segments: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` segments with the highest rate; ties in label order."""
    return segments.orderBy(F.desc_nulls_first("default_rate"), "severity_label", "band_label").limit(n)


def random_applicants(view: DataFrame, n: int, seed: int = fv.RANDOM_SEED) -> DataFrame:
    """``n`` random test applicants with a known age.

    The order is the md5 of id and seed: random across seeds, but the same on
    any partitioning, and a top-n rather than a full sort.
    """
    draw = F.md5(F.concat_ws(":", F.col("applicant_id").cast("string"), F.lit(str(seed))))
    eligible = view.filter((F.col("dataset_split") == "test") & F.col("age").isNotNull())
    return eligible.orderBy(draw, "applicant_id").limit(n)
