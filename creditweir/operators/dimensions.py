"""Seeded dimensions and the lookups into them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir import schemas
from creditweir.session import small_table

MAX_BAND_ROWS = 1000


def calendar(spark: SparkSession, start=fv.CALENDAR_START, end=fv.CALENDAR_END) -> DataFrame:
    """One row per day; Monday is day 0 of the week."""
    day = F.col("full_date")
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")
    )
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"),
        "full_date",
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.weekday(day).alias("day_of_week"),
        (F.last_day(day) == day).alias("is_month_end"),
    )


def income_bands(spark: SparkSession) -> DataFrame:
    rows = [(sort + 1, *rest, sort) for *rest, sort in fv.INCOME_BANDS]
    return small_table(spark, rows, schemas.DIM_INCOME_BAND)


def utilisation_bands(spark: SparkSession) -> DataFrame:
    rows = [(sort, *rest, sort) for *rest, sort in fv.UTILISATION_BANDS]
    return small_table(spark, rows, schemas.DIM_UTILISATION_BAND)


def delinquency_profile_key(late_30_59: Column, late_60_89: Column, late_90: Column, sentinel: Column) -> Column:
    """Key 1..16 of a flag combination: the flags read as a binary number plus 1."""
    weights = [(late_30_59, 8), (late_60_89, 4), (late_90, 2), (sentinel, 1)]
    key = F.lit(1)
    for flag, weight in weights:
        key = key + F.when(flag, weight).otherwise(0)
    return key


def delinquency_profiles(spark: SparkSession) -> DataFrame:
    """All sixteen flag combinations with their severity."""
    flags = ["has_30_59_late", "has_60_89_late", "has_90_plus_late", "has_sentinel_code"]
    bits = [(F.col("id").bitwiseAND(weight) > 0).alias(name) for name, weight in zip(flags, (8, 4, 2, 1))]
    severity = F.lit(fv.NO_SEVERITY)
    for flag, label in reversed(fv.SEVERITIES):
        severity = F.when(F.col(flag), label).otherwise(severity)
    combos = spark.range(0, 16, 1, 1).select((F.col("id") + 1).cast("int").alias("delinquency_profile_key"), *bits)
    return combos.withColumn("severity_label", severity)


def band_lookup(value: Column, bands: list, key: str, null_check: str = "is_unknown", null_key: bool = False) -> Column:
    """Key of the first band whose [lower, upper) holds ``value``.

    ``bands`` are the dimension's rows in sort order. Null goes to the row
    flagged ``null_check``; with no such row a null is an error, or gets a null
    key if ``null_key`` is set and the caller counts them. A value that no band holds
    goes to the last band.
    """
    unknown = [b[key] for b in bands if null_check in b and b[null_check]]
    if unknown:
        chain = F.when(value.isNull(), unknown[0])
    else:
        missing = F.lit(None) if null_key else F.raise_error(F.lit(f"null value has no {key}"))
        chain = F.when(value.isNull(), missing.cast("int"))
    for band in bands:
        lower, upper = band["lower_bound"], band["upper_bound"]
        tests = ([value >= lower] if lower is not None else []) + ([value < upper] if upper is not None else [])
        if tests:
            chain = chain.when(tests[0] if len(tests) == 1 else tests[0] & tests[1], band[key])
    return chain.otherwise(bands[-1][key])


def band_rows(bands: DataFrame) -> list:
    """The rows of a band dimension in sort order, checked to be few."""
    rows = bands.limit(MAX_BAND_ROWS + 1).collect()
    if len(rows) > MAX_BAND_ROWS:
        raise ValueError(f"a band dimension may hold at most {MAX_BAND_ROWS} rows")
    return sorted(rows, key=lambda r: r["sort_order"])
