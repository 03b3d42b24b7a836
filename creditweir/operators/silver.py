"""Bronze text rows to typed, flagged, one-per-applicant silver rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.columns import is_true, to_number, whole_number
from creditweir.schemas import SOURCE_COLUMNS


def latest_per_key(df: DataFrame, keys: list, order: str) -> DataFrame:
    """Keep the row with the highest ``order`` per key.

    ``max_by`` combines on the map side, so a key that holds a third of the
    rows leaves each task as a single row; a window would sort it in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def parse_numbers(bronze: DataFrame) -> DataFrame:
    """The twelve source columns as doubles under their silver names."""
    numbers = [to_number(F.col(c)).alias(fv.SILVER_NAMES.get(c, c)) for c in SOURCE_COLUMNS]
    others = [c for c in bronze.columns if c not in SOURCE_COLUMNS]
    return bronze.select(*others, *numbers)


def _sentinel(name: str) -> Column:
    return is_true(F.col(name).isin(*fv.SENTINEL_CODES))


def flag_quality(df: DataFrame) -> DataFrame:
    """Six boolean flags; values are nulled only for bad ages and sentinels."""
    age, label = F.col("age"), F.col("is_serious_delinquency")
    bad_age = is_true((age <= 0) | (age > fv.MAX_VALID_AGE))
    any_sentinel = F.lit(False)
    for name in fv.LATE_COUNTERS:
        any_sentinel = any_sentinel | _sentinel(name)
    flags = {
        "dq_income_missing": F.col("monthly_income").isNull(),
        "dq_dependents_missing": F.col("number_of_dependents").isNull(),
        "dq_age_invalid": bad_age,
        "dq_utilisation_outlier": is_true(F.col("revolving_utilisation") > fv.UTILISATION_OUTLIER_ABOVE),
        "dq_delinquency_sentinel": any_sentinel,
        "dq_row_quarantined": ~is_true(label.isin(*fv.LABEL_VALUES)),
    }
    repaired = {"age": F.when(~bad_age, age)}
    repaired.update({c: F.when(~_sentinel(c), F.col(c)) for c in fv.LATE_COUNTERS})
    values = [repaired.get(c, F.col(c)).alias(c) for c in df.columns]
    return df.select(*values, *[flag.alias(name) for name, flag in flags.items()])


def _overflows() -> Column:
    """Whether a value does not fit its silver column.

    A look at the texts tells most rows; only texts with many digits, an exponent or an
    infinity are parsed here. Ages and labels out of range are nulled and flagged instead.
    """
    sources = {fv.SILVER_NAMES.get(c, c): c for c in SOURCE_COLUMNS}

    def beyond(names, limit, places, hint):
        # One test for all texts of an array: a parse a column made a method too long to be compiled.
        texts = F.array(*[F.col(sources[n]) for n in names])
        large = F.exists(texts, lambda text: F.round(F.abs(to_number(text)), places) >= limit)
        return F.when(F.concat_ws(" ", texts).rlike(hint), F.coalesce(large, F.lit(False))).otherwise(False)

    counters = ["open_credit_lines", "real_estate_loans", *fv.LATE_COUNTERS, "number_of_dependents"]
    return (
        beyond(counters, 32768, 0, "[0-9]{5}|[eEiI]")
        | beyond(["revolving_utilisation"], 1e8, 6, "[0-9]{8}|[eEiI]")
        | beyond(["debt_ratio"], 1e10, 6, "[0-9]{10}|[eEiI]")
        | beyond(["monthly_income"], 1e12, 2, "[0-9]{12}|[eEiI]")
    )


def split_unkeyed(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, rows that go to the reject table).

    Rows without an applicant id cannot be deduplicated or keyed, and rows with a value
    beyond its column cannot be written; neither stops the load of the others.
    """
    # Whole numbers are read as such: a double would merge ids beyond 2^53.
    whole = F.trim("raw_row_id").try_cast("bigint")
    keyed = bronze.withColumn("applicant_id", F.coalesce(whole, F.rint(to_number(F.col("raw_row_id"))).try_cast("bigint")))
    usable = F.col("applicant_id").isNotNull() & ~_overflows()
    return keyed.filter(usable), keyed.filter(~usable).drop("applicant_id")


def to_silver(bronze: DataFrame, snapshot_date: Column) -> DataFrame:
    """Latest bronze row per applicant, typed and flagged.

    Only the id is parsed before the shuffle; the other columns are parsed and
    flagged once, on the rows that are kept.
    """
    keyed, _ = split_unkeyed(bronze)
    keep = ["applicant_id", "ingestion_id", "bronze_id"] + [c for c in SOURCE_COLUMNS if c != "raw_row_id"]
    latest = latest_per_key(keyed.select(*keep), ["applicant_id"], "bronze_id")
    numbers = latest.select(
        "applicant_id",
        "ingestion_id",
        *[to_number(F.col(c)).alias(fv.SILVER_NAMES.get(c, c)) for c in SOURCE_COLUMNS if c != "raw_row_id"],
    )
    flagged = flag_quality(numbers)
    label = F.col("is_serious_delinquency")

    def short(name):
        return whole_number(F.col(name), "smallint").alias(name)

    return flagged.select(
        "applicant_id",
        "ingestion_id",
        snapshot_date.cast("date").alias("snapshot_date"),
        # A label outside {0, 1} is quarantined and stored as null.
        F.when(is_true(label.isin(*fv.LABEL_VALUES)), label.cast("smallint")).alias("is_serious_delinquency"),
        F.col("revolving_utilisation").cast("decimal(14,6)").alias("revolving_utilisation"),
        short("age"),
        F.col("debt_ratio").cast("decimal(16,6)").alias("debt_ratio"),
        F.col("monthly_income").cast("decimal(14,2)").alias("monthly_income"),
        short("open_credit_lines"),
        short("real_estate_loans"),
        *[short(c) for c in fv.LATE_COUNTERS],
        short("number_of_dependents"),
        *[f"dq_{rule}" for rule in fv.DQ_RULES],
    )


def quality_counts(silver: DataFrame) -> DataFrame:
    """One row per rule with the number of silver rows it hit."""
    one_row = silver.agg(*[F.count_if(F.col(f"dq_{r}")).alias(r) for r in fv.DQ_RULES])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_name"), F.col(r).alias("rows_affected")) for r in fv.DQ_RULES])
    return one_row.select(F.inline(pairs)).select(
        "rule_name", F.lit(fv.DQ_SEVERITY).alias("severity"), "rows_affected"
    )
