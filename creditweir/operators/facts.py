"""The assessment fact and the model-facing view."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir import schemas
from creditweir.functions.columns import dataset_split, date_key, total_late_events
from creditweir.operators.dimensions import band_lookup, band_rows

FLAGS = {
    "has_30_59_late": "times_30_59_days_late",
    "has_60_89_late": "times_60_89_days_late",
    "has_90_plus_late": "times_90_days_late",
}


def build_fact(silver: DataFrame, borrowers: DataFrame, incomes: DataFrame, utilisations: DataFrame,
               profiles: DataFrame) -> DataFrame:
    """One row per applicant and snapshot date with all dimension keys.

    The borrower dimension is as large as silver and joins by shuffle; the band
    dimensions become CASE expressions; the sixteen profiles are broadcast.
    """
    rows = silver.filter(~F.col("dq_row_quarantined"))
    current = borrowers.filter("is_current").select("applicant_id", "borrower_key")
    keyed = rows.join(current, "applicant_id", "left").select(
        "*",
        date_key(F.col("snapshot_date")).alias("snapshot_date_key"),
        band_lookup(F.col("monthly_income").cast("double"), band_rows(incomes), "income_band_key").alias(
            "income_band_key"
        ),
        band_lookup(F.col("revolving_utilisation").cast("double"), band_rows(utilisations), "utilisation_band_key", null_key=True)
        .alias("utilisation_band_key"),
        *[(F.coalesce(F.col(counter), F.lit(0)) > 0).alias(flag) for flag, counter in FLAGS.items()],
        F.col("dq_delinquency_sentinel").alias("has_sentinel_code"),
    )
    flags = [*FLAGS, "has_sentinel_code"]
    # Sixteen rows by construction: every combination of four booleans.
    lookup = F.broadcast(profiles.select("delinquency_profile_key", *flags))
    return keyed.join(lookup, flags, "left").select(
        "snapshot_date_key",
        "borrower_key",
        "income_band_key",
        "utilisation_band_key",
        "delinquency_profile_key",
        "applicant_id",
        "revolving_utilisation",
        "debt_ratio",
        "monthly_income",
        "open_credit_lines",
        "real_estate_loans",
        "times_30_59_days_late",
        "times_60_89_days_late",
        "times_90_days_late",
        total_late_events().alias("total_delinquency_events"),
        "is_serious_delinquency",
        F.lit(False).alias("monthly_income_imputed"),
        dataset_split(F.col("applicant_id")).alias("dataset_split"),
    )


KEY_COLUMNS = schemas.FACT_ASSESSMENT.fieldNames()[:5]


def credit_view(fact: DataFrame, borrowers: DataFrame) -> DataFrame:
    """What a model may see: measures plus the borrower's age and dependents."""
    people = borrowers.select("borrower_key", "age", "number_of_dependents")
    return fact.join(people, "borrower_key").select(
        "applicant_id",
        "snapshot_date_key",
        "dataset_split",
        "is_serious_delinquency",
        "revolving_utilisation",
        "debt_ratio",
        "monthly_income",
        "open_credit_lines",
        "real_estate_loans",
        "times_30_59_days_late",
        "times_60_89_days_late",
        "times_90_days_late",
        "total_delinquency_events",
        "age",
        "number_of_dependents",
    )
