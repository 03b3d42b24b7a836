"""Type-2 history of the borrower dimension."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.columns import age_band, dependents_band

DAYS_PER_KEY = 100000  # room for the day number of effective_from in a key


def borrower_key(applicant_id: Column, effective_from: Column) -> Column:
    """Collision-free key: the same version gets the same key on every run.

    A decimal of 24 digits holds the key of every 64-bit id.
    """
    day_number = F.unix_date(effective_from).cast("decimal(7,0)")
    scaled = applicant_id.cast("decimal(19,0)") * F.lit(DAYS_PER_KEY).cast("decimal(6,0)")
    return (scaled + day_number).cast("decimal(24,0)")


def borrower_attributes(silver: DataFrame) -> DataFrame:
    """Non-quarantined applicants with their two bands."""
    return silver.filter(~F.col("dq_row_quarantined")).select(
        "applicant_id",
        "age",
        age_band(F.col("age")).alias("age_band"),
        "number_of_dependents",
        dependents_band(F.col("number_of_dependents")).alias("dependents_band"),
        "snapshot_date",
    )


VERSION_COLUMNS = [
    "borrower_key",
    "applicant_id",
    "age",
    "age_band",
    "number_of_dependents",
    "dependents_band",
    "effective_from",
    "effective_to",
    "is_current",
]


def classify(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current versions and incoming rows side by side with a change class.

    One full outer join on the key; both sides hold at most one row per
    applicant, so no key can be hot.
    """
    old = current.select(F.col("applicant_id"), F.struct(*VERSION_COLUMNS).alias("old"))
    new = incoming.select(F.col("applicant_id"), F.struct(*incoming.columns).alias("new"))
    changed = (F.col("old.age_band") != F.col("new.age_band")) | (
        F.col("old.dependents_band") != F.col("new.dependents_band")
    )
    change = (
        F.when(F.col("new").isNull(), "absent")
        .when(F.col("old").isNull(), "new")
        .when(changed, "changed")
        .otherwise("same")
    )
    return old.join(new, "applicant_id", "full_outer").withColumn("change", change)


def merge_versions(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """The dimension after one load: closed, opened and untouched versions."""
    history = dim.filter(~F.col("is_current")).select(*VERSION_COLUMNS)
    compared = classify(dim.filter("is_current"), incoming)
    day = F.col("new.snapshot_date")
    opened = F.struct(
        borrower_key(F.col("applicant_id"), day).alias("borrower_key"),
        F.col("applicant_id").alias("applicant_id"),
        F.col("new.age").alias("age"),
        F.col("new.age_band").alias("age_band"),
        F.col("new.number_of_dependents").alias("number_of_dependents"),
        F.col("new.dependents_band").alias("dependents_band"),
        day.alias("effective_from"),
        F.lit(fv.OPEN_END).cast("date").alias("effective_to"),
        F.lit(True).alias("is_current"),
    )
    last_day = F.when(day > F.col("old.effective_from"), F.date_sub(day, 1)).otherwise(
        F.raise_error(F.lit("a borrower changed twice on one snapshot date")).cast("date")
    )
    closed = F.struct(
        *[F.col(f"old.{c}").alias(c) for c in VERSION_COLUMNS[:7]],
        last_day.alias("effective_to"),
        F.lit(False).alias("is_current"),
    )
    versions = (
        F.when(F.col("change") == "new", F.array(opened))
        .when(F.col("change") == "changed", F.array(closed, opened))
        .otherwise(F.array(F.col("old")))
    )
    return compared.select(F.inline(versions)).unionByName(history)


def change_counts(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """Number of new and changed borrowers that a load would write."""
    return classify(dim.filter("is_current"), incoming).agg(
        F.count_if(F.col("change") == "new").alias("n_new"),
        F.count_if(F.col("change") == "changed").alias("n_changed"),
    )


def version_at(rows: DataFrame, dim: DataFrame, day: str) -> DataFrame:
    """Attach the borrower version valid on each row's ``day``."""
    versions = dim.drop("is_current")
    return rows.join(
        versions,
        (rows["applicant_id"] == versions["applicant_id"])
        & rows[day].between(versions["effective_from"], versions["effective_to"]),
        "left",
    ).drop(versions["applicant_id"])
