"""Cleaning and feature engineering with fit on train and apply elsewhere."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.columns import NO_BUCKET, clip, has_no_bucket, to_number, utilisation_bucket
from creditweir.operators.quantiles import exact_quantiles


class NotFittedError(ValueError):
    """Features were asked for before their parameters were learned."""


@dataclass
class FeatureParams:
    """What a fit learned; plain numbers, written next to the model."""

    feature_names: list
    values: dict = field(default_factory=dict)


def _numeric(df: DataFrame, name: str):
    """Already numeric columns pass; text is parsed, with bad text as null."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return to_number(F.col(name))
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def clean_credit(df: DataFrame, target="is_serious_delinquency") -> DataFrame:
    """Row validity only: no imputation. Unlabelled rows go when a label exists."""
    if target in df.columns:
        df = df.filter(F.col(target).isNotNull())
    cleaned = {}
    for name in fv.CREDIT_REQUIRED:
        value = _numeric(df, name)
        if name == "age":
            value = clip(value, *fv.MODEL_AGE_RANGE)
        elif name in fv.CREDIT_COUNTS:
            value = clip(value, lower=0)
        cleaned[name] = value.alias(name)
    return df.select(*[cleaned.get(c, F.col(c)) for c in df.columns])


def fit_credit(cleaned_train: DataFrame) -> FeatureParams:
    """Medians and caps from the training rows, exact, in two small passes."""
    found = exact_quantiles(
        cleaned_train,
        {
            "monthly_income": [0.5],
            "revolving_utilisation": [fv.CAP_QUANTILE],
            "debt_ratio": [fv.CAP_QUANTILE],
            "age": [0.5],
        },
    )
    return FeatureParams(
        list(fv.CREDIT_FEATURES),
        {
            "median_income": found["monthly_income"][0],
            "utilisation_cap": found["revolving_utilisation"][0],
            "debt_ratio_cap": found["debt_ratio"][0],
            # Filling gaps with the median does not move the median.
            "median_age": found["age"][0],
        },
    )


def credit_row_error() -> Column:
    """What keeps a cleaned row from having features; null if nothing does."""
    return F.when(has_no_bucket(F.col("revolving_utilisation")), NO_BUCKET)


def credit_features(cleaned: DataFrame, params: FeatureParams, carry: tuple = (), strict: bool = True) -> DataFrame:
    """The model's input columns in frozen order, after ``carry`` columns.

    A row for which ``credit_row_error`` has a text is an error; if not ``strict`` it only
    lacks the feature concerned, and the caller carries the text.
    """
    if params is None:
        raise NotFittedError("fit the feature parameters first or load them with the model")
    p = params.values

    def zero_if_null(name):
        return F.coalesce(F.col(name), F.lit(0.0)).alias(name)

    base = cleaned.select(
        *carry,
        F.col("monthly_income").isNull().cast("int").alias("income_missing"),
        F.coalesce(F.col("monthly_income"), F.lit(p["median_income"])).alias("monthly_income"),
        clip(F.col("revolving_utilisation"), upper=p["utilisation_cap"]).alias("revolving_utilisation"),
        clip(F.col("debt_ratio"), upper=p["debt_ratio_cap"]).alias("debt_ratio"),
        F.coalesce(F.col("age"), F.lit(p.get("median_age") or fv.DEFAULT_MEDIAN_AGE)).alias("age"),
        zero_if_null("number_of_dependents"),
        zero_if_null("open_credit_lines"),
        zero_if_null("real_estate_loans"),
        *[zero_if_null(c) for c in fv.LATE_COUNTERS],
        zero_if_null("total_delinquency_events"),
    )
    events = F.col("total_delinquency_events")
    derived = base.select(
        "*",
        (F.col("debt_ratio") * F.col("monthly_income")).alias("monthly_debt_payment"),
        (F.col("monthly_income") / (F.col("number_of_dependents") + 1)).alias("income_per_dependent"),
        (events / (F.col("open_credit_lines") + 1)).alias("delinquency_ratio"),
        (events > 0).cast("int").alias("has_any_delinquency"),
        utilisation_bucket(F.col("revolving_utilisation"), strict).alias("utilisation_bucket"),
    )
    return derived.select(*carry, *params.feature_names)


def clean_tree(df: DataFrame, target="is_serious_delinquency") -> DataFrame:
    """Second domain: drop unlabelled rows and parse its two columns."""
    if target in df.columns:
        df = df.filter(F.col(target).isNotNull())
    parsed = {c: _numeric(df, c).alias(c) for c in fv.TREE_FEATURES}
    return df.select(*[parsed.get(c, F.col(c)) for c in df.columns])


def fit_tree(cleaned_train: DataFrame) -> FeatureParams:
    """The second domain learns nothing but its column order."""
    return FeatureParams(list(fv.TREE_FEATURES))


def tree_row_error() -> Column:
    """No row of the second domain fails: gaps become 0."""
    return F.lit(None).cast("string")


def tree_features(cleaned: DataFrame, params: FeatureParams, carry: tuple = (), strict: bool = True) -> DataFrame:
    if params is None:
        raise NotFittedError("fit the feature parameters first or load them with the model")
    utilisation = F.coalesce(F.col("revolving_utilisation"), F.lit(0.0))
    return cleaned.select(
        *carry,
        clip(utilisation, upper=fv.TREE_UTILISATION_CAP).alias("revolving_utilisation"),
        F.coalesce(F.col("total_delinquency_events"), F.lit(0.0)).alias("total_delinquency_events"),
    ).select(*carry, *params.feature_names)


def class_balance(cleaned: DataFrame, target="is_serious_delinquency") -> DataFrame:
    """Negatives, positives and the weight that balances them."""
    label = F.col(target)
    counts = cleaned.agg(
        F.count_if(label == 0).alias("n_negative"), F.count_if(label == 1).alias("n_positive")
    )
    return counts.withColumn(
        "scale_pos_weight", F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive"))
    )


def cleaning_counts(rows: DataFrame, target="is_serious_delinquency", split="dataset_split") -> DataFrame:
    """Rows per split before and after cleaning, in one pass."""
    return rows.groupBy(split).agg(
        F.count("*").alias("rows_loaded"), F.count(F.col(target)).alias("rows_cleaned")
    )
