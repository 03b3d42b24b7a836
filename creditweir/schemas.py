"""Typed schemas of the bronze, silver, gold and monitoring tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweir import fixed_values as fv

TEXT, LONG, INT, SHORT = T.StringType(), T.LongType(), T.IntegerType(), T.ShortType()
KEY = T.DecimalType(24, 0)  # a 64-bit applicant id and a day number
BOOL, DATE, TIME = T.BooleanType(), T.DateType(), T.TimestampType()


def _table(*fields) -> T.StructType:
    """Fields as (name, type) or (name, type, "required")."""
    return T.StructType([T.StructField(f[0], f[1], len(f) == 2) for f in fields])


SOURCE_COLUMNS = list(fv.SOURCE_HEADERS.values())

BRONZE_APPLICATIONS = _table(
    ("bronze_id", LONG, "required"),
    ("ingestion_id", TEXT, "required"),
    ("source_file", TEXT, "required"),
    ("source_row_number", LONG, "required"),
    ("ingested_at", TIME, "required"),
    *[(name, TEXT) for name in SOURCE_COLUMNS],
)

INGESTION_RUNS = _table(
    ("ingestion_id", TEXT, "required"),
    ("source_file", TEXT, "required"),
    ("file_sha256", TEXT, "required"),
    ("row_count", LONG),
    ("started_at", TIME, "required"),
    ("completed_at", TIME),
    ("status", TEXT, "required"),
    ("error_message", TEXT),
)

SILVER_APPLICATIONS = _table(
    ("applicant_id", LONG, "required"),
    ("ingestion_id", TEXT, "required"),
    ("snapshot_date", DATE, "required"),
    ("is_serious_delinquency", SHORT),
    ("revolving_utilisation", T.DecimalType(14, 6)),
    ("age", SHORT),
    ("debt_ratio", T.DecimalType(16, 6)),
    ("monthly_income", T.DecimalType(14, 2)),
    ("open_credit_lines", SHORT),
    ("real_estate_loans", SHORT),
    ("times_30_59_days_late", SHORT),
    ("times_60_89_days_late", SHORT),
    ("times_90_days_late", SHORT),
    ("number_of_dependents", SHORT),
    *[(f"dq_{rule}", BOOL, "required") for rule in fv.DQ_RULES],
    ("processed_at", TIME),  # null on rows written before the column
)

DATA_QUALITY_LOG = _table(
    ("ingestion_id", TEXT, "required"),
    ("rule_name", TEXT, "required"),
    ("severity", TEXT, "required"),
    ("rows_affected", LONG, "required"),
    ("checked_at", TIME, "required"),
)

DIM_DATE = _table(
    ("date_key", INT, "required"),
    ("full_date", DATE, "required"),
    ("year", INT, "required"),
    ("quarter", INT, "required"),
    ("month", INT, "required"),
    ("month_name", TEXT, "required"),
    ("day_of_month", INT, "required"),
    ("day_of_week", INT, "required"),
    ("is_month_end", BOOL, "required"),
)

DIM_BORROWER = _table(
    ("borrower_key", KEY, "required"),
    ("applicant_id", LONG, "required"),
    ("age", SHORT),
    ("age_band", TEXT),
    ("number_of_dependents", SHORT),
    ("dependents_band", TEXT),
    ("effective_from", DATE, "required"),
    ("effective_to", DATE, "required"),
    ("is_current", BOOL, "required"),
)

DIM_INCOME_BAND = _table(
    ("income_band_key", INT, "required"),
    ("band_label", TEXT, "required"),
    ("lower_bound", T.DoubleType()),
    ("upper_bound", T.DoubleType()),
    ("is_unknown", BOOL, "required"),
    ("sort_order", INT, "required"),
)

DIM_UTILISATION_BAND = _table(
    ("utilisation_band_key", INT, "required"),
    ("band_label", TEXT, "required"),
    ("lower_bound", T.DoubleType()),
    ("upper_bound", T.DoubleType()),
    ("is_anomalous", BOOL, "required"),
    ("sort_order", INT, "required"),
)

DIM_DELINQUENCY_PROFILE = _table(
    ("delinquency_profile_key", INT, "required"),
    ("has_30_59_late", BOOL, "required"),
    ("has_60_89_late", BOOL, "required"),
    ("has_90_plus_late", BOOL, "required"),
    ("has_sentinel_code", BOOL, "required"),
    ("severity_label", TEXT, "required"),
)

DIM_MODEL = _table(
    ("model_key", LONG, "required"),
    ("pipeline_name", TEXT, "required"),
    ("model_name", TEXT, "required"),
    ("model_version", TEXT, "required"),
    ("algorithm", TEXT, "required"),
    ("hyperparameters", TEXT),
    ("feature_list", TEXT),
    ("training_rows", LONG),
    ("trained_at", TIME, "required"),
    ("metric_auc", T.DecimalType(6, 4)),
    ("metric_ks", T.DecimalType(6, 4)),
    ("is_active", BOOL, "required"),
)

FACT_ASSESSMENT = _table(
    ("snapshot_date_key", INT, "required"),
    ("borrower_key", KEY, "required"),
    ("income_band_key", INT, "required"),
    ("utilisation_band_key", INT, "required"),
    ("delinquency_profile_key", INT, "required"),
    ("applicant_id", LONG, "required"),
    ("revolving_utilisation", T.DecimalType(14, 6)),
    ("debt_ratio", T.DecimalType(16, 6)),
    ("monthly_income", T.DecimalType(14, 2)),
    ("open_credit_lines", SHORT),
    ("real_estate_loans", SHORT),
    ("times_30_59_days_late", SHORT),
    ("times_60_89_days_late", SHORT),
    ("times_90_days_late", SHORT),
    ("total_delinquency_events", INT),
    ("is_serious_delinquency", SHORT),
    ("monthly_income_imputed", BOOL, "required"),
    ("dataset_split", TEXT, "required"),
)

FACT_PREDICTION = _table(
    ("date_key", INT, "required"),
    ("model_key", LONG, "required"),
    ("borrower_key", KEY),
    ("request_id", TEXT, "required"),
    ("applicant_id", LONG),
    ("predicted_at", TIME, "required"),
    ("probability_default", T.DecimalType(9, 6), "required"),
    ("predicted_class", SHORT, "required"),
    ("risk_band", TEXT, "required"),
    ("threshold_used", T.DecimalType(5, 4), "required"),
    ("latency_ms", INT),
    ("actual_outcome", SHORT),
)

PREDICTION_LOG = _table(
    ("request_id", TEXT, "required"),
    ("received_at", TIME, "required"),
    ("received_date", DATE, "required"),  # partition column
    ("pipeline_name", TEXT, "required"),
    ("model_version", TEXT, "required"),
    ("request_payload", TEXT, "required"),
    ("feature_vector", TEXT, "required"),
    ("probability_default", T.DecimalType(9, 6)),
    ("predicted_class", SHORT),
    ("risk_band", TEXT),
    ("latency_ms", INT),
    ("status", TEXT, "required"),
    ("error_message", TEXT),
)

DRIFT_REPORT = _table(
    ("computed_at", TIME, "required"),
    ("pipeline_name", TEXT, "required"),
    ("model_version", TEXT, "required"),
    ("feature_name", TEXT, "required"),
    ("psi", T.DecimalType(10, 6), "required"),
    ("drift_status", TEXT, "required"),
    ("reference_window", TEXT, "required"),
    ("current_window", TEXT, "required"),
    ("n_reference", LONG),
    ("n_current", LONG),
)

SERVICE_EVENT = _table(
    ("occurred_at", TIME, "required"),
    ("service_name", TEXT, "required"),
    ("event_type", TEXT, "required"),
    ("details", TEXT),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared schema; a missing column is named in the error.

    The reader sees every column as nullable after a write, so required columns
    are guarded in the plan: a null in one of them stops the job.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the table: {missing}")
    out = []
    for field in schema:
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            message = F.lit(f"null in required column {field.name}")
            value = F.coalesce(value, F.raise_error(message).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)
