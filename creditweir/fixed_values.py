"""Names, bounds, codes and sentences that define the results.

Everything here is data, not logic. Each block is kept together and in its
natural order so that it can be checked by eye.
"""

import math

# Source header -> bronze column. An unnamed first header is
# written as an empty string in the file; the CSV reader names it "_c0".
SOURCE_HEADERS = {
    "Unnamed: 0": "raw_row_id",
    "SeriousDlqin2yrs": "serious_dlqin_2yrs",
    "RevolvingUtilizationOfUnsecuredLines": "revolving_utilization_unsecured_lines",
    "age": "age",
    "NumberOfTime30-59DaysPastDueNotWorse": "times_30_59_days_past_due",
    "DebtRatio": "debt_ratio",
    "MonthlyIncome": "monthly_income",
    "NumberOfOpenCreditLinesAndLoans": "open_credit_lines_and_loans",
    "NumberOfTimes90DaysLate": "times_90_days_late",
    "NumberRealEstateLoansOrLines": "real_estate_loans_or_lines",
    "NumberOfTime60-89DaysPastDueNotWorse": "times_60_89_days_past_due",
    "NumberOfDependents": "number_of_dependents",
}
UNNAMED_HEADERS = ("", "_c0", "Unnamed: 0")

# Bronze column -> silver column, where the name changes.
SILVER_NAMES = {
    "raw_row_id": "applicant_id",
    "serious_dlqin_2yrs": "is_serious_delinquency",
    "revolving_utilization_unsecured_lines": "revolving_utilisation",
    "times_30_59_days_past_due": "times_30_59_days_late",
    "open_credit_lines_and_loans": "open_credit_lines",
    "real_estate_loans_or_lines": "real_estate_loans",
    "times_60_89_days_past_due": "times_60_89_days_late",
}

# The three late-payment counters, sentinel codes and age range.
LATE_COUNTERS = ["times_30_59_days_late", "times_60_89_days_late", "times_90_days_late"]
SENTINEL_CODES = [96, 98]
MAX_VALID_AGE = 110
UTILISATION_OUTLIER_ABOVE = 1.0

# Data-quality rule names in report order, and their severity.
DQ_RULES = [
    "income_missing",
    "dependents_missing",
    "age_invalid",
    "utilisation_outlier",
    "delinquency_sentinel",
    "row_quarantined",
]
DQ_SEVERITY = "WARN"

# Allowed values of coded columns.
RUN_STATUSES = ["RUNNING", "SUCCESS", "FAILED"]
DQ_SEVERITIES = ["INFO", "WARN", "ERROR"]
LABEL_VALUES = [0, 1]
SPLITS = ["train", "valid", "test"]
DRIFT_STATUSES = ["OK", "WARN", "ALERT"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]

# Age bands as (label, lower, upper), lower <= age < upper.
AGE_BANDS = [
    ("<25", 0, 25),
    ("25-34", 25, 35),
    ("35-44", 35, 45),
    ("45-54", 45, 55),
    ("55-64", 55, 65),
    ("65+", 65, 200),
]
UNKNOWN_BAND = "unknown"

# Calendar range of the date dimension and the open end date.
CALENDAR_START = "2024-01-01"
CALENDAR_END = "2027-12-31"
OPEN_END = "9999-12-31"

# Income bands (label, lower, upper, is_unknown, sort_order).
INCOME_BANDS = [
    ("unknown", None, None, True, 0),
    ("0-2000", 0.0, 2000.0, False, 1),
    ("2000-4000", 2000.0, 4000.0, False, 2),
    ("4000-6000", 4000.0, 6000.0, False, 3),
    ("6000-10000", 6000.0, 10000.0, False, 4),
    ("10000+", 10000.0, None, False, 5),
]

# Utilisation bands (label, lower, upper, is_anomalous, sort_order).
UTILISATION_BANDS = [
    ("0-0.1", 0.0, 0.1, False, 1),
    ("0.1-0.3", 0.1, 0.3, False, 2),
    ("0.3-0.6", 0.3, 0.6, False, 3),
    ("0.6-1.0", 0.6, 1.0, False, 4),
    (">1.0 anomalous", 1.0, None, True, 5),
]

# Severity of the delinquency profile, first matching flag wins.
SEVERITIES = [
    ("has_sentinel_code", "unreliable"),
    ("has_90_plus_late", "severe"),
    ("has_60_89_late", "moderate"),
    ("has_30_59_late", "mild"),
]
NO_SEVERITY = "none"

# Dataset split, upper bound of md5 bucket (0..99) -> split.
SPLIT_BUCKETS = [(70, "train"), (85, "valid"), (100, "test")]

# The credit feature list in its frozen order.
CREDIT_FEATURES = [
    "income_missing",
    "monthly_income",
    "revolving_utilisation",
    "debt_ratio",
    "age",
    "number_of_dependents",
    "open_credit_lines",
    "real_estate_loans",
    "times_30_59_days_late",
    "times_60_89_days_late",
    "times_90_days_late",
    "total_delinquency_events",
    "monthly_debt_payment",
    "income_per_dependent",
    "delinquency_ratio",
    "has_any_delinquency",
    "utilisation_bucket",
]
CREDIT_REQUIRED = [
    "revolving_utilisation",
    "age",
    "debt_ratio",
    "monthly_income",
    "open_credit_lines",
    "real_estate_loans",
    "times_30_59_days_late",
    "times_60_89_days_late",
    "times_90_days_late",
    "total_delinquency_events",
    "number_of_dependents",
]
CREDIT_COUNTS = [
    "open_credit_lines",
    "real_estate_loans",
    "times_30_59_days_late",
    "times_60_89_days_late",
    "times_90_days_late",
    "total_delinquency_events",
    "number_of_dependents",
]
MODEL_AGE_RANGE = (18, 100)
DEFAULT_MEDIAN_AGE = 45.0
CAP_QUANTILE = 0.99
# Upper ends (inclusive) of the utilisation buckets 0..3; above is bucket 4.
UTILISATION_BUCKET_ENDS = [0.1, 0.3, 0.6, 1.0]
UTILISATION_BUCKET_FLOOR = -0.01

# The two-feature tree model.
TREE_FEATURES = ["revolving_utilisation", "total_delinquency_events"]
TREE_UTILISATION_CAP = 2.0

# Model settings.
DECISION_THRESHOLD = 0.5
RANDOM_SEED = 42
BOOSTING = {"trees": 500, "depth": 5, "learning_rate": 0.05, "row_fraction": 0.8,
            "column_fraction": 0.8, "patience": 50}
TREE = {"depth": 4, "min_rows": 50}
AUC_GAP_LIMIT = 0.02

# Risk bands, probability below the bound; last band is open.
RISK_BANDS = [(0.05, "low"), (0.15, "medium"), (0.35, "high")]
TOP_RISK_BAND = "very_high"

# Drift settings.
DRIFT_BINS = 10
EMPTY_SHARE = 1e-6
DRIFT_WARN = 0.10
DRIFT_ALERT = 0.25
DRIFT_MIN_ROWS = 100

# Portfolio stress scenarios (name, utilisation x, income x).
SCENARIOS = [
    ("none", 1.0, 1.0),
    ("moderate", 1.5, 0.8),
    ("severe", 3.0, 0.5),
]

# Request field -> accepted source header.
REQUEST_ALIASES = {
    "revolving_utilisation": "RevolvingUtilizationOfUnsecuredLines",
    "age": "age",
    "debt_ratio": "DebtRatio",
    "monthly_income": "MonthlyIncome",
    "open_credit_lines": "NumberOfOpenCreditLinesAndLoans",
    "real_estate_loans": "NumberRealEstateLoansOrLines",
    "times_30_59_days_late": "NumberOfTime30-59DaysPastDueNotWorse",
    "times_60_89_days_late": "NumberOfTime60-89DaysPastDueNotWorse",
    "times_90_days_late": "NumberOfTimes90DaysLate",
    "number_of_dependents": "NumberOfDependents",
}
# Request rules (field, minimum, maximum, may be null, integer).
REQUEST_RULES = [
    ("revolving_utilisation", 0, math.inf, False, False),
    ("age", 18, 110, False, True),
    ("debt_ratio", 0, math.inf, False, False),
    ("monthly_income", 0, math.inf, True, False),
    ("open_credit_lines", 0, math.inf, False, True),
    ("real_estate_loans", 0, math.inf, False, True),
    ("times_30_59_days_late", 0, math.inf, False, True),
    ("times_60_89_days_late", 0, math.inf, False, True),
    ("times_90_days_late", 0, math.inf, False, True),
    ("number_of_dependents", 0, math.inf, True, True),
]

# Feature -> label shown to people.
DISPLAY_NAMES = {
    "income_missing": "Income not provided",
    "monthly_income": "Monthly income",
    "revolving_utilisation": "Credit utilisation ratio",
    "debt_ratio": "Debt-to-income ratio",
    "age": "Age",
    "number_of_dependents": "Number of dependents",
    "open_credit_lines": "Open credit accounts",
    "real_estate_loans": "Real estate loans or lines",
    "times_30_59_days_late": "Payments 30-59 days late",
    "times_60_89_days_late": "Payments 60-89 days late",
    "times_90_days_late": "Payments 90+ days late",
    "total_delinquency_events": "Total late payment events",
    "monthly_debt_payment": "Estimated monthly debt payment",
    "income_per_dependent": "Income per household member",
    "delinquency_ratio": "Late payments per credit account",
    "has_any_delinquency": "Any history of late payment",
    "utilisation_bucket": "Credit utilisation band",
}

# Feature -> adverse-action reason code and its text.
REASON_CODES = {
    "revolving_utilisation": ("R01", "Proportion of revolving credit in use"),
    "times_90_days_late": ("R02", "History of seriously delinquent payments"),
    "debt_ratio": ("R03", "Level of existing debt relative to income"),
    "monthly_income": ("R04", "Income level relative to obligations"),
    "open_credit_lines": ("R05", "Number of open credit accounts"),
    "times_60_89_days_late": ("R06", "History of moderately delinquent payments"),
    "times_30_59_days_late": ("R07", "History of recent late payments"),
    "total_delinquency_events": ("R08", "Overall frequency of late payments"),
    "real_estate_loans": ("R09", "Number of real estate secured obligations"),
    "age": ("R10", "Length of credit-relevant history"),
    "number_of_dependents": ("R11", "Household obligations relative to income"),
    "income_missing": ("R12", "Income could not be verified"),
    "monthly_debt_payment": ("R13", "Estimated monthly debt service burden"),
    "income_per_dependent": ("R14", "Income available per household member"),
    "delinquency_ratio": ("R15", "Late payments relative to accounts held"),
    "has_any_delinquency": ("R16", "Presence of any delinquency on record"),
    "utilisation_bucket": ("R17", "Credit utilisation band"),
}
RAISES_RISK = "increases_risk"
LOWERS_RISK = "decreases_risk"
TOP_CONTRIBUTIONS = 5

# Report sentences. {} marks a value of the payload.
POPULATION_DEFAULT_RATE = 0.0668
SUMMARY_SENTENCE = (
    "Modelled probability of default is {}, placing this application in the {} risk band "
    "against a decision threshold of {}. The portfolio average is {}. "
    "This note was generated without narrative language support."
)
OBSERVATION_SENTENCE = "Recorded value {}; contribution to modelled risk {}."
FLAG_NOTE = "Field flagged as imputed or missing: {}."
NO_FLAG_NOTE = "No data quality flags were raised for this application."
RECOMMENDED_CHECKS = [
    "Verify reported income against documentary evidence.",
    "Confirm the delinquency history against the bureau record.",
    "Review current outstanding balances across all open accounts.",
]
MAX_RISK_FACTORS = 5

# Report audit.
NUMBER_PATTERN = r"\d+(?:\.\d+)?"
INCIDENTAL_NUMBERS = [0, 1, 2, 3, 4, 5]
