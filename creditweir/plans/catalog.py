"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

Results are shown with plain column types (long, double, string, boolean) and
doubles rounded to six places, so that another engine can check them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.functions.columns import dataset_split, date_key
from creditweir.operators import assertions, dimensions, drift, evaluation, features, requests, scd2, scoring
from creditweir.operators import silver as silver_ops
from creditweir.operators.facts import credit_view
from creditweir.operators.upsert import insert_if_absent, upsert
from creditweir.plans import given_tables as given
from creditweir.plans import monitoring, portfolio
from creditweir.plans.star import Star
from creditweir.session import cut, small_table
from creditweir.sources.runs import latest_success

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        # A 24-digit key is wider than 64 bits for ids above 9e13 only; the given tables have none.
        if kind in ("tinyint", "smallint", "int", "decimal(24,0)"):
            columns.append(f"CAST(`{name}` AS BIGINT) AS `{name}`")
        elif kind.startswith("decimal") or kind in ("double", "float"):
            # Adding zero turns a negative zero into a plain one.
            columns.append(f"round(CAST(`{name}` AS DOUBLE), {digits}) + 0.0D AS `{name}`")
        elif kind == "date":
            columns.append(f"date_format(`{name}`, 'yyyy-MM-dd') AS `{name}`")
        elif kind.startswith("timestamp"):
            columns.append(f"date_format(`{name}`, 'yyyy-MM-dd HH:mm:ss') AS `{name}`")
        else:
            columns.append(f"`{name}`")
    return df.selectExpr(*columns)


# --- landing, silver, history, facts -------------------------------------------------


@query
def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Star(spark, sf_dir).silver_rows)


@query
def dq_log(spark, sf_dir):
    return shown(silver_ops.quality_counts(Star(spark, sf_dir).silver_rows))


@query
def borrower_history(spark, sf_dir):
    return shown(Star(spark, sf_dir).borrowers_later)


@query
def borrower_changes(spark, sf_dir):
    star = Star(spark, sf_dir)
    first = scd2.change_counts(star.no_borrowers, scd2.borrower_attributes(star.silver))
    second = scd2.change_counts(star.borrowers, scd2.borrower_attributes(star.silver_later))
    return shown(
        first.withColumn("snapshot_date", F.lit(given.FIRST_SNAPSHOT)).unionByName(
            second.withColumn("snapshot_date", F.lit(given.SECOND_SNAPSHOT))
        )
    )


@query
def borrower_as_of(spark, sf_dir):
    """Attributes as they were in mid-January and mid-February."""
    star = Star(spark, sf_dir)
    days = F.array(F.lit("2026-01-15").cast("date"), F.lit("2026-02-15").cast("date"))
    rows = star.silver.filter(~F.col("dq_row_quarantined")).select("applicant_id", F.explode(days).alias("as_of"))
    found = scd2.version_at(rows, star.borrowers_later, "as_of")
    return shown(found.select("applicant_id", "as_of", "borrower_key", "age", "age_band", "dependents_band"))


@query
def fact_assessment(spark, sf_dir):
    return shown(Star(spark, sf_dir).fact)


@query
def fact_upsert(spark, sf_dir):
    """The first load, corrected for unknown incomes, plus the second load."""
    star = Star(spark, sf_dir)
    corrected = star.silver.withColumn(
        "monthly_income", F.when(F.col("dq_income_missing"), F.lit(3000)).otherwise(F.col("monthly_income")).cast("decimal(14,2)")
    ).filter("dq_income_missing")
    staged = star.fact_of(corrected, star.borrowers).unionByName(star.fact_later)
    merged = upsert(star.fact, staged, ["applicant_id", "snapshot_date_key"])
    return shown(
        merged.select(
            "applicant_id", "snapshot_date_key", "borrower_key", "income_band_key", "monthly_income", "dataset_split"
        )
    )


@query
def silver_upsert(spark, sf_dir):
    """Applicants without an income are ingested again a month later."""
    star = Star(spark, sf_dir)
    staged = star.silver_later.filter("dq_income_missing")
    merged = upsert(star.silver, staged, ["applicant_id"])
    return shown(merged.select("applicant_id", "snapshot_date", "age", "number_of_dependents", "dq_income_missing"))


@query
def borrower_insert_if_absent(spark, sf_dir):
    """Known applicants keep their first row; only unknown ones are added."""
    star = Star(spark, sf_dir)
    target = scd2.borrower_attributes(star.silver).filter(F.col("number_of_dependents").isNotNull())
    staged = scd2.borrower_attributes(star.silver_later)
    return shown(insert_if_absent(target, staged, ["applicant_id"]))


@query
def model_view(spark, sf_dir):
    """Both snapshots joined to the borrower version that each fact row names."""
    star = Star(spark, sf_dir)
    return shown(credit_view(star.fact.unionByName(star.fact_later), star.borrowers_later))


@query
def constraint_violations(spark, sf_dir):
    """All declared constraints of the fact, on a load with injected faults."""
    star = Star(spark, sf_dir)
    k = F.col("applicant_id")
    copies = F.when(k % 701 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    faulty = star.fact.select("*", F.explode(copies).alias("copy")).drop("copy")
    faulty = cut(faulty.withColumns(
        {
            "income_band_key": F.when(k % 709 == 0, 99).otherwise(F.col("income_band_key")),
            "utilisation_band_key": F.when(k % 719 != 0, F.col("utilisation_band_key")),
            "borrower_key": F.when(k % 727 == 0, -k).otherwise(F.col("borrower_key")),
            "dataset_split": F.when(k % 733 == 0, "holdout").otherwise(F.col("dataset_split")),
        }
    ))
    keys = ["snapshot_date_key", "borrower_key", "income_band_key", "utilisation_band_key", "delinquency_profile_key"]
    report = assertions.constraint_report(
        faulty,
        unique=[["applicant_id", "snapshot_date_key"]],
        references=[
            ("snapshot_date_key", dimensions.calendar(spark), "date_key"),
            ("borrower_key", star.borrowers, "borrower_key"),
            ("income_band_key", star.incomes, "income_band_key"),
            ("utilisation_band_key", star.utilisations, "utilisation_band_key"),
            ("delinquency_profile_key", star.profiles, "delinquency_profile_key"),
        ],
        required=keys,
        allowed={"dataset_split": fv.SPLITS, "is_serious_delinquency": fv.LABEL_VALUES},
    )
    return shown(report)


@query
def latest_run(spark, sf_dir):
    """Orders read as ingestion runs: newest successful run per customer segment."""
    runs = given.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("ingestion_id"),
        F.col("o_orderpriority").alias("source_file"),
        F.col("o_orderdate").cast("timestamp").alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("FAILED")
        .alias("status"),
    )
    return shown(latest_success(runs, ["source_file"]))


# --- portfolio reports ---------------------------------------------------------------


@query
def portfolio_summary(spark, sf_dir):
    return shown(portfolio.portfolio_summary(Star(spark, sf_dir).fact))


@query
def segment_default_rates(spark, sf_dir):
    star = Star(spark, sf_dir)
    return shown(portfolio.segment_default_rates(star.fact, star.profiles, star.incomes))


@query
def default_rate_by_severity(spark, sf_dir):
    star = Star(spark, sf_dir)
    return shown(portfolio.default_rate_by_severity(star.fact, star.profiles))


@query
def default_rate_by_income_band(spark, sf_dir):
    star = Star(spark, sf_dir)
    return shown(portfolio.default_rate_by_income_band(star.fact, star.incomes))


@query
def top_segments(spark, sf_dir):
    star = Star(spark, sf_dir)
    return shown(portfolio.top_segments(portfolio.segment_default_rates(star.fact, star.profiles, star.incomes), 10))


@query
def random_applicants(spark, sf_dir):
    drawn = portfolio.random_applicants(Star(spark, sf_dir).view, 25)
    return shown(drawn.select("applicant_id", "age", "is_serious_delinquency", "revolving_utilisation"))


# --- features ------------------------------------------------------------------------


def _fitted(star: Star):
    cleaned = features.clean_credit(star.stored_view)
    return cleaned, features.fit_credit(cleaned.filter("dataset_split = 'train'"))


@query
def feature_params(spark, sf_dir):
    _, params = _fitted(Star(spark, sf_dir))
    names = ["median_income", "utilisation_cap", "debt_ratio_cap", "median_age"]
    row = tuple(params.values[n] for n in names)
    return shown(small_table(spark, [row], ", ".join(f"{n} double" for n in names)))


@query
def credit_features(spark, sf_dir):
    cleaned, params = _fitted(Star(spark, sf_dir))
    return shown(features.credit_features(cleaned, params, ("applicant_id", "dataset_split")))


@query
def tree_features(spark, sf_dir):
    cleaned = features.clean_tree(Star(spark, sf_dir).fact)
    return shown(features.tree_features(cleaned, features.fit_tree(cleaned), ("applicant_id", "dataset_split")))


@query
def class_balance(spark, sf_dir):
    train = features.clean_credit(Star(spark, sf_dir).view).filter("dataset_split = 'train'")
    return shown(features.class_balance(train))


@query
def cleaning_counts(spark, sf_dir):
    """Splits over every silver row, so that unlabelled rows show."""
    rows = Star(spark, sf_dir).silver_rows.withColumn("dataset_split", dataset_split(F.col("applicant_id")))
    return shown(features.cleaning_counts(rows))


# --- drift ---------------------------------------------------------------------------


def _train_profile(star: Star):
    """The profile writes the training features; those of other rows are made where they are counted."""
    cleaned, params = _fitted(star)
    rows = features.credit_features(cleaned, params, ("dataset_split",))
    profile = drift.reference_profile(rows.filter("dataset_split = 'train'"), fv.CREDIT_FEATURES)
    return cleaned, params, rows, profile


def _readable_edges(profile):
    """Infinite outer edges are shown as null."""
    return profile.withColumns(
        {c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in ("lower_edge", "upper_edge")}
    )


@query
def reference_profile(spark, sf_dir):
    _, _, _, profile = _train_profile(Star(spark, sf_dir))
    return shown(_readable_edges(profile))


@query
def psi_by_split(spark, sf_dir):
    """Validation and test features against the training profile."""
    _, _, rows, profile = _train_profile(Star(spark, sf_dir))
    profile = cut(profile)
    counts = drift.bin_counts(
        rows.filter("dataset_split <> 'train'"), drift.edges_of(profile), ("dataset_split",)
    )
    return shown(drift.with_status(drift.psi_by_feature(profile, counts, ("dataset_split",))))


@query
def scenario_drift(spark, sf_dir):
    """Test applicants under portfolio stress, against the training profile."""
    cleaned, params, _, profile = _train_profile(Star(spark, sf_dir))
    profile = cut(profile)
    test = cleaned.filter("dataset_split = 'test' and age is not null")
    shifted = features.credit_features(scoring.scenario_rows(test), params, ("scenario",))
    counts = drift.bin_counts(shifted, drift.edges_of(profile), ("scenario",))
    return shown(drift.with_status(drift.psi_by_feature(profile, counts, ("scenario",))))


# --- monitoring ----------------------------------------------------------------------


def _as_of():
    return F.lit(given.AS_OF).cast("timestamp")


@query
def prediction_volume(spark, sf_dir):
    return shown(monitoring.prediction_volume(given.prediction_log(spark, sf_dir), _as_of()), 12)


def _drift_batches(spark, sf_dir):
    """Two batches of drift reports with their hours: the last ten and the last three days."""
    log = given.prediction_log(spark, sf_dir)
    values = log.select(
        "received_at",
        "status",
        F.try_element_at(F.from_json("feature_vector", "map<string,double>"), F.lit("k")).alias("k"),
    )
    past = values.filter((F.col("received_at") < given.REFERENCE_UNTIL) & (F.col("status") == "OK"))
    profile = cut(drift.reference_profile(past, ["k"]))
    windows = F.array(
        *[
            F.struct(F.lit(t).cast("timestamp").alias("computed_at"), F.lit(h).alias("hours"))
            for h, t in ((240, "2024-01-30 00:00:00"), (72, given.AS_OF))
        ]
    )
    by = ("computed_at", "hours", "model_version")
    end = F.col("computed_at")
    current = log.filter("status = 'OK'").select("*", F.inline(windows)).filter(
        (F.col("received_at") > end - F.make_dt_interval(hours="hours")) & (F.col("received_at") <= end)
    )
    psi = drift.with_status(drift.logged_psi(current, profile, by), warn=0.005, alert=0.01)
    return monitoring.drift_rows(
        psi,
        F.lit("credit"),
        F.col("model_version"),
        end,
        F.lit(f"log before 2024-01-21, {fv.DRIFT_BINS} bins"),
        F.format_string("last %dh of prediction_log", "hours"),
        F.col("hours"),
    )


def _drift_report(spark, sf_dir):
    return _drift_batches(spark, sf_dir).drop("hours")


@query
def logged_drift(spark, sf_dir):
    return shown(_drift_report(spark, sf_dir), 5)


@query
def latest_drift(spark, sf_dir):
    return shown(monitoring.latest_batch(_drift_report(spark, sf_dir)).select(
        "feature_name", "model_version", "psi", "drift_status", "computed_at", "n_reference", "n_current"
    ), 5)


@query
def service_metrics(spark, sf_dir):
    log = given.prediction_log(spark, sf_dir)
    return shown(monitoring.service_metrics(log, _as_of(), _drift_report(spark, sf_dir), "v1"))


@query
def score_histogram(spark, sf_dir):
    return shown(evaluation.score_histogram(given.prediction_log(spark, sf_dir), "probability_default"))


@query
def recent_scores(spark, sf_dir):
    return shown(monitoring.recent_scores(given.prediction_log(spark, sf_dir)))


@query
def prediction_calendar(spark, sf_dir):
    """Predictions per calendar day with the date dimension's attributes."""
    log = given.prediction_log(spark, sf_dir)
    daily = log.groupBy(date_key(F.col("received_at")).alias("date_key")).agg(F.count("*").alias("n"))
    return shown(daily.join(dimensions.calendar(spark), "date_key"))


# --- evaluation ----------------------------------------------------------------------


@query
def confusion_metrics(spark, sf_dir):
    rows = given.scored_labels(spark, sf_dir)
    return shown(evaluation.threshold_metrics(evaluation.confusion_counts(rows, "y", "score")))


@query
def rank_metrics(spark, sf_dir):
    return shown(evaluation.rank_metrics(given.scored_labels(spark, sf_dir), "y", "score"))


def _labelled_documents(spark, sf_dir):
    documents = given.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = given.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").filter("quality is not null")


@query
def document_rank_metrics(spark, sf_dir):
    return shown(evaluation.rank_metrics(_labelled_documents(spark, sf_dir), "quality", "n_chars"))


@query
def decile_lift(spark, sf_dir):
    return shown(evaluation.decile_lift(given.scored_labels(spark, sf_dir), "y", "score", "id"))


@query
def document_decile_lift(spark, sf_dir):
    return shown(evaluation.decile_lift(_labelled_documents(spark, sf_dir), "quality", "n_chars", "doc_id"))


@query
def evaluation_gap(spark, sf_dir):
    """Evaluation of the test split next to the validation AUC."""
    rows = cut(given.scored_labels(spark, sf_dir).withColumn("dataset_split", dataset_split(F.col("id"))))
    valid_auc = evaluation.rank_metrics(rows.filter("dataset_split = 'valid'"), "y", "score").select("auc").scalar()
    test = evaluation.evaluation_row(rows.filter("dataset_split = 'test'"), "y", "score", 0.4)
    gap, warning = evaluation.auc_gap(valid_auc, F.col("auc"))
    return shown(test.select("*", gap, warning))


# --- requests and scoring ------------------------------------------------------------


def _requests(spark, sf_dir):
    """Scoring requests from applicants, some under source headers, some broken."""
    k, c = F.col("k"), F.col("c")
    base = given.applicant_base(spark, sf_dir)
    fields = {
        "RevolvingUtilizationOfUnsecuredLines": F.when(k % 101 == 0, -0.5).otherwise(F.col("util_pct") / 100),
        "age": F.when(k % 103 == 0, 12).when(k % 107 == 0, 200).when(k % 109 != 0, 18 + c % 60),
        "DebtRatio": (F.col("qty") % 97) / 50,
        "MonthlyIncome": F.when(k % 113 == 0, -1000).when(k % 5 != 0, F.col("price") % 14000),
        "open_credit_lines": F.when(k % 127 == 0, -1).otherwise(F.col("n_lines") + c % 12),
        "real_estate_loans": c % 4,
        "NumberOfTime30-59DaysPastDueNotWorse": F.when(k % 131 == 0, 96).otherwise(F.greatest(F.col("n_r") - 1, F.lit(0))),
        "NumberOfTime60-89DaysPastDueNotWorse": F.when(k % 137 == 0, 98).otherwise(F.greatest(F.col("n_a") - 1, F.lit(0))),
        "NumberOfTimes90DaysLate": F.greatest(F.col("n_r") + F.col("n_a") - 4, F.lit(0)),
        "number_of_dependents": F.when(k % 37 != 0, c % 5),
    }
    return base.select(k.alias("request_id"), *[v.cast("double").alias(n) for n, v in fields.items()])


@query
def rejected_requests(spark, sf_dir):
    bad = requests.rejected(requests.validate(_requests(spark, sf_dir)))
    return shown(bad.select("request_id", F.concat_ws("; ", F.array_sort("errors")).alias("errors")))


@query
def accepted_requests(spark, sf_dir):
    return shown(requests.accepted(requests.validate(_requests(spark, sf_dir))))
