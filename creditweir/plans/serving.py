"""Batch scoring with explanation, prediction logging and the drift check."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir import schemas
from creditweir.operators import assertions, attribution, audit, drift, models, reasons, requests, scoring
from creditweir.plans import etl, monitoring, training
from creditweir.session import cut, small_table
from creditweir.sources import artifacts
from creditweir.sources.tables import Tables

PREDICTION_LOG = "monitoring/prediction_log"
DRIFT_REPORT = "monitoring/drift_report"
SERVICE_EVENT = "monitoring/service_event"
PREDICTION_FACT = "gold/fact_prediction"


def score_requests(valid: DataFrame, artifact_root: str, pipeline_name: str = "credit", version: str = "v1",
                   threshold: float = fv.DECISION_THRESHOLD, explain: bool = True) -> DataFrame:
    """Valid requests with probability, decision and, if asked, contributions.

    One transform for the whole table: features, model, attribution and ranking
    are column work on the same partitions, with no shuffle. A request whose features
    can't be built gets an ``error_message`` and neither probability nor contributions;
    the batch goes on.
    """
    pipeline = models.get_pipeline(pipeline_name)
    model, params, _ = artifacts.load(artifact_root, pipeline_name, version)
    request = F.struct(*fv.REQUEST_ALIASES).alias("request")
    carried = valid.select("*", request)
    kept = ("request_id", "request", "error_message")
    cleaned = pipeline.clean(carried, pipeline.target).withColumn("error_message", pipeline.row_error())
    ready = pipeline.apply(cleaned, params, kept, strict=False)
    scored = models.score(ready, model, params.feature_names)
    names = params.feature_names
    if explain:
        build = models.boosted_attributor if pipeline.algorithm == "GBTClassifier" else models.tree_attributor
        filled = scored.withColumns(
            {n: F.coalesce(F.col(n).cast("double"), F.lit(models.MISSING_VALUE)) for n in names}
        )
        scored = attribution.attribute(filled, build(model, names))
        ranked = reasons.ranked_contributions(names, F.col, lambda n: F.col(f"shap_{n}"))
        scored = scored.withColumn("contributions", F.when(F.col("error_message").isNull(), ranked))
    features = F.struct(*names).alias("features")
    extra = ["base_value", "contributions"] if explain else []
    return scoring.decide(scored.select(*kept, features, "probability_default", *extra), threshold=threshold)


def stress(valid: DataFrame, artifact_root: str, pipeline_name: str = "credit", version: str = "v1") -> DataFrame:
    """Valid requests rescored by the stored model under every stress scenario, for ``scoring.stress_summary`` and ``band_migration``."""
    pipeline = models.get_pipeline(pipeline_name)
    model, params, _ = artifacts.load(artifact_root, pipeline_name, version)

    def score(rows):
        # The features replace columns of the same names, so the row travels aside.
        carried = rows.select("*", F.struct(*rows.columns).alias("_row"))
        cleaned = pipeline.clean(carried, pipeline.target).withColumn("_error", pipeline.row_error())
        ready = pipeline.apply(cleaned, params, ("_row", "_error"), strict=False)
        p = F.when(F.col("_error").isNull(), F.col("probability_default"))
        return models.score(ready, model, params.feature_names).select("_row.*", p.alias("probability_default"))

    return scoring.rescored(valid, score)


def log_predictions(tables: Tables, scored: DataFrame, pipeline: str, version: str, received_at: Column = None,
                    latency_ms: Column = None) -> None:
    """Append one log row per scored request, a folder per day."""
    rows = scoring.log_rows(
        scored,
        list(fv.REQUEST_ALIASES),
        [f.name for f in scored.schema["features"].dataType],
        pipeline,
        version,
        F.current_timestamp() if received_at is None else received_at,
        latency_ms,
    )
    tables.append(PREDICTION_LOG, rows, schemas.PREDICTION_LOG, ("received_date",))


def reports(scored: DataFrame, pipeline: str, version: str, algorithm: str, status: str = "disabled") -> DataFrame:
    """Reason codes, payload and template report per explained request; a request in error has none."""
    scored = scored.filter("error_message is null")
    flags = F.struct(
        F.col("request.monthly_income").isNull().alias("monthly_income_imputed"),
        F.col("request.number_of_dependents").isNull().alias("dependents_missing"),
    )
    payload = reasons.payload(
        F.col("contributions"), F.col("request_id"), F.col("probability_default"), F.col("risk_band"),
        F.col("threshold_used"), flags, pipeline, version, algorithm,
    )
    with_payload = scored.select("*", payload.alias("payload"), reasons.reason_codes(F.col("contributions")).alias("reason_codes"))
    report = reasons.template_report("payload", ["monthly_income_imputed", "dependents_missing"], status)
    return with_payload.withColumn("report", report)


def final_reports(reported: DataFrame, replies: DataFrame, enabled: bool = True) -> DataFrame:
    """The report a reader gets per row of ``reports``: the written one if its audit finds nothing, else the template.

    ``replies`` holds (request_id, reply). Of several replies to a request the greatest
    text counts; they are reduced before the join, so a request with many of them is one
    row. A request without a reply keeps its row and gets the template.
    """
    latest = replies.groupBy("request_id").agg(F.max("reply").alias("reply"))
    rows = reported.withColumnRenamed("report", "template").join(latest, "request_id", "left")
    audited = audit.audit(rows)
    final = audit.final_report(F.lit(enabled), F.col("template"))
    return audited.withColumn("final_report", final).drop("template", "report", "reply").withColumnRenamed(
        "final_report", "report"
    )


def check_drift(tables: Tables, artifact_root: str, pipeline: str, version: str, as_of: Column, window_hours: int = 24,
                warn: float = fv.DRIFT_WARN, alert: float = fv.DRIFT_ALERT) -> DataFrame:
    """Compare the log's last hours with the reference profile and record it.

    Fewer than the minimum rows write nothing. Returns the recorded batch.
    """
    profile = artifacts.load_profile(artifact_root, pipeline, version)
    log = tables.read_appended(PREDICTION_LOG, schemas.PREDICTION_LOG)
    current = monitoring.recent(log, as_of, window_hours).filter(
        (F.col("pipeline_name") == pipeline) & (F.col("model_version") == version) & (F.col("status") == "OK")
    )
    psi = drift.with_status(drift.logged_psi(current, profile), warn, alert)
    head = profile.select("split", "bins").first()
    batch = cut(
        monitoring.drift_rows(
            psi,
            F.lit(pipeline),
            F.lit(version),
            as_of,
            F.lit(f"{head['split']} split, {head['bins']} bins"),
            F.lit(f"last {window_hours}h of prediction_log"),
        )
    )
    tables.append(DRIFT_REPORT, batch, schemas.DRIFT_REPORT)
    tables.append(SERVICE_EVENT, monitoring.alert_event(batch, F.lit(window_hours)), schemas.SERVICE_EVENT)
    skipped = drift.skipped_features(current, profile).withColumns(
        {"computed_at": as_of, "pipeline_name": F.lit(pipeline), "model_version": F.lit(version), "window_hours": F.lit(window_hours)}
    )
    tables.append(SERVICE_EVENT, monitoring.skipped_event(skipped), schemas.SERVICE_EVENT)
    return batch


def load_predictions(tables: Tables, first_day: str, last_day: str, applicants: DataFrame = None) -> DataFrame:
    """Store the prediction fact of the log's days ``first_day`` to ``last_day``; returns its constraint report.

    Only those day folders are read and rewritten. The report is checked first: any
    violation, such as a model that is not registered, stops the load and the stored
    fact stays as it was. Without ``applicants`` no row has a borrower.
    """
    log = tables.read_appended(PREDICTION_LOG, schemas.PREDICTION_LOG)
    log = log.filter(F.col("received_date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    known = tables.read(training.REGISTRY, schemas.DIM_MODEL)
    versions = etl.read_borrowers(tables)
    if applicants is None:
        applicants = small_table(tables.spark, [], "request_id string, applicant_id bigint")
    facts = cut(scoring.with_borrowers(scoring.prediction_facts(log, known), applicants, versions))
    report = cut(scoring.prediction_constraints(facts, known, versions, tables.read("gold/dim_date")))
    assertions.require_clean(report)
    tables.upsert_partitions(PREDICTION_FACT, facts, ["request_id", "date_key"], schemas.FACT_PREDICTION, "date_key")
    return report


def validated(raw_requests: DataFrame) -> tuple:
    """(accepted, rejected) requests; the rejected list all their errors."""
    checked = requests.validate(raw_requests)
    return requests.accepted(checked), requests.rejected(checked)
