"""Registered queries on scoring, explanation, reports, models and streams."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir import schemas
from creditweir.functions.text import plain_decimal
from creditweir.operators import attribution, audit, dimensions, drift, features, models, reasons, registry, requests, scoring
from creditweir.plans import given_tables as given
from creditweir.plans import monitoring, training
from creditweir.plans.catalog import _drift_batches, _drift_report, _fitted, _requests, query, shown
from creditweir.plans.star import Star
from creditweir.session import cut, shared_dir, small_table
from creditweir.sources import files
from creditweir.streaming import jobs as streams

FLAG_NAMES = ["monthly_income_imputed", "dependents_missing"]

# A fixed linear model: contribution = value x weight, for results that any
# engine can recompute. Large features are scaled down by their size.
LARGE = {"monthly_income": 4999, "monthly_debt_payment": 4999, "income_per_dependent": 1999, "age": 53, "open_credit_lines": 11}
LINEAR_WEIGHTS = {
    f: 0.0137 * ((i * 7) % 11 - 5) / LARGE.get(f, 1) for i, f in enumerate(fv.CREDIT_FEATURES)
}


def linear_probability():
    base = F.col("utilisation_bucket") * 0.07 + F.col("has_any_delinquency") * 0.1 + 0.013
    return F.round(base + F.least(F.col("total_delinquency_events"), F.lit(5.0)) * 0.031, 4)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every applicant with decision, ranked linear contributions and payload."""
    cleaned, params = _fitted(Star(spark, sf_dir))
    flags = F.struct(
        F.col("monthly_income").isNull().alias("monthly_income_imputed"),
        F.col("number_of_dependents").isNull().alias("dependents_missing"),
    )
    rows = features.credit_features(cleaned.withColumn("flags", flags), params, ("applicant_id", "flags"))
    ranked = reasons.ranked_contributions(
        fv.CREDIT_FEATURES, F.col, lambda n: F.col(n) * F.lit(LINEAR_WEIGHTS[n]) + F.lit(0.0)
    )
    scored = rows.select(
        "applicant_id", "flags", linear_probability().alias("probability_default"), ranked.alias("contributions")
    )
    return scoring.decide(scored)


def _with_payload(explained: DataFrame) -> DataFrame:
    payload = reasons.payload(
        F.col("contributions"),
        F.concat(F.lit("req-"), F.col("applicant_id").cast("string")),
        F.col("probability_default"),
        F.col("risk_band"),
        F.col("threshold_used"),
        F.col("flags"),
        "credit",
        "v1",
        "linear",
    )
    return explained.withColumn("payload", payload)


# For a plain ``inline`` Spark asks at the scan whether the list is empty, and so makes every list twice;
# empty lists are left out behind the generator instead.
_LISTED = "rank IS NOT NULL"


@query
def scored_applicants(spark, sf_dir):
    return shown(_explained(spark, sf_dir).select(
        "applicant_id", "probability_default", "predicted_class", "risk_band", "threshold_used"
    ))


@query
def reason_codes(spark, sf_dir):
    codes = _explained(spark, sf_dir).select("applicant_id", F.inline_outer(reasons.reason_codes(F.col("contributions"))))
    return shown(codes.filter(_LISTED))


@query
def model_payload(spark, sf_dir):
    rows = _with_payload(_explained(spark, sf_dir))
    return shown(rows.select(
        "applicant_id",
        F.col("payload.request_id").alias("request_id"),
        F.col("payload.prediction.probability_of_default").alias("probability_of_default"),
        F.col("payload.population_baseline.average_probability_of_default").alias("average_probability"),
        F.col("payload.data_quality.dependents_missing").alias("dependents_missing"),
        F.inline_outer("payload.contributions"),
    ).filter(_LISTED))


def _joined(column: str, text) -> DataFrame:
    return F.concat_ws(" | ", F.transform(column, text))


def _report_texts(report: DataFrame) -> DataFrame:
    """The report ``r`` of each applicant as flat texts."""
    return shown(report.select(
        "applicant_id",
        F.col("r.summary").alias("summary"),
        _joined("r.key_risk_factors", lambda f: F.concat_ws(": ", f["reason_code"], f["factor"], f["observation"]))
        .alias("key_risk_factors"),
        _joined("r.mitigating_factors", lambda f: F.concat_ws(": ", f["factor"], f["observation"]))
        .alias("mitigating_factors"),
        F.concat_ws(" | ", "r.data_quality_notes").alias("data_quality_notes"),
        F.concat_ws(" | ", "r.recommended_checks").alias("recommended_checks"),
        F.col("r.confidence").alias("confidence"),
        F.col("r.llm_status").alias("llm_status"),
    ))


@query
def template_report(spark, sf_dir):
    rows = _with_payload(_explained(spark, sf_dir))
    return _report_texts(rows.select("applicant_id", reasons.template_report("payload", FLAG_NAMES, "disabled").alias("r")))


def _replies(spark, sf_dir):
    """Written reports with known faults, one kind per remainder of the id."""
    rows = _with_payload(_explained(spark, sf_dir))
    kind = F.col("applicant_id") % 6
    report = rows.withColumn("kind", kind).withColumn("r", reasons.template_report("payload", FLAG_NAMES, "ok"))
    fake = F.struct(F.lit("Invented").alias("factor"), F.lit("Nothing.").alias("observation"), F.lit("R99").alias("reason_code"))
    factors = F.when(F.col("kind") == 1, F.array(fake)).when(F.col("kind") == 5, F.slice("r.key_risk_factors", 1, 0)).otherwise(
        F.col("r.key_risk_factors")
    )
    percent = plain_decimal(F.round(F.col("payload.prediction.probability_of_default") * 100, 2))
    summary = F.when(F.col("kind") == 2, F.lit("Default probability is 987654.321 percent.")).otherwise(
        F.concat(F.lit("The modelled probability is "), percent, F.lit(" percent."))
    )
    body = F.to_json(F.struct(
        summary.alias("summary"),
        factors.alias("key_risk_factors"),
        F.col("r.mitigating_factors").alias("mitigating_factors"),
        F.col("r.data_quality_notes").alias("data_quality_notes"),
        F.col("r.recommended_checks").alias("recommended_checks"),
        F.lit("medium").alias("confidence"),
    ))
    reply = F.when(F.col("kind") == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        F.col("kind") == 4, F.lit("I cannot write this report.")
    ).otherwise(body)
    return report.select("applicant_id", "payload", reply.alias("reply"))


@query
def report_audit(spark, sf_dir):
    audited = audit.audit(_replies(spark, sf_dir))
    return shown(audited.select(
        "applicant_id",
        F.concat_ws("; ", "problems").alias("problems"),
        F.concat_ws("; ", "fabricated").alias("fabricated"),
        F.concat_ws("; ", F.transform("unsupported", lambda n: n.cast("double").cast("string"))).alias("unsupported"),
        "is_valid",
        audit.outcome(F.col("applicant_id") % 7 != 0).alias("outcome"),
    ))


@query
def final_reports(spark, sf_dir):
    """The report each reader gets; every 7th request may not be written about, every 11th has no reply."""
    replies = _replies(spark, sf_dir).withColumn("reply", F.when(F.col("applicant_id") % 11 != 0, F.col("reply")))
    template = reasons.template_report("payload", FLAG_NAMES, "disabled")
    chosen = audit.final_report(F.col("applicant_id") % 7 != 0, template)
    return _report_texts(audit.audit(replies).select("applicant_id", chosen.alias("r")))


# --- failed requests, stress -----------------------------------------------------------

# Parameters as a model folder would hold them, so that any engine knows them.
STORED_PARAMS = features.FeatureParams(
    list(fv.CREDIT_FEATURES),
    {"median_income": 5400.0, "utilisation_cap": 1.5, "debt_ratio_cap": 2.0, "median_age": 52.0},
)


@query
def request_log(spark, sf_dir):
    """The log of valid requests; every 139th has a utilisation that is no number, every 149th was sent as a bad text."""
    k = F.col("request_id")
    sent = _requests(spark, sf_dir).withColumns({
        "RevolvingUtilizationOfUnsecuredLines": F.when(k % 139 == 0, float("nan")).otherwise(F.col("RevolvingUtilizationOfUnsecuredLines")),
        "DebtRatio": F.when(k % 149 == 0, "n/a").otherwise(F.col("DebtRatio").cast("string")),
    })
    valid = requests.accepted(requests.validate(sent))
    carried = features.clean_credit(valid.select("*", F.struct(*fv.REQUEST_ALIASES).alias("request")))
    cleaned = carried.withColumn("error_message", features.credit_row_error())
    kept = ("request_id", "request", "error_message")
    rows = features.credit_features(cleaned, STORED_PARAMS, kept, strict=False)
    scored = rows.select(*kept, F.struct(*fv.CREDIT_FEATURES).alias("features"), linear_probability().alias("probability_default"))
    log = scoring.log_rows(
        scoring.decide(scored), list(fv.REQUEST_ALIASES), fv.CREDIT_FEATURES, "credit", "v1", F.lit(given.AS_OF).cast("timestamp")
    )
    return shown(log.select(
        "request_id", "status", "error_message", "probability_default", "predicted_class", "risk_band",
        F.get_json_object("request_payload", "$.age").cast("double").alias("age_sent"),
        F.get_json_object("request_payload", "$.revolving_utilisation").cast("double").alias("utilisation_sent"),
        F.get_json_object("feature_vector", "$.utilisation_bucket").cast("double").alias("utilisation_bucket"),
    ))


def _stressed(spark, sf_dir):
    """Test applicants with their own and their stressed linear probability."""
    cleaned, params = _fitted(Star(spark, sf_dir))

    def score(rows):
        carried = rows.select("*", F.struct(*rows.columns).alias("_row"))
        return features.credit_features(carried, params, ("_row",), strict=False).select(
            "_row.*", linear_probability().alias("probability_default")
        )

    return scoring.rescored(cleaned.filter("dataset_split = 'test'"), score)


@query
def stress_scores(spark, sf_dir):
    return shown(scoring.stress_summary(_stressed(spark, sf_dir), 0.3))


@query
def stress_migration(spark, sf_dir):
    return shown(scoring.band_migration(_stressed(spark, sf_dir)))


# --- drift events, registry, prediction fact -----------------------------------------


@query
def drift_alerts(spark, sf_dir):
    """Alert events of each drift batch, as the listed features."""
    events = monitoring.alert_event(_drift_batches(spark, sf_dir), F.col("hours"))
    detail = "struct<pipeline:string,model_version:string,window_hours:int,features:array<struct<feature:string,psi:double>>>"
    parsed = events.select("occurred_at", "event_type", F.from_json("details", detail).alias("d"))
    return shown(parsed.select("occurred_at", "event_type", "d.pipeline", "d.model_version", "d.window_hours", F.inline("d.features")))


@query
def drift_status_counts(spark, sf_dir):
    return shown(monitoring.status_counts(_drift_report(spark, sf_dir)))


def _registry_entries(log: DataFrame) -> DataFrame:
    """One registry entry per logged model, measured on its log."""
    return log.groupBy("pipeline_name", "model_version").agg(
        F.count("*").alias("training_rows"),
        F.avg("probability_default").alias("metric_auc"),
        F.max("received_at").alias("trained_at"),
    ).select(
        registry.model_key(F.col("pipeline_name"), F.col("model_version")).alias("model_key"),
        "pipeline_name",
        F.concat_ws("_", "pipeline_name", F.lit("linear")).alias("model_name"),
        "model_version",
        F.lit("linear").alias("algorithm"),
        F.lit("{}").alias("hyperparameters"),
        F.lit("[]").alias("feature_list"),
        "training_rows",
        "trained_at",
        F.col("metric_auc").cast("decimal(6,4)").alias("metric_auc"),
        F.lit(0).cast("decimal(6,4)").alias("metric_ks"),
        F.lit(False).alias("is_active"),
    )


@query
def model_registry(spark, sf_dir):
    """Register both versions on early rows, activate v2, refresh on all rows."""
    log = given.prediction_log(spark, sf_dir)
    empty = small_table(spark, [], schemas.DIM_MODEL)
    early = _registry_entries(log.filter(F.col("received_at") < given.REFERENCE_UNTIL))
    first = cut(registry.activate(registry.register(empty, early), "credit", "v2"))
    refreshed = registry.register(first, _registry_entries(log))
    return shown(refreshed.select("pipeline_name", "model_name", "model_version", "training_rows", "trained_at", "is_active"))


@query
def prediction_facts(spark, sf_dir):
    """The prediction fact; only v1 is registered, so v2 has no model key."""
    log = given.prediction_log(spark, sf_dir)
    known = _registry_entries(log).filter("model_version = 'v1'")
    facts = scoring.prediction_facts(log, known)
    return shown(facts.withColumn("has_model", F.col("model_key").isNotNull()).drop("model_key"))


def _borrower_facts(spark, sf_dir, log):
    """Prediction facts of v1 and v2 with borrowers, and what they refer to; only v1 is registered.

    The log is moved to January and February 2026, where both borrower versions lie. One
    request in 97 was logged twice, and the applicants of some requests are unknown.
    """
    moved = log.withColumn("received_at", F.col("received_at") + F.expr("interval 746 days"))
    known = cut(_registry_entries(moved).filter("model_version = 'v1'"))
    events = given.table(spark, sf_dir, "events")
    applicants = events.select(F.col("event_id").alias("request_id"), (F.col("user_id") * 101).alias("applicant_id"))
    versions = cut(Star(spark, sf_dir).borrowers_later)
    return cut(scoring.with_borrowers(scoring.prediction_facts(moved, known), applicants, versions)), known, versions


@query
def prediction_borrowers(spark, sf_dir):
    """Applicant and borrower version of every prediction."""
    facts, _, _ = _borrower_facts(spark, sf_dir, given.prediction_log(spark, sf_dir))
    return shown(facts.select("date_key", "request_id", "applicant_id", "borrower_key", "risk_band"))


@query
def prediction_constraints(spark, sf_dir):
    """What the audit before a load finds in predictions with repeated requests, a model that is not registered and missing borrowers."""
    log = given.prediction_log(spark, sf_dir)
    facts, known, versions = _borrower_facts(spark, sf_dir, log.unionByName(log.filter("request_id % 97 = 0")))
    held = versions.filter("applicant_id % 3 > 0")
    return shown(scoring.prediction_constraints(facts, known, held, dimensions.calendar(spark)))


@query
def skipped_features(spark, sf_dir):
    """Profiled features that no vector of a version and third of the month carries; v2 logs empty vectors in the second third."""
    log = given.prediction_log(spark, sf_dir).filter("status = 'OK'").withColumn("third", F.expr("day(received_at) div 10"))
    emptied = (F.col("model_version") == "v2") & (F.col("third") == 1)
    log = log.withColumn("feature_vector", F.when(emptied, "{}").otherwise(F.col("feature_vector")))
    past = log.select(
        F.try_element_at(F.from_json("feature_vector", "map<string,double>"), F.lit("k")).alias("k"),
        F.col("probability_default").alias("margin"),
    )
    profile = cut(drift.reference_profile(past, ["k", "margin"]))
    return shown(drift.skipped_features(log, profile, ("model_version", "third")))


def _fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


# --- sources -------------------------------------------------------------------------


@query
def bronze_from_csv(spark, sf_dir):
    """Applicants written as CSV under the source headers, landed again as text."""
    headers = {column: header for header, column in fv.SOURCE_HEADERS.items()}
    raw = given.raw_applications(spark, sf_dir)
    folder = _fresh(spark, "csv")
    named = raw.select(*[F.col(c).alias(headers[c]) for c in schemas.SOURCE_COLUMNS])
    named.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)
    landed = files.csv_source(folder).read(spark)
    per_file = landed.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.max("source_row_number").alias("last"), F.countDistinct("source_row_number").alias("numbers")
    )
    numbered = per_file.filter((F.col("last") + 1 != F.col("rows")) | (F.col("numbers") != F.col("rows"))).agg(F.count("*")).scalar()
    return shown(landed.select(*schemas.SOURCE_COLUMNS).withColumn("files_misnumbered", numbered))


@query
def file_fingerprints(spark, sf_dir):
    """The given orders as text files by status, and the streamed SHA-256 of each file."""
    folder = _fresh(spark, "prints")
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), "o_orderkey", line.alias("line"))
    # One task and so one file a status, its lines by key.
    sorted_ = orders.repartition("status").sortWithinPartitions("status", "o_orderkey")
    sorted_.select("status", "line").write.partitionBy("status").text(folder)
    prints = files.fingerprints(spark, f"{folder}/status=*/*.txt")
    return prints.select(F.regexp_extract("source_file", "status=([^/]*)/", 1).alias("status"), "file_sha256")


# --- models --------------------------------------------------------------------------


def _trained(spark, sf_dir, pipeline):
    star = Star(spark, sf_dir)
    rows = star.stored_view if pipeline == "credit" else cut(star.fact)
    model, params, metadata = training.train(pipeline, rows)
    scored = training.predict(rows, models.get_pipeline(pipeline), model, params)
    return rows, model, params, metadata, scored


@query
def boosted_scores(spark, sf_dir):
    *_, scored = _trained(spark, sf_dir, "credit")
    return shown(scoring.decide(scored.select("applicant_id", "dataset_split", "probability_default")).drop("error_message"))


@query
def tree_scores(spark, sf_dir):
    *_, scored = _trained(spark, sf_dir, "dummy")
    return shown(scoring.decide(scored.select("applicant_id", "dataset_split", "probability_default")).drop("error_message"))


@query
def boosted_evaluation(spark, sf_dir):
    """Test-split metrics and decile lift of the boosted model: a row per decile, each with the metrics of the split."""
    _, _, _, metadata, scored = _trained(spark, sf_dir, "credit")
    test = cut(scored.filter("dataset_split = 'test'").select("applicant_id", "is_serious_delinquency", "probability_default"))
    metrics, deciles = training.measures(test, "is_serious_delinquency", metadata)
    # A split without rows has metrics and no decile.
    return shown(metrics.join(deciles, F.lit(True), "left").select(*deciles.columns, *metrics.columns))


@query
def boosted_attribution(spark, sf_dir):
    """Top contributions per applicant, with the additivity gap of each row."""
    rows, model, params, _, _ = _trained(spark, sf_dir, "credit")
    pipeline = models.get_pipeline("credit")
    names = params.feature_names
    ready = pipeline.apply(pipeline.clean(rows, pipeline.target), params, ("applicant_id",))
    scored = models.score(ready, model, names)
    filled = scored.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(models.MISSING_VALUE)) for n in names})
    explained = attribution.attribute(filled, models.boosted_attributor(model, names))
    total = F.col("base_value")
    for name in names:
        total = total + F.col(f"shap_{name}")
    p = F.col("probability_default")
    ranked = reasons.ranked_contributions(names, F.col, lambda n: F.col(f"shap_{n}"))
    return shown(explained.select(
        "applicant_id", F.abs(total - F.ln(p / (1 - p))).alias("additivity_gap"), F.inline_outer(ranked)
    ).filter(_LISTED))


# --- streams -------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = given.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return given.log_from_events(events)


@query
def stream_volume(spark, sf_dir):
    """Closed hours of the event stream, appended by a streaming job."""
    path = _fresh(spark, "volume")
    streams.start_volume(_event_stream(spark, sf_dir), path).awaitTermination()
    return shown(spark.read.parquet(path), 12)


@query
def stream_drift(spark, sf_dir):
    """Daily PSI per model version from the event stream."""
    log = given.prediction_log(spark, sf_dir)
    values = log.filter((F.col("received_at") < given.REFERENCE_UNTIL) & (F.col("status") == "OK")).select(
        F.try_element_at(F.from_json("feature_vector", "map<string,double>"), F.lit("k")).alias("k")
    )
    profile = cut(drift.reference_profile(values, ["k"]))
    path = _fresh(spark, "drift")
    streams.start_drift(_event_stream(spark, sf_dir), profile, path).awaitTermination()
    return shown(spark.read.parquet(path).drop("batch"), 5)
