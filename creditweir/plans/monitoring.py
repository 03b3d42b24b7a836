"""Reports over the prediction log and the drift reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir.operators.quantiles import exact_quantiles

STATUS_RANK = {"ALERT": 1, "WARN": 2, "OK": 3}


def recent(log: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Log rows of the last ``hours`` up to ``as_of``; other day folders are skipped."""
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    if "received_date" in log.columns:
        log = log.filter(F.col("received_date").between(F.to_date(start), F.to_date(as_of)))
    return log.filter((F.col("received_at") > start) & (F.col("received_at") <= as_of))


def hourly_volume(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "received_at").alias("hour")).agg(
        F.count("*").alias("n"), F.avg("probability_default").alias("avg_probability")
    )


def prediction_volume(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return hourly_volume(recent(log, as_of, days * 24)).orderBy("hour")


def service_metrics(log: DataFrame, as_of: Column, drift_report: DataFrame, active_version: str) -> DataFrame:
    """One row of service figures; latency quantiles are exact."""
    last_hour = (F.col("received_at") > as_of - F.expr("interval 1 hour")) & (F.col("received_at") <= as_of)
    p50, p95 = exact_quantiles(log, {"latency_ms": [0.5, 0.95]})["latency_ms"]
    counts = log.agg(
        F.count("*").alias("predictions_total"),
        F.count_if(last_hour).alias("predictions_last_hour"),
        F.count_if(F.col("status") != "OK").alias("errors_total"),
        F.avg(F.when(last_hour, F.col("probability_default"))).alias("average_probability_last_hour"),
    )
    return counts.select(
        "predictions_total",
        "predictions_last_hour",
        "errors_total",
        F.lit(p50 or 0.0).alias("latency_p50_ms"),
        F.lit(p95 or 0.0).alias("latency_p95_ms"),
        "average_probability_last_hour",
        F.lit(active_version).alias("active_model_version"),
        worst_status(drift_report).scalar().alias("drift_status"),
    )


def latest_batch(drift_report: DataFrame, pipeline: str = None) -> DataFrame:
    """Rows of the newest drift batch, largest PSI first."""
    report = drift_report if pipeline is None else drift_report.filter(F.col("pipeline_name") == pipeline)
    newest = report.agg(F.max("computed_at")).scalar()
    return report.filter(F.col("computed_at") == newest).orderBy(F.desc("psi"), "feature_name")


def worst_status(drift_report: DataFrame) -> DataFrame:
    """Worst status of the newest batch as one row; UNKNOWN without a report."""
    order = F.lit(len(STATUS_RANK))
    for status, rank in STATUS_RANK.items():
        order = F.when(F.col("drift_status") == status, rank).otherwise(order)
    # Newest batch first, then worst status, in one aggregate.
    pick = F.struct(-F.unix_micros("computed_at"), order)
    return drift_report.agg(
        F.coalesce(F.min_by("drift_status", pick), F.lit("UNKNOWN")).alias("drift_status")
    )


def recent_scores(log: DataFrame, n: int = 5000) -> DataFrame:
    """The newest ``n`` scored rows; ties by request id."""
    return (
        log.filter(F.col("probability_default").isNotNull())
        .orderBy(F.desc("received_at"), F.desc("request_id"))
        .limit(n)
        .select("request_id", "probability_default", "received_at")
    )


def drift_rows(psi: DataFrame, pipeline: Column, version: Column, computed_at: Column, reference_window: Column,
               current_window: Column, *extra: Column) -> DataFrame:
    """PSI rows in the shape of the drift report, ``extra`` behind; one time for the whole batch."""
    return psi.select(
        computed_at.alias("computed_at"),
        pipeline.alias("pipeline_name"),
        version.alias("model_version"),
        F.col("feature").alias("feature_name"),
        F.col("psi").cast("decimal(10,6)").alias("psi"),
        "drift_status",
        reference_window.alias("reference_window"),
        current_window.alias("current_window"),
        "n_reference",
        "n_current",
        *extra,
    )


def alert_event(report: DataFrame, window_hours: Column) -> DataFrame:
    """One service event per batch listing its alerting features; none without alerts."""
    alerts = report.filter(F.col("drift_status") == "ALERT").withColumn("window_hours", window_hours)
    # At most one entry per profiled feature.
    entry = F.struct((-F.col("psi")).alias("order"), F.col("feature_name").alias("feature"), F.round("psi", 4).alias("psi"))
    listed = F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["feature"].alias("feature"), e["psi"].alias("psi"))
    )
    grouped = alerts.groupBy("computed_at", "pipeline_name", "model_version", "window_hours").agg(listed.alias("features"))
    return grouped.select(
        F.col("computed_at").alias("occurred_at"),
        F.lit("monitoring").alias("service_name"),
        F.lit("drift_alert").alias("event_type"),
        F.to_json(
            F.struct(
                F.col("pipeline_name").alias("pipeline"),
                "model_version",
                "window_hours",
                "features",
            )
        ).alias("details"),
    )


def skipped_event(skipped: DataFrame) -> DataFrame:
    """One service event per batch listing the profiled features that were not logged; none if all were.

    ``skipped`` is (computed_at, pipeline_name, model_version, window_hours, feature, n_rows).
    """
    grouped = skipped.groupBy("computed_at", "pipeline_name", "model_version", "window_hours").agg(
        F.array_sort(F.collect_list("feature")).alias("features"), F.max("n_rows").alias("n_rows")
    )
    return grouped.select(
        F.col("computed_at").alias("occurred_at"),
        F.lit("monitoring").alias("service_name"),
        F.lit("drift_skipped").alias("event_type"),
        F.to_json(F.struct(F.col("pipeline_name").alias("pipeline"), "model_version", "window_hours", "n_rows", "features")).alias("details"),
    )


def status_counts(report: DataFrame) -> DataFrame:
    """Alerts, warnings and stable features of each batch."""
    return report.groupBy("computed_at", "pipeline_name", "model_version").agg(
        *[F.count_if(F.col("drift_status") == s).alias(f"n_{s.lower()}") for s in reversed(fv.DRIFT_STATUSES)]
    )
