"""Credit-shaped and monitoring inputs derived from the given tables.

One applicant per order, one scored request per event. All derivations are
whole-table DataFrame work, so their size follows the given data.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_SNAPSHOT = "2026-01-01"
SECOND_SNAPSHOT = "2026-02-01"
AS_OF = "2024-01-31 00:00:00"
REFERENCE_UNTIL = "2024-01-21 00:00:00"
INGESTION_ID = "00000000-0000-0000-0000-000000000001"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applicant_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer measures per order; the line items are combined map-side."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.expr("count(*) AS n_lines"),
            F.expr("sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pct"),
            F.expr("sum(floor(l_quantity)) AS qty"),
            F.expr("count_if(l_returnflag = 'R') AS n_r"),
            F.expr("count_if(l_returnflag = 'A') AS n_a"),
        )
    )
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "floor(o_totalprice) AS price")
    return orders.join(lines, F.expr("k = l_orderkey"), "left").selectExpr(
        "k",
        "c",
        "price",
        "coalesce(n_lines, 0) AS n_lines",
        "coalesce(disc_pct, 0) AS disc_pct",
        "coalesce(qty, 0) AS qty",
        "coalesce(n_r, 0) AS n_r",
        "coalesce(n_a, 0) AS n_a",
        "(coalesce(disc_pct, 0) * 7 + k) % 115 AS util_pct",
    )


# Integer risk score with ties; the label and the test scores come from it.
RISK_POINTS = "util_pct + 20 * greatest(n_r - 1, 0) + 15 * greatest(n_a - 1, 0) + (k * 7919) % 101"


def raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as a source file would hold them, one per applicant."""
    return applicant_base(spark, sf_dir).selectExpr(
        "k * 2 AS bronze_id",
        "string(k) AS raw_row_id",
        f"CASE WHEN k % 997 = 0 THEN '' WHEN {RISK_POINTS} > 215 THEN '1' ELSE '0' END AS serious_dlqin_2yrs",
        "CASE WHEN k % 211 = 0 THEN '50000' ELSE string(util_pct / 100) END AS revolving_utilization_unsecured_lines",
        "CASE WHEN k % 1499 = 0 THEN '0' ELSE string(18 + c % 60) END AS age",
        "CASE WHEN k % 557 = 0 THEN '98' ELSE string(greatest(n_r - 1, 0)) END AS times_30_59_days_past_due",
        "string((qty % 97) / 50) AS debt_ratio",
        "CASE WHEN k % 5 = 0 THEN '' ELSE string(price % 14000) END AS monthly_income",
        "string(n_lines + c % 12) AS open_credit_lines_and_loans",
        "CASE WHEN k % 563 = 0 THEN '96' ELSE string(greatest(n_r + n_a - 4, 0)) END AS times_90_days_late",
        "string(c % 4) AS real_estate_loans_or_lines",
        "string(greatest(n_a - 1, 0)) AS times_60_89_days_past_due",
        "CASE WHEN k % 37 = 0 THEN '' ELSE string(c % 5) END AS number_of_dependents",
    )


def bronze_applications(spark: SparkSession, sf_dir: str, ingestion_id: str = INGESTION_ID) -> DataFrame:
    """Bronze rows; every 50th applicant was ingested again with income 4321.

    The repeat is inlined from a two-element array, so the source is read once.
    """
    raw = raw_applications(spark, sf_dir)
    rows = raw.selectExpr("*", "explode(if(bronze_id % 100 = 0, array(0, 1), array(0))) AS repeat")
    return rows.selectExpr(
        "bronze_id + repeat AS bronze_id",
        f"'{ingestion_id}' AS ingestion_id",
        *[
            "if(repeat = 1, '4321', monthly_income) AS monthly_income" if c == "monthly_income" else c
            for c in raw.columns
            if c != "bronze_id"
        ],
    )


def second_snapshot(silver: DataFrame) -> DataFrame:
    """The same applicants a month later, some older or with more dependents."""
    k = F.col("applicant_id")
    later = {
        "number_of_dependents": F.when(
            (k % 13 == 0) & F.col("number_of_dependents").isNotNull(), (F.col("number_of_dependents") + 1) % 5
        ).otherwise(F.col("number_of_dependents")),
        "age": F.when(k % 17 == 0, F.col("age") + 10).otherwise(F.col("age")),
        "snapshot_date": F.lit(SECOND_SNAPSHOT).cast("date"),
    }
    return silver.select(
        *[later[c].cast(silver.schema[c].dataType).alias(c) if c in later else F.col(c) for c in silver.columns]
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score): applicants with an integer score that has many ties."""
    return applicant_base(spark, sf_dir).selectExpr(
        "k AS id",
        f"CAST({RISK_POINTS} > 215 AS INT) AS y",
        "least((util_pct + 20 * greatest(n_r - 1, 0) + (k * 31 + qty) % 83) / 400, 1.0D) AS score",
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as scored requests of two model versions."""
    events = table(spark, sf_dir, "events")
    return log_from_events(events)


def log_from_events(events: DataFrame) -> DataFrame:
    """Works on batch and streaming frames of events alike."""
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("credit").alias("pipeline_name"),
        F.when(F.col("user_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
        F.col("props").alias("feature_vector"),
        (F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(400.0)) / 400).alias("probability_default"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
    )
