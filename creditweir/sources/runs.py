"""The audit table of ingestion runs: one appended row per state change."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import schemas


def current_state(runs: DataFrame) -> DataFrame:
    """The latest appended state of each run; an end state beats RUNNING."""
    rank = F.when(F.col("status") == "RUNNING", 0).otherwise(1)
    rest = [c for c in runs.columns if c != "ingestion_id"]
    newest = F.max_by(F.struct(*rest), rank).alias("_newest")
    return runs.groupBy("ingestion_id").agg(newest).select("ingestion_id", "_newest.*")


def latest_success(runs: DataFrame, by: tuple = ()) -> DataFrame:
    """Newest successful run (per ``by`` group) and its UTC snapshot date.

    Runs that end at the same moment are ordered by id as a number when they are
    numbers, else as text.
    """
    order = F.struct("completed_at", F.coalesce(F.col("ingestion_id").try_cast("bigint"), F.lit(0)), "ingestion_id")
    picked = runs.filter(F.col("status") == "SUCCESS").groupBy(*by).agg(
        F.max_by("ingestion_id", order).alias("ingestion_id"), F.max("completed_at").alias("completed_at")
    )
    return picked.filter(F.col("ingestion_id").isNotNull()).withColumn("snapshot_date", F.to_date("completed_at"))


def append_state(spark: SparkSession, path: str, ingestion_id: str, source_file: str, sha256: str, status: str,
                 row_count: int = None, error: str = None) -> None:
    """Append one state row; times are the cluster's clock at write."""
    done = status == "SUCCESS"
    row = spark.range(1).select(
        F.lit(ingestion_id).alias("ingestion_id"),
        F.lit(source_file).alias("source_file"),
        F.lit(sha256).alias("file_sha256"),
        F.lit(row_count).cast("bigint").alias("row_count"),
        F.current_timestamp().alias("started_at"),
        F.when(F.lit(done), F.current_timestamp()).alias("completed_at"),
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"),
    )
    schemas.conform(row, schemas.INGESTION_RUNS).write.mode("append").parquet(path)
