"""Streaming counterparts of hourly volume and of the drift check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from creditweir import fixed_values as fv
from creditweir.operators import drift
from creditweir.operators.longform import binned, cell_counts
from creditweir.plans import monitoring
from creditweir.session import shared_dir


def hourly_volume(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Volume and mean score per hour; rows later than the watermark are dropped."""
    windows = log.withWatermark("received_at", lateness).groupBy(F.window("received_at", "1 hour"))
    return windows.agg(F.count("*").alias("n"), F.avg("probability_default").alias("avg_probability")).select(
        F.col("window.start").alias("hour"), "n", "avg_probability"
    )


def windowed_bin_counts(log: DataFrame, profile: DataFrame, window: str, lateness: str) -> DataFrame:
    """(window, model_version, feature, bin, n) of logged features.

    The state holds one count per window, version, feature and bin: bounded by
    the profile, not by the traffic.
    """
    edges = drift.edges_of(profile)
    ok = log.filter(F.col("status") == "OK").withWatermark("received_at", lateness)
    vector = F.from_json("feature_vector", "map<string,double>").alias("vector")
    read = ok.select(F.window("received_at", window).alias("window"), "model_version", vector)
    by = ("window", "model_version")
    bins = binned(read, {f: F.try_element_at("vector", F.lit(f)) for f in edges}, edges, by)
    counted = cell_counts(bins, edges, by, missing=True)
    return counted.select(F.col("window.end").alias("window_end"), "model_version", "feature", "bin", "n")


def window_psi(counts: DataFrame, profile: DataFrame, min_rows: int = fv.DRIFT_MIN_ROWS) -> DataFrame:
    """PSI per window, version and feature; windows with few rows give nothing."""
    by = ("window_end", "model_version")
    rows = counts.groupBy(*by, "feature").agg(F.sum("n").alias("n_rows"))
    enough = counts.join(rows.filter(F.col("n_rows") >= min_rows).drop("n_rows"), [*by, "feature"])
    binned = enough.withColumn("n", F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0))
    return drift.with_status(drift.psi_by_feature(profile, binned, by))


def start_drift(log: DataFrame, profile: DataFrame, path: str, window: str = "1 day", lateness: str = "1 hour",
                checkpoint: str = None) -> StreamingQuery:
    """Write the PSI of every closed window; each batch replaces its own folder.

    A window closes once, so a batch holds whole windows; a retried batch
    overwrites what it wrote before.
    """
    counts = windowed_bin_counts(log, profile, window, lateness)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        psi = window_psi(batch, profile)
        psi.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return (
        counts.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint or f"{path}_checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def start_volume(log: DataFrame, path: str, lateness: str = "1 hour", checkpoint: str = None) -> StreamingQuery:
    """Append the hourly volume of closed hours to a Parquet folder."""
    return (
        hourly_volume(log, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint or f"{path}_checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
