"""The model registry as a small table: register, activate, look up."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.operators.upsert import upsert

KEYS = ["pipeline_name", "model_version"]


class NoActiveModelError(LookupError):
    """A pipeline has no active model."""


def model_key(pipeline, version):
    """Stable key of a registry entry."""
    return F.xxhash64(pipeline, version)


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Add or refresh entries; a refreshed entry keeps its key and activity."""
    return upsert(registry, entries, KEYS, keep=("model_key", "is_active"))


def activate(registry: DataFrame, pipeline: str, version: str) -> DataFrame:
    """The registry with exactly one active version of the pipeline.

    The version is looked up first; an unknown one changes nothing.
    """
    wanted = (F.col("pipeline_name") == pipeline) & (F.col("model_version") == version)
    if registry.filter(wanted).limit(1).count() == 0:
        raise ValueError(f"cannot activate {pipeline!r} {version!r}: it is not registered")
    active = F.when(F.col("pipeline_name") == pipeline, F.col("model_version") == version).otherwise(
        F.col("is_active")
    )
    return registry.withColumn("is_active", active)


def active_models(registry: DataFrame) -> DataFrame:
    return registry.filter("is_active")


def active_model(registry: DataFrame, pipeline: str) -> dict:
    row = active_models(registry).filter(F.col("pipeline_name") == pipeline).first()
    if row is None:
        raise NoActiveModelError(f"no active model for pipeline {pipeline!r}: train one and activate it")
    return row.asDict()
