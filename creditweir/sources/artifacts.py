"""Trained models and their metadata below one root, written by Spark."""

import json
from uuid import uuid4

from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir.operators.drift import PROFILE_SCHEMA
from creditweir.operators.features import FeatureParams

LOADERS = {
    "GBTClassifier": GBTClassificationModel,
    "DecisionTreeClassifier": DecisionTreeClassificationModel,
}


class ArtifactNotFoundError(LookupError):
    """No saved model, metadata or profile at the expected path."""


def artifact_path(root: str, pipeline: str, version: str) -> str:
    return f"{root.rstrip('/')}/{pipeline}/{version}"


def save(root: str, pipeline: str, version: str, model, params: FeatureParams, metadata: dict) -> str:
    """Model, feature parameters and metadata.

    A model gets a folder of its own, which the metadata names. The metadata is written
    last, so a version that is saved again is whole at any time: the old model or the new one.
    """
    spark = SparkSession.getActiveSession()
    path = artifact_path(root, pipeline, version)
    folder = f"model-{uuid4().hex}"
    model.write().save(f"{path}/{folder}")
    full = {
        "pipeline_name": pipeline,
        "model_version": version,
        "model_folder": folder,
        "feature_names": params.feature_names,
        "preprocessing": params.values,
        **metadata,
    }
    row = spark.range(1, numPartitions=1).select(
        F.lit(json.dumps(full)).alias("value")
    )
    row.write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_metadata(root: str, pipeline: str, version: str) -> dict:
    spark = SparkSession.getActiveSession()
    path = artifact_path(root, pipeline, version)
    if not _exists(spark, f"{path}/metadata/_SUCCESS"):
        raise ArtifactNotFoundError(f"no artifact for {pipeline!r} {version!r} at {path}: train it first")
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def load(root: str, pipeline: str, version: str) -> tuple:
    """(model, feature parameters, metadata)."""
    metadata = load_metadata(root, pipeline, version)
    path = artifact_path(root, pipeline, version)
    model = LOADERS[metadata["algorithm"]].load(f"{path}/{metadata.get('model_folder', 'model')}")
    return model, FeatureParams(metadata["feature_names"], metadata["preprocessing"]), metadata


def save_profile(root: str, pipeline: str, version: str, profile: DataFrame, split: str, bins: int) -> str:
    path = f"{artifact_path(root, pipeline, version)}/reference_profile"
    labelled = profile.select("*", F.lit(split).alias("split"), F.lit(bins).alias("bins"))
    labelled.write.mode("overwrite").parquet(path)
    return path


def load_profile(root: str, pipeline: str, version: str) -> DataFrame:
    spark = SparkSession.getActiveSession()
    path = f"{artifact_path(root, pipeline, version)}/reference_profile"
    if not _exists(spark, f"{path}/_SUCCESS"):
        raise ArtifactNotFoundError(f"no reference profile at {path}: build one after training")
    return spark.read.schema(f"{PROFILE_SCHEMA}, split string, bins int").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
