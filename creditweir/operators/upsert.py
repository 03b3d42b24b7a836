"""Set-based upsert and insert-if-absent on whole tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, staged: DataFrame, keys: list, keep: tuple = ()) -> DataFrame:
    """Staged rows replace target rows with the same key; the rest stay.

    Columns named in ``keep`` are not overwritten on rows that already exist.
    ``staged`` must be unique on ``keys``.
    """
    untouched = target.join(staged.select(*keys), keys, "left_anti")
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in keep])
        kept = {c: F.coalesce(F.col(f"old_{c}"), F.col(c)).alias(c) for c in keep}
        staged = staged.join(old, keys, "left").select(*[kept.get(c, F.col(c)) for c in target.columns])
    return untouched.unionByName(staged.select(*target.columns))


def insert_if_absent(target: DataFrame, staged: DataFrame, keys: list) -> DataFrame:
    """Target rows stay as they are; only unknown keys are added."""
    fresh = staged.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))
