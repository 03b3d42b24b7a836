"""The load job: seed, ingest, silver, borrowers, fact."""

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir import fixed_values as fv
from creditweir import schemas
from creditweir.operators import assertions, dimensions, facts, scd2, silver
from creditweir.session import cut
from creditweir.sources import ingest as landing
from creditweir.sources.files import Source
from creditweir.sources.tables import Tables

log = logging.getLogger("creditweir.etl")

SILVER = "silver/loan_applications"
REJECTS = "silver/rejected_rows"
DQ_LOG = "silver/data_quality_log"
BORROWERS = "gold/dim_borrower"  # current versions
CLOSED_BORROWERS = "gold/dim_borrower_closed"  # a folder per closing date
FACT = "gold/fact_credit_assessment"
SEEDED = {
    "gold/dim_date": (dimensions.calendar, ["date_key"], schemas.DIM_DATE),
    "gold/dim_income_band": (dimensions.income_bands, ["band_label"], schemas.DIM_INCOME_BAND),
    "gold/dim_utilisation_band": (dimensions.utilisation_bands, ["band_label"], schemas.DIM_UTILISATION_BAND),
    "gold/dim_delinquency_profile": (
        dimensions.delinquency_profiles,
        ["has_30_59_late", "has_60_89_late", "has_90_plus_late", "has_sentinel_code"],
        schemas.DIM_DELINQUENCY_PROFILE,
    ),
}


def seed_dimensions(tables: Tables) -> None:
    for name, (build, keys, schema) in SEEDED.items():
        tables.seed(name, build(tables.spark), keys, schema)


def load_silver(tables: Tables, ingestion_id: str = None, snapshot_date: str = None) -> str:
    """Transform one bronze run and merge it into silver; returns the run's id."""
    run, day = landing.run_to_load(tables, ingestion_id, snapshot_date)
    bronze = landing.read_run(tables, run)
    _, unkeyed = silver.split_unkeyed(bronze)
    # A run that is loaded again adds no row twice.
    known = tables.read_appended(REJECTS, schemas.BRONZE_APPLICATIONS).filter(F.col("ingestion_id") == run).select("bronze_id")
    tables.append(REJECTS, cut(unkeyed.join(known, "bronze_id", "left_anti")), schemas.BRONZE_APPLICATIONS)
    staged = cut(silver.to_silver(bronze, F.lit(day)).withColumn("processed_at", F.current_timestamp()))
    tables.upsert(SILVER, staged, ["applicant_id"], schemas.SILVER_APPLICATIONS)
    counts = silver.quality_counts(staged).select(
        F.lit(run).alias("ingestion_id"), "*", F.current_timestamp().alias("checked_at")
    )
    tables.append(DQ_LOG, counts, schemas.DATA_QUALITY_LOG)
    return run


def load_borrowers(tables: Tables) -> tuple:
    """Apply silver to the borrower history; returns (new, changed).

    Only current versions are read and rewritten. Versions closed by this load
    go to the folder of their closing date, before the current versions change:
    a load that is repeated after a failure closes the same versions again.
    """
    current = tables.read(BORROWERS, schemas.DIM_BORROWER)
    incoming = scd2.borrower_attributes(tables.read(SILVER, schemas.SILVER_APPLICATIONS))
    counts = scd2.change_counts(current, incoming).first()
    versions = cut(scd2.merge_versions(current, incoming))
    tables.upsert_partitions(
        CLOSED_BORROWERS, versions.filter("not is_current"), ["borrower_key", "effective_to"], schemas.DIM_BORROWER,
        "effective_to",
    )
    tables.replace(BORROWERS, versions.filter("is_current"), schemas.DIM_BORROWER)
    return counts["n_new"], counts["n_changed"]


def read_borrowers(tables: Tables) -> DataFrame:
    """All versions, current and closed."""
    closed = tables.read_appended(CLOSED_BORROWERS, schemas.DIM_BORROWER)
    return tables.read(BORROWERS, schemas.DIM_BORROWER).unionByName(closed)


def load_fact(tables: Tables) -> None:
    """Build the fact from silver and upsert the snapshot dates it holds.

    The built rows are audited first: one that breaks a constraint stops the load, and
    the stored fact stays as it was.
    """
    fact = cut(
        facts.build_fact(
            tables.read(SILVER, schemas.SILVER_APPLICATIONS),
            tables.read(BORROWERS, schemas.DIM_BORROWER),
            tables.read("gold/dim_income_band"),
            tables.read("gold/dim_utilisation_band"),
            tables.read("gold/dim_delinquency_profile"),
        )
    )
    assertions.require_no_nulls(fact, facts.KEY_COLUMNS)
    assertions.require_clean(fact_constraints(tables, fact))
    tables.upsert_partitions(
        FACT, fact, ["applicant_id", "snapshot_date_key"], schemas.FACT_ASSESSMENT, "snapshot_date_key"
    )


def read_fact(tables: Tables) -> DataFrame:
    return tables.read_appended(FACT, schemas.FACT_ASSESSMENT)


def read_model_view(tables: Tables) -> DataFrame:
    return facts.credit_view(read_fact(tables), read_borrowers(tables))


def fact_report(tables: Tables) -> DataFrame:
    """Violations of the stored fact's declared constraints."""
    return fact_constraints(tables, read_fact(tables))


def fact_constraints(tables: Tables, fact: DataFrame) -> DataFrame:
    """Violations of the declared constraints in ``fact``, stored or still to be."""
    return assertions.constraint_report(
        fact,
        unique=[["applicant_id", "snapshot_date_key"]],
        references=[
            ("snapshot_date_key", tables.read("gold/dim_date"), "date_key"),
            ("borrower_key", read_borrowers(tables), "borrower_key"),
            ("income_band_key", tables.read("gold/dim_income_band"), "income_band_key"),
            ("utilisation_band_key", tables.read("gold/dim_utilisation_band"), "utilisation_band_key"),
            ("delinquency_profile_key", tables.read("gold/dim_delinquency_profile"), "delinquency_profile_key"),
        ],
        required=list(facts.KEY_COLUMNS),
        allowed={"dataset_split": fv.SPLITS, "is_serious_delinquency": fv.LABEL_VALUES},
    )


def run(tables: Tables, source: Source = None, snapshot_date: str = None) -> dict:
    """All stages in order; with a source it is ingested first. Seconds per stage."""
    seconds = {}

    def stage(name, work):
        started = time.monotonic()
        work()
        seconds[name] = time.monotonic() - started
        log.info("%s finished in %.1fs", name, seconds[name])

    stage("seed_dimensions", lambda: seed_dimensions(tables))
    if source is not None:
        stage("ingest", lambda: landing.ingest(tables, source))
    stage("silver", lambda: load_silver(tables, snapshot_date=snapshot_date))
    stage("borrowers", lambda: load_borrowers(tables))
    stage("fact", lambda: load_fact(tables))
    return seconds
