"""Landing of a source in bronze, with lineage and an audit trail."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir import schemas
from creditweir.operators.assertions import missing_columns
from creditweir.sources import runs
from creditweir.sources.files import Source
from creditweir.sources.tables import Tables

BRONZE = "bronze/loan_applications"
RUNS = "bronze/ingestion_runs"


def landed_rows(spark: SparkSession, source: Source, ingestion_id: str, start: int) -> DataFrame:
    """Source rows with run id, file, row number and a bronze id.

    Bronze ids go on from the last one of all earlier loads, in source order.
    """
    rows = source.read(spark)
    missing = missing_columns(rows, schemas.SOURCE_COLUMNS)
    if missing:
        raise ValueError(f"{source.name} lacks the columns {missing}")
    return rows.withColumns(
        {
            "bronze_id": F.lit(start).cast("bigint") + F.col("position"),
            "ingestion_id": F.lit(ingestion_id),
            "ingested_at": F.current_timestamp(),
        }
    )


def combined_digest(column: str):
    """The files' SHA-256 digests combined by exclusive or, in any file order.

    A single file keeps its own digest. The 64 hex digits are combined in pieces
    that fit a long.
    """
    pieces = []
    for start, length in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4)):
        piece = F.conv(F.substring(column, start, length), 16, 10).cast("bigint")
        pieces.append(F.lpad(F.lower(F.hex(F.bit_xor(piece))), length, "0"))
    return F.concat(*pieces)


def ingest(tables: Tables, source: Source, ingestion_id: str = None) -> str:
    """Append one source to bronze and return the run's id.

    The run is RUNNING until its rows are committed, then SUCCESS with the row
    count; on any error it is FAILED with the message, and the error is raised.
    Running the same file twice appends its rows twice, by design.
    """
    spark = tables.spark
    ingestion_id = ingestion_id or str(uuid4())
    log = tables.path(RUNS)
    digest = "unknown"
    runs.append_state(spark, log, ingestion_id, source.name, digest, "RUNNING")
    try:
        digest = source.fingerprint(spark).agg(combined_digest("file_sha256")).first()[0]
        first_id = tables.read_appended(BRONZE, schemas.BRONZE_APPLICATIONS).agg(F.max("bronze_id")).first()[0]
        start = 0 if first_id is None else first_id + 1
        landed = landed_rows(spark, source, ingestion_id, start)
        tables.append(BRONZE, landed, schemas.BRONZE_APPLICATIONS, ("ingestion_id",))
        count = read_run(tables, ingestion_id).count()
        runs.append_state(spark, log, ingestion_id, source.name, digest, "SUCCESS", row_count=count)
    except Exception as error:
        runs.append_state(spark, log, ingestion_id, source.name, digest, "FAILED", error=str(error))
        raise
    return ingestion_id


def read_run(tables: Tables, ingestion_id: str) -> DataFrame:
    """Bronze rows of one run; the run id is a partition, so others are skipped."""
    bronze = tables.read_appended(BRONZE, schemas.BRONZE_APPLICATIONS)
    return bronze.filter(F.col("ingestion_id") == ingestion_id)


def run_to_load(tables: Tables, ingestion_id: str = None, snapshot_date: str = None) -> tuple:
    """(ingestion_id, snapshot_date): as given, else the newest successful run."""
    log = runs.current_state(tables.read_appended(RUNS, schemas.INGESTION_RUNS))
    if ingestion_id is not None:
        log = log.filter(F.col("ingestion_id") == ingestion_id)
    row = runs.latest_success(log).first()
    if row is None:
        raise LookupError("no successful ingestion run")
    return row["ingestion_id"], snapshot_date or row["snapshot_date"].isoformat()
