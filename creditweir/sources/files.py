"""File sources: all-text CSV scan, fingerprints and row numbers."""

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweir import fixed_values as fv

BLOCK = ["source_file", "_block"]
#: Splits whose row counts are broadcast, at a few hundred bytes each.
MAX_SPLITS = 1_000_000
#: Bytes of a file that a fingerprint reads at a time.
PIECE = 8 << 20


@dataclass(frozen=True)
class Source:
    """What ingestion needs of any source: its rows and its fingerprints.

    ``read`` returns text columns named by business column plus ``source_file``,
    ``source_row_number`` and ``position``; any Spark reader can stand behind it. ``fingerprint`` returns one (source_file, file_sha256) row
    per input file.
    """

    name: str
    read: Callable[[SparkSession], DataFrame]
    fingerprint: Callable[[SparkSession], DataFrame]


def csv_source(path: str, header_names: list = None, multi_line: bool = False) -> Source:
    """A CSV file or folder of CSV files with one header line per file."""
    return Source(
        path,
        lambda spark: read_csv_text(spark, path, header_names, multi_line),
        lambda spark: fingerprints(spark, path),
    )


def rename_headers(name: str) -> str:
    """Bronze column of a source header; unknown headers keep their name."""
    if name in fv.UNNAMED_HEADERS:
        return fv.SOURCE_HEADERS["Unnamed: 0"]
    return fv.SOURCE_HEADERS.get(name, name)


def _header(spark: SparkSession, path: str) -> list:
    """Column names from the header line; only the first row is looked at."""
    return spark.read.option("header", True).csv(path).columns


def read_csv_text(spark: SparkSession, path: str, header_names: list = None, multi_line: bool = False) -> DataFrame:
    """Every column as text, blanks kept as '', plus lineage.

    ``source_row_number`` counts data rows per file from 0, ``position`` counts
    them over all files in path order. Lines are numbered within their
    file split as they are read; splits are counted in a second, column-free
    scan. The counts are broadcast, so no row is shuffled, up to ``MAX_SPLITS`` splits; beyond
    them rows are joined by split. Splits that changed between the scans are an error, not lost
    rows. Quoted line breaks need ``multi_line``, which makes each file one split.
    """
    names = header_names or _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("enforceSchema", True)
        .schema(schema)
        .csv(path)
        .select(
            *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(rename_headers(n)) for n in names],
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_read_order"),
        )
    )
    # Splits are a function of the file list and the session's settings, so both
    # scans number the lines alike. There is one row per split from here on.
    blocks = rows.groupBy(*BLOCK).agg(F.min("_read_order").alias("_first"), F.count("*").alias("_rows"))
    in_file = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *BLOCK,
        "_first",
        F.coalesce(F.sum("_rows").over(in_file), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(in_all), F.lit(0)).alias("_before_all"),
    )
    in_block = F.col("_read_order") - F.col("_first")
    # A partition holds whole files and at most one part of a file that is cut at both ends.
    if rows.rdd.getNumPartitions() + len(rows.inputFiles()) <= MAX_SPLITS:
        starts = F.broadcast(starts)
    moved = F.raise_error(F.lit("the file splits changed between two scans")).cast("bigint")
    numbered = rows.join(starts, BLOCK, "left").withColumns(
        {
            "source_row_number": F.coalesce("_before", moved) + in_block,
            "position": F.col("_before_all") + in_block,
        }
    )
    return numbered.drop("_block", "_read_order", "_first", "_before", "_before_all")


def file_store(path: str):
    """The file system of a path as tasks reach it, and the path there; None where only Spark's readers do."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path)
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):  # unknown, or its client is not installed
        return None


def streamed_digest(path: str, piece: int = PIECE) -> str:
    """SHA-256 of a file of any size, read piece by piece; nothing but the piece is held."""
    store, name = file_store(path)
    digest = hashlib.sha256()
    with store.open_input_stream(name, buffer_size=0) as stream:
        while data := stream.read(piece):
            digest.update(data)
    return digest.hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_sha256) of every file, each digested by one task as it is read.

    The listing reads no content and, as Spark does, leaves out empty files. Files of a store that only Spark's readers reach
    come as binary rows instead, which Spark limits to 2 GB; a larger one is an error.
    """
    files = spark.read.format("binaryFile").load(path)
    named = files.select(F.col("path").alias("source_file"))
    first = named.first()
    if first is None or file_store(first["source_file"]) is None:
        return files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_sha256"))

    def run(batches):
        for batch in batches:
            for name in batch.column("source_file").to_pylist():
                # One row at a time, so a long file keeps no digest waiting.
                yield pa.record_batch([pa.array([name]), pa.array([streamed_digest(name)])], names=["source_file", "file_sha256"])

    # Names are few bytes each, but stand for much work: spread over all cores, whatever their size.
    spread = named.repartition(spark.sparkContext.defaultParallelism, "source_file")
    return spread.mapInArrow(run, "source_file string, file_sha256 string")
