"""Operator 2: shards under a byte limit by extendible hashing.

Each row has a 60-bit hash of its id and text. Bytes are summed per cell, a prefix a few
bits longer than the shards should need; every bucket starts as the whole directory and
only buckets over the limit split on their next bit. Cells still over the limit at their
last bit are summed again on more bits, those rows only, until all buckets fit or the
hash is used up. The directory has one entry per cell and is joined, not collected.

The columns of a row travel in one struct, ``row``, so none is lost or overwritten,
whatever its name. Rows alike in id and text share a hash: their bucket can stay over the limit, as can one
with a single longer row; both are marked ``oversized`` and written as several files.
Null ids and texts count as empty. An empty table gives no shard.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut

HASH_BITS, SPARE_BITS = 60, 6
LIMIT = 16 << 20


def _bits(prefix, depth):
    """The first ``depth`` bits as text; the whole directory is the empty text."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def sized(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, hash, n_bytes): every row of ``docs`` as a struct, with its hash and the bytes of its text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("|"), text)
    return docs.select(
        F.struct("*").alias("row"),
        F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(cell_bits, cell, depth, shard_bytes, shard_rows): the bucket of each cell of (hash, n_bytes)."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    before, bits = 0, min(HASH_BITS, max(1, (total // limit).bit_length()) + SPARE_BITS)
    pending, found = rows, None
    while True:
        cell = F.shiftrightunsigned("hash", HASH_BITS - bits)
        cells = cut(pending.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")))
        # What a cell adds to every bucket on its way down.
        levels = cells.select("cell", "n_bytes", "n_rows", F.explode(F.sequence(F.lit(before), F.lit(bits))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS))
        first = F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("bucket")
        bucket = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(first)
        entry = cut(cells.join(bucket, "cell", "left").select(F.lit(bits).alias("cell_bits"), "cell", "bucket.*"))
        done = entry.where("depth IS NOT NULL")
        found = done if found is None else found.unionByName(done)
        over = entry.where("depth IS NULL")
        if bits == HASH_BITS or not over.limit(1).count():
            return found
        pending = pending.join(over.select(F.col("cell").alias("over")), cell == F.col("over")).drop("over")
        before, bits = bits, min(HASH_BITS, bits + SPARE_BITS)


def assign(rows: DataFrame, entries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows with shard, depth, shard_bytes, shard_rows and oversized."""
    steps = sorted(r[0] for r in entries.select("cell_bits").distinct().collect())  # a handful of numbers
    bucket = F.lit(None).cast("struct<depth: int, shard_bytes: bigint, shard_rows: bigint>")
    for bits in steps:
        # Cells are few next to rows; Spark broadcasts them where their files are small.
        part = entries.where(F.col("cell_bits") == bits).select("cell", F.struct("depth", "shard_bytes", "shard_rows").alias(f"bucket{bits}"))
        rows = rows.withColumn("cell", F.shiftrightunsigned("hash", HASH_BITS - bits)).join(part, "cell", "left").drop("cell")
        bucket = F.coalesce(bucket, F.col(f"bucket{bits}"))
    rows = rows.withColumn("bucket", bucket).drop(*(f"bucket{b}" for b in steps))
    rows = rows.withColumns({c: F.col(f"bucket.{c}") for c in ("depth", "shard_bytes", "shard_rows")}).drop("bucket")
    shard = _bits(F.expr(f"shiftrightunsigned(hash, {HASH_BITS} - depth)"), F.col("depth"))
    return rows.withColumns({"shard": shard, "oversized": F.col("shard_bytes") > limit})


def shard(docs: DataFrame, id_column="doc_id", text_column="text", limit: int = LIMIT) -> DataFrame:
    """(row, hash, n_bytes, depth, shard_bytes, shard_rows, shard, oversized) of every row of ``docs``."""
    rows = sized(docs, id_column, text_column)
    return assign(rows, directory(rows.select("hash", "n_bytes"), limit), limit)


def write(assigned: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """One folder per shard; an oversized shard becomes several files."""
    files = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / limit)).cast("int")
    spread = F.when(F.col("oversized"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), files)).otherwise(0)
    named = assigned.withColumn("bucket", F.concat(F.lit("b"), "shard"))
    named.withColumn("part", spread).repartition("bucket", "part").drop("part").write.partitionBy("bucket").parquet(folder)
