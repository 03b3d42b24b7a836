"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept; all but the last return the columns
of documents. Rows with a null or repeated id, null texts and extra columns are allowed:
language ID rejects texts without letters, and of rows alike in id and text one stays.
Columns of any name pass through, ``__key`` included.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweir.llm import decontamination, language, near_copies, packing, quality
from creditweir.llm.scratch import cut
from creditweir.llm.tokens import default_vocabulary

#: Corrected share of n-grams that the best language must hold.
LEAST_SCORE = 0.3
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Texts that go to a Python worker at a time; thousands of whole texts would fill its memory and the executor's.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1500


def _in_small_batches(stage):
    """The session's setting stays for as long as the stage's result may be read."""

    @wraps(stage)
    def run(spark, docs, sf_dir):
        if int(spark.conf.get(BATCH)) not in range(1, BATCH_ROWS + 1):
            spark.conf.set(BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The rows with a key of their content, and the operators' view with the key as id.

    The key is the same in every scan, so verdicts meet their rows after a lost executor
    as well; rows alike share it and their verdict.
    """
    key = _free(docs, "__key")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))
    return rows, rows.select(F.col(key).alias("doc_id"), "text", "lang", "source"), key


def _named(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``keys`` holds.

    The keys grow with the rows and are never broadcast, not even by a small table: each
    stage writes its rows once to a shuffle, at any size.
    """
    return rows.hint("merge").join(keys, key, "left_semi")


def _kept(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``verdicts`` (doc_id) names."""
    return _named(rows, verdicts.select(F.col("doc_id").alias(key)).distinct(), key).drop(key)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their own labels teach; no label of a row decides about it alone."""
    model = language.train(docs.select("text", "lang"))
    away = {c: _free(docs, f"__{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    judged = language.predict(docs.withColumnsRenamed(away), model)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in away.items()})


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their group's robust centre."""
    rows, view, key = _keyed(docs)
    return _kept(rows, quality.judge(view).where("kept"), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, and one row of it."""
    rows, view, key = _keyed(docs)
    found = near_copies.near_copies(view, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component_id"), F.count("*").alias("rows"))
    named = rows.select(F.col(key).alias("key"), "doc_id").distinct().join(found, "key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = cut(named.groupBy("component_id").agg(F.min_by(F.struct(F.col("key").alias(key), "rows"), order).alias("first")).select("first.*"))
    once = _named(rows, first.where("rows = 1").select(key), key)
    repeated = _named(rows, first.where("rows > 1").select(key), key).dropDuplicates([key])
    return once.unionByName(repeated).drop(key)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    rows, view, key = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(rows, decontamination.contamination(view, benchmark).where(F.size("begins") == 0), key)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their place in a training sequence."""
    return packing.pack(packing.pieces(docs, default_vocabulary(), end_id=0)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long")
    )


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in [
        ("language ID", identify_language),
        ("quality rules", apply_quality),
        ("near copies", drop_near_copies),
        ("benchmark decontamination", remove_contaminated),
        ("best-fit packing", pack_sequences),
    ]
]
#: Learned, robust and packed stages are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
