"""Session settings and the shared folder used to cut lineage."""

import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(master="local[*]", shuffle_partitions=None, app="creditweir", **conf) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster leave ``master`` and the sizing to spark-submit; the settings
    below only pin semantics (UTC, adaptive execution and skew handling).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM does not compile methods above 8000 bytes; wide projections run
        # several times faster when Spark splits them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call sites in error messages cost a stack walk for every column built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it then gets a fresh
    folder of its own. On a cluster the missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="creditweir-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Unlike a cached frame it survives lost executors, and unlike an RDD
    checkpoint later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A literal table held in the plan, for dimensions and parameters.

    Going through Arrow keeps it a local relation: no job, no Python workers.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = [list(values) for values in zip(*rows)] or [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)
