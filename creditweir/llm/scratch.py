"""Written intermediates of the text operators, deleted once an operator's result is written."""

from contextlib import contextmanager, suppress
from functools import wraps
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame

from creditweir.session import shared_dir

_open: list[list[str]] = []


def filesystem(path: str):
    """The file system of a path that Spark knows, and the path on it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


#: For rows of megabytes: by default the sizes of a page and of a row group are first looked at after 100 rows, and a reader holds both whole.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": False}
#: Bytes of rows that go to a Python worker at a time; Spark's own 64 MB take some four times that beside the heap.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark):
    """Plans that run inside send batches of ``BATCH_BYTES`` to Python workers."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def cut(df: DataFrame, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/text-{uuid4().hex}"
    df.write.options(**options).parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Tables cut inside are deleted at the end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            with suppress(OSError):  # files that stay cost space only
                store, name = filesystem(path)
                store.delete_dir(name)


def tidy(operator):
    """The operator's result is written; what it was made from goes."""

    @wraps(operator)
    def run(*args, **named):
        with scratch():
            result = operator(*args, **named)
            own = _open.pop()  # the result belongs to the caller
            try:
                result = cut(result)
            finally:
                _open.append(own)
        return result

    return run
