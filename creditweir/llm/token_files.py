"""Operator 1: token ids in Arrow files of equal-length sequences.

Documents are ordered by id, tokenised and written as one pair of Arrow files per
range: ``tokens-*.arrow`` holds record batches of ``SEQUENCES`` fixed-size lists
(ids, and a mask that is false on the padding after the last document), ``docs-*.arrow``
says where each document starts. Ids take two bytes where the vocabulary allows.
Sequence k of a file is row k % SEQUENCES of batch k // SEQUENCES: a memory map
reaches it without reading or copying anything else.

Null texts are empty and hold the end id alone; empty tables give no file. Equal
ids are ordered by text. A null id sorts first. Other columns are not read.
Files are written under an attempt's name and renamed when whole, so a repeated
task replaces a file by the same content.
"""

import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditweir.llm.scratch import cut, filesystem
from creditweir.llm.tokens import encoder
from creditweir.llm.words import slices, texts_of
from creditweir.session import shared_dir

SEQUENCES = 256
MANIFEST = "shard int, n_docs long, n_tokens long, tokens_file string, docs_file string"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Sequences:
    """Writes ids as rows of ``length``; the last row is padded."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting = np.empty(0, self.dtype)

    def add(self, ids: np.ndarray):
        ids = np.concatenate([self.waiting, ids.astype(self.dtype)])
        step = self.length * SEQUENCES
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self._write(ids[i : i + step], step)
        self.waiting = ids[whole:]

    def _write(self, ids: np.ndarray, real: int):
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.length)
            for values in (ids, np.arange(len(ids)) < real)
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self):
        if real := len(self.waiting):
            padded = np.zeros(-(-real // self.length) * self.length, self.dtype)
            padded[:real] = self.waiting
            self._write(padded, real)
        self.writer.close()


class TokenFile:
    """Random access to a tokens file; local files are memory-mapped."""

    def __init__(self, path: str):
        store, name = filesystem(path)
        local = isinstance(store, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name) if local else store.open_input_file(name))
        self.length = self.reader.schema.field("ids").type.list_size
        self._batch = (-1, None)

    def _values(self, batch: int) -> np.ndarray:
        if self._batch[0] != batch:
            self._batch = (batch, self.reader.get_batch(batch).column("ids").values.to_numpy())
        return self._batch[1]

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of one sequence, as views."""
        batch = self.reader.get_batch(k // SEQUENCES)
        return tuple(batch.column(c)[k % SEQUENCES].values for c in ("ids", "mask"))

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids from ``start`` on, across sequences."""
        step, parts = self.length * SEQUENCES, []
        while count:
            values = self._values(start // step)[start % step :][:count]
            parts.append(values)
            start, count = start + len(values), count - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = 2048
) -> DataFrame:
    """Writes the files below ``folder``; returns one row per pair of files."""

    def write(batches):
        shard, attempt = TaskContext.get().partitionId(), uuid4().hex
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        names = [f"{base}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "docs")]
        temporary = [f"{name}.{attempt}" for name in names]
        encode = encoder(vocabulary)
        dtype = np.uint16 if max(encode.size, end_id + 1) <= 1 << 16 else np.uint32
        rows = total = 0
        writers = None
        for batch in batches:
            for part in slices(batch, "text"):
                if writers is None:
                    sinks = [store.open_output_stream(name) for name in temporary]
                    writers = _Sequences(sinks[0], length, dtype), pa.ipc.new_file(sinks[1], DOCS)
                ids, starts = encode.encode(texts_of(part, "text"), end_id)
                writers[0].add(ids)
                columns = [part.column("doc_id"), pa.array(starts[:-1] + total), pa.array(np.diff(starts))]
                writers[1].write_batch(pa.record_batch(columns, schema=DOCS))
                rows, total = rows + part.num_rows, total + len(ids)
        if writers:
            for writer, sink in zip(writers, sinks):
                writer.close()
                sink.close()
            for old, new in zip(temporary, names):
                store.move(old, new)
            paths = [f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}" for name in names]
            yield pa.RecordBatch.from_pylist(
                [dict(shard=shard, n_docs=rows, n_tokens=total, tokens_file=paths[0], docs_file=paths[1])],
                schema=pa.schema(
                    [("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                     ("tokens_file", pa.string()), ("docs_file", pa.string())]
                ),
            )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # The hash splits one id that holds many rows over several ranges.
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .drop("tie")
    )
    return cut(ordered.mapInArrow(write, MANIFEST))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Digests per document, read from the files; ``start`` counts over all files."""
    shards = manifest.count()
    # One row per pair of files: the running total is over the list of files only.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens_file"])
                store, name = filesystem(row["docs_file"])
                with pa.ipc.open_file(store.open_input_file(name)) as index:
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        starts, counts = (part.column(c).to_numpy() for c in ("start", "n_tokens"))
                        sums = [zlib.crc32(tokens.ids(s, n).astype("<u4")) for s, n in zip(starts.tolist(), counts.tolist())]
                        yield pa.record_batch(
                            [part.column("doc_id"), pa.array(starts + row["base"]), part.column("n_tokens"),
                             pa.array(sums, pa.int64()), pa.array([row["shard"]] * len(sums), pa.int32())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                        )

    return placed.repartitionByRange(max(shards, 1), "shard").mapInArrow(read, RESULT)


def token_folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid4().hex}"
