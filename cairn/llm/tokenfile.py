"""Token ids as Arrow files of equal-length sequences with masks, for zero-copy random access.

A shard is two Arrow IPC files. ``ids-N.arrow``: record batches of fixed_size_list<uint16 or uint32>[L] ``ids`` and
fixed_size_list<bool>[L] ``mask``, without compression, so that a reader that maps the file reaches sequence i in batch
i // B at row i % B without parsing anything before it. ``docs-N.arrow``: key, start (ids in the shard before it) and n
for each document. Only a shard's last sequence is padded, with mask false. Documents are in ascending key order within
and across shards (null keys first); the prefix sum of shard totals gives global starts.

A task writes under a name of its own and renames at the end, so a task that runs twice leaves one whole shard. Files
go through pyarrow's file systems to the folder that driver and executors share.

Defined results: a null or empty text is its end id alone; repeated rows are documents of their own, in any order among
equal keys; an empty table gives no shard and no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .tokens import encoded, width

#: Sequences in a record batch, and estimated input of a shard.
BATCH, SHARD_BYTES = 64, 128 << 20


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


class ShardWriter:
    """Writes documents' ids one after the other into one shard."""

    def __init__(self, folder: str, name: str, length: int, kind: np.dtype, key: pa.DataType) -> None:
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.to = {k: f"{root}/{k}-{name}.arrow" for k in ("ids", "docs")}
        self.at = {k: f"{root}/.{k}-{name}-{uuid.uuid4().hex}" for k in self.to}
        self.length, self.kind, self.total = length, kind, 0
        item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.item = item
        schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        docs = pa.schema([("key", key), ("start", pa.int64()), ("n", pa.int64())])
        self.files = {k: self.fs.open_output_stream(p) for k, p in self.at.items()}
        self.ids, self.docs = pa.ipc.new_file(self.files["ids"], schema), pa.ipc.new_file(self.files["docs"], docs)
        self.left = np.empty(0, kind)

    def add(self, keys: pa.Array, ids: list[np.ndarray]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.docs.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(self.total + np.cumsum(n) - n), pa.array(n)], schema=pa.schema([("key", keys.type), ("start", pa.int64()), ("n", pa.int64())])))
        self.total += int(n.sum())
        rest = np.concatenate([self.left, *(x.astype(self.kind) for x in ids)])
        step = BATCH * self.length
        for i in range(0, len(rest) - step + 1, step):
            self._batch(rest[i : i + step], step)
        self.left = rest[len(rest) // step * step :]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.item), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], names=["ids", "mask"]))

    def close(self) -> None:
        if len(self.left):
            n = -(-len(self.left) // self.length) * self.length
            self._batch(np.concatenate((self.left, np.zeros(n - len(self.left), self.kind))), len(self.left))
        for w in (self.ids, self.docs):
            w.close()
        for k in ("docs", "ids"):
            self.files[k].close()
            self.fs.move(self.at[k], self.to[k])


class ShardReader:
    """Random access to a shard; a local one is mapped into memory."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = opened(folder)
        self.files = [pa.memory_map(p) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(p) for p in (f"{root}/ids-{name}.arrow", f"{root}/docs-{name}.arrow")]
        self.ids, self.docs = map(pa.ipc.open_file, self.files)
        self.length = self.ids.schema.field("ids").type.list_size
        self.known: tuple[int, pa.RecordBatch] = (-1, None)

    def batch(self, i: int) -> pa.RecordBatch:
        if self.known[0] != i:
            self.known = (i, self.ids.get_batch(i))
        return self.known[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i, the ids without a copy."""
        one = self.batch(i // BATCH)
        at = slice(i % BATCH * self.length, (i % BATCH + 1) * self.length)
        return one.column(0).flatten().to_numpy()[at], one.column(1).flatten().to_numpy(zero_copy_only=False)[at]

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, in parts of a batch at most."""
        step = BATCH * self.length
        while n:
            i, offset = divmod(start, step)
            ids = self.batch(i).column(0).flatten().to_numpy()[offset : offset + n]
            if not len(ids):
                raise ValueError("the shard ends before its documents")
            yield ids
            start, n = start + len(ids), n - len(ids)

    def close(self) -> None:
        for f in self.files:
            f.close()


def write(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text", length: int = 2048, shards: int | None = None) -> DataFrame:
    """Write docs in ascending key order; (shard, n_tokens, n_docs) of each shard, as a table of one row a task."""
    kind = width(path, end)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    arrow = pa.int64() if source.schema["key"].dataType.simpleString() == "bigint" else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, n = TaskContext.get().partitionId(), None, 0
        for keys, ids in encoded(batches, path, end):
            out = out or ShardWriter(folder, str(shard), length, kind, arrow or keys.type)
            out.add(keys, ids)
            n += len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([out.total]), pa.array([n])], ["shard", "n_tokens", "n_docs"])

    lean(docs.sparkSession)
    # as many shards as the session's shuffles, or one for each SHARD_BYTES of input if that is more
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // SHARD_BYTES))
    return source.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "shard long, n_tokens long, n_docs long")


def read(spark: SparkSession, folder: str, sizes: list[tuple[int, int]], key_type: str = "bigint") -> DataFrame:
    """One row per document of the shards (shard, tokens): key, start over all shards, n_tokens, ids_crc32."""
    before, total = {}, 0
    for shard, n in sorted(sizes):
        before[shard], total = total, total + n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                with_shard = ShardReader(folder, str(shard))
                for i in range(with_shard.docs.num_record_batches):
                    keys, starts, ns = with_shard.docs.get_batch(i).columns
                    crcs = []
                    for start, n in zip(starts.to_pylist(), ns.to_pylist(), strict=True):
                        crc = 0
                        for ids in with_shard.tokens(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(starts.to_numpy() + before[shard]), ns, pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])
                with_shard.close()

    shards = spark.createDataFrame([(s,) for s in before], "shard long").repartition(max(1, len(before)), "shard") if before else spark.createDataFrame([], "shard long")
    return shards.mapInArrow(run, f"key {key_type}, start long, n_tokens long, ids_crc32 long")
