"""Blocks of documents and the exchange of keys between them.

Documents are packed, a few MB of text at a time, into compressed blocks. A
block asks about keys (hashes of n-grams or windows): it sends each distinct
key once to the bucket that owns the key's range. A bucket sees what all blocks
say about its keys and replies in the order of the question. Blocks and buckets
are of bounded size whatever the data, and a key that every document holds
costs its bucket one entry per block."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.runtime import shared_folder

from .text import U64

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
ROW_GROUP_BYTES = 16 << 20
ARROW_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


#: Folders that the open ``scratch`` of this thread is to remove.
_OPEN: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: what several
    later steps read is computed once, and a lost executor costs no recompute.
    Inside ``scratch`` the table goes when that ends, unless ``keep``."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not keep and (folders := _OPEN.get()) is not None:
        folders.append(folder)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged inside, all but those with ``keep``. What is
    to outlast it must be kept, or read no other of them."""
    folders: list[str] = []
    before = _OPEN.set(folders)
    try:
        yield
    finally:
        _OPEN.reset(before)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def trimmed(use: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``use`` on the batches of a task. The Python worker outlives the task;
    it returns what was freed to the system, so that a long job of many
    different steps does not hold the largest of each."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from use(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


def mapped(df: DataFrame, use: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of ``ARROW_BYTES``, unless the session has
    a limit of its own. 10,000 rows of long texts, Spark's limit, are far more
    than a task needs at a time, and both the JVM and the worker hold them."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_LIMIT, None) is None:
        conf.set(ARROW_LIMIT, str(ARROW_BYTES))
    return df.mapInArrow(trimmed(use), schema)


def to_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def from_bytes(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


PACKS = "block bigint, n_bytes bigint, payload binary"


def packs(df: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``df`` (with a column ``text``) packed and staged. A block holds
    ``block_bytes`` of text, or one longer text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            payload = to_bytes(pa.Table.from_batches(held).combine_chunks())
            return _rows(PACK_SCHEMA, [(task << 32) + seq], [size], [payload])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            ends, at = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - before)
                at = upto
                if size >= block_bytes * 3 // 4:
                    yield block()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield block()

    return staged(mapped(df, pack, PACKS), name)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


PACK_SCHEMA = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
ASK = "bucket int, block bigint, blob binary"
ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


def bucket_count(packed: DataFrame, per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets in proportion to the text."""
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // per_bucket))


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where ``keys`` (ascending) pass from one bucket's range to the next."""
    edges = np.array([(i << 64) // n for i in range(1, n)], U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def write_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers as one compressed string. Ascending 64-bit keys are
    stored as differences, and bytes of equal weight lie side by side."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for x in arrays:
        ascending = x.dtype == U64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        y = np.diff(x, prepend=U64(0)) if ascending else x
        planes = np.ascontiguousarray(y).view(np.uint8).reshape(len(y), y.itemsize).T
        parts += [np.array([len(x), ascending], np.int64).tobytes(), y.dtype.str.encode().ljust(8), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def read_arrays(blob) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        n, ascending = np.frombuffer(raw, np.int64, 2, at)
        kind = np.dtype(raw[at + 16 : at + 24].decode().strip())
        size = int(n) * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at + 24).reshape(kind.itemsize, int(n))
        x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(np.cumsum(x, dtype=U64) if ascending else x)
        at += 24 + size
    return out


def asked(packed: DataFrame, n: int, question: Callable[[pa.Table, int], list[list[np.ndarray]]]) -> DataFrame:
    """Rows for the buckets. ``question(documents, block)`` gives lists of arrays
    of equal length; the first of each list are the keys, ascending."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                lists = question(from_bytes(payload.as_buffer()), block)
                at = [cuts(arrays[0], n) for arrays in lists]
                full = [b for b in range(n) if any(c[b] < c[b + 1] for c in at)]
                for lo in range(0, len(full), 64):
                    some = full[lo : lo + 64]
                    blobs = [write_arrays([x[c[b] : c[b + 1]] for arrays, c in zip(lists, at) for x in arrays]) for b in some]
                    yield _rows(ASK_SCHEMA, some, [block] * len(some), blobs)

    return mapped(packed.select("block", "payload"), ask, ASK)


def replied(asks: DataFrame, answer: Callable[[list[list[np.ndarray]], list[int]], list[list[np.ndarray]]]) -> DataFrame:
    """Answers of the buckets. ``answer(questions, blocks)`` has one list of
    arrays per asking block and gives as many back. The rows go to the blocks;
    further lists, if any, go to block -1."""

    def reply(table: pa.Table) -> pa.Table:
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        order = sorted(range(len(blocks)), key=blocks.__getitem__)
        blobs = table.column("blob")
        answers = answer([read_arrays(blobs[i].as_py()) for i in order], [blocks[i] for i in order])
        to = [blocks[i] for i in order] + [-1] * (len(answers) - len(order))
        batch = _rows(ASK_SCHEMA, [bucket] * len(to), to, [write_arrays(x) for x in answers])
        return pa.Table.from_batches([batch])

    return asks.groupBy("bucket").applyInArrow(reply, ASK)


def told(packed: DataFrame, replies: DataFrame, use: Callable[[pa.Table, int, list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """Each block with the replies to it, joined in the order of its question."""

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        buckets, blobs = right.column("bucket").to_pylist(), right.column("blob")
        parts = [read_arrays(blobs[i].as_py()) for i in sorted(range(len(buckets)), key=buckets.__getitem__)]
        answers = [np.concatenate(x) for x in zip(*parts)]
        return use(from_bytes(left.column("payload")[0].as_buffer()), left.column("block")[0].as_py(), answers)

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tell, schema)
