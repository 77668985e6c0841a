"""Blocks of documents that ask about hashes of theirs.

A block is a row that holds some megabytes of documents, zstandard-compressed. To learn something about a hash from all
documents (how often it occurs, who has it first), each block sends its distinct hashes, packed, to one of ``parts``
reducers by the hash; a reducer puts the blocks' lists together and answers each list in its own order. Only packed lists
cross the network: a hash that a third of all documents hold costs one entry a block. Blocks are written once to the shared
folder, hashed by their id, so that answers come to the blocks without moving these again.
"""

from __future__ import annotations

import ctypes
import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import _common as common

#: Text in a block, and (on average) in what one reducer answers for: these bound the memory of a task. There are blocks x
#: parts lists, so where tasks may take more memory, larger values of both serve larger inputs.
BLOCK_BYTES, PART_BYTES = 4 << 20, 32 << 20
#: Parts beyond the reducers', which small notes of all blocks are added up in.
TALLIES = 64


def zip_bytes(raw: bytes, level: int = 3) -> bytes:
    return zstandard.compress(raw, level)


def pack(df: DataFrame, sort_by: str, text: str, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(block, payload): the rows of df in blocks, each sorted by the column (NULLs last), written to the shared folder; and
    the number of parts that so much text is dealt to."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number = itertools.count()

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).sort_by([(sort_by, "ascending")]).combine_chunks()
            size = pc.sum(pc.binary_length(rows.column(text))).as_py() or 0
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([first + next(number)], pa.int64()), pa.array([zip_bytes(sink.getvalue())], pa.binary()), pa.array([size], pa.int64())], names=["block", "payload", "size"])

        held, size = [], 0
        for batch in batches:
            step = max(1, int(batch.num_rows * (block_bytes / 4) / max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                held.append(part)
                size += part.nbytes
                if size >= block_bytes:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    spark = df.sparkSession
    packed = common.map_in_arrow(df, run, "block long, payload binary, size long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a checkpoint of an adaptive plan forgets how its rows are partitioned
    try:
        out = common.cut(packed.repartition(common.parallelism(spark), "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    common.free(spark)
    size = out.agg(F.sum("size")).first()[0] or 0
    return out.drop("size"), max(common.parallelism(spark), -(-size // part_bytes))


def unpack(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.decompress(payload)) as rows:
        return rows.read_all().combine_chunks()


def release() -> None:
    """Gives memory that this process has freed back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches) -> Iterator[dict]:
    """One row at a time, so that only one block's values are Python's."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            release()


def requests(blocks: DataFrame, ask: Callable, parts: int) -> DataFrame:
    """(block, p, blob). ask: from a block's row to an iterator of (p, bytes)."""

    def run(batches):
        for row in rows_of(batches):
            for p, blob in ask(row, parts):
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([p], pa.int32()), pa.array([blob], pa.binary())], names=["block", "p", "blob"])

    return blocks.mapInArrow(run, "block long, p int, blob binary")


def answers(asked: DataFrame, reduce: Callable, schema: str = "block long, p int, blob binary") -> DataFrame:
    """reduce: from (p, block ids, blobs) to a table of that schema."""

    def run(group: pa.Table) -> pa.Table:
        release()
        group = group.sort_by([("block", "ascending")])
        return reduce(group.column("p")[0].as_py(), group.column("block").to_pylist(), group.column("blob").to_pylist())

    return asked.groupBy("p").applyInArrow(run, schema)


def exchange(blocks: DataFrame, ask: Callable, parts: int, reduce: Callable, schema: str = "block long, p int, blob binary") -> DataFrame:
    """What the reducers answered, in the shared folder; the lists that were sent for it are gone from disk."""
    out = common.cut(answers(requests(blocks, ask, parts), reduce, schema))
    common.free(blocks.sparkSession)
    return out


def delivered(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """The blocks with the column name: array<struct<p, blob>> of what was answered."""
    own = replies.groupBy("block").agg(F.collect_list(F.struct("p", "blob")).alias(name))
    return blocks.join(own, "block", "left")


def split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part of each key, an order that sorts by part and then key, where each part begins in that order)."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    return part, order, np.searchsorted(part[order], np.arange(parts + 1))


def to_bytes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.view("<u8").reshape(-1)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers, all first bytes before all second ones: small numbers then compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").reshape(-1)
