"""Token ids in binary files: bit-plane shuffled blocks, each plane compressed with zstandard, and an index of the chunks.

A file holds the ids of some documents one after the other, each document's end marked by one more id. Blocks of so many
ids are written as 32-bit numbers transposed into four byte planes, or 32 bit planes, and each plane is compressed by
itself; planes of zeros alone take no bytes. Layout, numbers little-endian:

* 8 bytes ``FLGIDS01``
* the chunks: planes of each block, the most significant first
* the documents: an Arrow stream of (id, n), zstandard-compressed
* the chunk index, zstandard-compressed: for each chunk its place in the file, its first id's number in the file and the
  sizes of its planes, as 64-bit numbers
* the footer: seven 64-bit numbers (part, ids, documents, ids of a full block, planes of a block, places of documents and
  index), 8 bytes ``FLGIDS01``

Files are ranges of documents by ascending id, so one file is as large as its task's share, and a document's place among all
ids is its place in the file after those of the files before. A task writes under a name of its own attempt and renames the
file when it is complete: tasks that run again leave the same file. The folder must be shared, of a kind that pyarrow writes.

Cases: a NULL or empty text has the end alone. Repeated ids and rows are kept; rows of one id are ordered by a hash of their
text; a NULL id comes first. An empty table gives no files and no rows. Other columns aren't read, whatever their names.
Special tokens in texts are what the library takes them for.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _common as common
from furlong.llm import _subwords as sub
from furlong.llm._blocks import release
from furlong.llm.bpe import pieces

BPE = "byte_bpe_50k.json"
END = 2
BLOCK = 1 << 16
#: Text in a file, about.
FILE_BYTES = 32 << 20
#: Longer texts are cut where the tokenizer begins a pre-token in any case.
PIECE = 1 << 20
MAGIC = b"FLGIDS01"
FOOTER = np.dtype([("part", "<i8"), ("ids", "<i8"), ("docs", "<i8"), ("block", "<i8"), ("planes", "<i8"), ("docs_at", "<i8"), ("index_at", "<i8")])
#: Files whose numbers are broadcast; of more the numbers are joined by a shuffle.
BROADCAST_FILES = 1 << 18


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of 32-bit ids, the most significant first; a bit plane's last byte is filled with zeros."""
    rows = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [*map(bytes, np.packbits(np.unpackbits(rows, axis=1).T, axis=1))]
    return [*map(bytes, np.ascontiguousarray(rows.T))]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) if p else np.zeros(n, np.uint8) for p in planes])
        return np.packbits(rows.T, axis=1).reshape(-1).view(">u4").astype(np.uint32)
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in planes])
    return np.ascontiguousarray(rows.T).reshape(-1).view(">u4").astype(np.uint32)


class Writer:
    """Writes one file to an open stream."""

    def __init__(self, out, part: int, kind: pa.DataType, block: int = BLOCK, bits: bool = False):
        self.out, self.part, self.block, self.bits = out, part, block, bits
        self.held, self.held_n, self.n_ids, self.n_docs, self.index = [], 0, 0, 0, []
        self.schema = pa.schema([("id", kind), ("n", pa.int64())])
        self.docs = pa.BufferOutputStream()
        self.stream = pa.ipc.new_stream(self.docs, self.schema)
        out.write(MAGIC)
        self.at = len(MAGIC)

    def _put(self, raw: bytes) -> int:
        self.out.write(raw)
        self.at += len(raw)
        return len(raw)

    def _chunk(self, ids: np.ndarray) -> None:
        place, first = self.at, self.index[-1][1] + self.block if self.index else 0
        sizes = [self._put(zstandard.compress(p, 3)) if p.strip(b"\0") else 0 for p in to_planes(ids, self.bits)]
        self.index.append([place, first, *sizes])

    def add(self, ids: np.ndarray, keys: pa.Array, counts: np.ndarray) -> None:
        """ids of documents one after the other, with their keys and how many ids each has."""
        self.held.append(ids)
        self.held_n += len(ids)
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(keys)
        self.stream.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], schema=self.schema))
        if self.held_n >= self.block:
            whole = np.concatenate(self.held)
            n = len(whole) // self.block * self.block
            for lo in range(0, n, self.block):
                self._chunk(whole[lo : lo + self.block])
            self.held, self.held_n = [whole[n:]], len(whole) - n

    def close(self) -> None:
        if self.held_n:
            self._chunk(np.concatenate(self.held))
        self.stream.close()
        docs_at = self.at
        self._put(zstandard.compress(self.docs.getvalue()))
        index_at, planes = self.at, 32 if self.bits else 4
        self._put(zstandard.compress(np.array(self.index, "<i8").reshape(-1, 2 + planes).tobytes()))
        self._put(np.array([(self.part, self.n_ids, self.n_docs, self.block, planes, docs_at, index_at)], FOOTER).tobytes() + MAGIC)


class Reader:
    """Reads a file through a function from (place, size) to bytes: the index first, then the chunks that are asked for."""

    def __init__(self, read, size: int):
        self.read = read
        tail = FOOTER.itemsize + len(MAGIC)
        raw = read(size - tail, tail)
        if raw[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a complete file of ids")
        self.footer = f = np.frombuffer(raw, FOOTER, 1)[0]
        self.index = np.frombuffer(zstandard.decompress(read(int(f["index_at"]), size - tail - int(f["index_at"]))), "<i8").reshape(-1, 2 + int(f["planes"]))

    def docs(self) -> pa.Table:
        at = int(self.footer["docs_at"])
        with pa.ipc.open_stream(zstandard.decompress(self.read(at, int(self.footer["index_at"]) - at))) as own:
            return own.read_all()

    def ids(self, first: int, n: int) -> np.ndarray:
        """So many ids from the first one's number in the file; only chunks that hold some of them are read."""
        block, total = int(self.footer["block"]), int(self.footer["ids"])
        last = min(first + n, total)
        if first >= last:
            return np.zeros(0, np.uint32)
        found = []
        for place, start, *sizes in self.index[first // block : -(-last // block)].tolist():
            raw, at, planes = self.read(place, sum(sizes)), 0, []
            for size in sizes:
                planes.append(zstandard.decompress(raw[at : at + size]) if size else b"")
                at += size
            found.append(from_planes(planes, min(block, total - start)))
        low = first // block * block
        return np.concatenate(found)[first - low : last - low]


def _encoded(texts: list[str | None], bpe: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with its end; how many each has)."""
    tokenizer = sub.byte_level(bpe, False)
    odd = {i: tokenizer.alone(t) for i, t in enumerate(texts) if t and any(s in t for s in tokenizer.specials)}
    cut = [pieces(t, PIECE) if t and i not in odd else [""] for i, t in enumerate(texts)]
    ids, count, _ = sub.Slice([*itertools.chain.from_iterable(cut)]).encode(tokenizer)
    first = np.cumsum([0, *map(len, cut)])
    of = np.concatenate([[0], np.cumsum(count)])[first]
    if odd:
        parts = [np.asarray(odd[i], np.int32) if i in odd else ids[of[i] : of[i + 1]] for i in range(len(texts))]
        ids, of = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    out = np.full(len(ids) + len(texts), end, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(of))] = ids
    return out, np.diff(of) + 1


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", bpe: str = BPE, end: int = END, block: int = BLOCK, bits: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files into a folder of its own and returns their list: part, file, n_ids, n_docs, start (ids before it)."""
    spark = df.sparkSession
    own = df.select(common.col(doc_id).alias("id"), common.col(text).alias("text"))
    total = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    placed = own.repartitionByRange(max(common.parallelism(spark), -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    kind = own.schema["id"].dataType
    _files(folder)[0].create_dir(_files(folder)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        task = TaskContext.get()
        part, (files, path) = task.partitionId(), _files(folder)
        name, draft = f"part-{part:06d}.ids", f"_{task.taskAttemptId()}-{uuid.uuid4().hex}.tmp"
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                out = files.open_output_stream(f"{path}/{draft}", compression=None)
                writer = Writer(out, part, to_arrow_type(kind), block, bits)
            texts = batch.column(1)
            for lo, hi in sub.runs([n or 0 for n in pc.utf8_length(texts).to_pylist()]):
                ids, counts = _encoded(texts.slice(lo, hi - lo).to_pylist(), bpe, end)
                writer.add(ids, batch.column(0).slice(lo, hi - lo), counts)
            release()
        if writer is not None:
            writer.close()
            out.close()
            files.move(f"{path}/{draft}", f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_ids": [writer.n_ids], "n_docs": [writer.n_docs]})

    listed = common.cut(placed.mapInArrow(run, "part int, file string, n_ids long, n_docs long"))
    # One row a file goes through one task here.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    listed = listed.withColumn("start", before)
    listed.write.parquet(f"{folder}/_list")
    return spark.read.schema("part int, file string, n_ids long, n_docs long, start long").parquet(f"{folder}/_list")


def read(spark: SparkSession, folder: str, kind: T.DataType | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents from the files alone: start is how many ids are before the document's,
    ids are its 32-bit little-endian numbers. kind: the type of doc_id, a long by default."""
    listed = spark.read.schema("part int, file string, n_ids long, n_docs long, start long").parquet(f"{folder}/_list")
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("doc_id", kind or T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_buffer()
                reader = Reader(lambda at, n, raw=raw: raw.slice(at, n).to_pybytes(), raw.size)
                first = 0
                for docs in reader.docs().to_batches(max_chunksize=1024):
                    counts = docs.column(1).to_numpy()
                    ends = np.cumsum(counts)
                    ids = reader.ids(first, int(ends[-1])).astype("<u4")
                    own = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), reader.footer["part"], np.int64)), docs.column(0), pa.array(first + ends - counts), docs.column(1), own], names=["part", "doc_id", "place", "n_tokens", "ids"])
                    first += int(ends[-1])
                release()

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("content").mapInArrow(run, schema)
    starts = listed.select(F.col("part").cast("long").alias("part"), F.col("start").alias("before"))
    starts = F.broadcast(starts) if listed.count() <= BROADCAST_FILES else starts
    return found.join(starts, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> list[int]:
    """So many ids from a place among all of them, by the chunk index: nothing else is read."""
    out, (files, path) = [], _files(folder)
    wanted = spark.read.parquet(f"{folder}/_list").filter((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).orderBy("part")
    for r in wanted.collect():
        with files.open_input_file(f"{path}/{r.file}") as raw:
            low = max(start - r.start, 0)
            out += Reader(lambda at, size, raw=raw: raw.read_at(size, at), raw.size()).ids(low, start + n - r.start - low).tolist()
    return out


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared(spark)}/ids-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), folder)
    found = read(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
