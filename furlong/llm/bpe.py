"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds the token ids of every whole text, ``decode`` the raw bytes of every list of ids. Special tokens are
ordinary text. NULL and empty texts give no ids, and no ids give empty bytes; NULL ids decode to NULL. Long texts are cut
before a single space that stands between two ASCII letters or digits: the split pattern always begins a match there, so
the ids are those of the whole text. Other columns are carried along; a column that has the name of the output is replaced.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _common as common

#: The name of a rank file that public_tokenizers has on every machine; a path is taken as it is.
RANKS = "byte_bpe_multi_50k.tiktoken"
CUT_CHARS = 1 << 16
_SAFE = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@functools.lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str | None = None):
    """The tiktoken encoding of a rank file; read once in each process."""
    import public_tokenizers
    import tiktoken

    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = CUT_CHARS) -> list[str]:
    """The text cut at the first safe boundary after every so many characters."""
    out, at = [], 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _replaced(schema: T.StructType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name not in dict(fields)), *(T.StructField(name, kind, True) for name, kind in fields)])


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns.values()], names=[*(batch.schema.names[i] for i in kept), *columns])


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", ranks: str = RANKS, pattern: str | None = None, rows: int = 256, decoded: str | None = None) -> DataFrame:
    """df with the column ids: array<int>. decoded: the name of a column for the bytes that these ids decode to, so that a
    round trip takes one pass."""

    def run(batches):
        encoder = encoding(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                found = []
                for x in part.column(part.schema.get_field_index(text)):
                    own = x.as_py() or ""
                    found.append(np.array([i for p in pieces(own) for i in encoder.encode_ordinary(p)], np.int32))
                ends = np.cumsum([0, *map(len, found)])
                columns = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))}
                if decoded:
                    columns[decoded] = pa.array([encoder.decode_bytes(x.tolist()) for x in found], pa.binary())
                yield _with(part, columns)

    fields = [(ids, T.ArrayType(T.IntegerType())), *([(decoded, T.BinaryType())] if decoded else [])]
    return common.map_in_arrow(df, run, _replaced(df.schema, fields))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", ranks: str = RANKS, pattern: str | None = None, rows: int = 256) -> DataFrame:
    """df with the column out: the raw bytes that the ids stand for (they needn't be valid UTF-8)."""

    def run(batches):
        encoder = encoding(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                found = [None if (own := x.as_py()) is None else encoder.decode_bytes(own) for x in part.column(part.schema.get_field_index(ids))]
                yield _with(part, {out: pa.array(found, pa.binary())})

    return common.map_in_arrow(df, run, _replaced(df.schema, [(out, T.BinaryType())]))


def digests(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> list:
    """The columns that stand for the ids and the bytes in a report."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, decoded="decoded").drop("text")
    return coded.select("doc_id", *digests(coded))
