"""Substring dedup: removes every word of a run that occurred earlier, found by fixed-block anchors.

Two equal windows of ``width`` words both hold the aligned reference block of width/2 words that lies in the earlier one.
So: each document's non-overlapping blocks are the index, all its rolling windows of that length probe it, and a hit is a
block that occurs anywhere else. Only full windows around hits are compared further, by two independent hashes of 96 bits
together and the earliest holder of each; neighbouring repeats join into maximal runs, whose words go.

Words are runs of other bytes than ASCII white space, unchanged. Earlier means a smaller doc_id, or the same document and
an earlier start; windows are judged on the input. Cases: NULL and empty texts have no words; texts shorter than a window
lose nothing; NULL ids come last; rows that share a doc_id count in the order of their blocks. Repeated rows: the first
one stays. An empty table gives an empty one. Further columns are carried along; n_words, n_removed, kept and removed are
replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _blocks as blk
from furlong.llm import _common as common
from furlong.llm._words import Words, mix, slices, whole, windows

WIDTH = 20
#: Bytes of a probe's hash that are sent, besides what its part says. A false hit costs a comparison, not a wrong result.
PROBE_BYTES = 5
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _hashed(rows: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of a block."""
    hashes, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, _, data, offsets in slices(rows.column(text)):
        w = Words(data, offsets)
        hashes.append(w.hashes()), row.append(lo + w.doc)
    return np.concatenate(hashes), np.concatenate(row)


def _probes(rows: pa.Table, text: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, word row, distinct probes, index of each window's probe or -1, which distinct probes are aligned)."""
    hashes, row = _hashed(rows, text)
    inside = whole(row, size)
    at = np.flatnonzero(inside)
    keys, index = np.unique(windows(hashes, size)[at], return_inverse=True)
    where = np.full(len(hashes), -1, np.int64)
    where[at] = index
    begin = np.searchsorted(row, np.arange(rows.num_rows + 1))
    aligned = np.zeros(len(keys), bool)
    aligned[index[(at - begin[row[at]]) % size == 0]] = True
    return hashes, row, keys, where, aligned


def _ask_anchors(text: str, size: int):
    def ask(block: dict, parts: int):
        _, _, keys, where, aligned = _probes(blk.unpack(block["payload"]), text, size)
        times = np.bincount(where[where >= 0], minlength=len(keys))
        _, order, cuts = blk.split(keys, parts)
        for p in range(parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                flags = np.concatenate([np.packbits(aligned[own]), np.packbits(times[own] > 1)])
                yield p, len(own).to_bytes(4, "little") + blk.to_bytes(keys[own] >> np.uint64(20), PROBE_BYTES) + flags.tobytes()

    return ask


def _find_anchors(p: int, block: list[int], blobs: list[bytes]) -> pa.Table:
    """For each list of probes a bit string: aligned somewhere, and found more than once."""
    sizes = [int.from_bytes(b[:4], "little") for b in blobs]
    keys = np.concatenate([blk.from_bytes(b[4 : 4 + PROBE_BYTES * n], PROBE_BYTES) for b, n in zip(blobs, sizes, strict=True)])
    flags = [np.frombuffer(b, np.uint8, offset=4 + PROBE_BYTES * n).reshape(2, -1) for b, n in zip(blobs, sizes, strict=True)]
    aligned, many = (np.concatenate([np.unpackbits(f[i])[:n] for f, n in zip(flags, sizes, strict=True)]).astype(bool) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    n = int(new.sum())
    good = (np.bincount(group, aligned, n) > 0) & ((np.bincount(group, minlength=n) > 1) | (np.bincount(group, many, n) > 0))
    hit = good[group]
    ends = np.cumsum([0, *sizes])
    parts = [hit[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    keep = [i for i, x in enumerate(parts) if x.any()]
    return pa.table({"block": pa.array([block[i] for i in keep], pa.int64()), "p": pa.array([p] * len(keep), pa.int32()), "blob": pa.array([blk.zip_bytes(np.packbits(parts[i]).tobytes()) for i in keep], pa.binary())})


def _candidates(block: dict, parts: int, text: str, width: int) -> tuple:
    """The windows around hits: (rows, word row, starts, distinct index, two hashes and first row of the distinct ones)."""
    import zstandard

    rows = blk.unpack(block["payload"])
    size = width // 2
    hashes, row, keys, where, _ = _probes(rows, text, size)
    _, order, cuts = blk.split(keys, parts)
    hit = np.zeros(len(keys) + 1, bool)
    for a in block["anchors"] or []:
        own = order[cuts[a["p"]] : cuts[a["p"] + 1]]
        hit[own] = np.unpackbits(np.frombuffer(zstandard.decompress(a["blob"]), np.uint8))[: len(own)].astype(bool)
    n = max(0, len(hashes) - width + 1)
    total = np.concatenate([[0], np.cumsum(hit[where])])  # where is -1 outside windows: the last entry, never hit
    starts = np.flatnonzero(whole(row, width) & (total[width - size + 1 :][:n] > total[:n])) if n else np.zeros(0, np.int64)
    first = windows(hashes, width)[starts]
    second = windows(mix(hashes ^ _OTHER), width)[starts] >> np.uint64(32)
    order = np.lexsort((starts, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    lead = order[new]
    return rows, row, starts, index, first[lead], second[lead], lead


def _numbers(rows: pa.Table, doc_id: str) -> np.ndarray:
    """Ids as numbers; NULL last."""
    return np.array([(1 << 63) - 1 if x is None else x for x in rows.column(doc_id).to_pylist()], np.int64)


def _ask_windows(text: str, doc_id: str, width: int):
    def ask(block: dict, parts: int):
        rows, row, starts, _, first, second, lead = _candidates(block, parts, text, width)
        ids = _numbers(rows, doc_id)[row[starts[lead]]]
        _, order, cuts = blk.split(first, parts)
        for p in range(parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                yield p, len(own).to_bytes(4, "little") + first[own].astype("<u8").tobytes() + second[own].astype("<u4").tobytes() + blk.zip_bytes(ids[own].astype("<i8").tobytes())

    return ask


def _find_first(p: int, block: list[int], blobs: list[bytes]) -> pa.Table:
    """For each list of windows a bit string: whether the block has the window's first occurrence of all."""
    import zstandard

    sizes = [int.from_bytes(b[:4], "little") for b in blobs]
    first = np.concatenate([np.frombuffer(b, "<u8", n, 4) for b, n in zip(blobs, sizes, strict=True)])
    second = np.concatenate([np.frombuffer(b, "<u4", n, 4 + 8 * n) for b, n in zip(blobs, sizes, strict=True)])
    ids = np.concatenate([np.frombuffer(zstandard.decompress(b[4 + 12 * n :]), "<i8") for b, n in zip(blobs, sizes, strict=True)])
    source = np.repeat(np.arange(len(blobs)), sizes)
    order = np.lexsort((source, ids, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    has = np.zeros(len(order), bool)
    has[order] = new
    ends = np.cumsum([0, *sizes])
    bits = [blk.zip_bytes(np.packbits(has[a:b]).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": pa.array(block, pa.int64()), "p": pa.array([p] * len(block), pa.int32()), "blob": pa.array(bits, pa.binary())})


def _gone(block: dict, parts: int, text: str, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows, word row, whether the word goes)."""
    import zstandard

    rows, row, starts, index, first, _, lead = _candidates(block, parts, text, width)
    own_first = np.zeros(len(first), bool)
    _, order, cuts = blk.split(first, parts)
    for a in block["firsts"] or []:
        own = order[cuts[a["p"]] : cuts[a["p"] + 1]]
        own_first[own] = np.unpackbits(np.frombuffer(zstandard.decompress(a["blob"]), np.uint8))[: len(own)].astype(bool)
    repeat = np.ones(len(starts), bool)
    repeat[lead[own_first]] = False
    change = np.zeros(len(row) + 1, np.int64)
    np.add.at(change, starts[repeat], 1)
    np.add.at(change, starts[repeat] + width, -1)
    return rows, row, np.cumsum(change)[:-1] > 0


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """df with n_words, n_removed, kept (the words that stay, joined by one space) and removed (array of word spans
    start, end: the maximal runs that went)."""
    base = df.drop("n_words", "n_removed", "kept", "removed")
    blocks, parts = blk.pack(base, doc_id, text)
    hits = blk.exchange(blocks, _ask_anchors(text, width // 2), parts, _find_anchors)
    anchored = blk.delivered(blocks, hits, "anchors")
    firsts = blk.exchange(anchored, _ask_windows(text, doc_id, width), parts, _find_first)
    both = blk.delivered(anchored, firsts, "firsts")
    names = base.columns

    def run(batches):
        for block in blk.rows_of(batches):
            rows, row, gone = _gone(block, parts, text, width)
            begin = np.searchsorted(row, np.arange(rows.num_rows + 1))
            for lo in range(0, rows.num_rows, 500):
                part = rows.slice(lo, 500)
                words, lost, kept, spans = [], [], [], []
                for i, x in enumerate(part.column(text), lo):
                    g = gone[begin[i] : begin[i + 1]]
                    own = (x.as_py() or "").encode().split()
                    words.append(len(own)), lost.append(int(g.sum()))
                    kept.append(b" ".join(own if not lost[-1] else [w for w, gone_too in zip(own, g, strict=True) if not gone_too]).decode())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                out = [c.combine_chunks() for c in part.columns]
                out += [pa.array(words, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(out, names=[*names, "n_words", "n_removed", "kept", "removed"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", span)])
    return both.mapInArrow(run, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)
), firsts AS (
  SELECT g, min((doc_id, s)) AS f FROM g GROUP BY g HAVING count(*) > 1
), later AS (
  SELECT doc_id, s FROM g JOIN firsts USING (g) WHERE (doc_id, s) <> f
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later
), lost AS (
  SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
