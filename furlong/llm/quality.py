"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions, in time linear in the number of features. Features: lower-cased words hashed into 2**bits slots with damped
and normalised counts; statistics of structure (length, repetition, capitals, symbols, digits, lines), each as a value and
as one of ten steps; and metadata, the document's declared n_chars where there is such a column.

Fitting draws a bounded, seeded sample of labelled rows (``rows``), so what reaches the driver has a fixed size.

Cases: NULL and empty texts get the features of an empty text and so a score; a NULL n_chars has a slot of its own. Rows
without label, text or id teach nothing; without labelled rows every score is 0.5. Equal texts with equal metadata
have equal scores. Columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _common as common
from furlong.llm._blocks import release
from furlong.llm._words import Words, slices

BITS = 14
RANK = 6
_STEPS = 10
_STATS = ("words", "chars", "word_chars", "distinct", "repeats", "capitals", "symbols", "digits", "lines", "marks", "declared")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?|"]] = True
#: Slots: words, a value and steps for each statistic, and one for missing metadata.
SLOTS = (1 << BITS) + len(_STATS) * (1 + _STEPS) + 1


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def features(column: pa.Array, declared: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, slot, value) of every feature, slice by slice of the texts; rows count from the slice's
    first. declared: characters by the metadata, NaN where missing."""
    for lo, hi, data, offsets in slices(column):
        n = hi - lo
        w = Words(data, offsets, lower=True)
        key = w.hashes()
        count = w.counts.astype(float)
        some = np.maximum(count, 1)
        pair = (w.doc.astype(np.uint64) << np.uint64(BITS)) | (key & np.uint64((1 << BITS) - 1))
        own, times = np.unique(pair, return_counts=True)
        doc = (own >> np.uint64(BITS)).astype(np.int64)
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(doc, value * value, n))
        rows, slots, values = [doc], [(own & np.uint64((1 << BITS) - 1)).astype(np.int64)], [value / np.maximum(norm[doc], 1e-9)]
        size = np.diff(offsets).astype(float)
        per = np.maximum(size, 1)
        share = lambda flags: np.where(size > 0, np.add.reduceat(np.append(flags, False), offsets[:-1], dtype=np.int64), 0).astype(float)  # noqa: B023, E731
        distinct = np.bincount(np.unique(w.doc.astype(np.uint64) << np.uint64(40) | key >> np.uint64(24)).astype(np.uint64) >> np.uint64(40), minlength=n)
        again = np.zeros(len(key))
        again[1:] = (key[1:] == key[:-1]) & (w.doc[1:] == w.doc[:-1])
        told = declared[lo:hi]
        stats = [
            np.log1p(count) / 10, np.log1p(size) / 12, np.minimum(size / some / 12, 2), distinct / some, np.bincount(w.doc, again, n) / some,
            share((data >= 65) & (data <= 90)) / per * 2, np.minimum(share(_SYMBOL[data]) / some, 2) / 2, share((data >= 48) & (data <= 57)) / per * 4,
            np.minimum(share(data == 10) / some * 4, 2), np.minimum(share(_MARK[data]) / some, 2), np.nan_to_num(np.log1p(np.maximum(told, 0)) / 12),
        ]
        for j, x in enumerate(stats):
            x = np.clip(x, 0, 2)
            base = (1 << BITS) + j * (1 + _STEPS)
            rows += [np.arange(n)] * 2
            slots += [np.full(n, base), base + 1 + np.minimum((x * _STEPS).astype(np.int64), _STEPS - 1)]
            values += [x, np.full(n, 0.5)]
        missing = np.flatnonzero(np.isnan(told))
        rows.append(missing), slots.append(np.full(len(missing), SLOTS - 1)), values.append(np.ones(len(missing)))
        yield lo, hi, np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def margins(m: Machine, n: int, row: np.ndarray, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The machine's sum for each of n rows; the pairwise part by the sum-of-squares identity."""
    total = m.bias + np.bincount(row, m.weights[slot] * value, n)
    for f in range(m.factors.shape[1]):
        term = m.factors[slot, f] * value
        total += (np.bincount(row, term, n) ** 2 - np.bincount(row, term * term, n)) / 2
    return total


def train(row: np.ndarray, slot: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Adam on the log loss, over shuffled batches."""
    draw = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SLOTS), draw.normal(0, 0.02, (SLOTS, RANK)))
    n = len(label)
    if (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, slot, value = row[order], slot[order], value[order]
    begin = np.searchsorted(row, np.arange(n + 1))
    theta = np.concatenate([m.weights[:, None], m.factors], 1)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs if n else 0):
        for some in np.array_split(draw.permutation(n), max(1, n // batch)):
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
            r = np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
            s, x = slot[at], value[at].astype(float)
            t = theta[s]
            term = t[:, 1:] * x[:, None]
            sums = np.stack([np.bincount(r, term[:, f], len(some)) for f in range(RANK)], 1)
            z = m.bias + np.bincount(r, t[:, 0] * x, len(some)) + ((sums**2).sum(1) - np.bincount(r, (term * term).sum(1), len(some))) / 2
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) / len(some)
            e = err[r] * x
            grad = np.concatenate([e[:, None], e[:, None] * (sums[r] - term)], 1)
            slots, where = np.unique(s, return_inverse=True)
            g = np.stack([np.bincount(where, grad[:, f], len(slots)) for f in range(RANK + 1)], 1) + decay * theta[slots]
            step += 1
            m.bias -= rate * err.sum()
            first[slots] = 0.9 * first[slots] + 0.1 * g
            second[slots] = 0.99 * second[slots] + 0.01 * g * g
            theta[slots] -= rate * (first[slots] / (1 - 0.9**step)) / (np.sqrt(second[slots] / (1 - 0.99**step)) + 1e-8)
    return Machine(m.bias, theta[:, 0].copy(), theta[:, 1:].copy())


def _declared(batch: pa.RecordBatch, chars: str) -> np.ndarray:
    at = batch.schema.get_field_index(chars)
    return np.full(batch.num_rows, np.nan) if at < 0 else batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _learn(some: DataFrame, text: str, label: str, key: str, chars: str, rows: int) -> Machine:
    """Trained on some, of which about ``rows`` rows are expected; more, by repeated ids, are cut once they are features."""
    usable = some.select(F.xxhash64(F.lit(11), F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"), F.col(label).cast("double").alias("y"), *([F.col(chars).alias("c")] if chars in some.columns else []))

    def run(batches):
        for batch in batches:
            for lo, hi, row, slot, value in features(batch.column(1), _declared(batch, "c")):
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(hi - lo + 1)).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.ListArray.from_arrays(ends, pa.array(slot[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value[order].astype(np.float32)))],
                    names=["h", "y", "slots", "values"],
                )

    found = usable.mapInArrow(run, "h long, y double, slots array<int>, values array<float>").orderBy("h").limit(rows).toArrow().sort_by("h")
    n = found.num_rows
    if not n:
        return Machine(0.0, np.zeros(SLOTS), np.zeros((SLOTS, RANK)))
    slots, values = found.column("slots").combine_chunks(), found.column("values").combine_chunks()
    counts = np.diff(slots.offsets.to_numpy())
    machine = train(np.repeat(np.arange(n, dtype=np.int32), counts), slots.flatten().to_numpy(), values.flatten().to_numpy(), found.column("y").to_numpy())
    del found, slots, values
    release()
    return machine


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", chars: str = "n_chars", rows: int = 8000) -> Machine:
    """A machine from ``rows`` labelled rows at most: those with the smallest seeded hashes of the id."""
    usable = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    ids = usable.select(key).distinct().orderBy(F.xxhash64(F.lit(11), F.col(key)), key).limit(rows)
    return _learn(usable.join(F.broadcast(ids), key, "left_semi"), text, label, key, chars, rows)


def score(df: DataFrame, machine: Machine, text: str = "text", chars: str = "n_chars", threshold: float = 0.7) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from the threshold on)."""
    base = df.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            z = np.zeros(batch.num_rows)
            for lo, hi, *found in features(column, _declared(batch, chars)):
                z[lo:hi] = margins(machine, hi - lo, *found)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return common.map_in_arrow(base, run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def fit_tables(docs: DataFrame, labels: DataFrame, rows: int = 8000) -> Machine:
    """Fitted on labels.quality of ``rows`` documents at most outside fold 2 of 4. The ids are drawn before any text moves:
    what is broadcast is that many ids and labels."""
    teach = ~common.in_fold(F.col("doc_id"), 4, 2)
    y = labels.filter(teach & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = docs.filter(teach & F.col("text").isNotNull()).select("doc_id", "text", "n_chars")
    ids = y.join(usable.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    return _learn(usable.join(F.broadcast(ids), "doc_id"), "text", "quality", "doc_id", "n_chars", rows)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fit_tables(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", common.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
