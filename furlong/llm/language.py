"""Language identification by compression.

Every language gets a raw-content zstandard dictionary, made of pieces of labelled texts. A text belongs to the language
whose dictionary compresses it to the fewest bytes; where the runner-up needs hardly more, the text is rejected.

Cases: a NULL text or one without a letter (by ``str.isalpha``: signs like a superscript two or a Roman numeral are none) has no
language (``und``, score 0). Equal sizes go to the first label in
the order of the dictionaries, the most frequent first. Letters are lower-cased before compression. Rows without label, id or text teach nothing. With no labelled row at all every text is ``und``. Whole texts
count: a long text is compressed in blocks, each against the dictionary alone, and the sizes are summed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _common as common

UNKNOWN = "und"


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", pieces: int = 400, piece_chars: int = 400) -> dict[str, bytes]:
    """A dictionary for each label, from a bounded sample: of the texts with the smallest hashes, ``pieces`` a label, one
    piece of ``piece_chars`` characters at a hashed place. The result has pieces * piece_chars characters a label at most."""
    hashed = F.xxhash64(F.lit(2), F.col(key), F.length(text))
    place = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.greatest(F.length(text) - piece_chars + 1, F.lit(1))).cast("int")
    some = (
        labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
        .select(F.col(label).alias("l"), hashed.alias("h"), F.substring(F.col(text), place + 1, F.lit(piece_chars)).alias("piece"))
        .withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "piece")))
        .filter(F.col("n") <= pieces)
    )
    found: dict[str, list] = {}
    for r in some.collect():
        found.setdefault(r.l, []).append((r.n, r.piece))
    often = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    return {k: "\n".join(x for _, x in sorted(found[k])).lower().encode() for k in sorted(found, key=lambda k: (-often[k], k))}


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = 5, block: int = 4096, margin: float = 0.01) -> DataFrame:
    """df with lang_best (the nearest language), lang_pred (``und`` also where the margin is narrow), rejected and score.

    margin: the least share by which the runner-up's compressed size must exceed the best. score: the softmax of the
    negative sizes, in bits for each character (0 to 1). Columns of those names are replaced."""
    labels = list(dictionaries)
    out = ["lang_best", "lang_pred", "rejected", "score"]
    base = df.drop(*out)

    def run(batches):
        import zstandard

        coders, parameters = [], zstandard.ZstdCompressionParameters.from_level(level, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        for name in labels:
            own = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=parameters)
            coders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=parameters))
        for batch in batches:
            best, score, rejected = [], [], []
            for x in batch.column(batch.schema.get_field_index(text)):
                own = x.as_py()
                if not own or not labels or not any(map(str.isalpha, own)):
                    best.append(UNKNOWN), score.append(0.0), rejected.append(False)
                    continue
                raw = own.lower().encode()
                blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
                sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders], float)
                k = int(sizes.argmin())
                rest = np.delete(sizes, k)
                bits = (sizes - sizes[k]) * 8 / math.sqrt(len(raw))
                best.append(labels[k])
                score.append(float(1 / np.exp(-np.minimum(bits, 500)).sum()))
                rejected.append(bool(len(rest)) and float(rest.min()) < sizes[k] * (1 + margin))
            pred = [UNKNOWN if r else b for b, r in zip(best, rejected, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(pred, pa.string()), pa.array(rejected, pa.bool_()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, *out],
            )

    kinds = (T.StringType(), T.StringType(), T.BooleanType(), T.DoubleType())
    return common.map_in_arrow(base, run, T.StructType([*base.schema.fields, *map(T.StructField, out, kinds)]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.in_fold(F.col("doc_id"), 4, 2)
    dictionaries = fit(docs.filter(~held_out & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), F.col("lang_best").alias("lang_pred"), "score", "rejected")
