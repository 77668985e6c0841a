"""From documents to training tokens, in five stages over the operators of furlong.llm.

Every stage reads what its predecessor wrote. Its decisions take effect: rejected, duplicate and contaminated documents
are gone from the next stage's input, and removed passages from its texts. All stages but the last return the columns of
documents. NULLs, empty texts, repeated rows, empty tables and extra columns go through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import _common as common
from furlong.llm import bpe, decontaminate, jaccard, quality, substring


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.7 or more)."""
    machine = quality.fit_tables(docs, common.table(spark, sf_dir, "labels"))
    names = docs.columns
    own = {n: common.fresh(n, names, ["score", "predicted"]) for n in names if n.lower() in ("score", "predicted")}
    kept = quality.score(docs.withColumnsRenamed(own), machine).filter("predicted = 1")
    return kept.select(*(common.col(own.get(n, n)).alias(n) for n in names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that occurred earlier; a text that loses nothing stays as it is. n_chars is the
    new length. Documents that lose all their words stay, with an empty text."""
    names = docs.columns
    outputs = ("n_words", "n_removed", "kept", "removed")
    own = {n: common.fresh(n, names, outputs) for n in names if n.lower() in outputs}
    found = substring.dedup(docs.withColumnsRenamed(own))
    lost = F.col("n_removed") > 0
    new = {"text": F.when(lost, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(lost, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(new.get(n, common.col(own.get(n, n))).alias(n) for n in names))


def benchmark_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and the digests of ids and decoded bytes."""
    coded = bpe.encode(docs.select("doc_id", "text"), decoded="decoded").drop("text")
    return coded.select("doc_id", "token_ids", *bpe.digests(coded))


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_clean),
    ("byte_bpe", tokens),
]

#: The classifier is learned, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
    return docs
