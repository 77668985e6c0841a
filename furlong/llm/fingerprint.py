"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles (five words, A-Z lower-cased;
a text of fewer words is one shingle; NULL, empty or blank texts have the empty sketch). Sketches of parts merge into the
sketch of the whole; two of them estimate resemblance and containment, one the number of distinct shingles. With fewer
than k shingles all of these are exact. Two empty sketches resemble each other fully (1.0); an empty and another one
don't (0.0). Equal texts have equal sketches. Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import _common as common

K = 128
SHINGLE = 5
_FIRST = -(1 << 63)


def sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the column out: array<bigint>. Word hashes are a column of their own, so that they are computed once."""
    words = F.filter(F.split(common.lower_ascii(F.coalesce(common.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = common.fresh("w", df.columns, [out])
    hashed = df.withColumn(own, F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(own)
    many = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (shingle - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, shingle))))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))
    all_of = F.when(F.size(w) >= shingle, many).otherwise(few)
    return hashed.withColumn(out, F.slice(F.sort_array(F.array_distinct(all_of)), 1, k)).drop(own)


def merge(sketches: Column, k: int = K) -> Column:
    """The sketch of a whole from array<array<bigint>>, the sketches of its parts."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(sketches))), 1, k)


def merge_groups(df: DataFrame, by: list[str], column: str = "sketch", k: int = K, salts: int = 16) -> DataFrame:
    """One sketch for each group, in two steps: a hot group is first merged in parts."""
    salt, keys = common.fresh("salt", by, [column]), [common.col(n) for n in by]
    parts = df.groupBy(*keys, F.pmod(F.xxhash64(common.col(column)), F.lit(salts)).alias(salt)).agg(merge(F.collect_set(common.col(column)), k).alias(column))
    return parts.groupBy(*keys).agg(merge(F.collect_list(common.col(column)), k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's k smallest hashes that both have."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(F.slice(F.array_union(a, b), 1, k)).cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") - F.lit(float(_FIRST))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(union, k) / own))


def as_text(a: Column) -> Column:
    """The sketch as 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(df: DataFrame, key: str, add, parts: int, then: Column | None = None) -> DataFrame:
    """Rows with what ``add(window)`` sees of the next row by descending key; after the last comes the first. then: what orders
    rows that share a key; rows that are equal in it too follow each other in any order.

    The keys are cut at quantiles into ranges, each one window; the head of a range is also dealt to the range before it,
    as a ghost row that only ends its window. add: from (DataFrame, window, the name of a column that is 0 for rows and 1 for
    ghosts) to DataFrame; runs over rows and ghosts."""
    k, t, p, d, g = (common.fresh(f"_{n}", df.columns) for n in "ktpdg")
    low = F.coalesce(common.col(key), F.lit(_FIRST))
    shares = [i / parts for i in range(1, parts)]
    found = df.select(low.alias("k")).agg(F.percentile_approx("k", shares, 20000) if shares else F.lit(None), F.min("k"), F.max("k")).first()
    if found[2] is None:
        heads = [0]
    else:
        heads = sorted({*(found[0] or []), found[2]})
    last = len([h for h in heads if h >= (found[1] if found[1] is not None else 0)])
    bounds = F.array(*map(F.lit, heads)).cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda h: h >= F.col(k)))
    placed = df.withColumns({k: low, t: F.lit(0) if then is None else then}).withColumn(p, part)
    ghost = F.when(F.array_contains(bounds, F.col(k)), F.when(F.col(p) > 1, F.col(p) - 1).otherwise(last))
    dealt = placed.withColumn(d, F.explode(F.filter(F.array(F.struct(F.col(p).alias("p"), F.lit(0).alias("g")), F.struct(ghost.alias("p"), F.lit(1).alias("g"))), lambda x: x.p.isNotNull())))
    dealt = dealt.withColumns({p: F.col(f"{d}.p"), g: F.col(f"{d}.g")}).drop(d)
    return add(dealt, Window.partitionBy(p).orderBy(g, F.desc(k), t), g).filter(F.col(g) == 0).drop(k, p, g, t)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def add(rows: DataFrame, window, ghost: str) -> DataFrame:
        n = F.length("text")
        cut = F.floor(n / 3).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.lead("text").over(window), F.lit(1), cut))
        rows = rows.withColumns({"edited": edited, "n_chars": n.cast("long")})
        rows = sketch(rows, "text").drop("text").withColumn("next", F.lead("sketch").over(window))
        return sketch(rows.filter(F.col(ghost) == 0), "edited", "edited_sketch")

    found = with_next(docs, "doc_id", add, 2 * common.parallelism(spark), F.xxhash64("text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next")).alias("near_next"),
    )
