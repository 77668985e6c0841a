"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is ``width`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. The training texts' term frequencies tell
which three words of each window are the rarest; postings (term, document, position) are written once to the shared folder
for those terms alone, adjusted by the word's offset in the item, and intersected: a document, item and shift with as many
rare terms as a window has is an alignment. So frequent terms have no lists, and no window that occurs is missed. A window that
several places of items have is aligned for the first of them only, and the places that a document's alignments leave are
merged, so each is compared once, by the window's hash (96 bits): repetitive texts cost no more than others.
A posting of the empty term, at the place after a document's last word, tells its length. The index is of one benchmark's
rare terms and one run; ``prepared`` makes it, ``matches``, ``judge`` and ``proximity`` read it.

Cases: a NULL text has no words and is neither hit nor contaminated. Repeated items count once for each item_id; items
without words are never found. Rows with the same id but other texts are kept apart; a NULL id is a key of its own.
Tables may be empty. Only the three or two named columns are read, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import _common as common

WIDTH = 13
RAREST = 3
#: What is broadcast has so many bytes at most, by a sum over its rows; larger sides are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_NO_ID = -(1 << 63)
Index = tuple[DataFrame, DataFrame, DataFrame, DataFrame]


def words(text: Column) -> Column:
    return F.regexp_extract_all(common.lower_ascii(F.coalesce(text, F.lit(""))), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))


def _bounded(df: DataFrame, size: Column | int) -> DataFrame:
    """df, to be broadcast if its rows have few enough bytes. size: of a row; numbers beside it count 64."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES else df


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = common.col(text)
    return docs.select(F.coalesce(common.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("_k"), F.xxhash64(own).alias("_h"), own.alias("_t"))


def _hashed(window: Column) -> tuple[Column, Column]:
    """What tells windows apart; windows of other lengths differ in it too."""
    return F.xxhash64(window).alias("a"), F.hash(window).alias("b")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(a, b, item, item_id, s): each window of each item, where it begins."""
    size = F.least(F.lit(width), F.col("n"))
    each = items.select("item", "item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("s"))
    return common.cut(each.select(*_hashed(F.slice("w", F.col("s") + 1, F.col("size"))), "item", "item_id", "s"))


def _anchors(texts: DataFrame, items: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(item, s, at, term, first): the rarest terms of each window (from s) of each item, by their frequency in the texts, and
    whether this is the first of equal windows. A word is dealt to the windows that it is in, so the work follows the items' words."""
    each = items.select("item", "n", F.posexplode("w").alias("at", "term"))
    terms = common.cut(each.select("term").distinct())
    counted = texts.select(F.explode(words(F.col("_t"))).alias("term")).join(_bounded(terms, F.octet_length("term")), "term").groupBy("term").agg(F.count("*").alias("df"))
    inside = each.join(counted, "term", "left").withColumn("s", F.explode(F.sequence(F.greatest(F.col("at") - width + 1, F.lit(0)), F.least(F.col("at"), F.greatest(F.col("n") - width, F.lit(0))))))
    rare = Window.partitionBy("item", "s").orderBy(F.coalesce("df", F.lit(0)), "at")
    chosen = inside.withColumn("r", F.row_number().over(rare)).filter(F.col("r") <= RAREST)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("item", "s")).alias("x")).select("x.item", "x.s", F.lit(True).alias("first"))
    return common.cut(chosen.join(first, ["item", "s"], "left").select("item", "s", "at", "term", F.coalesce("first", F.lit(False)).alias("first")))


def _postings(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(term, document, position) of the anchors' terms and of each text's end, written to the shared folder."""
    tokens = texts.select("_k", "_h", F.posexplode(F.concat(words(F.col("_t")), F.array(F.lit("")))).alias("p", "term"))
    terms = anchors.select("term").union(anchors.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    return common.cut(tokens.join(_bounded(terms, F.octet_length("term")), "term").select("term", "_k", "_h", "p"))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    split = benchmark.select(common.col(item_id).alias("item_id"), words(common.col(text)).alias("w")).filter(F.size("w") > 0).distinct()
    return common.cut(split.select(F.xxhash64("item_id", "w").alias("item"), "item_id", "w", F.size("w").alias("n")))


def prepared(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> Index:
    """The items, their anchors, the index and the items' windows: may be handed to several of the functions below."""
    texts, items = _keyed(docs, doc_id, text), _items(benchmark, item_id, text)
    windows = _windows(items, width)
    anchors = _anchors(texts, items, windows, width)
    return items, anchors, _postings(texts, anchors), windows


def _shifted(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """The postings with what the anchors have besides their term, and the shift of the item against the document."""
    return index.join(_bounded(anchors, F.octet_length("term")), "term").withColumn("shift", F.col("p") - F.col("at")).drop("term", "p")


def _ranges(index: Index, width: int) -> DataFrame:
    """(_k, _h, ranges array<struct<size, lo, hi>>): the places of each document at which windows of that many words may begin,
    as ranges that don't meet, so there are at most as many as the document has words."""
    items, anchors, postings, _ = index
    met = _shifted(postings, anchors.filter("first").select("item", "at", "term").distinct()).groupBy("_k", "_h", "item", "shift").agg(F.countDistinct("at").alias("c"))
    enough = met.join(_bounded(items.select("item", "n"), 0), "item").filter(F.col("c") >= F.least(F.lit(RAREST), F.col("n")))
    size = F.least(F.lit(width), F.col("n"))
    aligned = enough.select("_k", "_h", size.alias("size"), F.greatest("shift", F.lit(0)).alias("lo"), (F.col("shift") + F.col("n") - size).alias("hi")).filter("hi >= lo").distinct()
    order = Window.partitionBy("_k", "_h", "size").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = aligned.withColumn("new", (F.col("lo") > F.coalesce(before, F.lit(-2)) + 1).cast("int")).withColumn("part", F.sum("new").over(order))
    merged = parted.groupBy("_k", "_h", "size", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return common.cut(merged.groupBy("_k", "_h").agg(F.collect_list(F.struct("size", "lo", "hi")).alias("ranges")))


def _spans(docs: DataFrame, index: Index, doc_id: str, text: str, width: int) -> DataFrame:
    """(_k, _h, start, end, a, b): the spans of words that are windows of items, and which windows; in the shared folder."""
    ranges = _ranges(index, width)
    some = _keyed(docs, doc_id, text).join(_bounded(ranges, 12 * F.size("ranges")), ["_k", "_h"])
    # Few bytes, but much work: dealt to as many tasks as any shuffle, not to as few as the bytes would fit.
    some = some.repartition(common.parallelism(docs.sparkSession), "_k", "_h").dropDuplicates(["_k", "_h"])
    found = some.select("_k", "_h", words(F.col("_t")).alias("d"), "ranges")

    def places(r: Column) -> Column:
        last = F.least(r.hi, F.size("d") - r.size)
        starts = F.when(last >= r.lo, F.sequence(r.lo, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(at.alias("start"), (at + r.size).alias("end"), *_hashed(F.slice("d", at + 1, r.size))))

    tried = found.select("_k", "_h", F.explode(F.flatten(F.transform("ranges", places))).alias("x")).select("_k", "_h", "x.*")
    return common.cut(tried.join(_bounded(index[3].select("a", "b").distinct(), 0), ["a", "b"], "left_semi"))


def _named(found: DataFrame, index: Index) -> DataFrame:
    """What was found, with the ids of the items that have the window."""
    names = index[3].select("a", "b", "item_id").distinct()
    return found.join(_bounded(names, F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0))), ["a", "b"])


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = WIDTH, index: Index | None = None) -> DataFrame:
    """(doc_id, item_id, start, end): every window of an item that a document has, as a span of the document's words."""
    index = index or prepared(docs, benchmark, doc_id, item_id, text, width)
    return _named(_spans(docs, index, doc_id, text, width), index).select(_id(), "item_id", "start", "end")


def _id() -> Column:
    return F.when(F.col("_k") != _NO_ID, F.col("_k")).alias("doc_id")


def proximity(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = WIDTH, slack: int = 3, index: Index | None = None) -> DataFrame:
    """(doc_id, item_id, shift, terms): all rare terms of some window, their shifts at most ``slack`` words apart."""
    items, anchors, postings, _ = index or prepared(docs, benchmark, doc_id, item_id, text, width)
    ahead = Window.partitionBy("_k", "_h", "item", "s").orderBy("shift").rangeBetween(0, slack)
    close = _shifted(postings, anchors.drop("first")).withColumn("terms", F.size(F.collect_set("at").over(ahead)))
    wanted = anchors.groupBy("item", "s").agg(F.count("*").alias("of"))
    names = items.select("item", "item_id")
    enough = close.join(_bounded(wanted, 0), ["item", "s"]).filter("terms = of").join(_bounded(names, F.octet_length(F.col("item_id").cast("string"))), "item")
    best = enough.groupBy("_k", "_h", "item_id").agg(F.max("terms").alias("terms"), F.min("shift").alias("shift"))
    return best.select(_id(), "item_id", "shift", "terms")


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = WIDTH, share: int = 20) -> DataFrame:
    """One row for each document: _k, _h (its key), doc_id, n_words, n_hit, items (sorted ids), contaminated.

    contaminated: share * n_hit >= n_words, with a hit at least."""
    index = prepared(docs, benchmark, doc_id, item_id, text, width)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", start, lambda s, h: F.struct((s.n + F.greatest(h.end - F.greatest(h.start, s.end), F.lit(0))).alias("n"), F.greatest(s.end, h.end).alias("end")))
    found = _spans(docs, index, doc_id, text, width)
    counted = found.groupBy("_k", "_h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")).select("_k", "_h", covered.n.cast("long").alias("n_hit"))
    ids = _named(found.select("_k", "_h", "a", "b").distinct(), index).groupBy("_k", "_h").agg(F.array_sort(F.transform(F.collect_set(F.struct(F.col("item_id").cast("string").alias("i"))), lambda x: x.i)).alias("items"))
    hits = counted.join(ids, ["_k", "_h"], "left")
    texts = index[2].filter("term = ''").select("_k", "_h", _id(), F.col("p").cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return texts.join(hits, ["_k", "_h"], "left").select(
        "_k", "_h", "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their own columns, whatever their names."""
    k, h = common.fresh("k", docs.columns), common.fresh("h", docs.columns)
    dirty = common.cut(judge(docs, benchmark, doc_id, text=text).filter("contaminated").select(F.col("_k").alias(k), F.col("_h").alias(h)).distinct())
    keyed = docs.withColumns({k: F.coalesce(common.col(doc_id).cast("long"), F.lit(_NO_ID)), h: F.xxhash64(common.col(text))})
    return keyed.join(_bounded(dirty, 0), [k, h], "left_anti").select(*map(common.col, docs.columns))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark")
    return judge(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, g)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
