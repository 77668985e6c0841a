"""N-gram Jaccard join: a size-aware heavy-light join of documents' sets of word shingles.

A document's set: its distinct shingles of five consecutive words (runs of other bytes than ASCII white space, A-Z
lower-cased); with fewer words the whole sequence is one shingle; without words it is empty and linked with nothing. Two
documents link when 100 * |intersection| >= percent * |union|.

Documents with equal sets are one node, so copies cost nothing further. Nodes fall into two classes by size:

* light sets enumerate, for each size t that a partner may have, all subsets of the size k that a link of (s, t) needs in
  common. Two light sets of sizes s and t share such a subset exactly if they link. Sets of the larger size meet in that list
  too, having only k in common, which may be too little for them; so a list's star is over its smallest set, which tells all
  there is to know about components, and has only edges for which k is enough. Pairs of the larger size have their own lists.
* heavy sets, and light sets that may link with heavy ones, post a prefix to inverted lists: in one fixed order of shingles
  (rare ones first, by how many sets have them), linked sets share one of the first s - ceil(0.8 s) + 1. Shingles of one
  set aren't posted. Lists are scanned for pairs whose sizes and places allow a link; parity bitmaps give an exact bound that drops nearly
  all others, and the rest is decided on the sets themselves.

The size up to which sets are light is chosen by cost, from the histogram of small sizes: subsets that would be sent
against postings and the checks that follow them.

Components need not all links. First every list is compared with its smallest node only; what is linked by then is one
class. Then, in each list, the nodes outside the list's largest class are compared with all of other classes. So large
groups of near copies cost work in proportion to their size, and no link between classes is lost.

Cases: NULL text or no words: n_shingles 0, own component. Rows that share a doc_id are one document, linked if any of
its texts is. A NULL doc_id can't be named: its component_id is NULL, and it links nobody. Repeated rows: each returned. An empty table
gives an empty one. Only the two columns named are read. Shingles count as equal by a 64-bit hash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furlong.llm import _blocks as blk
from furlong.llm import _common as common
from furlong.llm._words import SPACES, Words, mix, slices, windows

SHINGLE = 5
PERCENT = 80
#: Bytes of a shingle's hash that are sent to be counted, besides what its part says. A false match makes a shingle seem
#: more frequent, for all sets alike; it costs a comparison, not a link.
KEY = 5
#: Sizes below this are in the histogram, which so many rows add up.
HISTOGRAM = 50
#: Bits of a set's parity bitmap.
PARITY = 512
#: Small sizes whose histogram the boundary is chosen from.
MOST_LIGHT = 24
#: What a posting costs, with the scan and checks that follow it, in subsets.
POSTING_COST = 6
#: A node's id is 8 bytes; up to so many are broadcast.
BROADCAST_NODES = 1_000_000


def shared(s: int, t: int, percent: int = PERCENT) -> int:
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    """The sizes that may link with s."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix(s: int, percent: int = PERCENT) -> int:
    return s - -(-percent * s // 100) + 1


def subsets(s: int, most: int, percent: int = PERCENT) -> int:
    return sum(math.comb(s, shared(s, t, percent)) for t in partners(s, percent) if t <= most)


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The largest light size: the cheapest from 1 to MOST_LIGHT for this histogram of sizes."""

    def cost(most: int) -> float:
        out = 0.0
        for s, n in histogram.items():
            if s <= most:
                out += n * subsets(s, most, percent)
            if s > most or 100 * s // percent > most:
                out += n * prefix(s, percent) * POSTING_COST
        return out

    return min(range(1, MOST_LIGHT + 1), key=lambda most: (cost(most), most))


def sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, data, offsets in slices(column):
        w = Words(data, offsets, SPACES, lower=True)
        h = w.hashes()
        grams = windows(h, shingle)
        for i in range(hi - lo):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= shingle:
                yield lo + i, np.unique(grams[a : b - shingle + 1])
            elif b > a:
                yield lo + i, mix(np.array([np.bitwise_xor.reduce(mix(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)))], np.uint64) + np.uint64(b - a))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], "<u8").tobytes()


def parity(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s >> np.uint64(7)) % np.uint64(PARITY), minlength=PARITY).astype(np.int64) % 2 == 1).tobytes()


def _block_sets(block: dict, shingle: int) -> tuple[pa.Array, list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """(ids, sets, signatures, distinct shingles of the block, in how many different sets of it each is)."""
    rows = blk.unpack(block["payload"])
    found = [s for _, s in sets(rows.column("text"), shingle)]
    names = [signature(s) for s in found]
    once = [s for s in dict(zip(names, found, strict=True)).values() if len(s)]
    keys, times = np.unique(np.concatenate(once) if once else np.zeros(0, np.uint64), return_counts=True)
    return rows.column("doc_id").combine_chunks(), found, names, keys, times


def _ask_counts(shingle: int):
    def ask(block: dict, parts: int):
        _, found, _, keys, times = _block_sets(block, shingle)
        _, order, cuts = blk.split(keys, parts)
        for p in range(parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                yield p, len(own).to_bytes(4, "little") + blk.to_bytes(keys[own] >> np.uint64(20), KEY) + blk.zip_bytes(blk.planes(times[own], 4))
        sizes = np.bincount([len(s) for s in found if len(s) < HISTOGRAM], minlength=HISTOGRAM)
        yield parts + block["block"] % blk.TALLIES, sizes.astype("<i8").tobytes()

    return ask


def _count(parts: int):
    """For each list of shingles a byte each: in how many different sets of the blocks they are, 255 at most; or a tally."""

    def reduce(p: int, block: list[int], blobs: list[bytes]) -> pa.Table:
        import zstandard

        if p >= parts:
            back, block = [np.sum([np.frombuffer(b, "<i8") for b in blobs], 0).astype("<i8").tobytes()], [None]
        else:
            sizes = [int.from_bytes(b[:4], "little") for b in blobs]
            keys = np.concatenate([blk.from_bytes(b[4 : 4 + KEY * n], KEY) for b, n in zip(blobs, sizes, strict=True)])
            times = np.concatenate([blk.from_planes(zstandard.decompress(b[4 + KEY * n :]), n, 4).astype(np.uint32) for b, n in zip(blobs, sizes, strict=True)])
            order = np.argsort(keys)
            keys = keys[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            del keys
            sums = np.minimum(np.add.reduceat(times[order], np.flatnonzero(new), dtype=np.uint64), 255).astype(np.uint8)
            count = np.empty(len(order), np.uint8)
            count[order] = np.repeat(sums, np.diff(np.append(np.flatnonzero(new), len(order))))
            ends = np.cumsum([0, *sizes])
            back = [blk.zip_bytes(count[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": pa.array(block, pa.int64()), "p": pa.array([p] * len(block), pa.int32()), "blob": pa.array(back, pa.binary())})

    return reduce


def _light_keys(s: np.ndarray, most: int, percent: int) -> Iterator[tuple[int, int]]:
    """(key, size) of each subset that a partner of some light size must share."""
    n = len(s)
    for t in partners(n, percent):
        if t <= most:
            k = shared(n, t, percent)
            tag = mix(np.array([min(n, t) << 16 | max(n, t) << 8 | k], np.uint64))
            for chosen in itertools.combinations(range(n), k):
                yield int(mix(tag ^ mix(s[list(chosen)]).sum(dtype=np.uint64))[0].astype(np.int64)), k


def _profiles(counted: DataFrame, shingle: int, percent: int, most: int, parts: int) -> DataFrame:
    """Rows of two kinds: a document (doc_id, n, sig, bits), or a posting (light, key, sig, n, at). A light posting's key
    names a subset, of size at; another's is a shingle, with its place in the set's order: by count, then by hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("bits", pa.binary()), ("light", pa.bool_()), ("key", pa.int64()), ("at", pa.int32())])

    def rows(block: dict):
        import zstandard

        ids, found, names, keys, _ = _block_sets(block, shingle)
        count = np.ones(len(keys), np.uint8)
        _, order, cuts = blk.split(keys, parts)
        for a in block["counts"] or []:
            count[order[cuts[a["p"]] : cuts[a["p"] + 1]]] = np.frombuffer(zstandard.decompress(a["blob"]), np.uint8)
        yield from zip(ids.to_pylist(), map(len, found), names, (parity(s) if len(s) else None for s in found), itertools.repeat(None), itertools.repeat(None), itertools.repeat(None))
        nameless = {sig for i, sig in zip(ids.to_pylist(), names, strict=True) if i is None} - {sig for i, sig in zip(ids.to_pylist(), names, strict=True) if i is not None}
        for sig, s in dict(zip(names, found, strict=True)).items():
            n = len(s)
            if not n or sig in nameless:
                continue
            if n <= most:
                yield from ((None, n, sig, None, True, key, k) for key, k in _light_keys(s, most, percent))
            if n > most or 100 * n // percent > most:
                c = count[np.searchsorted(keys, s)]
                first = np.lexsort((s, c))[: prefix(n, percent)]
                yield from ((None, n, sig, None, False, key, int(at)) for key, at in zip(s[first].astype(np.int64).tolist(), range(len(first)), strict=True) if c[first[at]] > 1)

    def run(batches):
        for block in blk.rows_of(batches):
            some = rows(block)
            while part := list(itertools.islice(some, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return common.cut(counted.mapInArrow(run, "doc_id long, n int, sig binary, bits binary, light boolean, key long, at int"))


def _allowed(a: str, b: str, percent: int) -> F.Column:
    """Whether sizes and places allow a link of two postings of one list."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    common_most = F.least(n - i, m - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (common_most * (100 + percent) >= percent * (n + m))


def _early(percent: int) -> F.Column:
    """Whether a posting's place allows a link with a set of its own size or more. Of two that aren't early, each would have to
    be the smaller: they never link."""
    return (F.col("n") - F.col("at")) * (100 + percent) >= 2 * percent * F.col("n")


def _decided(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that link: by parity bitmaps first, then by the sets."""
    bits = nodes.select("node", "n", "bits")
    a, b = bits.toDF("u", "n_u", "bits_u"), bits.toDF("v", "n_v", "bits_v")
    near = pairs.distinct().join(a, "u").join(b, "v")

    def bound(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bits_u", "bits_v"))
                apart = np.unpackbits(x ^ y, axis=1).sum(1)
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_u", "n_v"))
                # |A| + |B| - 2|A&B| >= apart, and a link needs |A&B| * (100 + p) >= p * (|A| + |B|)
                fits = (n + m - apart) * (100 + percent) >= 2 * percent * (n + m)
                yield batch.filter(pa.array(fits)).select(["u", "v"])

    near = common.cut(near.mapInArrow(bound, "u long, v long"))
    wanted = near.select("u").union(near.select("v")).distinct().withColumnRenamed("u", "doc_id")
    if near.isEmpty():
        return near
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)

    def whole(batches):
        for batch in batches:
            found = [s.astype("<u8").tobytes() for _, s in sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "s"])

    full = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(whole, "node long, s binary")

    def decide(batches):
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("s_u").to_pylist(), batch.column("s_v").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                yes.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(yes, pa.bool_())).select(["u", "v"])

    joined = near.join(full.toDF("u", "s_u"), "u").join(full.toDF("v", "s_v"), "v")
    return common.cut(joined.select("u", "v", "s_u", "s_v").mapInArrow(decide, "u long, v long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link. Alternating large and small stars; each
    round is written to the shared folder, and the number of rounds follows the logarithm of the longest path. A round that
    changes nothing is the last one, which a count and a hash of all (distinct) edges tell."""
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first())
    edges = common.cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while True:
        least = both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both(edges).filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.filter("u > v").distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u")
        after = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = common.cut(after)
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of df."""
    docs = df.select(common.col(doc_id).cast("long").alias("doc_id"), common.col(text).alias("text"))
    blocks, parts = blk.pack(docs, "doc_id", "text")
    counts = blk.exchange(blocks, _ask_counts(shingle), parts, _count(parts))
    tallies = [np.frombuffer(r.blob, "<i8") for r in counts.filter("block IS NULL").select("blob").collect()]
    histogram = {s: int(n) for s, n in enumerate(np.sum(tallies, 0) if tallies else []) if s and n}
    most = boundary(histogram, percent)
    profile = _profiles(blk.delivered(blocks, counts.filter("block IS NOT NULL"), "counts"), shingle, percent, most, parts)
    del blocks, counts
    rows = profile.filter("key IS NULL").select("doc_id", "n", "sig", "bits")
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = common.cut(named.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    common.free(df.sparkSession)
    same = named.select("sig", "doc_id").distinct().join(nodes.select("sig", "node"), "sig").filter("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    # A list's head and length are partial sums, joined back to it, so that a long list is nowhere whole in one task.
    posted = profile.filter("key IS NOT NULL").groupBy("light", "key", "sig").agg(F.min("n").alias("n"), F.min("at").alias("at"))
    posted = posted.join(nodes.select("sig", "node"), "sig").drop("sig")
    first = F.struct(F.when(F.col("light"), F.col("n")).alias("size"), "node", "n", "at")
    heads = posted.groupBy("light", "key").agg(F.min(first).alias("head"), F.count("*").alias("of"), F.bool_or(_early(percent)).alias("any"))
    lists = common.cut(posted.join(heads.filter("of > 1 AND (light OR any)").drop("of", "any"), ["light", "key"]))

    ranked = lists.filter("node <> head.node").withColumn("own", F.struct("node", "n", "at"))
    enough = percent * (F.col("head.n") + F.col("n")) <= F.col("at") * (100 + percent)
    light = ranked.filter("light").filter(enough).select(F.col("node").alias("u"), F.col("head.node").alias("v"))
    star = ranked.filter("NOT light").filter(_allowed("head", "own", percent)).select(F.col("head.node").alias("u"), F.col("node").alias("v"))
    links = common.cut(_decided(star, nodes, docs, shingle, percent).union(light).union(same).distinct())
    root = components(links)

    heavy = lists.filter("NOT light").drop("head").join(root, "node", "left").withColumns({"root": F.coalesce("root", "node"), "early": _early(percent)})
    of_class = heavy.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = of_class.groupBy("key").agg(F.max(F.struct("size", "root")).getField("root").alias("main"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    open_lists = common.cut(heavy.join(main, "key"))
    a, b = open_lists.filter("root <> main").alias("a"), open_lists.alias("b")
    across = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _allowed("a", "b", percent)
    # A pair has a posting that is early. Where both are outside the main class and early, it is met twice.
    once = (F.col("b.root") == F.col("b.main")) | ~F.col("b.early") | (F.col("a.node") < F.col("b.node"))
    rest = a.filter("a.early").join(b, across & once).unionAll(a.filter("NOT a.early").join(b.filter("b.early AND b.root = b.main"), across))
    more = _decided(rest.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), nodes, docs, shingle, percent)
    if not more.isEmpty():
        root = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    return rows.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest id, and of rows that share it that with the smallest hash of its text
    (of equal ones, any). Rows without id stay."""
    found = join(df, text, doc_id)
    id_, mark, place = common.fresh("id", df.columns), common.fresh("mark", df.columns), common.fresh("place", df.columns)
    each = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    marks = each.filter("c <> doc_id OR n > 1").select(F.col("doc_id").alias(id_), (F.col("c") == F.col("doc_id")).alias(mark))
    if marks.filter(common.col(mark)).isEmpty():
        return df.join(marks.drop(mark), df[doc_id] == marks[id_], "left_anti")
    marked = df.join(marks, df[doc_id] == marks[id_], "left").filter(F.coalesce(mark, F.lit(True)))
    alone, shared = marked.filter(common.col(mark).isNull()).select(*map(common.col, df.columns)), marked.filter(common.col(mark))
    first = Window.partitionBy(common.col(doc_id)).orderBy(F.xxhash64(common.col(text)))
    return alone.unionAll(shared.withColumn(place, F.row_number().over(first)).filter(common.col(place) == 1).select(*map(common.col, df.columns)))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[s : s + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), common AS MATERIALIZED (
  SELECT doc_id, g FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM common a JOIN common b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), reach AS (
  SELECT doc_id AS u, doc_id AS r FROM d
  UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.u WHERE reach.r < l.v
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id, n
"""
