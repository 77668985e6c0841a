"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Both tokenizers encode a space and the text: A a byte-level BPE, B a piece model, which adds that space itself. Byte offsets
at which tokens of both end cut them into groups. A byte-range chunk of a document yields a fragment: an open prefix up to
its first cut, closed groups, an open suffix behind its last cut. Fragments are a monoid (``compose``; without a cut, all
tokens are open), so those of a very long document, read in many Spark tasks, are composed in a tree of rounds; closed
groups leave the tree where they arise and only open ends go on. A document of one chunk is aligned where it is read.

Links are the pairs of an A and a B token occurrence in one group. An id pair's count is the number of documents that hold
it linked. Documents are kept in blocks, and a block sends each of its distinct pairs once, so a pair that all documents
hold costs a row a block; counts come back the same way.

Cases: a NULL or empty text has no tokens, nor has one whose tokens of A or B aren't its bytes (as where it holds U+2581,
which B reads as a space): zeros, an empty string of groups, and no part in counts. Special tokens in texts are plain text.
Every row is a document, repeated rows and NULL ids included. An empty table gives an empty one. Only the id and the text
are read, whatever other columns there are. Distinct spans of a slice are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _common as common
from furlong.llm import _subwords as sub
from furlong.llm._blocks import from_planes, planes, release, rows_of
from furlong.llm.bpe import pieces

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A document with more characters is dealt in byte ranges of about this size.
CHUNK = 1 << 16
#: Distinct (document, pair) entries of a block; a group whose product is larger is linked by its distinct ids.
ENTRIES, PRODUCT = 1 << 21, 4096
#: Fragments that a task composes in one round.
FAN = 16
#: Ids of both tokenizers are below this; a pair is id of A * this + id of B.
IDS = 1 << 17
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_DIGITS = np.frombuffer(b"".join(b"%06d" % i for i in range(IDS)), np.uint8).reshape(-1, 6)


@dataclass
class Tokens:
    """Tokens of both tokenizers, with the byte offsets at which they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __len__(self) -> int:
        return len(self.a) + len(self.b)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("a", "a_ends", "b", "b_ends")))

    def between(self, low: int, high: int) -> Tokens:
        """Those that end behind low, at high at most."""
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        k, n = np.searchsorted(self.b_ends, [low, high], "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:n], self.b_ends[k:n])

    def cuts(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)


NO_TOKENS = Tokens(*(np.zeros(0, t) for t in (np.int32, np.int64, np.int32, np.int64)))


@dataclass
class Fragment:
    """cut: whether there is one. Without, all tokens are in prefix. at: the byte at which the fragment begins; closed:
    (where it belongs, tokens), whole groups in order."""

    at: int
    cut: bool
    prefix: Tokens
    suffix: Tokens
    closed: list[tuple[tuple[int, int], Tokens]]


def fragment(at: int, tokens: Tokens) -> Fragment:
    """Of the tokens that end within a byte range which begins at this byte."""
    cuts = tokens.cuts()
    if not len(cuts):
        return Fragment(at, False, tokens, NO_TOKENS, [])
    inside = tokens.between(cuts[0], cuts[-1])
    return Fragment(at, True, tokens.between(-1, cuts[0]), tokens.between(cuts[-1], np.iinfo(np.int64).max), [((at, 1), inside)] if len(inside) else [])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two that follow each other. Associative."""
    if not x.cut:
        return Fragment(x.at, y.cut, x.prefix + y.prefix, y.suffix, y.closed)
    if not y.cut:
        return Fragment(x.at, True, x.prefix, x.suffix + y.prefix, x.closed)
    joined = x.suffix + y.prefix
    return Fragment(x.at, True, x.prefix, y.suffix, [*x.closed, *([((y.at, 0), joined)] if len(joined) else []), *y.closed])


def whole(found: Fragment) -> list[tuple[tuple[int, int], Tokens]]:
    """All groups of a document whose fragments are composed: both of its ends are cuts."""
    ends = [((-1, 0), found.prefix), *found.closed, ((np.iinfo(np.int64).max, 0), found.suffix)]
    return [(place, tokens) for place, tokens in ends if len(tokens)]


class Aligned:
    """The groups of tokens that begin and end at a cut, those of one or more documents one after the other. ends: the
    byte offsets at which documents end."""

    def __init__(self, tokens: Tokens, ends: np.ndarray):
        self.tokens, t = tokens, tokens
        cuts = t.cuts()
        self.ga, self.gb = np.searchsorted(cuts, t.a_ends), np.searchsorted(cuts, t.b_ends)
        self.na, self.nb = np.bincount(self.ga, minlength=len(cuts)), np.bincount(self.gb, minlength=len(cuts))
        self.bounds = np.concatenate([[0], np.searchsorted(cuts, ends, "right")])
        self.doc = np.repeat(np.arange(len(ends)), np.diff(self.bounds))

    def figures(self) -> list[np.ndarray]:
        """FIGURES of each document."""
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[self.bounds])
        return [sums(self.na), sums(self.nb), np.diff(self.bounds), sums(self.na * self.nb)]

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        t, n = self.tokens, len(self.tokens)
        before_a, before_b = np.concatenate([[0], np.cumsum(self.na)]), np.concatenate([[0], np.cumsum(self.nb)])
        ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(t.a)) + before_b[self.ga]] = t.a
        ids[np.arange(len(t.b)) + before_a[self.gb + 1]] = t.b
        after[before_a[1:] + before_b[:-1] - 1] = ord("|")
        after[before_a[1:] + before_b[1:] - 1] = ord(";")
        width = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
        shown = np.concatenate([_DIGITS[ids], after[:, None]], axis=1)[np.arange(7) >= 6 - width[:, None]]
        at = np.concatenate([[0], np.cumsum(width + 1)])[(before_a + before_b)[self.bounds]]
        return [shown[lo : max(lo, hi - 1)].tobytes() for lo, hi in itertools.pairwise(at.tolist())]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, how often), each pair once a document in a yield; large groups come by themselves."""
        t = self.tokens
        first_a, first_b = np.cumsum(self.na) - self.na, np.cumsum(self.nb) - self.nb
        large = self.na * self.nb > PRODUCT
        reps = np.where(large, 0, self.nb)[self.ga]
        key = np.repeat(self.doc[self.ga] * (IDS * IDS) + t.a.astype(np.int64) * IDS, reps) + t.b[sub.take(first_b[self.ga], reps)]
        key, times = np.unique(key, return_counts=True)
        yield key // (IDS * IDS), key % (IDS * IDS), times
        for g in np.flatnonzero(large).tolist():
            (a, n), (b, m) = (np.unique(x, return_counts=True) for x in (t.a[first_a[g] : first_a[g] + self.na[g]], t.b[first_b[g] : first_b[g] + self.nb[g]]))
            step = max(1, (1 << 20) // len(b))
            for lo in range(0, len(a), step):
                pair = (a[lo : lo + step, None].astype(np.int64) * IDS + b).ravel()
                yield np.full(len(pair), self.doc[g]), pair, (n[lo : lo + step, None] * m).ravel()


def encode(texts: list[str], bpe: str, model: str) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """(tokens of texts that begin with their space, whether each text has tokens that are its bytes, the byte offset in all
    tokens at which each such text ends)."""
    joined = sub.Slice(texts)
    if max(len(sub.byte_level(bpe, True).tokens), len(sub.pieces(model).tokens)) > IDS:
        raise ValueError(f"ids must be below {IDS}")
    both = [(tokenizer, *joined.encode(tokenizer)) for tokenizer in (sub.byte_level(bpe, True), sub.pieces(model))]
    right = both[0][3] & both[1][3]
    found = []
    for tokenizer, ids, count, _ in both:
        ids = ids[np.repeat(right, count)]
        found += [ids, np.cumsum(tokenizer.table.sizes[ids])]
    return Tokens(*found), right, np.cumsum(np.diff(joined.bounds)[right])


def _merged(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (document, pair) once, in order."""
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    return doc[first], pair[first], np.add.reduceat(times, np.flatnonzero(first)) if len(doc) else times


class _Block:
    """Documents and their entries, until they are as many as a block holds."""

    def __init__(self):
        self.ids, self.figures, self.digests, self.entries, self.size = [], [], [], [], 0

    def add(self, ids: pa.Array, figures: np.ndarray, digests: list[str], entries: list) -> None:
        base = sum(map(len, self.ids))
        self.ids.append(ids)
        self.figures.append(figures)
        self.digests += digests
        doc, pair, times = entries[0] if len(entries) == 1 else _merged(*(np.concatenate(x) for x in zip(*entries, strict=True)))
        self.entries.append((doc + base, pair, times))
        self.size += len(doc)

    def row(self, number: int) -> pa.RecordBatch:
        doc, pair, times = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        own, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        n = sum(map(len, self.ids))
        table = pa.table({"id": pa.chunked_array(self.ids), "digest": pa.array(self.digests, pa.string()), **{k: pa.array(x) for k, x in zip(FIGURES, np.concatenate(self.figures, axis=1), strict=True)}, "entries": pa.array(np.bincount(doc, minlength=n))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.combine_chunks())
        steps = np.diff(place, prepend=0)  # small within a document
        steps[1:][doc[1:] != doc[:-1]] = place[1:][doc[1:] != doc[:-1]]
        blobs = [zstandard.compress(x) for x in (sink.getvalue(), planes(steps, 4), planes(times, 4))]
        row = [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(x, pa.int64())) for x in (own, held)]
        return pa.RecordBatch.from_arrays([*row, *lists], names=["block", "docs", "places", "times", "pairs", "held"])


def _scored(row: pa.RecordBatch, kind: pa.Schema) -> pa.RecordBatch:
    """A block's documents with what the counts of its pairs make of their links."""
    docs, places, often = (zstandard.decompress(row.column(k)[0].as_py()) for k in ("docs", "places", "times"))
    with pa.ipc.open_stream(docs) as own:
        table = own.read_all()
    found = pc.list_flatten(row.column("counts"))
    counts = np.stack([found.field(k).to_numpy() for k in ("pair", "n", "best")], axis=1)
    counts = counts[np.argsort(counts[:, 0])]  # as the block's pairs are
    entries = table.column("entries").to_numpy()
    n = int(entries.sum())
    steps, times = (from_planes(x, n, 4).astype(np.int64) for x in (places, often))
    ends = np.cumsum(entries)
    place = np.cumsum(steps)
    before = np.concatenate([[0], place])[ends - entries]
    place -= np.repeat(before, entries)
    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (times * counts[place, 2], times * counts[place, 1])]
    columns = [table.column("id"), *(table.column(k) for k in FIGURES), *map(pa.array, sums), table.column("digest")]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=kind)


def _short(df: DataFrame, bpe: str, model: str, entries: int, chunk: int) -> DataFrame:
    """Blocks of the documents of one chunk. df: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = itertools.count(TaskContext.get().partitionId() << 32), _Block()
        for batch in batches:
            texts = batch.column(1)
            sizes = [n or 0 for n in pc.utf8_length(texts).to_pylist()]
            for lo, hi in sub.runs(sizes):
                own = texts.slice(lo, hi - lo).to_pylist()
                full = np.array([bool(t) for t in own], bool)
                tokens, right, ends = encode([" " + t for t in own if t], bpe, model)
                full[full] = right
                aligned = Aligned(tokens, ends)
                rows, figures, digests = np.flatnonzero(full), np.zeros((4, len(own)), np.int64), [""] * len(own)
                figures[:, rows] = aligned.figures()
                for i, text in zip(rows.tolist(), aligned.texts(), strict=True):
                    digests[i] = hashlib.sha256(text).hexdigest()
                found = [(rows[doc], pair, times) for doc, pair, times in aligned.pairs()]
                block.add(batch.column(0).slice(lo, hi - lo), figures, digests, found)
                if block.size >= entries:
                    yield block.row(next(number))
                    block = _Block()
            release()
        if block.ids:
            yield block.row(next(number))

    schema = "block long, docs binary, places binary, times binary, pairs array<long>, held array<long>"
    return common.cut(df.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(run, schema))


def _pack(tokens: Tokens) -> bytes:
    return b"".join([np.array([len(tokens.a), len(tokens.b)], np.int64).tobytes(), tokens.a.astype(np.int32).tobytes(), tokens.b.astype(np.int32).tobytes(), tokens.a_ends.astype(np.int64).tobytes(), tokens.b_ends.astype(np.int64).tobytes()])


def _unpack(raw: bytes) -> Tokens:
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    a, b = np.frombuffer(raw, np.int32, n, 16), np.frombuffer(raw, np.int32, m, 16 + 4 * n)
    at = 16 + 4 * (n + m)
    return Tokens(a, np.frombuffer(raw, np.int64, n, at), b, np.frombuffer(raw, np.int64, m, at + 8 * n))


_PARTS = "k long, at long, place int, right boolean, digest binary, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<long>, cut boolean, prefix binary, suffix binary"


def _part_rows(k: int, found: list, right: bool = True) -> list[dict]:
    """Rows of closed groups: their text and figures, without the tokens."""
    rows = []
    for (at, place), tokens in found:
        own = Aligned(tokens, np.array([max(tokens.a_ends[-1], tokens.b_ends[-1])]))
        _, pair, times = _merged(*(np.concatenate(x) for x in zip(*own.pairs())))
        figures = {name: int(x[0]) for name, x in zip(FIGURES, own.figures(), strict=True)}
        rows.append({"k": k, "at": at, "place": place, "right": right, "digest": zstandard.compress(own.texts()[0]), **figures, "pairs": pair, "times": times})
    return rows


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _chunks(df: DataFrame, chunk: int) -> DataFrame:
    """(k, id, at, text) of long documents: pieces that the tokenizers can encode by themselves, each with its space. df: k, id, text."""
    kind = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts, at = pieces(" " + batch.column(2)[i].as_py(), chunk), 0
                for part in parts:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([at], pa.int64()), pa.array([part], pa.string())], names=["k", "id", "at", "text"])
                    at += len(part.encode())

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", kind), T.StructField("at", T.LongType()), T.StructField("text", T.StringType())])
    return df.mapInArrow(run, schema)


def _fragments(parts: DataFrame, bpe: str, model: str, chunk: int) -> DataFrame:
    """Rows of _PARTS: closed groups, and (where cut isn't NULL) each chunk's fragment."""
    arrow = _arrow(_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tokens, right, _ = encode([row["text"]], bpe, model)
            base, size = row["at"], len(row["text"].encode())
            if not right[0]:
                yield _batch([{"k": row["k"], "at": base, "place": 1, "right": False, "digest": b"", **dict.fromkeys(FIGURES, 0)}], arrow)
                continue
            tokens = Tokens(tokens.a, tokens.a_ends + base, tokens.b, tokens.b_ends + base)
            for low in range(0, size, chunk):  # one range, unless the text has no place to cut it
                f = fragment(base + low, tokens.between(base + low, base + min(size, low + chunk)))
                own = {"k": row["k"], "at": f.at, "right": True, "cut": f.cut, "prefix": _pack(f.prefix), "suffix": _pack(f.suffix)}
                yield _batch([*_part_rows(row["k"], f.closed), own], arrow)

    return parts.mapInArrow(run, _PARTS)


def _composed(found: DataFrame, fan: int) -> DataFrame:
    """Rows of closed groups alone: the fragments of each document composed in rounds of so many neighbours."""
    arrow = _arrow(_PARTS)
    closed, rest = [found.filter("cut is null")], found.filter("cut is not null")
    number = F.row_number().over(Window.partitionBy("k").orderBy("at")) - 1
    rest = rest.withColumn("i", number)
    most = (rest.agg(F.max("i")).first()[0] or 0) + 1

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("at").to_pylist()
        made = functools.reduce(compose, (Fragment(r["at"], r["cut"], _unpack(r["prefix"]), _unpack(r["suffix"]), []) for r in rows))
        k = rows[0]["k"]
        own = {"k": k, "at": made.at, "right": True, "cut": made.cut, "prefix": _pack(made.prefix), "suffix": _pack(made.suffix)}
        out = [*_part_rows(k, made.closed), own] if most > fan else _part_rows(k, whole(made))
        return pa.Table.from_batches([_batch(out, arrow)])

    while True:
        made = common.cut(rest.withColumn("g", F.expr(f"i div {fan}")).groupBy("k", "g").applyInArrow(run, _PARTS))
        closed.append(made.filter("cut is null"))
        if most <= fan:
            return functools.reduce(DataFrame.unionByName, closed)
        rest, most = made.filter("cut is not null").withColumn("i", number), -(-most // fan)


def _long(df: DataFrame, bpe: str, model: str, chunk: int, fan: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the documents of several chunks: (k, id), (k, digest, FIGURES), (k, pair, times). df: k, id, text, fixed."""
    spark = df.sparkSession
    parts = common.cut(_chunks(df, chunk).repartition(common.parallelism(spark)))
    found = common.cut(_fragments(parts.select("k", "at", "text"), bpe, model, chunk))
    wrong = found.filter("not right").select("k").distinct()
    rows = common.cut(_composed(found.join(wrong, "k", "left_anti"), fan))
    out = "k long, digest string, n_a long, n_b long, n_groups long, n_links long"
    arrow = _arrow(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a document follow each other in its order: one running hash, whatever its length."""
        key = sha = None
        for row in rows_of(batches):
            if row["k"] != key:
                if sha:
                    yield _batch([{"k": key, "digest": sha.hexdigest(), **sums}], arrow)
                key, sha, sums = row["k"], hashlib.sha256(), dict.fromkeys(FIGURES, 0)
            else:
                sha.update(b";")
            sha.update(zstandard.decompress(row["digest"]))
            sums = {name: sums[name] + row[name] for name in FIGURES}
        if sha:
            yield _batch([{"k": key, "digest": sha.hexdigest(), **sums}], arrow)

    ordered = rows.select("k", "at", "place", "digest", *FIGURES).repartition(common.parallelism(spark), "k").sortWithinPartitions("k", "at", "place")
    linked = rows.select("k", F.explode(F.arrays_zip("pairs", "times")).alias("e")).groupBy("k", F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("times"))
    return parts.filter("at = 0").select("k", "id"), ordered.mapInArrow(digest, out), linked


def _counted(asked: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether that is its A id's highest. asked: pair, n."""
    total = common.cut(asked.groupBy("pair").agg(F.sum("n").alias("n")))
    # An id of A is below IDS, so this side has 32 MB at most, whatever the corpus.
    highest = total.groupBy(F.expr(f"pair div {IDS}").alias("a")).agg(F.max("n").alias("most"))
    return total.join(F.broadcast(highest), F.expr(f"pair div {IDS}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bpe: str = BPE, model: str = PIECES, chunk: int = CHUNK, entries: int = ENTRIES, fan: int = FAN) -> DataFrame:
    """One row for each document: its id (under its own name), n_a, n_b, n_groups, n_links, n_best (links whose pair's count is
    the highest of their A id), count_sum (of the counts of all links), groups_sha256 (of ``groups``' text, or empty).

    bpe and model: names of files that public_tokenizers has on every machine, or paths."""
    own = df.select(common.col(doc_id).alias("id"), common.col(text).alias("text"))
    blocks = _short(own, bpe, model, entries, chunk)
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("e")).select("block", F.col("e.pairs").alias("pair"), F.col("e.held").alias("n"))
    keyed = own.filter(F.length("text") > chunk).withColumn("k", F.monotonically_increasing_id()).select("k", "id", "text")
    ids, digests, linked = _long(keyed, bpe, model, chunk, fan)
    total = _counted(asked.select("pair", "n").unionByName(linked.select("pair", F.lit(1).cast("long").alias("n"))))
    kind = T.StructType([T.StructField("id", own.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in (*FIGURES, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for i in range(batch.num_rows):
                yield _scored(batch.slice(i, 1), to_arrow_schema(kind))
                release()

    back = asked.select("block", "pair").join(total, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("counts"))
    short = blocks.drop("pairs", "held").join(back, "block", "left").select("docs", "places", "times", "counts").mapInArrow(score, kind)
    sums = linked.join(total, "pair").groupBy("k").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    long = ids.join(digests, "k", "left").join(sums, "k", "left").select("id", *map(zero, (*FIGURES, "n_best", "count_sum")), F.coalesce("digest", F.lit("")).alias("groups_sha256"))
    return short.unionByName(long).withColumnRenamed("id", doc_id)


def groups(df: DataFrame, text: str = "text", out: str = "groups", bpe: str = BPE, model: str = PIECES) -> DataFrame:
    """df with the column out: ``a1,a2|b1;a3|b2,b3``, the decimal ids of each group in order; empty without tokens. A column of
    that name is replaced."""
    base = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for lo, hi in sub.runs([len(t or "") for t in own]):
                full = np.array([bool(t) for t in own[lo:hi]], bool)
                tokens, right, ends = encode([" " + t for t in own[lo:hi] if t], bpe, model)
                full[full] = right
                found = np.full(hi - lo, "", object)
                found[full] = [t.decode() for t in Aligned(tokens, ends).texts()]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.tolist(), pa.string())], names=[*part.schema.names, out])

    return common.map_in_arrow(base, run, T.StructType([*base.schema.fields, T.StructField(out, T.StringType())]))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
