"""Prefix tries of conversations, built from adaptive radix trees.

A turn's id is the MD5 of role and text: 16 bytes, big-endian, so a conversation's key is the ids of its turns one after the
other. Distinct keys, with their number of conversations, are dealt in ranges; a task puts a range's keys into an adaptive
radix tree (nodes of 4, 16, 48 or 256 children that grow as needed, with compressed paths) and yields a node of the trie at
each byte depth at which a turn ends. A prefix that occurs in several ranges is one of the first key of all but the first of
them, so a range needs to know only how many turns its first and last key share with its neighbours: such nodes come out
in parts, whose sums (members, children, leaves, saved tokens) are the whole node's, as what could be counted twice is
counted by the first range that has it alone. Nothing else is merged.

Cases: a NULL role or text is empty. Turns with the same number are ordered by role and text; a NULL number comes first. A
NULL conv_id names no conversation, and its rows are in none. A conversation without turns ends at the root. Repeated rows
are turns of their own. An empty table has no trie: no rows. Only the four columns named are read. A conversation's ids are
one value, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import _common as common

ID = 16
#: Keys of a range, about: they bound the memory of a task.
RANGE_BYTES = 8 << 20
#: Conversations of one key are first listed by so many consecutive ids.
LISTED = 4096
#: What is broadcast has so many bytes at most; larger sides are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of the tree: the bytes of its path after the parent's, what ends here, and children by their first byte.

    layout: the number of children that it has room for. With 4 and 16, ``bytes`` lists the children's first bytes in order;
    with 48, ``bytes`` has each byte's place among the children plus one; with 256, children are at their bytes."""

    __slots__ = ("path", "value", "layout", "bytes", "children")

    def __init__(self, path: bytes, value: int | None = None):
        self.path, self.value, self.layout, self.bytes, self.children = path, value, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            return self.children[self.bytes[byte] - 1] if self.bytes[byte] else None
        return self.children[byte]

    def put(self, child: Node) -> None:
        """Adds a child, or replaces that with the same first byte."""
        byte = child.path[0]
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if len(self.children) < self.layout:
                at = next((i for i, b in enumerate(self.bytes) if b > byte), len(self.bytes))
                self.bytes.insert(at, byte)
                self.children.insert(at, child)
                return
            self._grow()
            return self.put(child)
        if self.layout == 48:
            if self.bytes[byte]:
                self.children[self.bytes[byte] - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.bytes[byte] = len(self.children)
            else:
                self._grow()
                self.put(child)
            return
        self.children[byte] = child

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            places = bytearray(256)
            for i, b in enumerate(self.bytes):
                places[b] = i + 1
            self.layout, self.bytes = 48, places
        else:
            own: list = [None] * 256
            for child in self.children:
                own[child.path[0]] = child
            self.layout, self.bytes, self.children = 256, bytearray(), own

    def each(self) -> list[Node]:
        return [c for c in self.children if c is not None]


def insert(root: Node, key: bytes, value: int) -> None:
    """Adds a key that the tree doesn't have yet. The root's path is empty."""
    node, at = root, 0
    while at < len(key):
        child = node.child(key[at])
        if child is None:
            node.put(Node(key[at:], value))
            return
        path, rest = child.path, key[at : at + len(child.path)]
        if path != rest:
            same = next((i for i, (a, b) in enumerate(zip(path, rest)) if a != b), len(rest))
            middle = Node(path[:same])
            node.put(middle)
            child.path = path[same:]
            middle.put(child)
            child = middle
        at += len(child.path)
        node = child
    node.value = value


_NODES = {"id": pa.binary(), "parent": pa.binary(), "open": pa.bool_(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string()}


def turn_nodes(keys: list[bytes], times: list[int], low: list[int], words: list[list[int]], ends: list[str], before: int, after: int) -> dict[str, list]:
    """The trie's nodes that a range of distinct keys has, as columns of _NODES.

    before and after: how many turns the first key shares with the key before the range, the last one with that after it; -1
    where there is none. A node that other ranges have too is open, and so is a parent_conv_id that isn't known here."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    first, last = order[0], order[-1]
    root = Node(b"")
    for i in order:
        insert(root, keys[i], i)
    goes_on = after >= 0 and after * ID == len(keys[last])
    # Top down: each node with its parent's place and the byte depth of its end; bottom up, sums over what is below.
    found, parents, depth = [root], [-1], [0]
    for at, node in enumerate(found):
        for child in node.each():
            found.append(child)
            parents.append(at)
            depth.append(depth[at] + len(child.path))
    n = len(found)
    members, least, some, leaves, saved, kids = [0] * n, [None] * n, [None] * n, [0] * n, [0] * n, [0] * n
    has_first, has_last = [False] * n, [False] * n
    edges: list[list] = [[] for _ in range(n)]
    for at in range(n - 1, -1, -1):
        i, parent = found[at].value, parents[at]
        if i is not None:
            leaves[at] += members[at] == 0 and not (i == last and goes_on)
            members[at] += times[i]
            least[at] = low[i] if least[at] is None else min(least[at], low[i])
            some[at], has_first[at], has_last[at] = i, has_first[at] or i == first, has_last[at] or i == last
        above = depth[parent] if parent >= 0 else -1
        for d in range(depth[at] // ID, above // ID, -1):
            mine = not (has_first[at] and d <= before)
            w = words[some[at]][d - 1] if d else 0
            saved[at] += members[at] * w - (w if mine else 0)
            shared = not mine or (has_last[at] and d <= after)
            edges[at].append((d, shared, kids[at], saved[at], ends[i] if i is not None and d * ID == depth[at] else None))
            kids[at] = int(mine)
        if parent >= 0:
            members[parent] += members[at]
            least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])
            some[parent], has_first[parent], has_last[parent] = some[at], has_first[parent] or has_first[at], has_last[parent] or has_last[at]
            leaves[parent], saved[parent], kids[parent] = leaves[parent] + leaves[at], saved[parent] + saved[at], kids[parent] + kids[at]
    out: dict[str, list] = {k: [] for k in _NODES}
    reached: list = [None] * n  # (id, conv_id if known) of the last turn's end at or above each node
    for at in range(n):
        own = reached[parents[at]] if at else (None, None)
        for d, shared, children, total, end in reversed(edges[at]):
            key = keys[some[at]]
            name = hashlib.blake2b((own[0] or b"") + key[(d - 1) * ID : d * ID] if d else b"", digest_size=ID).digest()
            row = (name, own[0], shared, d, least[at], own[1], members[at], children, leaves[at], total, end)
            for k, x in zip(out, row, strict=True):
                out[k].append(x)
            own = (name, None if shared else least[at])
        reached[at] = own
    return out


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, t array<struct<i, id, w>>): the turns of each conversation in order, with their ids in hex and words.

    turns: conv_id, turn, role, text."""
    role, text = (F.coalesce(common.col(n), F.lit("")) for n in ("role", "text"))
    own = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    numbered = own.select("conv_id", place.alias("i"), name.alias("id"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("w"))
    return numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "id", "w"))).alias("t"))


def keyed(own: DataFrame) -> DataFrame:
    """(conv_id, key, words) of sequences."""
    ids = F.unhex(F.array_join(F.transform("t", lambda x: x.id), ""))
    return own.select("conv_id", ids.alias("key"), F.transform("t", lambda x: x.w).alias("words"))


def _distinct(convs: DataFrame) -> DataFrame:
    """(key, n, low, words, ends): each distinct key once, with the hash of its conversations' ids in ascending order.

    Ids are first joined in lists of neighbours; a key's lists then follow each other in one running hash, so that a key of
    very many conversations is neither a large task nor a large value."""
    listed = convs.groupBy("key", F.expr(f"conv_id div {LISTED} - if(conv_id % {LISTED} < 0, 1, 0)").alias("b")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("words").alias("words")
    )
    ordered = listed.repartition(common.parallelism(convs.sparkSession), "key").sortWithinPartitions("key", "b")
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("words", pa.list_(pa.int32())), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sha = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if held and held["key"] == row["key"]:
                    held["n"] += row["n"]
                    held["low"] = min(held["low"], row["low"])
                    sha.update(b",")
                else:
                    if held:
                        rows.append(held | {"ends": sha.hexdigest()})
                    held, sha = {k: row[k] for k in ("key", "n", "low", "words")}, hashlib.sha256()
                sha.update(row["ids"].encode())
            yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist([held | {"ends": sha.hexdigest()}], schema)

    return ordered.mapInArrow(run, "key binary, n long, low long, words array<int>, ends string")


def _neighbours(ranged: DataFrame) -> DataFrame:
    """(r, before, after): turns that the first and the last key of each range share with the ranges beside it. One row a
    range, of its two keys, goes through one task here."""
    edges = ranged.groupBy("r").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("r")
    beside = edges.select("r", "first", "last", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns(a: bytes | None, b: bytes | None) -> int:
            if a is None or b is None:
                return -1
            n = min(len(a), len(b))
            differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else np.zeros(0)
            return int(differ[0] if len(differ) else n) // ID

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"r": pa.array([x["r"] for x in rows], pa.int32()), "before": pa.array([turns(x["left"], x["first"]) for x in rows], pa.int32()), "after": pa.array([turns(x["last"], x["right"]) for x in rows], pa.int32())})

    return common.cut(beside.mapInArrow(run, "r int, before int, after int"))


def _bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows. df is fixed: counting it doesn't make it again."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def trie(convs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (of the ids that end there), and id and parent, 16 bytes each.

    convs: conv_id, key, words (the words of each turn)."""
    spark = convs.sparkSession
    distinct = common.cut(_distinct(convs))
    total = distinct.agg(F.sum(F.octet_length("key") + 4 * F.size("words") + 128)).first()[0] or 0
    ranges = max(common.parallelism(spark), -(-total // range_bytes))
    ranged = common.cut(distinct.repartitionByRange(ranges, "key").withColumn("r", F.spark_partition_id()))
    beside = _neighbours(ranged)

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(k).to_pylist() for k in ("key", "n", "low", "words", "ends")]
        found = turn_nodes(*columns, group.column("before")[0].as_py(), group.column("after")[0].as_py())
        return pa.table({k: pa.array(found[k], kind) for k, kind in _NODES.items()})

    schema = "id binary, parent binary, open boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
    parts = common.cut(ranged.join(_bounded(beside, 64), "r").groupBy("r").applyInArrow(run, schema))
    sums = [F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = common.cut(parts.filter("open").groupBy("id", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")))
    names = ["id", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    # A parent that several ranges have is known only now.
    whole = parts.filter("not open").select(*names, "parent_conv_id").unionByName(merged.select(*names, F.lit(None).cast("long").alias("parent_conv_id")))
    above = _bounded(merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("above")), 128)
    return whole.join(above, "parent", "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"), "id", "parent",
    )


def rebuilt(own: DataFrame, every: int = 20, at_most: int = 4) -> DataFrame:
    """Sequences whose first turns are those of another conversation: of c - c % every, the first crc32(c) % at_most. (The
    crc32 is of the decimal number.) What replaces them has as many turns, or all that there are, or none."""
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, at_most - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % at_most).cast("int")
    placed = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "n": n}).join(heads, "base", "left")
    none = F.slice("t", 1, 0)
    rest = F.slice(F.col("t"), F.col("n") + 1, F.greatest(F.size("t") - F.col("n"), F.lit(0)))
    return placed.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("n")), rest).alias("t"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = common.cut(sequences(common.table(spark, sf_dir, "conversations")))
    return trie(common.cut(keyed(rebuilt(own)))).drop("id", "parent")


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)
), turns AS (
  SELECT heads.c, 0 AS part, i, id, w FROM heads JOIN own ON own.c = heads.c - heads.c % 20 AND i <= h
  UNION ALL SELECT heads.c, 1, i, id, w FROM heads JOIN own ON own.c = heads.c AND i > h
), convs AS (
  SELECT heads.c, coalesce(t, []) AS t, coalesce(ws, []) AS ws
  FROM heads LEFT JOIN (SELECT c, list(id ORDER BY part, i) AS t, list(w ORDER BY part, i) AS ws FROM turns GROUP BY c) USING (c)
), prefixes AS (
  SELECT c, d, t[1:d] AS p, len(t) = d AS whole, coalesce(ws[d], 0) AS w FROM (SELECT *, unnest(generate_series(0, len(t))) AS d FROM convs)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(c, ',' ORDER BY c) FILTER (whole), '') AS ends FROM prefixes GROUP BY p, d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
  SELECT p[1:e] AS p, sum((n - 1) * w) AS saved, sum(leaf) AS leaves
  FROM (SELECT nodes.*, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, unnest(generate_series(0, d)) AS e FROM nodes LEFT JOIN children USING (p))
  GROUP BY 1
)
SELECT nodes.conv_id, nodes.d AS depth, above.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes LEFT JOIN children USING (p) JOIN below USING (p) LEFT JOIN nodes AS above ON nodes.d > 0 AND above.p = nodes.p[1:nodes.d - 1]
"""
