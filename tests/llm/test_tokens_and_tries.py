import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import _subwords as sub
from furlong.llm import align, idfiles, trie
from furlong.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SIGNS = [" ", "  ", "\n", "\t", "'", "s", "re", "ll", "x", "Z", "1", "٣", "é", "日", "本", "　", "\xa0", ".", "!?", "𝔘", "՘", "\0", "<|endoftext|>", "'s", "don't", "²", "\r\n", "​", "😀"]
ROWS = [
    (1, "Some words, and MORE words!"), (2, "Some words, and MORE words!"), (3, None), (4, ""), (5, " \n\t "), (None, "no id"), (6, "a▁b is read as a space"), (1, "Some words, and MORE words!"),
    (7, "word " * 900 + "<|endoftext|> " + "x" * 700 + "日本語" * 90), (8, "<|endoftext|>"), (9, "'s it's ''s  'll"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """NULLs, empty and long texts, repeated rows, special tokens in texts, and columns named as the operators' own."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit("own").alias(n) for n in ("id", "k", "at", "block", "n_a", "n", "start", "n_tokens", "place", "ids", "a`b", "groups_sha256")))


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(1, 30))) for _ in range(n)]


def test_ids_of_slices_are_the_libraries_own():
    texts = [t for _, t in ROWS if t] + odd_texts(3000)
    joined = sub.Slice([" " + t for t in texts])
    for tokenizer, alone in ((a := sub.byte_level(align.BPE, True), lambda t: a.alone(" " + t)), (b := sub.pieces(align.PIECES), b.alone)):
        ids, count, right = joined.encode(tokenizer)
        at = np.cumsum(count) - count
        for i, t in enumerate(texts):
            want = alone(t)
            same = b"".join(tokenizer.tokens[x] for x in want) == (" " + t).encode()
            assert right[i] == same and (not same or ids[at[i] : at[i] + count[i]].tolist() == want), t


def test_every_kind_of_character_is_classed_as_the_library_does():
    tokenizer, points = sub.byte_level(align.BPE, True), [*range(0xD800), *range(0xE000, 0x30000)]
    texts = [f"a{chr(p)}b 1{chr(p)}2 {chr(p)}.{chr(p)}! '{chr(p)}" for p in points[:: 7]]
    joined = sub.Slice(texts)
    begins = np.flatnonzero(tokenizer.starts(joined.points, joined.first)).tolist()
    whole = "".join(texts)
    cuts = [whole[a:z] for a, z in zip(begins, [*begins[1:], len(whole)], strict=True)]
    assert cuts == [t[a:z] for t in texts for _, (a, z) in tokenizer.tokenizer.pre_tokenizer.pre_tokenize_str(t)]


def aligned_by_brute_force(rows):
    a_, b_ = sub.byte_level(align.BPE, True), sub.pieces(align.PIECES)
    found, held = [], collections.Counter()
    for k, t in rows:
        groups = []
        if t:
            a, b, full = a_.alone(" " + t), b_.alone(t), (" " + t).encode()
            if b"".join(a_.tokens[i] for i in a) == full == b"".join(b_.tokens[i] for i in b):
                i = j = x = y = 0
                own = ([], [])
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        own[0].append(a[i])
                        x, i = x + len(a_.tokens[a[i]]), i + 1
                    else:
                        own[1].append(b[j])
                        y, j = y + len(b_.tokens[b[j]]), j + 1
                    if x == y:
                        groups.append(own)
                        own = ([], [])
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        found.append((k, groups, links))
    most = collections.Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for k, groups, links in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((k, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_by_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, SF).select(COLUMNS).collect()), key=str)
    assert got == aligned_by_brute_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_alignment_of_long_documents_in_fragments(spark, docs):
    """Chunks that are short or have no place to be cut, trees of several rounds, small blocks, products above the limit."""
    rows = [*ROWS, *enumerate(odd_texts(60, 5), 100)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string"))
    want = aligned_by_brute_force(rows)
    for chunk, entries, fan in ((20, 50, 2), (300, 4000, 3)):
        assert sorted((tuple(r) for r in align.align(df, chunk=chunk, entries=entries, fan=fan).select(COLUMNS).collect()), key=str) == want
    assert align.align(docs).count() == len(ROWS) and align.align(docs.limit(0)).count() == 0
    shown = align.groups(docs).collect()
    assert len(shown) == len(ROWS) and {r["a`b"] for r in shown} == {"own"}
    assert {(hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in shown} <= {w[-1] for w in want}


def test_large_groups_are_linked_by_distinct_ids(monkeypatch):
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 9, 40).astype(np.int32), draw.integers(0, 7, 30).astype(np.int32)
    tokens = align.Tokens(a, np.append(np.arange(2, 80, 2), 200), b, np.append(np.arange(1, 59, 2), 200))
    links = []
    for product in (10, 4096):
        monkeypatch.setattr(align, "PRODUCT", product)
        found = align.Aligned(tokens, np.array([200]))
        assert [int(x[0]) for x in found.figures()] == [40, 30, 1, 1200]
        links.append(sorted((d, p, n) for x in found.pairs() for d, p, n in zip(*map(np.ndarray.tolist, x), strict=True)))
    assert links[0] == links[1] and sum(n for _, _, n in links[0]) == 1200


def test_fragments_are_a_monoid():
    """Any cutting of two streams of tokens into byte ranges, composed in any order, gives the groups of the whole."""
    draw = random.Random(6)
    show = lambda parts: [(t.a.tolist(), t.b.tolist()) for _, t in parts]
    for _ in range(300):
        size = draw.randrange(1, 40)
        ends = [np.array(sorted({*draw.sample(range(1, size + 1), draw.randrange(size)), size})) for _ in range(2)]
        whole = align.Tokens(np.arange(len(ends[0])), ends[0], np.arange(len(ends[1])), ends[1])
        cuts = [0, *sorted(draw.sample(range(1, size), draw.randrange(size))), size]
        leaves = [align.fragment(lo, whole.between(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        while len(leaves) > 1:
            i = draw.randrange(len(leaves) - 1)
            leaves[i : i + 2] = [align.compose(leaves[i], leaves[i + 1])]
        flat = lambda parts: summed([t for _, t in parts])
        got = align.whole(leaves[0])
        places = [p for p, _ in got]
        assert places == sorted(places) and len(set(places)) == len(places)
        joined = flat(got)
        assert (joined.a.tolist(), joined.b.tolist()) == (whole.a.tolist(), whole.b.tolist())
        bounds = set(whole.cuts().tolist())
        assert all({int(t.a_ends[-1]), int(t.b_ends[-1])} <= bounds and t.a_ends[-1] == t.b_ends[-1] for _, t in got), show(got)
        none = align.Fragment(0, False, align.NO_TOKENS, align.NO_TOKENS, [])
        assert show(align.whole(align.compose(none, leaves[0]))) == show(got) == show(align.whole(align.compose(leaves[0], none)))


def summed(parts):
    out = align.NO_TOKENS
    for p in parts:
        out = out + p
    return out


def files_by_brute_force(rows):
    tokenizer, at, out, flat = sub.byte_level(idfiles.BPE, False), 0, [], []
    for k, t in rows:
        ids = [*tokenizer.alone(t or ""), idfiles.END]
        out.append((k, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
        flat += ids
    return out, flat


def test_token_files_query_by_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == files_by_brute_force(rows)[0]


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, docs, tmp_path, bits):
    folder = f"file://{tmp_path}/ids"
    listed = idfiles.write(docs, folder, block=64, bits=bits, file_bytes=2000)
    assert listed.count() > 1 and not [p for p in (tmp_path / "ids").iterdir() if p.name.endswith(".tmp")]
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want, flat = files_by_brute_force(rows)
    got = idfiles.read(spark, folder).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got] == want
    for start, n in ((0, 3), (60, 70), (len(flat) - 2, 9), (len(flat), 1), (10, 0)):
        assert idfiles.read_range(spark, folder, start, n) == flat[start : start + n]
    empty = f"file://{tmp_path}/none"
    assert idfiles.write(docs.limit(0), empty).count() == 0 and idfiles.read(spark, empty).count() == 0


def test_planes_round_trip():
    for ids in (np.zeros(0, np.int64), np.array([0, 1, 255, 256, 65535, 65536, 2**32 - 1]), np.arange(1000) * 37):
        for bits in (False, True):
            planes = idfiles.to_planes(ids, bits)
            assert len(planes) == (32 if bits else 4)
            assert idfiles.from_planes([p if p.strip(b"\0") else b"" for p in planes], len(ids)).tolist() == ids.tolist()


def test_radix_nodes_grow_and_find_their_keys():
    draw = random.Random(3)
    keys = list({bytes(draw.choice((0, 1, 255, draw.randrange(256))) for _ in range(16 * draw.randrange(4))) for _ in range(900)})
    draw.shuffle(keys)
    root = trie.Node(b"")
    for i, k in enumerate(keys):
        trie.insert(root, k, i)
    layouts, seen, stack = set(), {}, [(root, b"")]
    while stack:
        node, path = stack.pop()
        layouts.add(node.layout)
        assert node.value is not None or len(node.each()) > 1 or node is root
        if node.value is not None:
            seen[path] = node.value
        for c in node.each():
            assert node.child(c.path[0]) is c
            stack.append((c, path + c.path))
    assert layouts == {4, 16, 48, 256} and seen == {k: i for i, k in enumerate(keys)}


def trie_by_brute_force(rows):
    by, base = collections.defaultdict(list), {}
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in by:
        by[c] = [(r, t) for _, _, r, t in sorted(by[c])]
    for c in by:
        h = zlib.crc32(str(c).encode()) % 4
        base[c] = by.get(c - c % 20, [])[:h] + by[c][h:]
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, t in base.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                children[tuple(t[: d - 1])].add(tuple(t[:d]))
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(base[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in under if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_by_brute_force(spark):
    """Shared beginnings, copies, conversations that end inside others, empty ones, NULLs, repeats; in one range and in many."""
    draw = random.Random(8)
    rows = [(c, i, draw.choice(("user", None)), draw.choice(("a b", "c", None, "d e f"))) for c in range(120) for i in range(draw.randrange(6))]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (None, 0, "user", "x"), (1019, 0, "user", "a b"), *((2000 + c, i, "user", "same words here") for c in range(30) for i in range(5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("own")).withColumn("key", F.lit(1))
    want = trie_by_brute_force(rows)
    convs = trie.keyed(trie.rebuilt(trie.sequences(df)))
    for range_bytes in (1 << 20, 300):
        got = trie.trie(convs, range_bytes).drop("id", "parent").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert trie.trie(trie.keyed(trie.sequences(df.limit(0)))).count() == 0


def test_trie_parts_of_one_range_each_add_up(spark):
    """Every key a range of its own: all that is shared comes out in parts."""
    draw = random.Random(9)
    ids = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    keys = sorted({b"".join(draw.choice(ids) for _ in range(draw.randrange(6))) for _ in range(60)})
    words = lambda k: [k[i] % 5 for i in range(0, len(k), 16)]
    rows = [(i, k, words(k)) for i, k in enumerate(keys)]
    one = trie.turn_nodes(keys, [1] * len(keys), list(range(len(keys))), [w for _, _, w in rows], [""] * len(keys), -1, -1)
    sums = collections.defaultdict(lambda: [0, 0, 0, 0])
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) // 16
    for i, (c, k, w) in enumerate(rows):
        part = trie.turn_nodes([k], [1], [c], [w], [""], shared(keys[i - 1], k) if i else -1, shared(k, keys[i + 1]) if i + 1 < len(keys) else -1)
        for j, name in enumerate(part["id"]):
            for m, column in enumerate(("n_convs", "n_children", "n_leaves", "saved_tokens")):
                sums[name][m] += part[column][j]
    assert dict(sums) == {name: [one[c][j] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")] for j, name in enumerate(one["id"])}
