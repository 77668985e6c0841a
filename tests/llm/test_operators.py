import collections
import functools
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furlong.llm import _blocks as blk
from furlong.llm import bpe, chat, decontaminate, fingerprint, jaccard, katz, language, quality, sharding, substring
from furlong.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(WORDS)
ROWS = [
    (1, LONG), (2, LONG), (3, LONG + " end"), (4, None), (5, ""), (6, "  \n\t"), (7, "Two words"), (8, "two WORDS"), (None, LONG), (9, "x " * 3000),
    (10, "é ü ' <|endoftext|> \\ </turn>"), (7, "Two words"), (11, " ".join(WORDS[:30]) + " " + " ".join(f"v{i}" for i in range(30))),
]


@pytest.fixture(scope="module")
def docs(spark):
    """NULLs, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("score"), F.lit(2).alias("shard"), F.lit(3).alias("kept"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert mine == sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()))


def test_jaccard(docs, none):
    got = collections.defaultdict(list)
    for r in jaccard.join(docs).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id))
    assert got[2] == [(56, 1)] and got[3] == [(57, 1)] and got[11] == [(56, 11)]
    assert got[4] == [(0, 4)] and got[6] == [(0, 6)] and got[8] == [(1, 7)] and got[7] == [(1, 7)] * 2
    assert got[None] == [(56, None)]
    assert jaccard.join(none).count() == 0


def test_jaccard_small_and_large_sets_by_brute_force(spark):
    """Families around the boundary of light and heavy sets, with edits that straddle the threshold."""
    rows = []
    for n in (5, 6, 9, 12, 14, 18, 25, 40):
        base = [f"a{n}x{i}" for i in range(n + 4)]
        rows += [base, base[:-1], base[:-2], base[1:], [*base, "z"], ["q", *base[1:]], base[:-3], base[2:]]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    sets = [{tuple(r[i : i + 5]) for i in range(max(1, len(r) - 4))} for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == {i: find(i) for i in range(len(rows))}


def test_jaccard_light_lists_hold_no_false_links(spark, monkeypatch):
    """Sets of one light size that share just enough for a link with a smaller one, but not with each other."""
    monkeypatch.setattr(jaccard, "boundary", lambda *_: 8)
    rows = ["a b c d e f g h x", "a b c d e f g h y"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == {0: 0, 1: 1}
    more = [*rows, "a b c d e f g h"]  # links with both
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == {0: 0, 1: 0, 2: 0}


def test_language(spark, none, docs):
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    dictionaries = language.fit(docs.filter("doc_id < 4"))
    got = {(r.doc_id, r.text): r for r in language.predict(docs, dictionaries).collect()}
    assert got[(4, None)].lang_pred == got[(6, "  \n\t")].lang_best == "und" and got[(1, LONG)].lang_best == "en"
    assert language.predict(docs, {}).filter("lang_pred <> 'und'").count() == 0
    assert language.fit(none) == {} and language.predict(none, dictionaries).count() == 0


def test_language_by_compressing_afresh(spark):
    """Every text against every dictionary, in blocks, with compressors made for each."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    teach = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").select("doc_id", "text", "lang")
    dictionaries = language.fit(teach)
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    parameters = zstandard.ZstdCompressionParameters.from_level(5, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in docs.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        raw = r.text.lower().encode()
        sizes = {}
        for name, own in dictionaries.items():
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
            sizes[name] = sum(len(coder.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        least = min(sizes.values())
        assert sizes[g.lang_pred] == least
        assert g.score == pytest.approx(1 / sum(math.exp(-min((x - least) * 8 / math.sqrt(len(raw)), 500)) for x in sizes.values()))


def test_quality_margins_equal_the_sum_over_pairs():
    draw = np.random.default_rng(3)
    m = quality.Machine(0.3, draw.normal(0, 0.3, quality.SLOTS), draw.normal(0, 0.3, (quality.SLOTS, quality.RANK)))
    texts = pa.array(["Some words, some MORE words! 12", None, "", "a b c " * 30], pa.string())
    for lo, hi, row, slot, value in quality.features(texts, np.array([31.0, np.nan, 0.0, 180.0])):
        for i, z in enumerate(quality.margins(m, hi - lo, row, slot, value)):
            own = list(zip(slot[row == i], value[row == i]))
            want = m.bias + sum(m.weights[a] * x for a, x in own)
            want += sum(m.factors[a] @ m.factors[b] * x * y for k, (a, x) in enumerate(own) for b, y in own[:k])
            assert z == pytest.approx(want)


def test_quality(spark, none, docs):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    machine = quality.fit(docs.withColumn("quality", (F.col("doc_id") % 2).cast("int")))
    rows = quality.score(docs, machine).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, machine).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(none.withColumn("quality", F.lit(1)))).collect()} == {0.5}
    few = quality.fit(docs.unionByName(docs).withColumn("quality", (F.col("doc_id") % 2).cast("int")), rows=2)
    assert quality.score(docs, few).count() == docs.count()


def test_substring(docs, none):
    got = collections.defaultdict(list)
    for r in substring.dedup(docs).collect():
        got[r.doc_id].append(r)
    assert got[1][0].n_removed == 0 and got[1][0].kept == LONG
    assert got[2][0].n_removed == 60 and got[2][0].kept == "" and [tuple(s) for s in got[2][0].removed] == [(0, 60)]
    assert got[3][0].kept == "end" and got[11][0].n_removed == 30 and got[None][0].n_removed == 60
    assert got[4][0].n_words == 0 and got[9][0].n_removed == 2999 and got[7][0].n_removed == 0
    assert substring.dedup(none).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_against_brute_force(spark, docs, none, monkeypatch, order):
    """With many small blocks, so that some n-grams are one block's own, and with one."""
    trains = F.coalesce(F.col("doc_id") != 3, F.lit(True))
    tok = lambda t: [*low(t).encode().split(), b"\0end"]
    grams = [collections.Counter() for _ in range(order)]
    seen = lambda x: (*[b"\0begin"] * (order - 1), *x)
    for k, t in ROWS:
        if k != 3:
            x = seen(tok(t))
            for i in range(order - 1, len(x)):
                for n in range(order):
                    grams[n][x[i - n : i + 1]] += 1
    after = [collections.defaultdict(dict) for _ in grams]
    for n, own in enumerate(grams):
        for g, c in own.items():
            after[n][g[:-1]][g[-1]] = c
    d = [katz.discounts([collections.Counter(own.values())[i] for i in range(1, 7)]) for own in grams]
    f = lambda n, c: d[n][c] if c <= 5 else 1.0
    total = sum(grams[0].values())
    unknown = sum((1 - f(0, v)) * v for v in grams[0].values()) / total

    @functools.lru_cache(None)
    def left(h):
        n, follow = len(h), after[len(h)][h]
        all_of, freed = sum(follow.values()), sum((1 - f(n, v)) * v for v in follow.values())
        all_of, mass = (all_of, freed / all_of) if freed else (all_of + 1, 1 / (all_of + 1))
        return all_of, mass / (1 - sum(p(w, h[1:]) for w in follow))

    def p(w, h):
        n = len(h)
        if not n:
            return f(0, grams[0][w,]) * grams[0][w,] / total if grams[0][w,] else unknown
        if h not in after[n]:
            return p(w, h[1:])
        c = grams[n][(*h, w)]
        return f(n, c) * c / left(h)[0] if c else left(h)[1] * p(w, h[1:])

    for h in [*after[-1], (b"never",) * (order - 1)]:
        assert sum(p(w, h) for (w,) in grams[0]) + p(b"\0unknown", h) == pytest.approx(1)
    for block_bytes in (200, 1 << 22):
        monkeypatch.setattr(blk.pack, "__defaults__", (block_bytes, 1000))
        for r in katz.score(docs, trains, order=order).collect():
            x = seen(tok(r.text))
            want = sum(math.log10(p(x[i], x[i - order + 1 : i])) for i in range(order - 1, len(x)))
            assert r.score == pytest.approx(want, abs=1e-8)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x) - order + 1, sum(grams[0][w,] > 0 for w in x[order - 1 :]), total)
    if order == 3:
        assert katz.score(none, F.lit(True)).count() == 0
        assert {r.score for r in katz.score(docs, F.lit(False)).collect()} == {0.0}


def test_chat_branches(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "<good> \\l", 5.0), ("t", 4, 3, "user", None, 1.0), (None, 9, 77, None, "lost", None)]
    m = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    got = {r.tree: r for r in chat.format_trees(m).select("*", chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.turns(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in got["t"].turns] == [("user", "hi"), ("assistant", "<good> \\l"), ("user", "")]
    assert got["t"].loss == "<good> \\l" and got["t"].leaf == 4 and [tuple(t) for t in got[None].turns] == [("", "lost")]
    assert chat.format_trees(m, top=2).filter("tree = 't'").count() == 2 and chat.format_trees(m.limit(0)).count() == 0


def test_chat_cycles_give_no_path(spark):
    """A bare cycle, a leaf and a chain that hang on one, a message that answers itself, beside a tree and a deep chain."""
    links = [(1, 2), (2, 1), (3, 1), (4, 3), (5, 5), (6, None), (7, 6), (8, 6), *((i, i - 1 if i > 100 else None) for i in range(100, 150))]
    m = spark.createDataFrame([("t", i, p, "user", f"m{i}", float(i)) for i, p in links], "tree string, id long, parent long, role string, text string, score double")
    assert sorted((r.leaf, r.id, r.up) for r in chat.paths(m).collect()) == sorted([(7, 7, 0), (7, 6, 1), (8, 8, 0), (8, 6, 1), *((149, i, 149 - i) for i in range(100, 150))])
    assert chat.paths(m.filter("id < 3")).count() == 0 and chat.paths(m.filter("id < 6")).count() == 0
    best = chat.format_trees(m, top=9).orderBy("rank").collect()
    assert [(r.leaf, r.n_messages) for r in best] == [(149, 50), (8, 2), (7, 2)]


def test_bpe(docs, none):
    long = ("word " * 40000 + "x" * 3000 + "  \n 12").strip()
    assert "".join(bpe.pieces(long)) == long and len(bpe.pieces(long)) > 2
    encoder = bpe.encoding()
    assert [i for p in bpe.pieces(long) for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(long)
    once = {(r.doc_id, r.text): r for r in bpe.encode(docs, decoded="back").collect()}
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert (once[r.doc_id, r.text].token_ids, once[r.doc_id, r.text].back) == (r.token_ids, r.decoded)
        assert r.token_ids == encoder.encode_ordinary(r.text or "") and r.decoded == (r.text or "").encode()
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_bpe_query_digests(spark):
    encoder, texts = bpe.encoding(), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_sharding(docs, none):
    rows = sharding.shuffle(docs, 3, seed=1, bucket_bytes=2000).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shuffle(docs, 3, seed=1, bucket_bytes=2000).collect()))
    assert sharding.shuffle(none, 3).count() == 0


def test_sharding_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 20, raising=False)
    rows = [(i, f"text {i}", float(i)) for i in range(60)] + [(7, "same", 0.0)] * 9 + [(7, "same", -0.0)] * 5 + [(8, None, float("nan"))] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, x double")
    found = []
    for layout in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("doc_id")), df.repartition(3, "text")):
        out = sharding.shuffle(layout, 3, seed=1, bucket_bytes=900).collect()
        assert sorted(str(tuple(r)[:3]) for r in out) == sorted(map(str, rows))
        assert sorted(r.slot * 3 + r.shard for r in out) == list(range(len(rows)))
        found.append(sorted(map(str, out)))
    assert all(f == found[0] for f in found)


def test_sharding_query_and_files(spark, tmp_path):
    """The query's columns from the documents alone, and files whose rows stand in the order of their slots."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_sharding"](spark, SF).collect()
    by = collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == sorted(texts) and set(by) == set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    mixed = sharding.shuffle(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), 3, seed=2, bucket_bytes=50_000)
    sharding.write(mixed, str(tmp_path / "shards"))
    for k in range(3):
        slots = [r.slot for f in sorted((tmp_path / f"shards/shard={k}").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(WORDS[5:25])), (2, "TWO words"), (3, None), (1, " ".join(WORDS[5:25])), (4, "")], "item_id long, text string")
    got = collections.defaultdict(list)
    for r in decontaminate.judge(docs, bench).collect():
        got[r.doc_id].append((r.n_words, r.n_hit, r["items"], r.contaminated))
    assert got[1] == [(60, 20, ["1"], True)] and got[7] == [(2, 2, ["2"], True)] * 2 and got[8] == got[7][:1]
    assert got[4] == [(0, 0, [], False)] and got[None] == got[1] and got[9][0][1] == 0
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [4, 5, 6, 9, 10]
    assert decontaminate.judge(none, bench).count() == 0 and decontaminate.judge(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.proximity(docs, bench).filter("doc_id = 1").count() == 1


def brute_hits(text, items, width=13):
    """{item: spans of the text's words that windows of the item cover}, by comparing everything."""
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    out = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        n = min(width, len(w))
        wanted = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()
        found = {(a, a + n) for a in range(len(own) - n + 1) if tuple(own[a : a + n]) in wanted}
        if found:
            out[i] = out.get(i, set()) | found
    return out, len(own)


def test_decontaminate_against_brute_force(spark):
    """Long, short and repetitive items and texts, items partly at the ends of a text, and repeated rows."""
    draw = random.Random(4)
    some = lambda n, m: " ".join(f"t{draw.randrange(m)}" for _ in range(n))
    items = [(1, some(300, 40)), (2, "a " * 40), (3, some(13, 9)), (4, "t1 t2"), (5, some(20, 500)), (6, "a b " * 20), (7, None)]
    texts = [some(200, 40) + " " + " ".join(items[0][1].split()[100:130]), "a " * 500, "b a " * 60, some(400, 9), " ".join(items[4][1].split()[5:]) + " x", "x T1, t2", None, "", " ".join(items[0][1].split()[:14])]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    index = decontaminate.prepared(docs, bench)
    found = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in decontaminate.matches(docs, bench, index=index).collect():
        found[r.doc_id][r.item_id].add((r.start, r.end))
    judged = {r.doc_id: r for r in decontaminate.judge(docs, bench).collect()}
    assert decontaminate.judge(docs, bench).count() == len(texts) + 1
    for i, t in enumerate(texts):
        want, n = brute_hits(t, items)
        assert {k: v for k, v in found[i].items()} == want
        hit = len({p for spans in want.values() for a, b in spans for p in range(a, b)})
        r = judged[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, hit, sorted(map(str, want)), hit > 0 and 20 * hit >= n)


def test_decontaminate_repetitive_texts_cost_their_length(spark):
    """100,000 equal words against 1,000 of them, and periods of two and three: seconds, where all alignments by all windows
    would be 10^9 comparisons. Items that share windows, and one without an id, are all named."""
    items = [(1, "a " * 1000), (2, "b c " * 500), (3, "a " * 14), (4, "x y z " * 300), (None, "a " * 13), (5, "b " * 3 + "c")]
    texts = ["a " * 100_000, "c b " * 20_000, "y z x " * 10_000 + "a " * 12, "a " * 12 + "q", None]
    docs, bench = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    index = decontaminate.prepared(docs, bench)
    assert decontaminate._ranges(index, 13).agg(F.max(F.size("ranges"))).first()[0] == 1
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.judge(docs, bench).collect()}
    assert got[0] == (100_000, 100_000, ["1", "3", None], True) and got[1] == (40_000, 40_000, ["2"], True)
    assert got[2] == (30_012, 30_000, ["4"], True) and got[3] == (13, 0, [], False) and got[4] == (0, 0, [], False)
    assert decontaminate.matches(docs, bench, index=index).filter("doc_id = 1").count() == 40_000 - 12


def test_proximity_is_within_slack_and_one_window(spark):
    short, long = [f"i{i}" for i in range(13)], [f"j{i}" for i in range(26)]
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    common = " ".join([*short[3:], *(w for i, w in enumerate(long) if i not in (0, 12, 25))])
    at = lambda **places: " ".join({p: w for w, p in places.items()}.get(p, "f") for p in range(40))
    # Shifts of 0, 4 and 7; of 0, 1 and 3; three rare terms of which no window has all.
    texts = [(1, at(i0=0, i1=5, i2=9)), (2, at(i0=0, i1=2, i2=5)), (3, at(j0=0, j12=12, j25=25)), *((10 + i, common) for i in range(5))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = decontaminate.prepared(docs, bench)
    found = decontaminate.proximity(docs, bench, index=index)
    assert [(r.doc_id, r.item_id, r.shift, r.terms) for r in found.filter("doc_id < 10").collect()] == [(2, 1, 0, 3)]
    assert decontaminate.matches(docs, bench, index=index).count() == 0


def test_fingerprint(spark, docs, none):
    df = fingerprint.sketch(docs)
    a, b = (F.lit(x) for x in ([1, 2, 3], [2, 3, 4]))
    one = spark.range(1).select(fingerprint.resemblance(a, b).alias("r"), fingerprint.containment(a, b).alias("c"), fingerprint.distinct_shingles(a).alias("n")).first()
    assert one.r == 0.5 and one.n == 3 and one.c == pytest.approx(2 / 3)
    by = {(r.doc_id, r.text): r.sketch for r in df.collect()}
    assert by[(4, None)] == by[(5, "")] == by[(6, "  \n\t")] == [] and by[(1, LONG)] == by[(2, LONG)] and by[(7, "Two words")] == by[(8, "two WORDS")]
    assert fingerprint.merge_groups(df.withColumn("g", F.lit(1)), ["g"]).count() == 1 and fingerprint.sketch(none).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    want = {}
    for i, (k, t) in enumerate(rows):
        m = len(t) // 3
        want[k] = hashlib.sha256((t[: len(t) - m] + rows[(i + 1) % len(rows)][1][:m]).encode()).hexdigest()
    got = QUERIES["op10_fingerprint"](spark, SF).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want and all(0 <= r.near_edited <= 1 for r in got)


def test_fingerprint_query_by_brute_force(spark):
    """Sketches from hashes of every shingle, and likeness from the sketches, with one function of Spark as the hash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy(F.desc("doc_id")).collect()]
    edited = {k: t[: len(t) - len(t) // 3] + rows[(i + 1) % len(rows)][1][: len(t) // 3] for i, (k, t) in enumerate(rows)}
    words = {w for t in [*dict(rows).values(), *edited.values()] for w in low(t).encode().split()}
    hashed = {bytes(r.w): r.h for r in spark.createDataFrame([(w.decode(), w) for w in words], "t string, w binary").select("w", F.xxhash64("t").alias("h")).collect()}
    grams = {tuple(hashed[w] for w in x[i : i + 5]) for t in [*dict(rows).values(), *edited.values()] if len(x := low(t).encode().split()) >= 5 for i in range(len(x) - 4)}
    of = {tuple(r)[:5]: r.g for r in spark.createDataFrame(list(grams), "a long, b long, c long, d long, e long").select("*", F.xxhash64("a", "b", "c", "d", "e").alias("g")).collect()}
    short = {b" ".join(x) for t in [*dict(rows).values(), *edited.values()] if 0 < len(x := low(t).encode().split()) < 5}
    few = {tuple(r.w): r.h for r in spark.createDataFrame([([hashed[w] for w in s.split()],) for s in short] or [([0],)], "w array<long>").select("w", F.xxhash64(F.array_join(F.col("w").cast("array<string>"), " ")).alias("h")).collect()}

    def sketch(t):
        x = tuple(hashed[w] for w in low(t).encode().split())
        return sorted({of[x[i : i + 5]] for i in range(len(x) - 4)} if len(x) >= 5 else {few[x]} if x else set())[:128]

    def like(a, b):
        union = sorted({*a, *b})[:128]
        return len({*a} & {*b} & {*union}) / len(union) if union else 1.0

    text = lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in s)
    own = {k: sketch(t) for k, t in rows}
    got = {r.doc_id: r for r in QUERIES["op10_fingerprint"](spark, SF).collect()}
    for i, (k, t) in enumerate(rows):
        r, e = got[k], sketch(edited[k])
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), text(own[k]), text(e))
        assert r.near_edited == pytest.approx(like(own[k], e)) and r.near_next == pytest.approx(like(own[k], own[rows[(i + 1) % len(rows)][0]]))


HOSTILE = ["_h", "_b", "_k", "_w", "_p", "_g", "_d", "_gone", "_text", "_trains", "trains", "block", "payload", "size", "own_score", "score", "predicted", "id", "mark", "place", "k", "h", "w", "c0", "t0", "a`b", "a.b c", "kept", "n_words", "removed", "n_removed", "shard", "slot", "token_ids", "decoded", "sketch", "n_tokens", "lang_pred", "rejected"]


@pytest.fixture(scope="module")
def hostile(docs):
    """The rows of docs, whole repeats included, with columns that have the names that operators use."""
    return docs.select("doc_id", "text", "n_chars", *(F.lit(f"own {n}").alias(n) for n in HOSTILE))


@pytest.mark.parametrize("name", ["language", "quality", "substring", "katz", "bpe", "sharding", "fingerprint", "one_of_each", "keep_clean", *range(4)])
def test_other_columns_are_carried_along(spark, hostile, none, name):
    bench = spark.createDataFrame([(1, "no such words"), (None, None)], "item_id long, text string")
    replaced, outputs = {
        "language": (lambda d: language.predict(d, {"en": b"w1 w2"}), ["lang_best", "lang_pred", "rejected", "score"]),
        "quality": (lambda d: quality.score(d, quality.Machine(0.0, np.zeros(quality.SLOTS), np.zeros((quality.SLOTS, quality.RANK)))), ["score", "predicted"]),
        "substring": (substring.dedup, ["n_words", "n_removed", "kept", "removed"]),
        "katz": (lambda d: katz.score(d, F.lit(True)), ["n_tokens", "n_known", "train_tokens", "base_score", "score"]),
        "bpe": (lambda d: bpe.decode(bpe.encode(d)), ["token_ids", "decoded"]),
        "sharding": (lambda d: sharding.shuffle(d, 3, bucket_bytes=5000), ["shard", "slot"]),
        "fingerprint": (fingerprint.sketch, ["sketch"]),
        "one_of_each": (jaccard.one_of_each, []), "keep_clean": (lambda d: decontaminate.keep_clean(d, bench), []),
    }.get(name) or (lambda d: __import__("corpus_pipeline").STAGES[name][1](spark, d, SF), [])
    out = replaced(hostile)
    if isinstance(name, int) or name in ("one_of_each", "keep_clean"):
        assert out.columns == hostile.columns
    rows = out.collect()
    for n in HOSTILE:
        if n not in outputs:
            assert {r[n] for r in rows} <= {f"own {n}"}, n
    ids = collections.Counter(r.doc_id for r in rows)
    if name in ("one_of_each", 1):
        assert ids == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1, 9: 1, 10: 1, 11: 1}
    elif name != 0:
        assert ids == collections.Counter(k for k, _ in ROWS)
    assert replaced(hostile.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a brute-force version over what came before it; the classifier's against the operator's scores."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
        old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        if name == "quality_classifier":
            scores = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
            assert set(new) == {i for i in old if scores[i].score >= 0.7} and all((scores[i].predicted == 1) == (scores[i].score >= 0.7) for i in old)
        if name == "ngram_jaccard_join":
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in old.items() if (w := low(t).encode().split())}
            root = {i: i for i in old}
            for i in sets:
                for j in sets:
                    if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = root[i], root[j]
                        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
            assert set(new) == {i for i, r in root.items() if i == r}
        if name == "substring_dedup":
            first, all_texts = {}, {i: t.encode().split() for i, t in sorted(old.items())}
            for i, w in all_texts.items():
                gone = set()
                for s in range(len(w) - 19):
                    if first.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                        gone |= set(range(s, s + 20))
                assert new[i].text == (b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else old[i])
        if name == "benchmark_decontamination":
            want = set()
            for i, t in old.items():
                found, n = brute_hits(t, items)
                hit = len({p for spans in found.values() for a, b in spans for p in range(a, b)})
                want |= set() if hit and 20 * hit >= n else {i}
            assert set(new) == want
        if name == "byte_bpe":
            assert {i: r.token_ids for i, r in new.items()} == {i: bpe.encoding().encode_ordinary(t) for i, t in old.items()}
            assert all(r.decoded_sha256 == hashlib.sha256(old[i].encode()).hexdigest() for i, r in new.items())


def test_results_do_not_depend_on_parts_or_blocks(spark, docs, monkeypatch):
    of = lambda: (sorted(map(str, jaccard.join(docs).collect())), sorted(map(str, substring.dedup(docs).select("doc_id", "kept", "removed").collect())))
    want = of()
    monkeypatch.setattr(blk.pack, "__defaults__", (300, 700))
    assert of() == want


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    from furlong.llm import _words, jaccard

    texts = pa.array(["", None, "A b " * 500, "x" * 300 + " y", " ", "one two three four five six"], pa.string())
    want = [s.tolist() for _, s in jaccard.sets(texts, 5)]
    monkeypatch.setattr(_words, "PIECE", 7)
    assert [s.tolist() for _, s in jaccard.sets(texts, 5)] == want


def test_signs_that_are_no_letters_have_no_language(spark):
    df = spark.createDataFrame([("\u00b2\u00bd \u2167",), ("12 _",), ("\u00aa",), ("\u65e5",)], "text string")
    assert [r.lang_best for r in language.predict(df, {"en": b"w1 w2"}).collect()] == ["und", "und", "en", "en"]


def test_chat_repeats_nan_and_missing_ids(spark):
    """Rows that come twice, messages that share an id, scores that are no numbers, messages without an id."""
    kind = "tree string, id long, parent long, role string, text string, score double"
    chain = [("t", i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(40)]
    m = spark.createDataFrame(chain * 3, kind)
    (r,) = chat.format_trees(m, top=9).collect()
    assert r.n_messages == 40 and r.formatted.count("<turn ") == 40
    shared = [("s", 1, None, "user", "b", 1.0), ("s", 1, None, "user", "a", 1.0), ("s", 1, None, "user", "0", 0.5), ("s", None, 1, "user", "lost", 9.0), ("s", 2, 1, "user", "nan", float("nan")), ("s", 3, 1, "user", "two", 0.5)]
    got = [x.formatted for x in chat.format_trees(spark.createDataFrame(shared, kind), top=9).orderBy("rank").collect()]
    assert got == ["<turn user>a</turn>\n<turn user>two</turn>\n", "<turn user>a</turn>\n<turn user>nan</turn>\n"]


def test_sharding_of_maps_and_variants(spark):
    rows = spark.createDataFrame([(1, {"a": 1}), (2, None), (1, {"a": 1}), (3, {})], "x int, m map<string, int>").withColumn("n", F.array(F.struct("m")))
    rows = rows.withColumn("v", F.parse_json(F.lit('{"a": [1, 2]}')))
    out = sharding.shuffle(rows, 2, seed=3)
    assert out.columns == [*rows.columns, "shard", "slot"]
    show = lambda df: sorted(str((r.x, r.m, r.n, r.j)) for r in df.select("x", "m", "n", F.to_json("v").alias("j")).collect())
    assert show(out) == show(rows) and sorted((r.shard, r.slot) for r in out.select("shard", "slot").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_fingerprints_of_groups_and_neighbours_with_any_names(spark, docs):
    df = fingerprint.sketch(docs).select("sketch", *(F.lit(1).alias(n) for n in ("_s", "salt", "a`b")))
    assert fingerprint.merge_groups(df, ["_s", "salt", "a`b"]).columns == ["_s", "salt", "a`b", "sketch"] and fingerprint.merge_groups(df, ["a`b"]).count() == 1
    own = spark.range(5).select("id", *(F.lit("own").alias(n) for n in ("_k", "_t", "_p", "_d", "_g")))
    out = fingerprint.with_next(own, "id", lambda rows, window, ghost: rows.withColumn("next", F.lead("id").over(window)), 2)
    assert {r.id: r.next for r in out.collect()} == {4: 3, 3: 2, 2: 1, 1: 0, 0: 4} and all(r["_g"] == "own" for r in out.collect()) and out.columns == [*own.columns, "next"]
