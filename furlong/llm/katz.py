"""Language-model scoring: a word n-gram model with Katz backoff, of any order (three by default).

Tokens of a text are its words (runs of other bytes than ASCII white space, A-Z lower-cased) and one end; before the first
token stands a begin sign. Counts come from all documents that ``trains`` marks. Good-Turing discounts apply to counts up to
five, by order; where counts of counts can't give them (small or odd corpora), discounts of n1/(n1+2*n2) in each count do.
The mass that discounts free goes, per history, to the words not seen after it, in proportion to the next lower order; that
of single words goes to one unknown word. So the probabilities of vocabulary, end and unknown sum to one for every history.
A history all of whose counts are above five gives up 1/(N+1).

The tables of counts are partitioned by hashes of the history; the few histories that make up a 500th of all tokens or more
are dealt by the whole n-gram. Blocks of documents ask for what their own distinct n-grams need (see _blocks), one order
after the other. An answer tells too whether any other block has asked for the same n-gram: if none has, all there is to
know of it as a history is in the block itself, and isn't sent. Backoff weights are sent for histories that the block has an
unseen n-gram of; the others' counts are those of the lower order. Then every token is evaluated recursively: an n-gram that
was seen by its discounted count, another by the backoff weight of its history times the lower order.

Cases: NULL and empty texts have one token, the end. With no training text every token has probability one (score 0).
Repeated rows count as often as they occur. Ids aren't used. Further columns are carried along, whatever their names; only
the outputs' names are replaced. N-grams count as equal by a hash: 56 bits and the part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import _blocks as blk
from furlong.llm import _common as common
from furlong.llm._words import Words, mix, slices

ORDER = 3
GOOD_TURING = 5
#: A history is dealt by the n-gram from this share of all tokens on.
HOT = 1 / 500
BEGIN, END, START = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA41B56C4E9), np.uint64(0x1B56C4E9B5297A4D)
#: Bytes of a count or rank, and of a hash beside the part that it is in.
WIDE, KEY = 5, 7
#: What is known of a history: its count N, how many n-grams with it occur 1 to 5 times, and of those that occur at all the
#: lower order's counts: the sum of those above 5, and how many are 1 to 5.
SUMS = 2 * GOOD_TURING + 2
_REPLY = "block long, p int, blob binary, h long, sums array<double>"


def discounts(n: list[float]) -> np.ndarray:
    """Factors for counts 0 to 5 from the numbers of types that occur 1 to 6 times."""
    out = np.ones(GOOD_TURING + 1)
    if all(x > 0 for x in n[: GOOD_TURING + 1]):
        cut = (GOOD_TURING + 1) * n[GOOD_TURING] / n[0]
        if cut < 1:
            own = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) for r in range(1, GOOD_TURING + 1)]
            if all(0 < d < 1 for d in own):
                out[1:] = own
                return out
    share = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    out[1:] = [(r - share) / r for r in range(1, GOOD_TURING + 1)]
    return out


class Unigrams:
    """Probabilities of words by their counts."""

    def __init__(self, total: float, types: float, n: list[float]):
        self.total, self.types, self.factor = total, types, discounts(n)
        freed = sum((1 - self.factor[r]) * r * n[r - 1] for r in range(1, GOOD_TURING + 1))
        self.scale = 1.0 if freed > 0 or not total else total / (total + 1)
        self.unknown = 1.0 if not total else (freed / total if freed > 0 else 1 / (total + 1))

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.factor) * self.scale / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.types + 1)))


def discounted(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.where(count > GOOD_TURING, 1.0, factor[np.minimum(count, GOOD_TURING)]) * count


_R = np.arange(1, GOOD_TURING + 1)


def of_sums(sums: np.ndarray, factor: np.ndarray, lower_factor: np.ndarray) -> list[np.ndarray]:
    """Of histories by their sums: their count, what discounts free of it, and the lower order's discounted counts of what
    was seen after them."""
    return [sums[:, 0], sums[:, 1 : GOOD_TURING + 1] @ ((1 - factor[1:]) * _R), sums[:, GOOD_TURING + 1] + sums[:, GOOD_TURING + 2 :] @ (lower_factor[1:] * _R)]


def of_grams(group: np.ndarray, n: int, count: np.ndarray, lower: np.ndarray, factor: np.ndarray, lower_factor: np.ndarray) -> list[np.ndarray]:
    """The same of n histories from all their n-grams: the history of each, its count, and that of the lower order."""
    freed = np.where(count > GOOD_TURING, 0, (1 - factor[np.minimum(count, GOOD_TURING)]) * count)
    return [np.bincount(group, count, n), np.bincount(group, freed, n), np.bincount(group, np.where(count > 0, discounted(lower, lower_factor), 0), n)]


def sums_of(group: np.ndarray, n: int, count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The sums (see SUMS) of n histories from all their n-grams."""
    out = np.zeros((n, SUMS))
    out[:, 0] = np.bincount(group, count, n)
    out[:, GOOD_TURING + 1] = np.bincount(group, np.where((count > 0) & (lower > GOOD_TURING), lower, 0), n)
    for r in range(1, GOOD_TURING + 1):
        out[:, r] = np.bincount(group, count == r, n)
        out[:, GOOD_TURING + 1 + r] = np.bincount(group, (count > 0) & (lower == r), n)
    return out


def shares(count: np.ndarray, freed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the discounted counts of each history are divided by, the mass that it leaves for other words)."""
    total = np.maximum(np.where(freed > 0, count, count + 1), 1)
    return total, np.where(freed > 0, freed, 1.0) / total


def _types(count: np.ndarray) -> np.ndarray:
    """How many of the counts are 1 to 6."""
    return np.bincount(np.minimum(count, GOOD_TURING + 2), minlength=GOOD_TURING + 3)[1 : GOOD_TURING + 2]


class Grams:
    """The distinct n-grams of one order in a block: which each token ends, and of each its history, last word and hash."""

    def __init__(self, at: np.ndarray, lead: np.ndarray, history: np.ndarray, word: np.ndarray, hashes: np.ndarray, learns: np.ndarray):
        self.at, self.lead, self.history, self.word, self.hashes = at, lead, history, word, hashes
        self.times = np.bincount(at, learns, len(lead)).astype(np.int64)
        self.count, self.only = np.zeros(len(lead), np.int64), np.zeros(len(lead), bool)


class Block:
    """The tokens of a block, and their n-grams as far as they have been answered."""

    def __init__(self, payload: bytes, text: str, trains: str, parts: int):
        self.rows, self.parts = blk.unpack(payload), parts
        words, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for lo, _, data, offsets in slices(self.rows.column(text)):
            w = Words(data, offsets, lower=True)
            words.append(w.hashes()), doc.append((lo + w.doc).astype(np.int32))
        words, doc, n = np.concatenate(words), np.concatenate(doc), self.rows.num_rows
        token = np.full(len(words) + n, END, np.uint64)
        token[np.arange(len(words)) + doc] = words
        self.ends = np.searchsorted(doc, np.arange(n), "right") + np.arange(n)
        del words, doc
        self.doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.ends, prepend=-1))
        self.first = np.zeros(len(token), bool)
        self.first[np.concatenate([[0], self.ends[:-1] + 1]) if n else []] = True
        self.learns = self.rows.column(trains).to_numpy().astype(bool)[self.doc] if n else np.zeros(0, bool)
        hashes, lead, at = np.unique(token, return_index=True, return_inverse=True)
        none = np.zeros(len(hashes), np.int64)
        self.grams = [Grams(at.astype(np.int32), lead, none, np.arange(len(hashes)), hashes, self.learns)]
        self.rank, self.part = none.copy(), (hashes % np.uint64(parts)).astype(np.int64)

    def deeper(self) -> Grams:
        """The n-grams of the next order. The history of a document's first token is one of its own."""
        low, words = self.grams[-1], self.grams[0]
        m, n = len(words.lead), len(low.lead)
        history = np.empty(len(low.at), np.int64)
        history[1:] = low.at[:-1]
        history[self.first] = n
        keys, lead, at = np.unique(history * m + words.at, return_index=True, return_inverse=True)
        own, word = keys // m if m else keys, keys % m if m else keys
        before = np.append(low.hashes, START if len(self.grams) > 1 else BEGIN)
        hashes = mix(before[own] * np.uint64(0x9E3779B97F4A7C15) + mix(words.hashes[word]) + np.uint64(len(self.grams)))
        self.grams.append(Grams(at.astype(np.int32), lead, own, word, hashes, self.learns))
        return self.grams[-1]

    def named(self, replies: list) -> None:
        """Takes in what is known of the words."""
        import zstandard

        g = self.grams[0]
        _, order, cuts = blk.split(g.hashes, self.parts)
        for a in replies or []:
            own = order[cuts[a["p"]] : cuts[a["p"] + 1]]
            raw, n = zstandard.decompress(a["blob"]), len(own)
            g.count[own], self.rank[own], g.only[own] = blk.from_planes(raw, n, WIDE), blk.from_planes(raw, n, WIDE, WIDE * n), blk.from_planes(raw, n, 1, 2 * WIDE * n) > 0

    def asked(self, hot_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the highest order: (the hashes of histories, which n-grams stay local, which are dealt by the n-gram, those that
        are asked for, in the order in which they are sent, where each part begins among them)."""
        g, low = self.grams[-1], self.grams[-2]
        hashes = np.append(low.hashes, START if len(self.grams) > 2 else BEGIN)
        local = np.append(low.only, False)[g.history]
        hot = np.append(low.count >= hot_from, True)[g.history]
        part = (np.where(hot, g.hashes, hashes[g.history]) % np.uint64(self.parts)).astype(np.int64)
        sent = np.flatnonzero(~local)
        sent = sent[np.argsort(part[sent], kind="stable")]
        return hashes, local, hot, sent, np.searchsorted(part[sent], np.arange(self.parts + 1))

    def lower(self) -> np.ndarray:
        """The lower order's count of each n-gram without its first word."""
        return self.grams[-2].count[self.grams[-2].at[self.grams[-1].lead]]

    def answered(self, replies: list, hot_from: float, learned: tuple | None = None) -> list[np.ndarray]:
        """Takes in what is known of the highest order. learned: the sums of hot histories, and the discounts of this and the
        lower order; with these, returns what of_sums has of each history."""
        import zstandard

        g = self.grams[-1]
        hashes, local, hot, sent, cuts = self.asked(hot_from)
        out = [np.zeros(len(hashes) if learned else 0) for _ in range(3)]
        g.count[local], g.only[local] = g.times[local], True
        for a in replies or []:
            own = sent[cuts[a["p"]] : cuts[a["p"] + 1]]
            n, raw = len(own), zstandard.decompress(a["blob"])
            g.count[own], g.only[own] = blk.from_planes(raw, n, WIDE), blk.from_planes(raw, n, 1, WIDE * n) > 0
            if learned:
                begin = own[np.flatnonzero(np.diff(g.history[own], prepend=-1))]
                h, m = g.history[begin], len(begin)
                flags = blk.from_planes(raw, m, 1, (WIDE + 1) * n)
                # A history's count is its own as an n-gram; without unseen ones all that matters is whether discounts free any.
                out[0][h], out[1][h] = np.append(self.grams[-2].count, 0)[h], (flags & np.uint64(1)).astype(float)
                told = h[flags > 1]
                k = len(told)
                sums = np.column_stack([blk.from_planes(raw, k, WIDE, (WIDE + 1) * n + m + j * WIDE * k) for j in range(SUMS)]).astype(float)
                for x, y in zip(out, of_sums(sums, *learned[1:]), strict=True):
                    x[told] = y
        if learned:
            inside = np.flatnonzero(local)
            which, group = np.unique(g.history[inside], return_inverse=True)
            for x, y in zip(out, of_grams(group, len(which), g.count[inside], self.lower()[inside], *learned[1:]), strict=True):
                x[which] = y
            warm = np.unique(g.history[hot & ~local])
            sums = np.array([learned[0].get(int(hashes[h] >> np.uint64(8)), np.zeros(SUMS)) for h in warm]).reshape(-1, SUMS)
            for x, y in zip(out, of_sums(sums, *learned[1:]), strict=True):
                x[warm] = y
        return out


def _ask_words(text: str, trains: str):
    def ask(block: dict, parts: int):
        g = Block(block["payload"], text, trains, parts).grams[0]
        _, order, cuts = blk.split(g.hashes, parts)
        for p in range(parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                yield p, len(own).to_bytes(4, "little") + blk.zip_bytes(blk.planes(g.hashes[own] >> np.uint64(8), KEY) + blk.planes(g.times[own], WIDE))

    return ask


def _reply(block: list[int], p: int, blobs: list[bytes], sums: list[tuple[int, np.ndarray]]) -> pa.Table:
    n, m = len(block), len(sums)
    return pa.table({
        "block": pa.array([*block, *[None] * m], pa.int64()), "p": pa.array([p] * (n + m), pa.int32()), "blob": pa.array([*blobs, *[None] * m], pa.binary()),
        "h": pa.array([*[None] * n, *(h for h, _ in sums)], pa.int64()), "sums": pa.array([*[None] * n, *(list(map(float, x)) for _, x in sums)], pa.list_(pa.float64())),
    })


def _count_words(p: int, block: list[int], blobs: list[bytes]) -> pa.Table:
    import zstandard

    sizes = [int.from_bytes(b[:4], "little") for b in blobs]
    raw = [zstandard.decompress(b[4:]) for b in blobs]
    keys = np.concatenate([blk.from_planes(b, n, KEY) for b, n in zip(raw, sizes, strict=True)])
    times = np.concatenate([blk.from_planes(b, n, WIDE, KEY * n) for b, n in zip(raw, sizes, strict=True)])
    own, index, askers = np.unique(keys, return_inverse=True, return_counts=True)
    count = np.bincount(index, times, len(own)).astype(np.int64)
    order = np.argsort(count, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own)) - np.searchsorted(count[order], count[order])
    ends = np.cumsum([0, *sizes])
    back = [blk.zip_bytes(blk.planes(count[i], WIDE) + blk.planes(rank[i], WIDE) + blk.planes(askers[i] == 1, 1)) for i in (index[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
    return _reply(block, p, back, [(0, [count.sum(), (count > 0).sum(), *_types(count)])])


def _ask_grams(text: str, trains: str, parts: int, columns: list[str], hot_from: float):
    """What blocks ask at the next order, given the answers in these columns: n-grams by their last word, and the count of the
    lower order, in runs of one history each. How often local n-grams occur is told too, to one of some further parts."""

    def ask(block: dict, _: int):
        b = Block(block["payload"], text, trains, parts)
        b.named(block[columns[0]])
        for name in columns[1:]:
            b.deeper()
            b.answered(block[name], hot_from)
        g, words = b.deeper(), b.grams[0]
        hashes, local, hot, sent, cuts = b.asked(hot_from)
        lower = b.lower()
        for p in range(parts):
            own = sent[cuts[p] : cuts[p + 1]]
            n = len(own)
            if n:
                begin = np.flatnonzero(np.diff(g.history[own], prepend=-1))
                w = g.word[own]
                names = blk.planes(words.count[w], WIDE) + blk.planes(b.rank[w], WIDE) + blk.planes(b.part[w], 4) + blk.planes(g.times[own], WIDE) + blk.planes(lower[own], WIDE)
                heads = blk.planes(hashes[g.history[own[begin]]] >> np.uint64(8), KEY) + blk.planes(np.diff(begin, append=n), WIDE) + blk.planes(hot[own[begin]], 1)
                yield p, np.array([n, len(begin)], "<u4").tobytes() + blk.zip_bytes(names + heads)
        yield parts + block["block"] % blk.TALLIES, _types(g.times[local]).astype("<i8").tobytes()

    return ask


def _count_grams(parts: int):
    def reduce(p: int, block: list[int], blobs: list[bytes]) -> pa.Table:
        import zstandard

        if p >= parts:
            return _reply([], p, [], [(0, [*np.sum([np.frombuffer(b, "<i8") for b in blobs], 0), *[0] * (SUMS - GOOD_TURING - 1)])])
        h, w, times, lower, heads, hot, lengths = [], [], [], [], [], [], []
        for b in blobs:
            n, m = map(int, np.frombuffer(b, "<u4", 2))
            raw = zstandard.decompress(b[8:])
            count, rank, part, own, low = (blk.from_planes(raw, n, wide, at * n) for wide, at in ((WIDE, 0), (WIDE, WIDE), (4, 2 * WIDE), (WIDE, 2 * WIDE + 4), (WIDE, 3 * WIDE + 4)))
            at = (4 * WIDE + 4) * n
            top = blk.from_planes(raw, m, KEY, at)
            lengths.append(blk.from_planes(raw, m, WIDE, at + KEY * m).astype(np.int64))
            h.append(np.repeat(top, lengths[-1])), w.append(mix(count ^ mix(rank << np.uint64(24) | part)))
            times.append(own.astype(np.int64)), lower.append(low.astype(np.int64)), heads.append(top), hot.append(blk.from_planes(raw, m, 1, at + (KEY + WIDE) * m) > 0)
        heads, hot = np.concatenate(heads), np.concatenate(hot)
        h, w, times, lower = map(np.concatenate, (h, w, times, lower))
        order = np.argsort(mix(h) + w)  # one sort: equal n-grams meet, and different ones differ by 64 bits
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        gram = np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        n = int(new.sum())
        count, askers, low = np.bincount(gram, times, n).astype(np.int64), np.bincount(gram, minlength=n), lower[order][new]
        own, group = np.unique(h[order][new], return_inverse=True)
        del h, w, times, lower, order, new
        sums = sums_of(group, len(own), count, low)
        where = np.searchsorted(own, heads)
        frees = sums[:, 1 : GOOD_TURING + 1].any(1)
        ends, heads_end = np.cumsum([0, *(x.sum() for x in lengths)]), np.cumsum([0, *map(len, lengths)])
        back = []
        for i, runs in enumerate(lengths):
            head, g = where[heads_end[i] : heads_end[i + 1]], gram[ends[i] : ends[i + 1]]
            unseen = np.add.reduceat(count[g] == 0, np.cumsum(runs) - runs, dtype=np.int64) > 0
            x = sums[head[unseen]].astype(np.int64)
            back.append(blk.zip_bytes(blk.planes(count[g], WIDE) + blk.planes(askers[g] == 1, 1) + blk.planes(frees[head] + 2 * unseen, 1) + b"".join(blk.planes(x[:, j], WIDE) for j in range(SUMS))))
        warm = np.unique(where[hot])
        return _reply(block, p, back, [(0, [*_types(count), *[0] * (SUMS - GOOD_TURING - 1)]), *((int(own[i]), sums[i]) for i in warm)])

    return reduce


def _totals(replies: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Totals of what the reducers noted: one row of the corpus, and one for each hot history (501 at most)."""
    rows = replies.filter(F.col("h").isNotNull()).groupBy("h").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
    return {r[0]: np.array(r[1:], float) for r in rows}


def _scores(block: dict, text: str, trains: str, parts: int, columns: list[str], hot_from: float, unigrams: Unigrams, hot_sums: list[dict], factors: list[np.ndarray]) -> tuple[pa.Table, list[np.ndarray]]:
    b = Block(block["payload"], text, trains, parts)
    b.named(block[columns[0]])
    words = b.grams[0]
    p, lower_total, lower = unigrams.of(words.count), np.full(len(words.lead), unigrams.total / unigrams.scale), unigrams.factor
    for name, hot, factor in zip(columns[1:], hot_sums, factors, strict=True):
        g = b.deeper()
        count, freed, seen = b.answered(block[name], hot_from, (hot, factor, lower))
        suffix = b.grams[-2].at[g.lead]
        total, left = shares(count, freed)
        back = np.where(count[g.history] > 0, left[g.history] / np.maximum(1 - seen[g.history] / np.maximum(lower_total[suffix], 1), 1e-300), 1.0)
        p = np.where(g.count > 0, discounted(g.count, factor) / total[g.history], back * p[suffix])
        lower_total, lower = total[g.history], factor
    n, count = b.rows.num_rows, words.count[words.at]
    base = unigrams.base(words.count)[words.at] if unigrams.total else np.zeros(len(count))
    return b.rows, [
        np.bincount(b.doc, minlength=n).astype(np.int64), np.bincount(b.doc, count > 0, n).astype(np.int64), np.full(n, int(unigrams.total), np.int64),
        np.bincount(b.doc, base, n), np.bincount(b.doc, np.log10(p)[b.grams[-1].at], n),
    ]


def score(df: DataFrame, trains: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """df with n_tokens, n_known, train_tokens, base_score (the smoothed unigram baseline) and score, both log10.

    trains: which rows the counts come from. order: the longest n-gram, its last word included; 1 has single words only.
    Without a training token the scores are 0."""
    outputs = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    names = [n for n in df.columns if n not in {f.name for f in outputs}]
    marked = common.fresh("trains", df.columns)
    blocks, parts = blk.pack(df.select(*map(common.col, names), F.coalesce(trains, F.lit(False)).alias(marked)), doc_id, text)
    replies = blk.exchange(blocks, _ask_words(text, marked), parts, _count_words, _REPLY)
    total = _totals(replies, GOOD_TURING + 3).get(0, np.zeros(GOOD_TURING + 3))
    unigrams = Unigrams(total[0], total[1], list(total[2:]))
    hot_from = max(2.0, HOT * total[0])
    at, columns, hot_sums, factors = blocks, ["words"], [], []
    for k in range(1, order):
        at = blk.delivered(at, replies.filter(F.col("block").isNotNull()), columns[-1])
        replies = blk.exchange(at, _ask_grams(text, marked, parts, list(columns), hot_from), parts, _count_grams(parts), _REPLY)
        found = _totals(replies, SUMS)
        factors.append(discounts(list(found.pop(0, np.zeros(SUMS))[: GOOD_TURING + 1])))
        hot_sums.append(found)
        columns.append(f"grams_{k + 1}")
    at = blk.delivered(at, replies.filter(F.col("block").isNotNull()), columns[-1])
    kept = [f for f in df.schema.fields if f.name in names]

    def run(batches):
        for block in blk.rows_of(batches):
            rows, found = _scores(block, text, marked, parts, columns, hot_from, unigrams, hot_sums, factors)
            out = [rows.column(n).combine_chunks() for n in names] + [pa.array(x) for x in found]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *(f.name for f in outputs)])

    return at.mapInArrow(run, T.StructType([*kept, *outputs]))


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.in_fold(F.col("doc_id"), 5, 1)
    found = score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
