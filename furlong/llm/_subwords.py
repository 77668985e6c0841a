"""Token ids of many texts at once, by public tokenizers, each distinct pre-token of a slice encoded once.

A byte-level BPE encodes every match of its split pattern by itself, and a piece model without pieces that go on after a
word's end encodes every word (with the spaces before it) by itself. So the texts of a slice are cut there, vectorised over
code points, and only distinct spans go through the library; the ids of whole texts are put together from theirs. Which
code points are letters, numbers or spaces is asked of the tokenizer, once for each code point that occurs.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np

from furlong.llm._words import Words

SLICE_CHARS = 1 << 21
#: What a worker remembers: so many spans, of so many bytes in all.
SPANS, SPAN_BYTES = 1 << 19, 32 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
_UNSEEN = 9


class Spans(Words):
    """Any byte spans, hashed as words are."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends, self._lower = data, starts, ends, False


def take(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first[i] to first[i] + count[i] - 1 for every i, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Spans and their ids; forgets all when it is full."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], sizes: np.ndarray, token: Callable[[int], bytes]):
        self.encode, self.sizes, self.token = encode, sizes, token
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.bytes = self.n_spans = self.n_ids = 0
        self.first, self.count, self.right, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool), np.zeros(4096, np.int32)

    def _add(self, spans: list[bytes]) -> None:
        found = self.encode(spans)
        flat = np.concatenate([np.asarray(x, np.int32) for x in found]) if found else np.zeros(0, np.int32)
        counts = np.array([len(x) for x in found], np.int64)
        n, m = self.n_spans, self.n_ids
        while n + len(spans) > len(self.first):
            self.first, self.count, self.right = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.right))
        while m + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[m : m + len(flat)] = flat
        self.count[n : n + len(spans)] = counts
        self.first[n : n + len(spans)] = m + np.cumsum(counts) - counts
        self.right[n : n + len(spans)] = [b"".join(map(self.token, x)) == s for x, s in zip(found, spans, strict=True)]
        self.places.update(zip(spans, range(n, n + len(spans)), strict=True))
        self.n_spans, self.n_ids, self.bytes = n + len(spans), m + len(flat), self.bytes + sum(map(len, spans))

    def __call__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all spans one after the other, how many each has, whether each one's tokens are its bytes)."""
        if self.n_spans > SPANS or self.bytes > SPAN_BYTES:
            self._clear()
        _, at, which = np.unique(Spans(np.frombuffer(raw, np.uint8), starts, ends).hashes(), return_index=True, return_inverse=True)
        own = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        known = [*map(self.places.get, own)]
        if None in known:
            self._add([s for s, place in zip(own, known, strict=True) if place is None])
            known = map(self.places.__getitem__, own)
        place = np.fromiter(known, np.int64, len(own))[which]
        count = self.count[place]
        return self.ids[take(self.first[place], count)], count, self.right[place]


class ByteLevel:
    """A byte-level BPE of the tokenizers library with the split pattern that such files have by default."""

    def __init__(self, path: str, plain_specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, _UNSEEN, np.uint8)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        assert set(signs) == set(pre_tokenizers.ByteLevel.alphabet())
        self.signs = str.maketrans({chr(b): c for c, b in signs.items()})
        size = self.tokenizer.get_vocab_size()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.tokens = [bytes(signs[c] for c in e) if all(c in signs for c in e) else e.encode() for e in entries]
        self.table = Table(self._encode, np.array([len(t) for t in self.tokens]), self.tokens.__getitem__)

    def _encode(self, spans: list[bytes]) -> list[list[int]]:
        model, signs = self.tokenizer.model, self.signs
        return [[t.id for t in model.tokenize(s.decode("latin-1").translate(signs))] for s in spans]

    def alone(self, text: str) -> list[int]:
        """The ids of one text by the library alone."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point, as the tokenizer's own splitting shows it."""
        found = self.classes[points]
        if (unseen := np.unique(points[found == _UNSEEN])).size:
            split = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
            for p in unseen.tolist():
                c = chr(p)
                self.classes[p] = LETTER if split("a" + c) == 1 else NUMBER if split("1" + c) == 1 else OTHER if split("." + c) == 1 else SPACE
            found = self.classes[points]
        return found

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each code point; first: whether a text does.

        Runs of letters, of numbers and of other signs are pre-tokens, with one U+0020 before them; of white space before
        them all but the last character is one, and the last too, unless it is that U+0020. An apostrophe that begins a
        pre-token of its own takes one of seven endings with it."""
        kind = self._class_of(points)
        begins = first.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero(begins[1:] & ~first[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        begins[after - 1] = True
        begins[after] = points[after - 1] != 32
        n = len(points)
        quote = np.flatnonzero((points == 39) & begins)
        padded, alone = np.concatenate([points, np.zeros(3, points.dtype)]), np.concatenate([first, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = ~alone[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        pair = ~alone[quote + 1] & ~alone[quote + 2] & np.isin(one.astype(np.int64) * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        for which, size in ((short, 2), (pair, 3)):
            at = quote[which]
            begins[at + 1] = False
            begins[(at + size)[at + size < n]] = True
        return begins


class Pieces:
    """A BPE model of the sentencepiece library that adds a space before a text, changes no other character, and has no
    piece in which a space follows another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.space = m.piece_to_id("▁")
        if any("▁" in e.lstrip("▁") for e in entries):
            raise ValueError("a piece goes on after a word's end: words can't be encoded by themselves")
        self.tokens = [bytes([int(e[1:-1], 16)]) if m.is_byte(i) else e.replace("▁", " ").encode() for i, e in enumerate(entries)]
        self.table = Table(self._encode, np.array([len(t) for t in self.tokens]), self.tokens.__getitem__)

    def _encode(self, spans: list[bytes]) -> list[list[int]]:
        found = self.model.encode([s[1:].decode() for s in spans], num_threads=1)
        return [ids or [self.space] for ids in found]  # the library gives an empty text no space

    def alone(self, text: str) -> list[int]:
        """The ids of one text by the library alone; it adds the space before it."""
        return self.model.encode(text)

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        begins = first.copy()
        begins[1:] |= (points[1:] == 32) & (points[:-1] != 32)
        return begins


@functools.lru_cache(maxsize=4)
def byte_level(name: str, plain_specials: bool) -> ByteLevel:
    """The name of a file that public_tokenizers has on every machine, or a path."""
    return ByteLevel(_path(name), plain_specials)


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(_path(name))


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class Slice:
    """Some texts, joined: their bytes, code points, and where each one begins."""

    def __init__(self, texts: list[str]):
        whole = "".join(texts)
        self.raw = whole.encode()
        self.points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.first = np.zeros(len(self.points), bool)
        begins = np.cumsum(lengths) - lengths
        self.first[begins[lengths > 0]] = True
        widths = 1 + (self.points > 0x7F).astype(np.int64) + (self.points > 0x7FF) + (self.points > 0xFFFF)
        self.offsets = np.concatenate([[0], np.cumsum(widths)])
        #: Byte bounds of the texts.
        self.bounds = self.offsets[np.concatenate([begins, [len(self.points)]])]

    def encode(self, tokenizer: ByteLevel | Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has, whether each text's tokens are its bytes)."""
        n = len(self.bounds) - 1
        starts = self.offsets[:-1][tokenizer.starts(self.points, self.first)]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
        ids, count, right = tokenizer.table(self.raw, starts, np.append(starts[1:], len(self.raw)))
        total, wrong = (np.concatenate([[0], np.cumsum(x)]) for x in (count, ~right))
        of = np.searchsorted(starts, self.bounds)
        return ids, np.diff(total[of]), np.diff(wrong[of]) == 0


def runs(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about so many characters, or of one longer text."""
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)
