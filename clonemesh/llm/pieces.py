"""Piece tables of a SentencePiece model and the rules that its segmentation follows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: Last token of an empty prefix, and of one that ends in a character without a piece.
START, UNKNOWN = -1, -2


class PairMap:
    """int64 -> int64 by open addressing in numpy; only adds. Keys are not negative."""

    def __init__(self, bits: int = 16):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.n, self.bits = 0, bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing (values are never negative)."""
        s = self._slot(k)
        at = self.keys[s]
        out = np.where(at == k, self.values[s], -1)
        i = np.flatnonzero((at != k) & (at != -1))
        while len(i):
            s[i] = (s[i] + 1) & ((1 << self.bits) - 1)
            at = self.keys[s[i]]
            hit = at == k[i]
            out[i[hit]] = self.values[s[i[hit]]]
            i = i[~hit & (at != -1)]
        return out

    def add(self, k: np.ndarray, v: np.ndarray) -> None:
        """New distinct keys."""
        if 2 * (self.n + len(k)) > 1 << self.bits:
            old = self.keys >= 0
            ok, ov = self.keys[old], self.values[old]
            self._make(max(self.bits + 1, int(4 * (len(ok) + len(k))).bit_length()))
            self.add(ok, ov)
        s, left = self._slot(k), np.arange(len(k))
        while len(left):
            free = self.keys[s[left]] == -1
            i = left[free]
            self.keys[s[i]] = k[i]
            won = self.keys[s[i]] == k[i]
            self.values[s[i[won]]] = v[i[won]]
            left = np.concatenate([left[~free], i[~won]])
            s[left] = (s[left] + 1) & ((1 << self.bits) - 1)
        self.n += len(k)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at, n, shift = at + 1, n | (byte & 127) << shift, shift + 7
            if byte < 128:
                return n

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


# Fields of the model file, its two types of segmentation that are read here,
# and the type of pieces that are matched before segmentation.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, UNIGRAM, MERGES = 3, 1, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
PIECE_TYPE, USER_DEFINED = 3, 4


def model_type(model: bytes) -> int:
    """UNIGRAM or MERGES, as the model says; models that normalise texts are refused."""
    kind, rules, own = UNIGRAM, {}, False
    for n, v in _fields(model):
        if n == TRAINER:
            kind = dict(_fields(v)).get(MODEL_TYPE, UNIGRAM)
        elif n == NORMALIZER:
            rules = dict(_fields(v))
        elif n == PIECES:
            own |= dict(_fields(v)).get(PIECE_TYPE) == USER_DEFINED
    if rules.get(CHARSMAP) or not rules.get(DUMMY_PREFIX, 1) or rules.get(REMOVE_SPACES, 1) or not rules.get(ESCAPE_SPACES, 1) or own or kind not in (UNIGRAM, MERGES):
        raise ValueError("only unigram and merge models with a dummy prefix, without normalisation and user-defined pieces, are read")
    return kind


def _bpe(text: str, rank: dict[str, float]) -> list[str]:
    """The last two pieces that merging by rank leaves of a piece, the leftmost of equal
    ranks first."""
    t = list(text)
    while len(t) > 2:
        r, i = min(((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(t, t[1:]))), default=(np.inf, 0))
        if r == np.inf:
            raise ValueError(f"merges do not build the piece {text!r}")
        t[i : i + 2] = [t[i] + t[i + 1]]
    return t


class Pieces:
    """What segmentation needs from a model: identity normalisation and a dummy prefix.

    For merge models a token sequence is what merging gives exactly if every two neighbours
    could not have been merged across their border (``fits``), and then there is just one
    such sequence; so it can be found by dynamic programming from left to right. ``runs[r]``
    is the number of tokens of r space marks alone.
    """

    RUNS = 512

    def __init__(self, model: bytes):
        import sentencepiece

        self.merges = model_type(model) == MERGES
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(self.size)]
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(names, special)) if not s}
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        self.byte_id = {int(p[1:-1], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if s else p.encode() for i, (p, s) in enumerate(zip(names, special))]
        self.raw[self.unknown] = " \u2047 ".encode()
        if SPACE not in self.ids or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("only models with a piece for spaces and pieces within words are read")
        self.longest = max(map(len, self.ids))
        #: pieces of a word, without those of two or more space marks
        self.words = {p: i for p, i in self.ids.items() if len(p) == 1 or p.strip(SPACE)}
        if self.merges:
            self._merges()
            self.runs = [0] + [len(sp.encode(" " * (r - 1))) if r > 1 else 1 for r in range(1, self.RUNS)]

    @property
    def periodic(self) -> bool:
        """Whether 16 more space marks are one more token from some number of them on."""
        return self.merges and all(self.runs[r] == self.runs[r - 16] + 1 for r in range(self.RUNS // 2, self.RUNS))

    def _merges(self) -> None:
        rank = {p: -float(self.score[i]) for p, i in self.ids.items()}
        self.rank, self.left, self.right, self.pair = {}, {}, {}, {}
        for p, i in self.ids.items():
            self.rank[i] = -1.0
            if len(p) > 1:
                a, b = _bpe(p, rank)
                self.rank[i], self.left[i], self.right[i] = rank[p], self.ids[a], self.ids[b]
                for k in range(1, len(p)):
                    if p[:k] in self.ids and p[k:] in self.ids:
                        self.pair[self.ids[p[:k]], self.ids[p[k:]]] = rank[p]

    def fits(self, u: int, t: int) -> bool:
        """Token t can follow token u: undoing merges from the latest back, no merge across
        the border came first."""
        if u < 0 or t < 0:
            return True
        limit = np.inf
        while True:
            if self.pair.get((u, t), np.inf) < limit:
                return False
            ru, rt = self.rank[u], self.rank[t]
            if ru < 0 and rt < 0:
                return True
            if ru > rt:
                limit, u = ru, self.right[u]
            else:  # of equal ranks the left merge comes first
                limit, t = rt + 0.5, self.left[t]


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
