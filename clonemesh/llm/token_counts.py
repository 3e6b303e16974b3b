"""Token counts by a finite-state transducer.

The tokenizer is compiled, as states are met, into a deterministic transducer over
characters whose transitions carry the change in the number of tokens of the text so far.
A state holds, for each place where a piece under way may have begun, the node of the piece
trie, the last token before it and the tokens since; which token ends at a character
follows from these alone. A batch of texts is cut into chunks of equal length which advance
together. A chunk is a map from entry state to exit state: from its first word border on, the
state does not depend on its entry, so its map is constant and only the head before the
border needs the entry; a chunk without a border has a map proper. Maps are made for the
entries that the chunks before can leave, all chunks at once, until no new entry turns up,
and then composed by a parallel prefix scan, in log n steps, which gives every chunk's entry.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .pieces import SPACE, START, UNKNOWN, PairMap, Pieces, pieces, read_model
from .scan import column

_CLASS_BITS, _SHIFT = 16, 64
#: Characters of a chunk, and bytes of texts (characters of a long one) of a block.
CHUNK, BLOCK = 512, 1 << 20


class Transducer:
    """States are met and compiled lazily; when ``most`` are known, all are forgotten."""

    def __init__(self, p: Pieces, most: int = 400_000):
        if not p.periodic:
            raise ValueError("only merge models in which long runs of spaces are periodic are compiled")
        self.p, self.most = p, most
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        chars = sorted({c for w in p.words for c in w})
        self.cls = np.zeros(0x110000, np.uint16)
        for lo, hi, n in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.cls[lo:hi] = n  # classes 1 to 4: characters without a piece, by their bytes
        code = {c: i for i, c in enumerate([SPACE, *(c for c in chars if c != SPACE)], 5)}
        for c, i in code.items():
            self.cls[ord(c)] = i
        self.space = code[SPACE]
        self.cls[0x20] = self.space
        for w, i in p.words.items():
            n = 0
            for c in w:
                if code[c] not in self.trie[n]:
                    self.trie[n][code[c]] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                n = self.trie[n][code[c]]
            self.token[n] = i
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.fit: dict[int, bool] = {}
        self.states: list[bytes] = []
        self.map = PairMap(18)
        self.start = self.state([(0, START, 0)], 0)

    def state(self, live: list[tuple[int, int, int]], run: int) -> int:
        key = array("i", [run, *(x for entry in live for x in entry)]).tobytes()
        q = self.known.get(key)
        if q is None:
            q = self.known[key] = len(self.states)
            self.states.append(key)
        return q

    def compile(self, q: int, c: int) -> tuple[int, int]:
        """(next state, change in tokens) of state q for character class c."""
        packed = array("i", self.states[q])
        run, live = packed[0], zip(packed[1::3], packed[2::3], packed[3::3])
        if c == self.space:
            run += 1
            if run >= self.p.RUNS:
                run -= 16  # from there on, 16 more space marks are one more token
            f, g = self.p.runs[run], self.p.runs[run - 1]
            node = self.trie[0][c]
            return self.state([(node, START, g - f), (0, self.token[node], 0)], run), f - g
        best, on = None, []
        for node, last, rel in live:
            child = self.trie[node].get(c)
            if child is not None:
                t = self.token[child]
                if t is not None and self.fits(last, t):
                    best = rel + 1, t
                if self.trie[child]:
                    on.append((child, last, rel))
        if best is None:
            best, on = (c if self.p.byte_id else 1, UNKNOWN), []
        d, t = best
        return self.state([*((n, e, r - d) for n, e, r in on), (0, t, 0)], 0), d

    def fits(self, last: int, t: int) -> bool:
        key = (last << 32) + t
        if key not in self.fit:
            if len(self.fit) > 150_000:
                self.fit.clear()
            self.fit[key] = self.p.fits(last, t)
        return self.fit[key]

    def step(self, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = (q << _CLASS_BITS) | c
        v = self.map.find(k)
        miss = np.flatnonzero(v < 0)
        if len(miss):
            new = np.unique(k[miss])
            got = [self.compile(int(x) >> _CLASS_BITS, int(x) & ((1 << _CLASS_BITS) - 1)) for x in new]
            self.map.add(new, np.array([(a << 8) | (d + _SHIFT) for a, d in got], np.int64))
            v[miss] = self.map.find(k[miss])
        return v >> 8, (v & 255) - _SHIFT

    def deltas(self, c: np.ndarray, fresh: np.ndarray, entry: bytes | None = None, after_space: bool = False) -> tuple[np.ndarray, bytes]:
        """The change in tokens at each character, and the state after the last. fresh: a
        text starts here. entry: the state before the first character, of a text that began
        earlier (``after_space``: with a space mark just before)."""
        if len(self.states) > self.most:
            self.reset()
        begin = self.start if entry is None else self.adopt(entry)
        n = -(-len(c) // CHUNK)
        pad = n * CHUNK - len(c)
        is_space = c == self.space
        sync = fresh | (is_space & ~np.r_[after_space, is_space[:-1]])
        x = np.r_[c, np.full(pad, 1, c.dtype)].astype(np.int64).reshape(n, CHUNK)
        s = np.r_[sync, np.zeros(pad, bool)].reshape(n, CHUNK)
        xt, st = np.ascontiguousarray(x.T), np.ascontiguousarray(s.T)
        out = np.zeros((n, CHUNK), np.int8)
        q = np.full(n, self.start)
        q[0] = begin
        last = len(c) - (n - 1) * CHUNK - 1
        for t in range(CHUNK):
            q = np.where(st[t], self.start, q)
            q, out[:, t] = self.step(q, xt[t])
            if t == last:
                end = int(q[-1])
        border = s.any(axis=1)
        head = np.where(border, s.argmax(axis=1), CHUNK)
        head[0] = 0  # its entry is known
        const = border.copy()
        const[0] = True
        maps = _Maps(n)
        chunk = np.flatnonzero(head[1:] > 0) + 1
        state = q[chunk - 1]  # certain where the chunk before is constant, else a guess
        while len(chunk):
            chunk, state, new = maps.add(chunk, state)
            exits, rows = self._heads(xt, chunk, state, head[chunk])
            maps.fill(new, np.where(const[chunk], q[chunk], exits), rows)
            on = ~const[chunk] & (chunk + 1 < n)
            on[on] &= head[chunk[on] + 1] > 0
            chunk, state = maps.fresh(chunk[on] + 1, exits[on])
        entries = maps.scan(const, q)
        at = np.flatnonzero(head > 0)
        if len(at):
            own = maps.slot(at, entries[at])
            for i, k in zip(at.tolist(), own.tolist()):
                h = int(head[i])
                out[i, :h] = maps.rows[k][:h]
            if at[-1] == n - 1 and not border[-1]:
                end = int(self._heads(xt, at[-1:], entries[at[-1:]], np.array([last + 1]))[0][0])
        return out.reshape(-1)[: len(c)], self.states[end]

    def _heads(self, xt: np.ndarray, chunk: np.ndarray, state: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Run the first ``head`` characters of chunks from states: the states after them, and
        the changes at each character."""
        exits = state.copy()
        rows = np.zeros((len(chunk), int(head.max()) if len(chunk) else 0), np.int8)
        for t in range(rows.shape[1]):
            go = np.flatnonzero(head > t)
            exits[go], rows[go, t] = self.step(exits[go], xt[t, chunk[go]])
        return exits, [r[:h] for r, h in zip(rows, head.tolist())]

    def adopt(self, key: bytes) -> int:
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]


class _Maps:
    """Chunks' maps: for each (chunk, entry state) met, the exit state and the changes."""

    def __init__(self, n: int):
        self.n, self.keys = n, np.zeros(0, np.int64)
        self.slots, self.exits, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    @staticmethod
    def _key(chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
        return (chunk.astype(np.int64) << 32) + state

    def _find(self, k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, k), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == k, at, -1) if len(self.keys) else np.full(len(k), -1)

    def fresh(self, chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are not known yet."""
        k = np.unique(self._key(chunk, state))
        k = k[self._find(k) < 0]
        return k >> 32, k & 0xFFFFFFFF

    def add(self, chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chunk, state = self.fresh(chunk, state)
        new = np.arange(len(self.slots), len(self.slots) + len(chunk))
        keys, slots = np.r_[self.keys, self._key(chunk, state)], np.r_[np.arange(len(self.slots)) if not len(self.keys) else self.order, new]
        o = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[o], slots[o]
        self.slots = np.r_[self.slots, new]
        return chunk, state, new

    def fill(self, new: np.ndarray, exits: np.ndarray, rows: list[np.ndarray]) -> None:
        self.exits = np.r_[self.exits, exits]
        self.rows += rows

    def slot(self, chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
        return self.order[self._find(self._key(chunk, state))]

    def scan(self, const: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The entry state of each chunk. Each chunk's map goes from the places of its entries
        to those of the next one's, and 2^k chunks' maps are composed in step k."""
        n = self.n
        entries = np.r_[-1, q[:-1]].astype(np.int64)  # after a constant chunk
        if not len(self.keys) or const.all():
            return entries
        chunk, state = self.keys >> 32, self.keys & 0xFFFFFFFF
        first = np.searchsorted(chunk, np.arange(n + 1))
        many = np.diff(first)
        wide = max(1, int(many.max()))
        # to[i, a]: the place, among the entries of chunk i + 1, where entry a of chunk i leads
        to = np.zeros((n, wide), np.int64)
        exits = self.exits[self.order]
        place = np.arange(len(chunk)) - first[chunk]
        goal = self._find(self._key(chunk + 1, exits))
        to[chunk, place] = np.where(goal >= 0, goal - first[np.minimum(chunk + 1, n)], 0)
        fixed = np.flatnonzero(const[:-1])
        goal = self._find(self._key(fixed + 1, q[fixed]))
        to[fixed] = np.where(goal >= 0, goal - first[fixed + 1], 0)[:, None]
        step = 1
        while step < n:
            to[step:] = np.take_along_axis(to[step:], to[:-step].copy(), axis=1)
            step *= 2
        have = np.flatnonzero(many[1:] > 0) + 1
        entries[have] = state[first[have] + to[have - 1, 0]]
        return entries


def _counter(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(model)
        for b in batches:
            data, off = column(b.column(1))
            raw, rows, counts = data.tobytes(), len(off) - 1, []
            r = 0
            while r < rows:
                e = max(r + 1, int(np.searchsorted(off, off[r] + BLOCK, "right")) - 1)
                if off[e] - off[r] > BLOCK:
                    counts.append(np.array([_long(fst, raw[off[r] : off[e]].decode())], np.int64))
                    r = e
                    continue
                texts = [raw[off[i] : off[i + 1]].decode() for i in range(r, e)]
                size = np.array([len(t) + 1 if t else 0 for t in texts])
                cp = np.frombuffer("".join(SPACE + t for t in texts if t).encode("utf-32-le"), np.uint32)
                end = np.cumsum(size)
                fresh = np.zeros(len(cp), bool)
                fresh[(end - size)[size > 0]] = True
                total = np.r_[0, np.cumsum(fst.deltas(fst.cls[cp], fresh)[0], dtype=np.int64)] if len(cp) else np.zeros(1, np.int64)
                counts.append(total[end] - total[end - size])
                r = e
            yield pa.record_batch([b.column(0), pa.array(np.diff(off)), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _long(fst: Transducer, text: str) -> int:
    """Tokens of a text longer than a block, block by block with the state carried on."""
    count, state, spaced = 0, None, False
    for i in range(0, len(text), BLOCK):
        cp = np.frombuffer(((SPACE if not i else "") + text[i : i + BLOCK]).encode("utf-32-le"), np.uint32)
        fresh = np.zeros(len(cp), bool)
        fresh[0] = not i
        cls = fst.cls[cp]
        d, state = fst.deltas(cls, fresh, state, spaced)
        count, spaced = count + int(d.sum(dtype=np.int64)), bool(cls[-1] == fst.space)
    return count


_made: dict[int, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    """One for each Python worker; it outlives the task."""
    key = hash(model)
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(pieces(model))
    return _made[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row's whole text.

    The counts are those of the SentencePiece library for the merge model at ``model_path``
    (read on the driver), without begin or end tokens; special strings inside a text are
    ordinary text. A null or empty text has 0 bytes and 0 tokens. A text of over 1 MB is counted
    in blocks with the state carried on; besides the text itself only a block's temporaries
    are held, some 60 bytes a character. Rows stay as they are:
    null ids and repeated rows are counted like any other. An empty table gives an empty
    result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    model = read_model(model_path)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = slim.mapInArrow(_counter(model), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
