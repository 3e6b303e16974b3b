"""SentencePiece encoding and decoding by batched Viterbi.

Texts are cut before each run of space marks; the distinct units of a batch that the
worker has not met yet are segmented. Units of equal length advance together: at each
position every substring that ends there is looked up by its hash among the sorted piece
keys, candidates are scored, and the maximum over them stores a backpointer. For unigram
models a candidate's score is the best score before it plus its own. For merge models it is
its score if the token may follow the one before it, and nothing otherwise: just one
candidate may, and the path is what merging gives (see ``Pieces``).

Long units (texts without spaces) are cut into segments, which advance together as well.
What follows a position depends only on the tokens at the last ``longest`` positions, so a
segment is begun a little earlier, from a guess; where the guess and the segment before
disagree, it is done again from what that one ends with, until all agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches
from .pieces import SPACE, START, UNKNOWN, PairMap, Pieces, pieces, read_model
from .scan import U, column, mix, powers

_P = U(0xA24BAED4963EE407)
_MARK = ord(SPACE)
#: Characters of texts that are encoded at once.
BLOCK = 4 << 20
#: Characters of a segment of a long unit, and of the run-up to it.
SEGMENT, RUN_UP = 256, 64


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges start[i] .. start[i] + size[i], one after another."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


class Codec:
    """Encodes batches of texts; units met before are kept, up to ``most`` of them."""

    def __init__(self, p: Pieces, most: int = 600_000):
        self.p, self.most, self.merges = p, most, p.merges
        text = "".join(p.ids)
        size = np.array([len(w) for w in p.ids])
        h = self._hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size)
        o = np.argsort(h)
        self.keys, self.ids = h[o], np.array(list(p.ids.values()))[o]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("piece hashes collide")
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.keys >> U(44)).astype(np.int64)] = True
        self.lowest = self.p.score[self.ids].min()
        self.fit = PairMap(18)
        raw = p.raw
        self.piece_size = np.array([len(x) for x in raw])
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_ids = np.array([p.byte_id.get(i, p.unknown) for i in range(256)])
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, U)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _hashes(cp: np.ndarray, start: np.ndarray, size: np.ndarray, piece: int = 1 << 17) -> np.ndarray:
        """A hash of each range of code points; ranges are in order, and taken in pieces."""
        out, i, end = np.empty(len(start), U), 0, start + size
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + piece, "right")))
            lo, hi = int(start[i]), int(end[j - 1])
            up, down = powers(_P, hi - lo + 1)
            acc = np.zeros(hi - lo + 1, U)
            np.cumsum((cp[lo:hi].astype(U) + U(1)) * up[: hi - lo], out=acc[1:])
            a, b = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((acc[b] - acc[a]) * down[a] + size[i:j].astype(U))
            i = j
        return out

    @staticmethod
    def _unit_hashes(cp: np.ndarray, start: np.ndarray, size: np.ndarray, piece: int = 1 << 17) -> np.ndarray:
        """A hash of each unit, of any length: code points are mixed with their places before
        they are summed, which no text of a regular build gets round."""
        out, i, end = np.empty(len(start), U), 0, start + size
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + piece, "right")))
            lo, hi = int(start[i]), int(end[j - 1])
            place = (np.arange(lo, hi) - np.repeat(start[i:j], size[i:j])).astype(U)
            out[i:j] = mix(np.add.reduceat(mix((place << U(21)) + cp[lo:hi].astype(U) + U(1)), start[i:j] - lo) + size[i:j].astype(U))
            i = j
        return out

    def _probe(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1)
        i = np.flatnonzero(self.likely[(h >> U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[i]), len(self.keys) - 1)
        hit = self.keys[k] == h[i]
        out[i[hit]] = self.ids[k[hit]]
        return out

    def _fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        ok = u < 0
        i = np.flatnonzero(~ok)
        k = u[i] * self.p.size + t[i]
        v = self.fit.find(k)
        miss = np.flatnonzero(v < 0)
        if len(miss):
            new = np.unique(k[miss])
            if self.fit.n > 500_000:
                self.fit = PairMap(18)
                return self._fits(u, t)
            self.fit.add(new, np.array([self.p.fits(int(x) // self.p.size, int(x) % self.p.size) for x in new], np.int64))
            v[miss] = self.fit.find(k[miss])
        ok[i] = v > 0
        return ok

    def _viterbi(self, m: np.ndarray, seed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """m: code points of units of one length, a row each. Tokens at each end position,
        their lengths, and the scores. seed: tokens and scores at the first positions."""
        n, size = m.shape
        up, down = powers(_P, size + 1)
        acc = np.zeros((n, size + 1), U)
        np.cumsum((m.astype(U) + U(1)) * up[:size], axis=1, out=acc[:, 1:])
        token = np.full((n, size + 1), UNKNOWN)
        back = np.ones((n, size + 1), np.int64)
        best = np.full((n, size + 1), -np.inf, np.float32)
        given = 1
        if seed is None:
            token[:, 0], best[:, 0] = START, 0
        else:
            given = seed[0].shape[1]
            token[:, :given], best[:, :given] = seed
        for i in range(given, size + 1):
            unknown = np.ones(n, bool)
            for k in range(1, min(i, self.p.longest) + 1):
                t = self._probe(mix((acc[:, i] - acc[:, i - k]) * down[i - k] + U(k)))
                r = np.flatnonzero(t >= 0)
                if not len(r):
                    continue
                t = t[r]
                if k == 1:
                    unknown[r] = False
                if self.merges:
                    ok = self._fits(token[r, i - k], t)
                    r, t = r[ok], t[ok]
                    score = self.p.score[t].astype(np.float32)
                else:
                    score = best[r, i - k] + self.p.score[t].astype(np.float32)
                up_ = score >= best[r, i]  # of equal ones the longest stays
                r, t = r[up_], t[up_]
                best[r, i], token[r, i], back[r, i] = score[up_], t, k
            if not self.merges:
                score = best[:, i - 1] + np.float32(self.lowest - 10)
                r = unknown & (score > best[:, i])
                best[r, i], token[r, i], back[r, i] = score[r], UNKNOWN, 1
        return token, back, best

    def _long(self, units: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens at each end position and their lengths of units of over a segment."""
        keep = self.p.longest  # positions that what follows depends on
        own = [(u, j) for u, x in enumerate(units) for j in range(-(-len(x) // SEGMENT))]
        n = len(own)
        width = RUN_UP + SEGMENT
        m = np.zeros((n, width), np.uint32)
        for i, (u, j) in enumerate(own):
            part = units[u][max(0, j * SEGMENT - RUN_UP) : (j + 1) * SEGMENT]
            m[i, : len(part)] = part
        lead = np.array([RUN_UP if j else 0 for _, j in own])
        token, back, best = (np.concatenate(x) for x in zip(*(self._viterbi(m[i : i + 2048]) for i in range(0, n, 2048))))
        cols = lead[:, None] + np.arange(SEGMENT + 1)
        rows = np.arange(n)[:, None]
        edge = lambda x, at: x[np.arange(n)[:, None], at[:, None] + np.arange(1 - keep, 1)]
        begin = [edge(token, np.maximum(lead, keep)), edge(best, np.maximum(lead, keep))]
        token, back, best = token[rows, cols], back[rows, cols], best[rows, cols]
        follows = np.flatnonzero(lead > 0)
        chars = m[rows, np.minimum(cols[:, :-1], width - 1)]
        while True:
            ends = [x[follows - 1, SEGMENT + 1 - keep :] for x in (token, best)]
            rel = lambda x: x - x[:, -1:]
            same = (ends[0] == begin[0][follows]).all(axis=1)
            if not self.merges:
                with np.errstate(invalid="ignore"):
                    same &= np.isclose(rel(ends[1]), rel(begin[1][follows]), atol=1e-4).all(axis=1)
            redo = follows[~same]
            if not len(redo):
                break
            seed = [x[~same] for x in ends]
            if not self.merges:
                seed[1] = rel(seed[1])
            begin[0][redo], begin[1][redo] = seed
            full = np.concatenate([chars[redo - 1][:, SEGMENT + 1 - keep :], chars[redo]], axis=1)
            got = self._viterbi(full, tuple(seed))
            for x, y in zip((token, back, best), got):
                x[redo, 1:] = y[:, keep:]
        out, i = [], 0
        for x in units:
            k = -(-len(x) // SEGMENT)
            out.append(tuple(np.r_[y[i, :1], y[i : i + k, 1:].reshape(-1)[: len(x)]] for y in (token, back)))
            i += k
        return out

    def _segment(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of units, one after another, and their number for each unit. A unit is a
        run of space marks and the word after it."""
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(size[order]) != 0, True])
        units, counts, flats, chars = [], [], [], []
        long = order[size[order] > RUN_UP + SEGMENT]
        for a, b in zip(cut[:-1], cut[1:]):
            length = int(size[order[a]])
            if length > RUN_UP + SEGMENT:
                break
            step = max(1, (1 << 19) // (length + 1))
            for lo in range(a, b, step):
                rows = order[lo : min(lo + step, b)]
                m = cp[start[rows][:, None] + np.arange(length)]
                token, back, _ = self._viterbi(m)
                at, r = np.full(len(rows), length), np.arange(len(rows))
                ends = np.zeros(token.shape, bool)
                while len(r):
                    ends[r, at[r]] = True
                    at[r] -= back[r, at[r]]
                    r = r[at[r] > 0]
                r, e = np.nonzero(ends)
                units.append(rows)
                counts.append(ends.sum(axis=1))
                flats.append(token[r, e])
                chars.append(m[r, e - 1])
        for u, (token, back) in zip(long.tolist(), self._long([cp[start[u] : start[u] + size[u]] for u in long]) if len(long) else ()):
            ends, at, step = [], len(token) - 1, back.tolist()
            while at > 0:
                ends.append(at)
                at -= step[at]
            e = np.array(ends[::-1])
            units.append(np.array([u]))
            counts.append(np.array([len(e)]))
            flats.append(token[e])
            chars.append(cp[start[u] + e - 1])
        unit, count, flat, char = (np.concatenate(x) for x in (units, counts, flats, chars))
        back_to = np.argsort(unit)
        at = _ragged((np.cumsum(count) - count)[back_to], count[back_to])
        count, flat, char = count[back_to], flat[at], char[at]
        return self._expand(flat, char, count)

    def _expand(self, flat: np.ndarray, char: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes, or, if the model has no bytes, each
        run of them the unknown piece."""
        gone = np.flatnonzero(flat < 0)
        if not len(gone):
            return flat, count
        end = np.cumsum(count)
        n = np.ones(len(flat), np.int64)
        if self.p.byte_id:
            ids = [self.byte_ids[list(chr(c).encode())] for c in char[gone].tolist()]
            n[gone] = [len(x) for x in ids]
            ids = np.concatenate(ids)
        else:
            again = np.r_[False, gone[1:] == gone[:-1] + 1] & ~np.isin(gone, end)
            n[gone[again]] = 0
            ids = np.full(int((~again).sum()), self.p.unknown)
        out = np.repeat(flat, n)
        out[_ragged((np.cumsum(n) - n)[gone], n[gone])] = ids
        return out, np.diff(np.r_[0, np.cumsum(n)][np.r_[0, end]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after another, and their number for each text."""
        size = np.array([len(t) + 1 if t else 0 for t in texts])
        cp = np.frombuffer("".join(SPACE + t for t in texts if t).encode("utf-32-le"), np.uint32).copy()
        cp[cp == 0x20] = _MARK
        end = np.cumsum(size)
        mark = cp == _MARK
        sync = mark & ~np.r_[False, mark[:-1]]
        sync[(end - size)[size > 0]] = True
        start = np.flatnonzero(sync)
        length = np.diff(np.r_[start, len(cp)])
        h = self._unit_hashes(cp, start, length)
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[k] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            if len(self.known) + len(new) > self.most and len(self.known):
                self.reset()
                return self.encode(texts)
            flat, count = self._segment(cp, start[at[new]], length[at[new]])
            begin = np.cumsum(count) - count + len(self.flat)
            known = np.concatenate([self.known, distinct[new]])
            o = np.argsort(known)
            self.known, self.start, self.count = known[o], np.concatenate([self.start, begin])[o], np.concatenate([self.count, count])[o]
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        k = np.searchsorted(self.known, distinct)[back]
        ids = self.flat[_ragged(self.start[k], self.count[k])] if len(k) else np.zeros(0, np.int32)
        total = np.r_[0, np.cumsum(self.count[k])]
        unit = np.searchsorted(start, np.r_[0, end])
        return ids, np.diff(total[unit])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of each text: pieces joined, space marks to spaces, the first one gone."""
        size = self.piece_size[ids]
        raw = self.piece_bytes[_ragged(self.piece_start[ids], size)].tobytes() if len(ids) else b""
        cut = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(count)]].tolist()
        mark = SPACE.encode()
        return [raw[a:b].removeprefix(mark).replace(mark, b" ") for a, b in zip(cut[:-1], cut[1:])]


_made: dict[tuple, Codec] = {}


def codec(model: bytes) -> Codec:
    """One for each Python worker; it outlives the task."""
    key = (hash(model),)
    if key not in _made:
        _made.clear()
        _made[key] = Codec(pieces(model))
    return _made[key]


def encode_decode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Encode each row's whole text, decode the ids again, and compare.

    Returns the columns ``keep`` of ``docs`` and: token_ids array<int>, n_tokens,
    decoded_sha256 (of the decoded text's UTF-8), exact boolean (the decoded text is the
    text); with ``with_text`` also decoded. Ids are those of the SentencePiece library for
    the model at ``model_path`` (read on the driver), without begin or end tokens.

    Whether the model merges pairs or is a unigram one is read from it; models that
    normalise texts are refused with a ValueError. A text is held whole in a worker, with some
    60 bytes a character of it; time is in proportion to its length, with or without spaces.

    A null text is an empty one: no ids. The mark U+2581 in a text comes back as a space, so
    such a text is not exact. Rows stay as they are, whatever repeats or is null. An empty
    table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    model = read_model(model_path)
    kept = [f for f in docs.schema if f.name in keep]
    more = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType()), *([T.StructField("decoded", T.StringType())] if with_text else [])]
    schema = T.StructType([*kept, *more])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            data, off = column(b.column(b.num_columns - 1))
            raw, rows, r = data.tobytes(), len(off) - 1, 0
            while r < rows:
                e = max(r + 1, int(np.searchsorted(off, off[r] + BLOCK, "right")) - 1)
                texts = [raw[off[i] : off[i + 1]] for i in range(r, e)]
                ids, count = c.encode([t.decode() for t in texts])
                back = c.decode(ids, count)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                cols = [*(b.column(i).slice(r, e - r) for i in range(len(kept))), lists, pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, texts)], pa.bool_())]
                if with_text:
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in back], pa.string()))
                yield pa.record_batch(cols, names=names)
                r = e

    slim = docs.select(*(F.col(f.name) for f in kept), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_cm_text"))
    return slim.mapInArrow(run, schema)
