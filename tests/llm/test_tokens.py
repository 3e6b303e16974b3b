from __future__ import annotations

import numpy as np
import pytest

from clonemesh.llm import pieces, sentencepiece_codec, token_counts
from clonemesh.llm.queries import piece_model

TEXTS = ["", " ", "   a  b ", "a" * 3000, "ab" * 2000 + " x", " " * 900 + "q", "▁▁ x▁y", "<s> </s> é\n\n\t😀 日本 語" * 50, "x\x00y", "\n\n   \n", "Hello  world"] + [" " * k + c for k in range(1, 60) for c in ("a", "\n", "tion", "")]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(piece_model())


@pytest.fixture(scope="module")
def lib(model):
    return pieces.pieces(model).lib


def test_codec_gives_the_library_ids(model, lib, corpus):
    texts = TEXTS + [c[1] or "" for c in corpus]
    c = sentencepiece_codec.Codec(pieces.pieces(model), most=200)
    for _ in range(2):
        ids, n = c.encode(texts)
        end = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(end, n)] == [lib.encode(t) for t in texts]
    assert [b.decode() for b in c.decode(ids, n)] == [t.replace("▁", " ") for t in texts]


def message(number, value):
    """A field of a serialised message, for models that are written by hand."""
    import struct

    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_fallback):
    """A unigram model of all short strings over a few letters; scores are drawn, and sums of
    them are exact in the single precision that the library adds them in."""
    import itertools

    r = np.random.default_rng(5)
    names = [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{i:02X}>", 6) for i in range(256 * byte_fallback))]
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abc▁", repeat=n)]
    words = [w for w in words if "▁" not in w.lstrip("▁")]
    rows = [(w, 0.0, k) for w, k in names] + [(w, float(r.integers(-2300, -250)) / 256, 1) for w in words]
    body = b"".join(message(1, message(1, w.encode()) + message(2, v) + message(3, k)) for w, v, k in rows)
    trainer = message(3, 1) + (message(35, 1) if byte_fallback else b"")
    return body + message(2, trainer) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))


@pytest.mark.parametrize("byte_fallback", [0, 1])
def test_unigram_models_give_the_library_ids(byte_fallback):
    import random

    p = pieces.Pieces(unigram_model(byte_fallback))
    assert not p.merges
    r = random.Random(2)
    texts = ["", " ", "   ", "éé a", "zz", "azzb zab", *("".join(r.choice("aabbcc z") for _ in range(n)) for n in (5, 40, 300, 5000)), "".join(r.choice("abc") for _ in range(9000))]
    c = sentencepiece_codec.Codec(p)
    ids, n = c.encode(texts)
    end = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(end, n)] == [p.lib.encode(t) for t in texts]
    with pytest.raises(ValueError):
        token_counts.Transducer(p)


def test_models_that_normalise_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(unigram_model(0) + message(3, message(2, b"x")))


def test_long_units_take_time_in_proportion(model, lib):
    import random
    import time

    r = random.Random(7)
    odd = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(80_000))
    c = sentencepiece_codec.Codec(pieces.pieces(model))
    took = []
    for t in (odd[:20_000], odd, "a" * 20_000, " " * 3_000 + "x" + " " * 1_000, "日本語" * 3_000, "-" * 4_001 + odd[:700]):
        began = time.time()
        ids, _ = c.encode([t])
        took.append(time.time() - began)
        assert ids.tolist() == lib.encode(t)
    assert took[1] < 10 * took[0] + 1


def test_transducer_counts_as_the_library(model, lib, corpus):
    import pyarrow as pa

    texts = TEXTS + [c[1] for c in corpus]
    fst = token_counts._counter(model)
    t = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    got = [x for b in fst(iter(t.to_batches(max_chunksize=20))) for x in b.column(2).to_pylist()]
    assert got == [len(lib.encode(x or "")) for x in texts]


def test_forgetting_states_changes_nothing(model, lib):
    p = pieces.pieces(model)
    small = token_counts.Transducer(p, most=3)
    for t in ("some words here", "and others there"):
        cp = np.frombuffer(("▁" + t).encode("utf-32-le"), np.uint32)
        fresh = np.zeros(len(cp), bool)
        fresh[0] = True
        assert small.deltas(small.cls[cp], fresh)[0].sum() == len(lib.encode(t))


def test_operators(clashing, corpus, lib):
    got = {r.doc_id: r for r in token_counts.token_counts(clashing, piece_model(), 100).collect()}
    enc = {r.doc_id: r for r in sentencepiece_codec.encode_decode(clashing, piece_model(), with_text=True).collect()}
    for i, t, *_ in corpus:
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 100)
        assert enc[i].token_ids == ids and enc[i].exact and enc[i].decoded == (t or "")
    assert token_counts.token_counts(clashing.limit(0), piece_model()).count() == 0
    assert sentencepiece_codec.encode_decode(clashing.limit(0), piece_model()).count() == 0


def test_pair_map():
    m, r = pieces.PairMap(4), np.random.default_rng(0)
    k = np.unique(r.integers(0, 1 << 40, 5000))
    for part in np.array_split(r.permutation(k), 7):
        m.add(part, part % 97)
    assert (m.find(k) == k % 97).all() and (m.find(k + (1 << 41)) == -1).all()


def test_long_texts_without_a_border(model, lib, monkeypatch):
    """Chunks are composed by the scan, and blocks carry their state on."""
    import random
    import time

    r = random.Random(1)
    odd = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(70_000))
    texts = ["a" * 40_000, "ab" * 9_000 + "c", "-" * 30_001, odd, odd[:30_000] + " " + odd[30_000:], " " * 7_000 + "x" * 6_000 + " " * 5_000 + "日本" * 4_000, "the " * 9_000]
    fst = token_counts.Transducer(pieces.pieces(model))
    want = [len(lib.encode(t)) for t in texts]
    whole = lambda t: fst.deltas(fst.cls[np.frombuffer(("▁" + t).encode("utf-32-le"), np.uint32)], np.arange(len(t) + 1) == 0)[0].sum(dtype=np.int64)
    assert [whole(t) for t in texts] == want
    for block in (512, 5000, 1 << 14):
        monkeypatch.setattr(token_counts, "BLOCK", block)
        assert [token_counts._long(fst, t) for t in texts] == want
    monkeypatch.undo()
    took = []
    for n in (1, 4):
        began = time.time()
        whole(odd * n * 3)
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1
