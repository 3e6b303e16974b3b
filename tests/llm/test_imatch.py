from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from clonemesh.llm import imatch


def test_edits_and_likeness(clashing, corpus):
    got = {r.doc_id: r for r in imatch.fingerprints(clashing).collect()}
    assert len(got) == len(corpus)
    rows = sorted(((-1 if c[0] is None else c[0]), c[0], c[1] or "") for c in corpus)
    for (_, i, t), (_, j, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == got[j].fingerprint:
            assert r.near_next == 1
    assert got[100].fingerprint == got[101].fingerprint and got[100].near_next == 1
    assert got[300].fingerprint == got[301].fingerprint == "0" * len(got[300].fingerprint)
    assert got[0].fingerprint != got[1].fingerprint


def test_a_third_of_the_rows_are_copies(spark):
    r = random.Random(5)
    rest = [" ".join(["the", "of", "and"] + [f"w{r.randrange(1500)}" for _ in range(60)]) for _ in range(60)]
    base = ["the", "of", "and"] + [f"hot{i}" for i in range(200)]
    near = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in (50, 90, 130, 170)]
    texts = [" ".join(base)] * 26 + near + rest
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in imatch.fingerprints(docs).collect()}
    assert all(got[i].near_edited > 0 for i in range(30))
    assert len({got[i].fingerprint for i in range(26)}) == 1 and len({got[i].fingerprint for i in range(30)}) > 1
    assert all(0.5 < got[i].near_next <= 1 for i in range(29)) and got[29].near_next < 0.2
    # words that are frequent everywhere stay out of the lexicon
    words = {x.term for x in imatch.lexicon(docs.withColumnRenamed("text", "_cm_text")).collect()}
    hashes = lambda t: set(spark.createDataFrame([(t,)], "t string").select(imatch.terms(F.col("t"))).first()[0])
    assert not words & hashes("the of and") and hashes("hot1 hot2 hot199") <= words


def test_small_tables(spark, docs):
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(3, "alpha beta")], "doc_id long, text string")
    r = imatch.fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"alpha" + b"alpha").hexdigest() and r.near_next == 1
    twice = spark.createDataFrame([(3, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    assert imatch.fingerprints(twice).count() == 3


def test_no_python_on_the_main_path(docs):
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute(rows):
    """All results by the definition, in plain Python."""
    import struct

    import regex
    import xxhash

    signed = lambda n: n - (1 << 64) if n >> 63 else n
    of = lambda b: signed(xxhash.xxh64(b, seed=42).intdigest())

    def folded(ts):
        h = 42
        for t in ts:
            h = xxhash.xxh64(struct.pack("<q", t), seed=h).intdigest()
        return signed(h)

    terms = lambda t: {of(w.encode()) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    texts = [t or "" for _, t in rows]
    df = {}
    for t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    low, high = max(2.0, 0.0005 * len(rows)), max(2.0, 0.1 * len(rows))
    band = {w for w, k in df.items() if low <= k <= high}
    bare = [t for t in texts if terms(t) and len(terms(t) & band) * 8 < len(terms(t))]
    own = {}
    for t in bare:
        for w in terms(t):
            own[w] = own.get(w, 0) + 1
    lexicon = band | {w for w, k in own.items() if w not in band and 2 * k >= df[w]}

    def parts(t):
        ts, out, at = sorted(terms(t) & lexicon), [], 0
        for bits in (3, 5, 7, 9):
            for i in range(min(16, 1 << bits)):
                out.append(folded([w for w in ts if (w % (1 << 64) >> at) & ((1 << bits) - 1) == i]))
            at += bits
        out.append(42 if ts or not t else folded(sorted(terms(t))) if terms(t) else of(t.encode()))
        return [0 if h == 42 else max(h & 0xFFFFFFFF, 1) for h in out]

    def likeness(a, b):
        if a == b:
            return 1.0
        shares, at = [], 0
        for n in (8, 16, 16, 16):
            x, y = a[at : at + n], b[at : at + n]
            some = sum(p != 0 or q != 0 for p, q in zip(x, y))
            if some >= 4:
                shares.append(sum(p == q != 0 for p, q in zip(x, y)) / some)
            at += n
        some = sum(p != 0 or q != 0 for p, q in zip(a, b))
        return max(shares) if shares else sum(p == q != 0 for p, q in zip(a, b)) / some if some else 0.0

    keys = sorted({(-(1 << 63) if i is None else i, of((t or "").encode()), len(t or ""), t or "") for i, t in rows})
    nxt = {k: keys[(j + 1) % len(keys)][3] for j, k in enumerate(keys)}
    out = []
    for i, t in rows:
        t = t or ""
        after, half = nxt[-(1 << 63) if i is None else i, of(t.encode()), len(t), t], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e = parts(t), parts(edited)
        text = lambda p: "".join(f"{h:08x}" for h in p)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f), text(e), likeness(f, e), likeness(f, parts(after))))
    return out


def test_all_results_are_those_of_brute_force(spark, corpus):
    r = random.Random(8)
    words = [f"t{i}" for i in range(400)]
    rows = [c[:2] for c in corpus] + [(600 + i, " ".join(r.choice(words) for _ in range(r.randint(3, 90)))) for i in range(60)]
    # repeated ids with other texts, repeated rows, rows without an id, marks only, no letters
    rows += [(700, "some text"), (700, "other text"), (700, "some text"), (None, "no id"), (None, None), (701, "!!!"), (702, "???"), (703, "!!!"), (704, " ".join(words) * 40)]
    got = [tuple(x) for x in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[3])
    got, want = sorted(got, key=order), sorted(brute(rows), key=order)
    assert len(got) == len(rows) and [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a[k] - b[k]) < 1e-12 for a, b in zip(got, want) for k in (5, 6))
    of = {x[0]: x for x in got}
    assert of[701][3] == of[703][3] != of[702][3] and of[701][6] == 0
