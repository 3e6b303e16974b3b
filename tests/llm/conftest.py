from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, blanks, a long text and ties."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(60), text(120)
    rows = [(i, text(r.randint(1, 150))) for i in range(40)]
    rows += [(100, base), (101, base), (102, base + " tail words here"), (99, base.upper())]
    rows += [(200 + i, text(20) + " " + shared + " " + text(15)) for i in range(4)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one two"), (304, "ONE  two"), (305, "\x0bone\x0ctwo\r")]
    rows += [(400, text(3000)), (401, "é ñ 日本 " * 30 + shared), (None, shared), (500, text(12)), (501, "x" * 5000)]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


#: Names that operators use inside, as columns of the input.
CLASHING = "key rep hub n s1 s2 a b u v part pick y idx slice term kind head cell block query root node prev_key batch tokens probability weight token_ids score".split()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def alike():
    """Pairs of texts that sums of powers modulo 2**64 cannot tell apart: Thue-Morse texts of
    1,024 to 8,192 letters and their complements."""
    out, t = [], "a"
    while len(t) < 8192:
        t += t.translate({97: 98, 98: 97})
        if len(t) >= 1024:
            out.append((t, t.translate({97: 98, 98: 97})))
    return out
