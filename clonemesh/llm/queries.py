"""The queries of this subpackage for ``__spark_entry__``: name -> function and SQL.

Operator modules are imported by the functions, so one can be read without the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """Place of the public 32k merge vocabulary; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), piece_model())


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grace import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_(?!sql$)", name)}


#: Words of a text, and letters of upper case, for DuckDB.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _windows(size: int) -> str:
    return f"""w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), n AS (SELECT doc_id, ws, len(ws) AS n FROM w),
 p AS (SELECT doc_id, unnest(range(n - {size} + 1)) AS pos, ws FROM n WHERE n >= {size}), h AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + {size}], chr(1))) AS h FROM p),
 o AS (SELECT h, min(doc_id) AS low, max(doc_id) AS high FROM h GROUP BY 1),
 later AS (SELECT DISTINCT doc_id, pos + k AS pos FROM h JOIN o USING (h), range({size}) r(k) WHERE low < doc_id)"""


def op10_sql(size: int = 13) -> str:
    return f"""WITH {_windows(size)}, words AS (SELECT doc_id, unnest(range(n)) AS pos, unnest(ws) AS word FROM n),
 kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY pos)) AS s, count(*) AS k FROM words ANTI JOIN later USING (doc_id, pos) GROUP BY 1)
 SELECT n.doc_id, n.n AS n_words, n.n - coalesce(k, 0) AS n_removed, coalesce(s, sha256('')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)"""


def op1_sql(size: int = 50) -> str:
    return f"""WITH {_windows(size)}, words AS (SELECT doc_id, unnest(range(n)) AS pos, unnest(ws) AS word FROM n),
 shared AS (SELECT DISTINCT doc_id, pos + k AS pos FROM h JOIN o USING (h), range({size}) r(k) WHERE low < high),
 isl AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM shared),
 spans AS (SELECT i.doc_id, min(i.pos) AS a, max(i.pos) + 1 AS b, sha256(string_agg(word, ' ' ORDER BY i.pos)) AS s, count(later.pos) = 0 AS f FROM isl i JOIN words USING (doc_id, pos) LEFT JOIN later USING (doc_id, pos) GROUP BY i.doc_id, g)
 SELECT doc_id, a AS start_word, b AS end_word, b - a AS n_words, CAST(sum(b - a) OVER (PARTITION BY doc_id) AS BIGINT) AS n_repeated, f AS first, s AS span_sha256 FROM spans"""


def op7_sql(threshold: int = 85) -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[pos + 1 : pos + 5], chr(1)) AS x FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, least(len(ws), 1)))) AS pos FROM w) q),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 b AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM s l JOIN s r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM b JOIN n l ON l.doc_id = a JOIN n r ON r.doc_id = b WHERE 100 * k >= {threshold} * (l.n + r.n - k)),
 both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, root) AS (SELECT a, a FROM both_ UNION SELECT b.b, w.root FROM walk w JOIN both_ b ON b.a = w.node WHERE w.root < b.b),
 roots AS (SELECT node, min(root) AS root FROM walk GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN roots ON node = d.doc_id"""


def op8_sql() -> str:
    return """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
 l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.9),
 walk(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, w.root FROM walk w JOIN l ON l.a = w.node WHERE w.root < l.b), roots AS (SELECT node, min(root) AS root FROM walk GROUP BY 1),
 k AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
 SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN k ON a = vec_id LEFT JOIN roots ON node = vec_id"""


def op9_sql() -> str:
    piece = lambda i: f"CAST('0x' || substr(x, {10 * i + 1}, 10) AS UBIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({piece(i)} >> {35 - 5 * k}) & 31) + 1 AS BIGINT), 1)" for i in range(4) for k in range(8))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM p)
 SELECT page_id, strlen(h) AS payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
 CAST(1 + greatest(0, (strlen(h) - 1) // 1048576) AS INT) AS chunks, true AS verified FROM g"""


def op11_sql() -> str:
    return """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS x FROM documents),
 g AS (SELECT doc_id, x, count(*) OVER (PARTITION BY x) AS group_size, first_value(doc_id) OVER (PARTITION BY x ORDER BY n DESC, doc_id) AS keep_id FROM t)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g"""


#: CTE of the 256 remainders of CRC-32, as list t of table crc.
_CRC = """crc AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
 FROM (SELECT unnest(range(256)) AS b) q) z)"""


def _crc32(x: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text, with crc in scope."""
    digits = f"hex(encode({x}))"
    some = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST(concat('0x', substr({digits}, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {some}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


def op12_sql(buckets: int = 10_000) -> str:
    words = lambda t: f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {t}"
    return f"""WITH {_CRC}, d AS (SELECT doc_id, {words("documents")}), b AS (SELECT {words("benchmark")}),
 v AS (SELECT word, {_crc32("word")} % {buckets} AS bucket FROM (SELECT unnest(ws) AS word FROM d UNION SELECT unnest(ws) FROM b) q, crc),
 f AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(ws) AS word FROM d) q JOIN v USING (word)),
 s AS (SELECT bucket, count(*) AS s FROM f GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS word FROM b) q JOIN v USING (word) GROUP BY 1),
 tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
 g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + {buckets}) / ((s::DOUBLE + 1) * (tt + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
 w AS (SELECT doc_id, count(*) AS k, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) GROUP BY 1),
 r AS (SELECT doc_id, coalesce(k, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
 n AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, count(*) OVER () AS n FROM r WHERE n_features >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN rn <= 10 * n // 100 THEN rn END AS rank FROM r LEFT JOIN n USING (doc_id)"""


def op13_sql() -> str:
    return f"""WITH RECURSIVE {_CRC}, d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
 l AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS w, count(*) AS k FROM d WHERE length(run) >= 7 GROUP BY 1, 2),
 h AS (SELECT w, k, {_crc32("concat(doc_id, ':', w)")} AS h FROM l, crc),
 c AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, k FROM h),
 v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
 p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v), cut AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS x FROM p),
 e AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT x, word FROM cut WHERE x IN (SELECT word FROM v) UNION SELECT word, x FROM cut WHERE x IN (SELECT word FROM v)),
 o AS (SELECT e.a AS word, e.b AS form, v.n AS form_n, count(*) OVER (PARTITION BY e.a) AS n_near, row_number() OVER (PARTITION BY e.a ORDER BY v.n DESC, e.b) AS rn FROM e JOIN v ON v.word = e.b),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND rn = 1),
 walk(word, root) AS (SELECT word, word FROM v UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
 ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
 SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are held against brute force, the
    tokenizer's library or held-out labels in tests."""
    from .mixing import mixture_sql

    return {"op1_suffix_array_dedup": op1_sql(), "op4_mixing": mixture_sql(), "op7_minhash_dedup": op7_sql(), "op8_embedding_dedup": op8_sql(), "op9_warc": op9_sql(), "op10_substring_dedup": op10_sql(), "op11_exact_dedup": op11_sql(), "op12_importance_resampling": op12_sql(), "op13_spelling_variants": op13_sql()}
