"""Mixing sources to target weights with DataFrame and SQL functions only.

Documents are counted by cell (source, language, topic). Iterative proportional fitting
rakes the cells' token weights to target marginals, which are given by value or follow from the
tokens; each document is then kept with a probability in proportion to its cell's raked weight
per token. With the largest such probability at 1 the kept tokens have the raked marginals in
expectation; for a stated share of all tokens beyond that, cells are capped at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import looked_up
from .common import drop, text_or_empty, written

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
#: Rounds of one plan.
ROUNDS_AT_ONCE = 4
_TINY = "CAST(1e-300 AS DOUBLE)"
#: Cells whose probabilities are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000

#: Topics by form, from counts of bytes, bars and digits; the same text for both engines.
TOPIC = """CASE WHEN bars * 100 > bytes THEN 'table' WHEN digits * 100 > 3 * bytes THEN 'numeric'
 WHEN bytes < 1000 THEN 'brief' WHEN bytes < 4000 THEN 'article' ELSE 'long' END"""


def _start(cells: str, alpha: float, given: tuple[str, ...]) -> list[str]:
    """Steps up to r0: cells with their targets, and their share of tokens as weight. Targets
    are tokens ** alpha by value of each dimension, or for the dimensions in ``given`` the
    columns goal_source, goal_lang and goal_topic of ``cells``."""
    sums = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS all_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMENSIONS)
    power = {d: f"power(CAST(all_{d} AS DOUBLE) / total, CAST({alpha} AS DOUBLE))" for d in DIMENSIONS} | {d: f"CAST(goal_{d} AS DOUBLE)" for d in given}
    # a value's power is summed once: each of its cells carries an equal part
    goals = ", ".join(f"p_{d} / greatest(sum(p_{d} / n_{d}) OVER (PARTITION BY one), {_TINY}) AS t_{d}" for d in DIMENSIONS)
    return [
        f"k0 AS (SELECT *, {sums}, sum(tokens) OVER (PARTITION BY one) AS total FROM (SELECT *, 1 AS one FROM {cells}) z)",
        f"k1 AS (SELECT *, {', '.join(f'{power[d]} AS p_{d}' for d in DIMENSIONS)} FROM k0)",
        f"r0 AS (SELECT source, lang, topic, one, tokens, total, {goals}, CAST(tokens AS DOUBLE) / total AS w FROM k1)",
    ]


def _rounds(last: str, rounds: int) -> tuple[list[str], str]:
    """Steps that rake ``last`` for so many rounds, and the last one's name."""
    steps = []
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"r{i + 1}{d[0]}"
            steps.append(f"{name} AS (SELECT source, lang, topic, one, tokens, total, t_source, t_lang, t_topic, w * t_{d} / greatest(sum(w) OVER (PARTITION BY {d}), {_TINY}) AS w FROM {last})")
            last = name
    return steps, last


def _finish(last: str, share: float | None) -> tuple[list[str], str]:
    """Steps from raked cells to probabilities, and the final selection."""
    if share is None:
        steps = [f"g AS (SELECT *, max(w / tokens) OVER (PARTITION BY one) AS top FROM {last})"]
        return steps, "SELECT source, lang, topic, w AS weight, coalesce(w / tokens / nullif(top, 0), 0) AS probability FROM g"
    before = "WINDOW before AS (PARTITION BY one ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    steps = [
        # probabilities are capped at 1; the others make up for what the capped cells lack
        f"o AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY w / tokens DESC, source, lang, topic) AS pos FROM {last})",
        f"s AS (SELECT *, coalesce(sum(tokens) OVER before, 0) AS capped, sum(w) OVER (PARTITION BY one) - coalesce(sum(w) OVER before, 0) AS open_w FROM o {before})",
        f"l AS (SELECT *, (CAST({share} AS DOUBLE) * total - capped) / nullif(open_w, 0) AS factor FROM s)",
        "f AS (SELECT *, min(CASE WHEN factor * w / tokens <= 1 THEN pos END) OVER (PARTITION BY one) AS from_ FROM l)",
        "g AS (SELECT *, max(CASE WHEN pos = from_ THEN factor END) OVER (PARTITION BY one) AS scale FROM f)",
    ]
    return steps, "SELECT source, lang, topic, w AS weight, CASE WHEN w = 0 THEN CAST(0 AS DOUBLE) WHEN from_ IS NULL OR pos < from_ THEN CAST(1 AS DOUBLE) ELSE scale * w / tokens END AS probability FROM g"


def raking_sql(cells: str, alpha: float, share: float | None, rounds: int, given: tuple[str, ...] = ()) -> tuple[list[str], str]:
    """Steps and final selection over ``cells`` (source, lang, topic, tokens) that give each
    cell its raked weight and its probability, as one statement."""
    steps, last = _rounds("r0", rounds)
    end, select = _finish(last, share)
    return [*_start(cells, alpha, given), *steps, *end], select


def raked_in_one_task(cells: DataFrame, alpha: float, share: float | None, rounds: int, given: tuple[str, ...] = ()) -> DataFrame:
    """The statement of :func:`raking_sql`, written every few rounds to keep plans small."""
    sql = lambda steps, select, t: t.sparkSession.sql(f"WITH {', '.join(steps)} {select}", t=t.coalesce(1))
    steps, last, t = _start("{t}", alpha, given), "r0", cells
    while True:
        more, last = _rounds(last, min(rounds, ROUNDS_AT_ONCE))
        t, rounds = written(sql([*steps, *more], f"SELECT * FROM {last}", t), "raking"), rounds - ROUNDS_AT_ONCE
        if rounds <= 0:
            steps, select = _finish("{t}", share)
            return sql(steps, select, t)
        steps, last = [], "{t}"


def raked_by_sums(cells: DataFrame, alpha: float, share: float | None, rounds: int, given: tuple[str, ...] = ()) -> DataFrame:
    """What :func:`raking_sql` gives, for cells that are too many for one task: every sum is an
    aggregate with map-side combine, joined back by broadcast of hot values, and the cells are
    written each round."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d in DIMENSIONS:
        by = cells.groupBy(d).agg(F.first(f"goal_{d}").alias("p") if d in given else F.pow(F.sum("tokens") / F.lit(float(total or 1)), F.lit(float(alpha))).alias("p"))
        goals[d] = written(by, "goals")
        whole = goals[d].agg(F.sum("p")).first()[0] or 1.0
        goals[d] = goals[d].select(F.col(d).alias("node"), (F.col("p") / F.lit(float(whole))).alias("goal"))
    r = written(cells.select(*DIMENSIONS, "tokens", (F.col("tokens") / F.lit(float(total or 1))).alias("w")), "raked")
    for _ in range(rounds):
        for d in DIMENSIONS:
            rate = r.groupBy(F.col(d).alias("node")).agg(F.sum("w").alias("sum")).join(goals[d], "node")
            rate = written(rate.select("node", (F.col("goal") / F.nullif(F.col("sum"), F.lit(0.0))).alias("root")), "rates")
            was, r = r, looked_up(r, d, rate, "rate")
            r = written(r.select(*DIMENSIONS, "tokens", F.coalesce(F.col("w") * F.col("rate"), F.lit(0.0)).alias("w")), "raked")
            drop(cells.sparkSession, was, rate)
    per = F.col("w") / F.col("tokens")
    if share is None:
        scale = 1 / (r.agg(F.max(per)).first()[0] or float("inf"))
    else:  # cells that a scale caps are left out of the next one, until it caps no more
        scale, capped = 0.0, -1
        while True:
            full = F.lit(scale) * per > 1 if capped >= 0 else F.lit(False)
            row = r.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
            if row["n"] == capped or not row["w"]:
                break
            scale, capped = (share * total - row["t"]) / row["w"], row["n"]
    return r.select(*DIMENSIONS, F.col("w").alias("weight"), F.least(F.lit(1.0), F.lit(scale) * per).alias("probability"))


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with _cm_source, _cm_lang, _cm_topic and _cm_tokens (4 bytes a token, one at
    least). A null source or language is a value of its own; a column ``topic`` is used if
    there is one."""
    text = text_or_empty()
    size = F.octet_length(text)
    topic = F.expr(TOPIC.replace("bars", "_cm_bars").replace("digits", "_cm_digits").replace("bytes", "_cm_bytes"))
    d = docs.withColumns({"_cm_bytes": size.cast("long"), "_cm_bars": (size - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))).cast("long"), "_cm_digits": (size - F.octet_length(F.translate(text, "0123456789", ""))).cast("long")})
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) if c in docs.columns else F.lit("(none)")
    d = d.withColumns({"_cm_source": label("source"), "_cm_lang": label("lang"), "_cm_topic": label("topic") if "topic" in docs.columns else topic, "_cm_tokens": F.greatest(F.lit(1), F.ceil(F.col("_cm_bytes") / 4)).cast("long")})
    return d.drop("_cm_bytes", "_cm_bars", "_cm_digits")


def uniform(docs: DataFrame, seed: int) -> Column:
    """A number in [0, 1) for each document from its id, or its text where it has none."""
    key = F.concat(F.lit(f"mix{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(text_or_empty(), "UTF-8"))))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def raked_cells(d: DataFrame, alpha: float, share: float | None, rounds: int, targets: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, bool]:
    """The cells of :func:`described` documents with tokens, weight and probability, and
    whether they are few enough to be broadcast."""
    cells = written(d.groupBy("_cm_source", "_cm_lang", "_cm_topic").agg(F.sum("_cm_tokens").alias("tokens")), "cells")
    few = cells.count() <= MOST_BROADCAST
    small = cells.select(F.col("_cm_source").alias("source"), F.col("_cm_lang").alias("lang"), F.col("_cm_topic").alias("topic"), "tokens")
    given = tuple(x for x in DIMENSIONS if x in (targets or {}))
    for x in given:
        goal = F.coalesce(*(F.when(F.col(x) == v, F.lit(float(w))) for v, w in targets[x].items()), F.lit(0.0)) if targets[x] else F.lit(0.0)
        small = small.withColumn(f"goal_{x}", goal)
    if few:  # every window of the raking is in one task
        raked = raked_in_one_task(small, alpha, share, rounds, given)
    else:
        raked = raked_by_sums(small, alpha, share, rounds, given)
    return written(raked.join(small.select(*DIMENSIONS, "tokens"), list(DIMENSIONS)), "raked"), few


def marginals(docs: DataFrame, alpha: float = 0.5, share: float | None = None, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """How far the sample is from its targets: dimension, value, share of tokens there are,
    raked (share after the last round) and kept (share of the kept tokens in expectation);
    raked and kept differ where probabilities are capped, and raked is the target if the
    rounds sufficed."""
    raked, _ = raked_cells(described(docs), alpha, share, rounds, targets)
    rows = raked.select(F.explode(F.array(*(F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in DIMENSIONS))).alias("d"), "tokens", "weight", (F.col("probability") * F.col("tokens")).alias("kept"))
    sums = rows.groupBy("d.dimension", "d.value").agg(*(F.sum(c).alias(c) for c in ("tokens", "weight", "kept")))
    whole = raked.agg(F.sum("tokens").alias("all_t"), F.sum("weight").alias("all_w"), F.sum(F.col("probability") * F.col("tokens")).alias("all_k"))
    return sums.crossJoin(F.broadcast(whole)).select("dimension", "value", (F.col("tokens") / F.col("all_t")).alias("there"), (F.col("weight") / F.nullif("all_w", F.lit(0.0))).alias("raked"), (F.col("kept") / F.nullif("all_k", F.lit(0.0))).alias("kept"))


def sample_mixture(docs: DataFrame, alpha: float = 0.5, share: float | None = None, rounds: int = ROUNDS, seed: int = 1, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, and _cm_source, _cm_lang, _cm_topic,
    _cm_tokens, _cm_weight (the cell's raked share of tokens) and _cm_probability.

    ``targets`` gives weights by value for any of source, lang and topic, as in
    ``{"lang": {"en": 3, "de": 1}}``; values that it leaves out are not kept at all. For the
    other dimensions target shares are in proportion to tokens to the power ``alpha``. The
    sample is the largest that meets the targets, or with ``share`` that share of all tokens in
    expectation; where this needs a probability over 1, cells are capped and kept tokens miss
    the targets (see :func:`marginals`).

    A null text has one token; a null source or language is the value "(none)". Tied cells have
    equal probabilities. Rows that repeat an id are kept or dropped together; rows without an
    id by their text. An empty table gives an empty result. Texts are only measured.
    """
    d = described(docs)
    raked, few = raked_cells(d, alpha, share, rounds, targets)
    raked = raked.select(*(F.col(c).alias(f"_cm_{c}") for c in (*DIMENSIONS, "weight", "probability")))
    raked = F.broadcast(raked) if few else raked
    kept = d.withColumn("_cm_u", uniform(docs, seed)).join(raked, ["_cm_source", "_cm_lang", "_cm_topic"])
    return kept.where("_cm_u < _cm_probability").drop("_cm_u")


def mixture(docs: DataFrame, alpha: float = 0.5, share: float | None = None, rounds: int = ROUNDS, seed: int = 1, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight and probability of the sampled rows; see
    :func:`sample_mixture`."""
    kept = sample_mixture(docs, alpha, share, rounds, seed, targets)
    return kept.select("doc_id", F.col("_cm_source").alias("source"), F.col("_cm_lang").alias("lang"), F.col("_cm_topic").alias("topic"), F.col("_cm_tokens").alias("tokens"), F.round("_cm_weight", 9).alias("weight"), F.round("_cm_probability", 9).alias("probability"))


def mixture_sql(alpha: float = 0.5, share: float | None = None, rounds: int = ROUNDS, seed: int = 1) -> str:
    """The same rows in DuckDB's SQL."""
    d = f"""d AS (SELECT *, {TOPIC} AS topic, greatest(1, CAST(ceil(bytes / 4.0) AS BIGINT)) AS tokens FROM (
      SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, strlen(coalesce(text, '')) AS bytes,
      strlen(coalesce(text, '')) - strlen(replace(coalesce(text, ''), '|', '')) AS bars,
      strlen(coalesce(text, '')) - strlen(translate(coalesce(text, ''), '0123456789', '')) AS digits,
      CAST('0x' || substr(md5('mix{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8) AS UBIGINT) / 4294967296.0 AS u
      FROM documents) q)"""
    steps, select = raking_sql("cells", alpha, share, rounds)
    return f"""WITH {d}, cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
      {', '.join(steps)}, raked AS ({select})
      SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(weight, 9) AS weight, round(probability, 9) AS probability
      FROM d JOIN raked ON d.source = raked.source AND d.lang = raked.lang AND d.topic = raked.topic WHERE u < probability"""
