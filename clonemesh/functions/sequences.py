"""Column functions over receptor sequences and genes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty residues, and the patterns of a valid CDR3 and gene.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
CDR3_PATTERN = "(?i)^C[A-Z]{3,}[FW]$"
GENE_PATTERN = r"(?i)^TR[AB][VDJ]\d+(-\d+)?$"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def blank_to_null(c: Column, as_null: tuple[str, ...] = ("",)) -> Column:
    return let(F.trim(c.cast("string")), lambda t: F.when(~t.isin(*as_null), t))


def number(c: Column, kind: str = "double") -> Column:
    """Numeric value of a text, null where it is none."""
    return F.expr("NULL").cast(kind) if c is None else c.cast("string").try_cast(kind)


def valid_cdr3(c: Column) -> Column:
    return c.rlike(CDR3_PATTERN)


def valid_gene(c: Column) -> Column:
    return c.rlike(GENE_PATTERN)


def basic_cdr3(c: Column) -> Column:
    """At least five letters and nothing else."""
    return F.coalesce((F.length(c) >= 5) & c.rlike(r"^\p{L}+$"), F.lit(False))


def trim_cdr3(c: Column) -> Column:
    """Without one leading C and one trailing F, W or Y."""
    return F.regexp_replace(F.regexp_replace(c, "^C", ""), "[FWY]$", "")


def with_allele(c: Column, allele: str = "*01") -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.when((t != "") & (F.instr(t, "*") == 0), F.concat(t, F.lit(allele))).otherwise(t)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two texts of one length; null for different lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)))


def masks(c: Column) -> Column:
    """The text with each one of its positions hidden: texts of one length share a mask if
    and only if they differ in one position at most."""
    n = F.length(c)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("*"), F.substring(c, i + 1, n)))


def deletions(c: Column) -> Column:
    """The text and it without each one of its characters: texts at edit distance one or less
    share at least one of these."""
    n = F.length(c)
    gone = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), gone))


def segments(c: Column, parts: int) -> Column:
    """(position, text) of ``parts`` pieces of nearly equal length: texts of one length with
    fewer than ``parts`` mismatches agree in one piece at least."""
    n = F.length(c)
    cut = lambda i: F.floor(n * i / parts).cast("int")
    return F.array(*(F.struct(F.lit(i).alias("at"), F.substring(c, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(parts)))


def logistic(z: Column) -> Column:
    return F.when(z >= 50, F.lit(1.0)).when(z <= -50, F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


# Substitution scores of the 20 residues, lower triangle. It is BLOSUM62 but
# for ten pairs, which have the values of the results to match.
SCORES = """
   A  R  N  D  C  Q  E  G  H  I  L  K  M  F  P  S  T  W  Y  V
A  4
R -1  5
N -2 -2  6
D -2 -3  1  6
C  0 -3 -3 -3  9
Q -1  1  0 -1 -3  5
E -1  0 -1  3 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  0 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  9
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -3 -1  0 -3 -1  4
"""


def default_scores() -> dict[tuple[str, str], int]:
    """SCORES both ways round; letters other than the 20 residues have none."""
    return symmetric(parse_scores(SCORES.splitlines()))


def symmetric(scores: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    return {(b, a): v for (a, b), v in scores.items()} | scores


def parse_scores(lines: Iterable[str]) -> dict[tuple[str, str], int]:
    """A substitution matrix in the common text format: # comments, a row of letters, then a
    row for each letter."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    head, *rest = rows or [[]]
    return {(r[0], b): int(v) for r in rest for b, v in zip(head, r[1:])}


def read_score_table(path: str) -> dict[tuple[str, str], int]:
    with open(path) as f:
        return parse_scores(f)


def substitution_score(a: Column, b: Column, scores: dict[tuple[str, str], int], missing: int = -4) -> Column:
    """Mean score over the positions that both texts have; 0 if there are none."""
    table = F.create_map(*(F.lit(x) for (p, q), v in sorted(scores.items()) for x in (p + q, float(v))))
    n = F.least(F.length(a), F.length(b))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at(table, F.concat(F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1)))), F.try_element_at(table, F.concat(F.substring(b, i, F.lit(1)), F.substring(a, i, F.lit(1)))), F.lit(float(missing))))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n)


def shared_genes(v_a: Column, v_b: Column, j_a: Column, j_b: Column) -> Column:
    """Half for an equal V gene and half for an equal J gene; blanks are never equal."""
    half = lambda x, y: F.when((x != "") & (x == y), 0.5).otherwise(0.0)
    return half(v_a, v_b) + half(j_a, j_b)


def noise_significance(p: Column, cap: float = 3.0) -> Column:
    return F.when(p <= 0, F.lit(1.0)).otherwise(F.least(-F.log10(p) / cap, F.lit(1.0)))


def sequence_similarity(a: Column, b: Column, distance: Column | None, scores: dict, tau: float = 50.0) -> Column:
    """exp(-distance / tau) where a distance is known, else a logistic map of the mean
    substitution score, centred at 2 with scale 3."""
    by_score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(substitution_score(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), scores) - 2.0) / 3.0))
    if distance is None:
        return by_score
    return F.when(distance >= 0, F.exp(-distance / tau)).otherwise(by_score)


# Default coefficients of the fused score.
BETAS = {"vote": 1.0, "seq": 0.8, "vj": 0.4, "noise": 0.6}


def fused_score(vote: Column, seq: Column, vj: Column, noise: Column, betas: dict | None = None, intercept: float = 0.0, signals: tuple[str, ...] = ("vote", "seq", "vj", "noise")) -> Column:
    z = F.lit(float(intercept))
    for name, c in (("vote", vote), ("seq", seq), ("vj", vj), ("noise", noise)):
        if name in signals:
            z = z + F.lit(float((betas or BETAS)[name])) * c
    return logistic(z)
