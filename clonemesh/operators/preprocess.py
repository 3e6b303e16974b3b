"""Normalising, filtering, cleaning, validating and deduplicating receptor tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import RESIDUES, basic_cdr3, blank_to_null, let, number, valid_cdr3, valid_gene
from ..schema import CANONICAL, ORD, ChainMode

NULLS = ("", "NA", "na", "N/A", "nan", "None")


def with_order(df: DataFrame, key: Column | None = None) -> DataFrame:
    """``ord``: the row's place in the input, unless the table has it."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id() if key is None else key)


def dense_order(df: DataFrame) -> DataFrame:
    """``ord``: 0, 1, 2 ... in the order of the input, unless the table has it. Rows are
    counted by partition first, one row for each of which is broadcast; the input must come
    in the same partitions both times, as files do."""
    if ORD in df.columns:
        return df
    d = df.withColumn("_m", F.monotonically_increasing_id())
    d = d.withColumns({"_p": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = d.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    return d.join(F.broadcast(before), "_p").withColumn(ORD, F.col("_before") + F.col("_m")).drop("_p", "_m", "_before")


def made_id(n: Column) -> Column:
    """``tcr_000001`` and so on; longer numbers keep all their digits."""
    return F.format_string("tcr_%06d", n)


def _any_set(*cols: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in cols))


def chain_mode(df: DataFrame) -> str:
    """One value for the data set, from which CDR3 columns hold anything."""
    has = {c: c in df.columns for c in ("cdr3_alpha", "cdr3_beta")}
    row = df.agg(*(F.max(blank_to_null(F.col(c)).isNotNull()).alias(c) for c, h in has.items() if h)).first() if any(has.values()) else None
    a, b = (bool(row and c in row.asDict() and row[c]) for c in ("cdr3_alpha", "cdr3_beta"))
    return (ChainMode.PAIRED_AB if a and b else ChainMode.ALPHA_ONLY if a else ChainMode.BETA_ONLY).value


def normalize(df: DataFrame, keep_extra: bool = False, empty_as_null: bool = True, mode: str | None = None) -> DataFrame:
    """The canonical table: trimmed texts, generated ids, counts and frequencies as numbers
    (bad counts are 1), one chain mode, no rows without a CDR3, all canonical columns."""
    df = with_order(df) if "tcr_id" in df.columns else dense_order(df)
    as_null = NULLS if empty_as_null else ("nan", "None")
    texts = [f.name for f in CANONICAL if f.dataType.typeName() == "string"]
    cols: dict[str, Column] = {c: blank_to_null(F.col(c), as_null) if c in df.columns else F.lit(None).cast("string") for c in texts}
    cols["count"] = F.coalesce(F.floor(number(F.col("count"))).cast("long"), F.lit(1).cast("long")) if "count" in df.columns else F.lit(1).cast("long")
    cols["frequency"] = number(F.col("frequency")) if "frequency" in df.columns else F.lit(None).cast("double")
    mode = mode or chain_mode(df)
    cols["tcr_id"] = F.coalesce(cols["tcr_id"], made_id(F.col(ORD)))
    cols["chain_mode"] = F.lit(mode)
    extra = [F.col(c) for c in df.columns if keep_extra and c not in cols and c != ORD]
    out = df.select(*(cols[f.name].alias(f.name) for f in CANONICAL), *extra, F.col(ORD))
    return out.where(_any_set("cdr3_alpha", "cdr3_beta"))


def filter_chain(df: DataFrame, gene: str | None) -> DataFrame:
    """Rows of a chain by the first gene, chain or locus column there is, else by a CDR3."""
    if gene is None:
        return df
    # Columns looked at, in order.
    for c in ("_gene", "Gene", "gene", "chain", "_chain", "locus", "_locus"):
        if c in df.columns:
            return df.where(F.upper(F.col(c)) == gene.upper())
    own = {"TRB": ("cdr3_beta", "CDR3", "CDR3.beta.aa", "cdr3", "cdr3b"), "TRA": ("cdr3_alpha", "CDR3.alpha.aa", "CDR3.alpha")}.get(gene.upper(), ())
    for c in own:
        if c in df.columns:
            return df.where(F.length(F.coalesce(F.col(f"`{c}`"), F.lit(""))) > 0)
    return df


def filter_score(df: DataFrame, min_score: float = 0, column: str | None = None) -> DataFrame:
    """Rows with a score of at least ``min_score``; what is no number is 0."""
    c = column or next((x for x in ("_score", "Score", "score", "quality", "confidence") if x in df.columns), None)
    if min_score <= 0 or c is None:
        return df
    return df.where(F.coalesce(number(F.col(c)), F.lit(0.0)) >= float(min_score))


def cdr3_reason(c: Column, min_length: int = 5, max_length: int = 30, c_start: bool = True, residues: bool = True) -> Column:
    """Why a CDR3 is blanked; null for a good or missing one. The first reason counts."""
    r = F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
    if residues:
        r = r.when(~c.rlike(f"^[{RESIDUES}]+$"), "invalid")
    r = r.when((F.length(c) < min_length) | (F.length(c) > max_length), "length")
    return r.when(~c.startswith("C"), "start") if c_start else r


def clean_cdr3(df: DataFrame, min_length: int = 5, max_length: int = 30, c_start: bool = True, upper: bool = True, residues: bool = True, columns: tuple[str, ...] = ("cdr3_beta", "cdr3_alpha")) -> DataFrame:
    """Blank bad CDR3s (to null), then drop rows without any."""
    have = [c for c in columns if c in df.columns]
    good = lambda v: F.when((v != "") & cdr3_reason(v, min_length, max_length, c_start, residues).isNull(), v)
    df = df.withColumns({c: let(F.upper(F.trim(F.col(c))) if upper else F.col(c), good) for c in have})
    return df.where(_any_set(*have)) if have else df


def cleaning_report(df: DataFrame, columns: tuple[str, ...] = ("cdr3_beta", "cdr3_alpha"), **kw) -> DataFrame:
    """One row: how many values of each column are blanked for each reason."""
    have = [c for c in columns if c in df.columns]
    reason = {c: cdr3_reason(F.upper(F.trim(F.col(c))), **kw) for c in have}
    return df.agg(*(F.count_if(reason[c] == r).alias(f"{c}_{r}") for c in have for r in ("invalid", "length", "start")))


def dedup(df: DataFrame, by: tuple[str, ...] = ("cdr3_beta", "v_beta"), strategy: str = "keep_first") -> DataFrame:
    """One row for each key: the first by ``ord``, or the one with the most filled columns."""
    if strategy not in ("keep_first", "keep_most_complete"):
        raise ValueError(f"unknown strategy {strategy}")
    df = with_order(df)
    by = [c for c in by if c in df.columns]
    if not by:
        return df
    order = [F.col(ORD)]
    if strategy == "keep_most_complete":
        filled = reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "", 1).otherwise(0) for c in df.columns if c != ORD))
        order = [filled.desc(), F.col(ORD)]
    # the best row of a key by an aggregate with map-side combine: a hot key is no hot task
    if strategy == "keep_first":
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        best = df.groupBy(*by).agg(F.min_by(row, F.col(ORD)).alias("row"))
        return best.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


# Keys of the two JSON columns and the columns they become.
META_KEYS = {"subject.id": "subject_id", "cell.subset": "cell_subset", "tissue": "tissue", "subject.cohort": "cohort", "donor.MHC": "donor_mhc"}
FIX_KEYS = {"good": "cdr3_fix_good", "fixNeeded": "cdr3_fix_needed"}


def json_field(c: Column, key: str) -> Column:
    """Text at a key that may hold dots; '' where the JSON is bad or has no value there."""
    return F.coalesce(F.get_json_object(c, f"$['{key}']"), F.lit(""))


def extract_metadata(df: DataFrame, meta: str = "_meta", fix: str = "_cdr3fix", json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Fields of the JSON columns there are; other ones become maps of texts."""
    cols = {}
    for column, keys in ((meta, META_KEYS), (fix, FIX_KEYS)):
        if column in df.columns:
            for k, name in keys.items():
                got = json_field(F.col(column), k)
                cols[name] = F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)).otherwise(got) if name in df.columns else got
    cols |= {f"{c}_map": F.from_json(F.col(c), "map<string,string>") for c in json_columns if c in df.columns}
    return df.withColumns(cols) if cols else df


def validate(df: DataFrame) -> DataFrame:
    """``df`` with errors array<string>: what is wrong with a canonical row."""
    beta, alpha = F.col("chain_mode").isin("beta_only", "paired_ab"), F.col("chain_mode").isin("alpha_only", "paired_ab")
    rules = [(F.coalesce(F.col("tcr_id"), F.lit("")) == "", "tcr_id is required")]
    for chain, need in (("beta", beta), ("alpha", alpha)):
        c = F.coalesce(F.col(f"cdr3_{chain}"), F.lit(""))
        rules.append((need & (c == ""), f"cdr3_{chain} is required"))
        rules.append(((c != "") & ~valid_cdr3(c), f"cdr3_{chain} is not valid"))
        for g in "vj":
            x = F.coalesce(F.col(f"{g}_{chain}"), F.lit(""))
            rules.append(((x != "") & ~valid_gene(x), f"{g}_{chain} is not valid"))
    rules += [(F.col("count") < 1, "count must be at least 1"), ((F.col("frequency") < 0) | (F.col("frequency") > 1), "frequency must be between 0 and 1")]
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules))))


def basic_check(df: DataFrame, column: str = "cdr3_beta") -> DataFrame:
    return df.withColumn("basic_ok", basic_cdr3(F.col(column)))


def keep_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    if "tcr_id" not in df.columns:
        raise ValueError("tcr_id is missing")
    return df.join(ids.select("tcr_id").distinct(), "tcr_id", "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("tcr_id").distinct(), "tcr_id", "left_anti")


def min_pairs_per_label(df: DataFrame, key: tuple[str, ...] = ("cdr3_alpha", "cdr3_beta"), label: str = "epitope", least: int = 2) -> DataFrame:
    """Rows whose label has at least ``least`` distinct pairs."""
    good = df.groupBy(label).agg(F.count_distinct(F.struct(*key)).alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(good, label, "left_semi")


def benchmark_rows(df: DataFrame, min_verified: float = 2, min_identification: float = 4.3, lengths: tuple[int, int] = (6, 23), bad_publications: tuple[str, ...] = (), cd8_only: bool = False, drop_pairs: DataFrame | None = None) -> DataFrame:
    """The filter chain of a benchmark from a pooled database: scores, label, publication,
    optional CD8 subset, four genes, CDR3 lengths, labels with two pairs, dedup, ids from 1."""
    df = with_order(df)
    ok = (F.col("Verified_score").try_cast("double") == min_verified) & (F.col("Identification_score").try_cast("double") > min_identification) & F.col("Epitope").isNotNull()
    if bad_publications:
        ok &= ~F.coalesce(F.col("PubMed_ID"), F.lit("")).isin(*bad_publications)
    if cd8_only:
        ok &= F.col("Cell_subset") == "CD8"
    for c in ("V_alpha", "J_alpha", "V_beta", "J_beta"):
        ok &= F.col(c).isNotNull()
    for c in ("CDR3_alpha", "CDR3_beta"):
        ok &= F.length(c).between(*lengths)
    rows = min_pairs_per_label(df.where(ok), ("CDR3_alpha", "CDR3_beta"), "Epitope")
    rows = dedup(rows, tuple(c for c in df.columns if c in ("V_alpha", "CDR3_alpha", "J_alpha", "V_beta", "CDR3_beta", "J_beta", "Epitope", "Antigen_organism", "PubMed_ID", "Cell_subset")))
    if drop_pairs is not None:
        rows = rows.join(drop_pairs.select("CDR3_alpha", "CDR3_beta"), ["CDR3_alpha", "CDR3_beta"], "left_anti")
    return sequential_ids(rows)


def sequential_ids(df: DataFrame, start: int = 1, column: str = "tcr_id") -> DataFrame:
    """``tcr_000001`` and so on by ``ord``: ranks within range partitions plus the rows of the
    partitions before, so the table is never in one task."""
    placed = df.repartitionByRange(F.col(ORD)).withColumn("_p", F.spark_partition_id())
    from ..storage import written

    placed = written(placed, "ranged")
    sizes = placed.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    w = Window.partitionBy("_p").orderBy(ORD)
    ranked = placed.join(F.broadcast(before), "_p").withColumn("_n", F.col("_before") + F.row_number().over(w) - 1 + start)
    return ranked.withColumn(column, made_id(F.col("_n"))).drop("_p", "_before", "_n")


def cdr3_list(df: DataFrame) -> DataFrame:
    """Distinct CDR3s of both chains, sorted."""
    cols = [c for c in ("cdr3_alpha", "cdr3_beta") if c in df.columns]
    both = reduce(DataFrame.union, (df.select(F.col(c).alias("cdr3")) for c in cols))
    return both.where("cdr3 is not null and cdr3 <> ''").distinct().orderBy("cdr3")


def step_report(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, rows) of named intermediate tables, as one plan."""
    return reduce(DataFrame.union, (d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("step"), "rows") for n, d in steps))


def to_records(df: DataFrame) -> Iterator[dict]:
    """The canonical columns of each row as a dict, in a stream: blank texts are None, counts
    numbers of at least the default 1, frequencies numbers or None, chain modes of the
    enumeration. Rows come a partition at a time, so the table need not fit the driver."""
    texts = [f.name for f in CANONICAL if f.dataType.typeName() == "string"]
    cols = {c: blank_to_null(F.col(c), ("", "nan", "None")) if c in df.columns else F.lit(None).cast("string") for c in texts}
    cols["chain_mode"] = F.coalesce(cols["chain_mode"], F.lit(ChainMode.BETA_ONLY.value))
    cols["count"] = F.coalesce(F.floor(number(F.col("count"))).cast("long"), F.lit(1).cast("long")) if "count" in df.columns else F.lit(1).cast("long")
    cols["frequency"] = number(F.col("frequency")) if "frequency" in df.columns else F.lit(None).cast("double")
    for row in df.select(*(cols[f.name].alias(f.name) for f in CANONICAL)).toLocalIterator():
        d = row.asDict()
        yield d | {"tcr_id": d["tcr_id"] or "", "chain_mode": ChainMode(d["chain_mode"])}
