"""The canonical receptor table, its enumerations, and the contracts between stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

#: Columns of the canonical table in their fixed order.
CANONICAL = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("tcr_id", "chain_mode", "cdr3_alpha", "cdr3_beta", "v_alpha", "j_alpha", "v_beta", "j_beta", "subject_id", "sample_id", "epitope", "hla")]
    + [T.StructField("count", T.LongType()), T.StructField("frequency", T.DoubleType()), T.StructField("source_dataset", T.StringType())]
)
#: Row order of the input; operators whose result depends on order use it.
ORD = "ord"
ASSIGNMENTS = "method string, tcr_id string, cluster_id string, membership_score double"
LABELS = "tcr_id string, epitope string"


# The texts of the enumerations below.
class _Text(str, Enum):
    def __str__(self) -> str:
        return self.value


class ChainMode(_Text):
    ALPHA_ONLY = "alpha_only"
    BETA_ONLY = "beta_only"
    PAIRED_AB = "paired_ab"


class RepertoireType(_Text):
    BULK = "bulk"
    SINGLE_CELL = "single_cell"
    ANTIGEN_ENRICHED = "antigen_enriched"
    CURATED_DB = "curated_db"


class Objective(_Text):
    HIGH_PURITY = "high_purity"
    BALANCED = "balanced"
    HIGH_RECALL = "high_recall"
    NOISE_ROBUST = "noise_robust"
    FAST_SCREENING = "fast_screening"
    PAIRED_CHAIN = "paired_chain_analysis"


class ConsensusMode(_Text):
    CONSERVATIVE = "conservative"
    BALANCED = "balanced"
    COVERAGE = "coverage"


class MemberLabel(_Text):
    CORE = "core"
    PERIPHERAL = "peripheral"
    LOW_CONFIDENCE = "low_confidence"


class MethodStatus(_Text):
    SUCCESS = "success"
    FAILED = "failed"
    SKIPPED = "skipped"


@dataclass
class DatasetProfile:
    n_tcrs: int = 0
    chain_mode: str = ChainMode.BETA_ONLY.value
    cdr3_length_summary: dict[str, float] = field(default_factory=dict)
    vj_completeness: float = 0.0
    unique_ratio: float = 0.0
    clone_expansion: float = 0.0
    publicity_score: float = 0.0
    background_noise_score: float = 0.5
    label_availability: bool = False
    repertoire_type: str = RepertoireType.BULK.value
    notes: list[str] = field(default_factory=list)


@dataclass
class RunPlan:
    objective: str
    selected_methods: list[str]
    consensus_mode: str = ConsensusMode.BALANCED.value
    use_tiered: bool = True
    method_params: dict = field(default_factory=dict)
    weighting_profile: str = "balanced"
    refinement_params: dict = field(default_factory=dict)
    reporting_flags: dict = field(default_factory=dict)
