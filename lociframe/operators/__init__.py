from lociframe.operators.aggregates import (
    agreement_table,
    best_checkpoint,
    latest_version,
    missing_keys,
    notes_rollup,
    overfit_onset,
    trainable_share,
)
from lociframe.operators.alleles import match_variants, normal_alleles, normalise, vaf_gap
from lociframe.operators.answers import answer_slots, example_scores, parse_answers, slot_scores
from lociframe.operators.genes import (
    HitRules,
    add_hits,
    gene_flags,
    gene_losses,
    gene_table,
    hit_summary,
    hrd_cohort,
    variant_summary,
)
from lociframe.operators.genome import LossRules, arm_shares, gwloh_exclusive, gwloh_inclusive, lost_arms
from lociframe.operators.joins import default_category, filter_in, natural_join, threshold_lookup
from lociframe.operators.ordering import batch_plan, every_k, global_ordinal, row_at
from lociframe.operators.overlap import overlap_join
from lociframe.operators.replicates import exact_medians, fold_samples, normalize_replicates, precision, size_factors
from lociframe.operators.scoring import (
    abundance_matrix,
    normalize_abundance,
    score_batches,
    score_groups,
    weighted_score,
)
from lociframe.operators.segments import resolve_segments
from lociframe.operators.sweep import sweep_join
from lociframe.operators.text import build_vocab, check_answer, check_examples, encode, few_shot

__all__ = [
    "HitRules",
    "LossRules",
    "abundance_matrix",
    "add_hits",
    "agreement_table",
    "answer_slots",
    "arm_shares",
    "batch_plan",
    "best_checkpoint",
    "build_vocab",
    "check_answer",
    "check_examples",
    "default_category",
    "encode",
    "every_k",
    "example_scores",
    "exact_medians",
    "few_shot",
    "filter_in",
    "fold_samples",
    "gene_flags",
    "gene_losses",
    "gene_table",
    "global_ordinal",
    "gwloh_exclusive",
    "gwloh_inclusive",
    "hit_summary",
    "hrd_cohort",
    "latest_version",
    "missing_keys",
    "lost_arms",
    "match_variants",
    "natural_join",
    "normal_alleles",
    "normalise",
    "normalize_abundance",
    "normalize_replicates",
    "notes_rollup",
    "overfit_onset",
    "overlap_join",
    "parse_answers",
    "precision",
    "resolve_segments",
    "row_at",
    "score_batches",
    "score_groups",
    "size_factors",
    "slot_scores",
    "sweep_join",
    "threshold_lookup",
    "trainable_share",
    "vaf_gap",
    "variant_summary",
    "weighted_score",
]
