from lociframe.plans.cohort import analysis_files, dna_batch, dna_scores, rna_batch, rna_scores, union_scores
from lociframe.plans.concordance import concordance, discrepant
from lociframe.plans.replicates import ReplicateSets, write_replicates
from lociframe.plans.reports import eligible_reports, report_rollup
from lociframe.plans.results import final_call, gene_level, gene_level_from_raw, hrd_calls, order_level
from lociframe.plans.training import training_examples

__all__ = [
    "ReplicateSets",
    "analysis_files",
    "concordance",
    "discrepant",
    "dna_batch",
    "dna_scores",
    "eligible_reports",
    "final_call",
    "gene_level",
    "gene_level_from_raw",
    "hrd_calls",
    "order_level",
    "report_rollup",
    "rna_batch",
    "rna_scores",
    "training_examples",
    "union_scores",
    "write_replicates",
]
