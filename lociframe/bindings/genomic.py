"""Queries for the genomic result tables and the cohort scores."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from lociframe.bindings.inputs import Tables
from lociframe.bindings.registry import query
from lociframe.operators.alleles import match_variants, vaf_gap
from lociframe.operators.genes import (
    HIT_FLAGS,
    add_hits,
    add_reportable,
    gene_flags,
    gene_losses,
    gene_table,
    hrd_cohort,
    order_table,
    pathogenic_count,
    variant_summary,
)
from lociframe.operators.genome import LossRules, gwloh_exclusive, gwloh_inclusive, lost_arms
from lociframe.operators.joins import default_category
from lociframe.operators.overlap import overlap_join
from lociframe.operators.segments import resolve_segments
from lociframe.operators.sweep import sweep_join
from lociframe.operators.scoring import abundance_matrix, normalize_abundance, score_groups, weighted_score
from lociframe.plans.cohort import DEFAULT_COHORT, dna_batch, dna_scores, rna_batch, rna_scores, union_scores
from lociframe.plans.replicates import write_replicates
from lociframe.plans.results import gene_level, gene_level_from_raw, hrd_calls, order_level
from lociframe.session import shared_dir
from lociframe.sources import read_csv, write_csv, write_file_per_key

# the segments of v_segments don't overlap; those of v_overlapping, and of files, are resolved
RULES = LossRules(loh_reportable=0.8, deep_loss_reportable=0.8, resolve_overlaps=False)
METRIC = "dna_gwloh"
RNA_THRESHOLD = 50.0
SEGMENT_FILE = "chrom INT, seg_start BIGINT, seg_end BIGINT, total_cn INT, minor_cn INT"
EVENT_GENES = ("click", "error", "purchase", "signup", "view")

# -- reference SQL, layer by layer

IS_LOH = "minor_cn = 0 AND total_cn > 0"
SQL_INCLUSIVE = f"""
 SELECT analysis_id, CAST(SUM(CASE WHEN {IS_LOH} THEN seg_end - seg_start ELSE 0 END) AS DOUBLE)
  / SUM(seg_end - seg_start) AS inclusive FROM v_segments WHERE chrom BETWEEN 1 AND 22 GROUP BY analysis_id"""
SQL_ARMS = f"""
 SELECT s.analysis_id, s.chrom, a.arm,
  SUM(LEAST(seg_end, arm_end) - GREATEST(seg_start, arm_start)) AS bp,
  SUM(CASE WHEN {IS_LOH} THEN LEAST(seg_end, arm_end) - GREATEST(seg_start, arm_start) ELSE 0 END) AS loh
 FROM v_segments s JOIN v_arms a ON s.chrom = a.chrom AND seg_start < arm_end AND arm_start < seg_end
 WHERE s.chrom BETWEEN 1 AND 22 GROUP BY 1, 2, 3"""
SQL_EXCLUSIVE = f"""
 SELECT analysis_id, CAST(SUM(CASE WHEN CAST(loh AS DOUBLE) / bp >= 0.9 THEN 0 ELSE loh END) AS DOUBLE) / SUM(bp) AS exclusive,
  CAST(SUM(CASE WHEN CAST(loh AS DOUBLE) / bp >= 0.9 THEN 1 ELSE 0 END) AS INTEGER) AS lost
 FROM ({SQL_ARMS}) arms GROUP BY analysis_id"""


def _sql_pairs(genes: str) -> str:
    return f"""
 SELECT s.analysis_id, s.chrom, s.seg_start, s.total_cn, s.minor_cn, g.gene, gene_end - gene_start AS gene_bp,
  LEAST(seg_end, gene_end) - GREATEST(seg_start, gene_start) AS overlap_bp
 FROM v_segments s JOIN {genes} g ON s.chrom = g.chrom AND seg_start < gene_end AND gene_start < seg_end"""


SQL_LOSSES = f"""
 SELECT analysis_id, gene,
  CAST(SUM(CASE WHEN {IS_LOH} THEN overlap_bp ELSE 0 END) AS DOUBLE) / MAX(gene_bp) AS loh_proportion,
  CAST(SUM(CASE WHEN total_cn = 0 THEN overlap_bp ELSE 0 END) AS DOUBLE) / MAX(gene_bp) AS deep_loss_proportion,
  CAST(SUM(CASE WHEN total_cn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS deep_loss_probes
 FROM ({_sql_pairs('v_panel')}) pairs GROUP BY analysis_id, gene"""


def _counted(origin: str, classification: str) -> str:
    return (
        f"CAST(SUM(CASE WHEN alteration = 'short' AND origin = '{origin}' AND classification = '{classification}'"
        f" THEN 1 ELSE 0 END) AS BIGINT) AS {origin}_{classification}_count"
    )


SQL_VARIANTS = f"""
 SELECT analysis_id, gene, {_counted('somatic', 'pathogenic')}, {_counted('germline', 'pathogenic')},
  {_counted('somatic', 'vus')}, {_counted('germline', 'vus')},
  MAX(CASE WHEN alteration = 'loh' THEN 1 ELSE 0 END) AS loh_reported,
  MAX(CASE WHEN alteration = 'deep_loss' THEN 1 ELSE 0 END) AS deep_loss_reported,
  ROUND(MAX(CASE WHEN alteration = 'short' AND origin = 'germline' THEN somatic_vaf - germline_vaf END), 6) AS vaf_difference
 FROM v_variants GROUP BY analysis_id, gene"""
SQL_GENES = f"""
 SELECT a.analysis_id, a.order_id, g.gene,
  COALESCE(v.somatic_pathogenic_count, 0) AS somatic_pathogenic_count,
  COALESCE(v.germline_pathogenic_count, 0) AS germline_pathogenic_count,
  COALESCE(v.somatic_vus_count, 0) AS somatic_vus_count,
  COALESCE(v.germline_vus_count, 0) AS germline_vus_count,
  COALESCE(v.loh_reported, 0) AS loh_reported,
  CASE WHEN COALESCE(l.loh_proportion, 0) >= 0.8 THEN 1 ELSE 0 END AS loh_reportable,
  COALESCE(l.loh_proportion, 0) AS loh_proportion, v.vaf_difference,
  COALESCE(v.deep_loss_reported, 0) AS deep_loss_reported,
  CASE WHEN COALESCE(l.deep_loss_proportion, 0) >= 0.8 AND l.deep_loss_probes >= 1 THEN 1 ELSE 0 END AS deep_loss_reportable,
  COALESCE(l.deep_loss_proportion, 0) AS deep_loss_proportion,
  COALESCE(l.deep_loss_probes, 0) AS deep_loss_probes,
  CAST(g.interested AS INTEGER) AS interested_gene, a.cancer_cohort
 FROM v_analyses a CROSS JOIN (SELECT * FROM v_panel WHERE reported) g
 LEFT JOIN ({SQL_LOSSES}) l ON l.analysis_id = a.analysis_id AND l.gene = g.gene
 LEFT JOIN ({SQL_VARIANTS}) v ON v.analysis_id = a.analysis_id AND v.gene = g.gene"""
PATHOGENIC = "somatic_pathogenic_count + germline_pathogenic_count"
SQL_HITS = f"""
 SELECT *,
  CASE WHEN loh_reportable = 1 OR somatic_vus_count + germline_vus_count > 0 OR {PATHOGENIC} >= 1 THEN 1 ELSE 0 END AS single_hit,
  CASE WHEN {PATHOGENIC} + loh_reportable >= 2 OR deep_loss_reportable = 1 THEN 1 ELSE 0 END AS double_hit
 FROM ({SQL_GENES}) genes"""
SQL_ORDER_HITS = f"""
 SELECT analysis_id, order_id, cancer_cohort, CAST(SUM({PATHOGENIC}) AS BIGINT) AS pathogenic_var_count,
  bool_or(single_hit = 1 AND interested_gene = 1) AS single_hit_interested_genes,
  bool_or(double_hit = 1 AND interested_gene = 1) AS double_hit_interested_genes,
  bool_or(single_hit = 1) AS single_hit_reported_genes,
  bool_or(double_hit = 1) AS double_hit_reported_genes
 FROM ({SQL_HITS}) hits GROUP BY 1, 2, 3"""
SQL_COHORT = """CASE WHEN double_hit_interested_genes THEN 'positive' WHEN single_hit_interested_genes THEN 'intermediate'
 WHEN NOT double_hit_reported_genes THEN 'negative' END AS hrd_cohort"""
SQL_ORDERS = f"""
 SELECT h.order_id, h.cancer_cohort, i.inclusive AS genome_wide_loh_proportion_inclusive,
  e.exclusive AS genome_wide_loh_proportion_exclusive, e.lost AS lost_chromosome_arms_count, h.pathogenic_var_count,
  h.single_hit_interested_genes, h.double_hit_interested_genes, h.single_hit_reported_genes, h.double_hit_reported_genes,
  {SQL_COHORT}
 FROM ({SQL_ORDER_HITS}) h LEFT JOIN ({SQL_INCLUSIVE}) i ON h.analysis_id = i.analysis_id
 LEFT JOIN ({SQL_EXCLUSIVE}) e ON h.analysis_id = e.analysis_id"""
SQL_META = """
 SELECT analysis_id, CASE WHEN cancer_cohort IN (SELECT cancer_cohort FROM v_thresholds) THEN cancer_cohort
  ELSE 'Pan Cancer' END AS cancer_cohort, url, assay, match_type FROM v_analyses"""


def _sql_dna(scores: str, column: str) -> str:
    return f"""
 SELECT m.analysis_id, m.cancer_cohort, m.url, m.assay, m.match_type, t.hrd_metric, t.threshold,
  s.{column} AS hrd_score, 'dna' AS analyte,
  CASE WHEN s.{column} > t.threshold THEN 'Positive' ELSE 'Not Detected' END AS hrd_call
 FROM ({SQL_META}) m LEFT JOIN v_thresholds t ON m.cancer_cohort = t.cancer_cohort AND t.hrd_metric = 'dna_gwloh'
 LEFT JOIN ({scores}) s ON s.analysis_id = m.analysis_id"""


SQL_NORMALIZED = """
 SELECT sample, gene, counts,
  log2(1 + 1000000.0 * counts / NULLIF(SUM(counts) OVER (PARTITION BY sample), 0)) AS normalized FROM v_abundance"""
SQL_RNA_SCORES = f"""
 SELECT n.sample AS sample_id, SUM(n.normalized * w.weight) AS hrd_score
 FROM ({SQL_NORMALIZED}) n JOIN v_weights w ON n.gene = w.gene GROUP BY n.sample"""
SQL_RNA = f"""
 SELECT a.analysis_id, CASE WHEN a.cancer_cohort IN (SELECT cancer_cohort FROM v_thresholds) THEN a.cancer_cohort
   ELSE 'Pan Cancer' END AS cancer_cohort, a.assay, 'rna' AS hrd_metric, CAST(50.0 AS DOUBLE) AS threshold,
  ROUND(s.hrd_score, 6) AS hrd_score, 'rna' AS analyte,
  CASE WHEN s.hrd_score > 50.0 THEN 'Positive' ELSE 'Not Detected' END AS hrd_call
 FROM v_rna_analyses a LEFT JOIN ({SQL_RNA_SCORES}) s ON s.sample_id = a.sample_id"""


# -- LOH shares


@query("gwloh_inclusive", f"SELECT analysis_id, inclusive AS genome_wide_loh_proportion_inclusive FROM ({SQL_INCLUSIVE}) i")
def _(t):
    return gwloh_inclusive(t.v_segments, rules=RULES)


@query("gwloh_exclusive", f"SELECT analysis_id, exclusive AS genome_wide_loh_proportion_exclusive FROM ({SQL_EXCLUSIVE}) e")
def _(t):
    return gwloh_exclusive(t.v_segments, t.v_arms, rules=RULES)


@query("lost_arms", f"SELECT analysis_id, lost AS lost_chromosome_arms_count FROM ({SQL_EXCLUSIVE}) e")
def _(t):
    return lost_arms(t.v_segments, t.v_arms, rules=RULES)


@query("overlap_join", f"SELECT analysis_id, chrom, seg_start, gene, overlap_bp FROM ({_sql_pairs('v_genes')}) pairs")
def _(t):
    pairs = overlap_join(
        t.v_segments, t.v_genes, "chrom", ("seg_start", "seg_end"), ("gene_start", "gene_end")
    )
    return pairs.select("analysis_id", "chrom", "seg_start", "gene", "overlap_bp")


# -- segments that overlap

SQL_RESOLVED = """
 SELECT analysis_id, chrom, pos AS seg_start, next_pos AS seg_end, CAST(lowest // 1000 AS INTEGER) AS total_cn,
  CAST(lowest % 1000 AS INTEGER) AS minor_cn, depth
 FROM (SELECT p.analysis_id, p.chrom, p.pos, p.next_pos, min(s.total_cn * 1000 + s.minor_cn) AS lowest, count(*) AS depth
  FROM (SELECT *, lead(pos) OVER (PARTITION BY analysis_id, chrom ORDER BY pos) AS next_pos
   FROM (SELECT analysis_id, chrom, seg_start AS pos FROM v_overlapping
    UNION SELECT analysis_id, chrom, seg_end AS pos FROM v_overlapping) points) p
  JOIN v_overlapping s ON s.analysis_id = p.analysis_id AND s.chrom = p.chrom AND s.seg_start <= p.pos AND p.next_pos <= s.seg_end
  GROUP BY 1, 2, 3, 4) resolved"""


@query("resolved_segments", SQL_RESOLVED)
def _(t):
    return resolve_segments(t.v_overlapping)


@query("resolved_gwloh", f"""
 SELECT analysis_id, CAST(SUM(CASE WHEN {IS_LOH} THEN seg_end - seg_start ELSE 0 END) AS DOUBLE) / SUM(seg_end - seg_start)
  AS genome_wide_loh_proportion_inclusive FROM ({SQL_RESOLVED}) r WHERE chrom BETWEEN 1 AND 22 GROUP BY analysis_id""")
def _(t):
    return gwloh_inclusive(t.v_overlapping)


@query("resolved_gene_losses", f"""
 WITH b AS (SELECT r.analysis_id, g.gene, total_cn, minor_cn, gene_end - gene_start AS gene_bp,
   LEAST(seg_end, gene_end) - GREATEST(seg_start, gene_start) AS overlap_bp FROM ({SQL_RESOLVED}) r
   JOIN v_panel g ON r.chrom = g.chrom AND seg_start < gene_end AND gene_start < seg_end),
 n AS (SELECT analysis_id, gene, SUM(CASE WHEN total_cn = 0 THEN 1 ELSE 0 END) AS probes FROM v_overlapping o
  JOIN v_panel g ON o.chrom = g.chrom AND seg_start < gene_end AND gene_start < seg_end GROUP BY 1, 2)
 SELECT b.analysis_id, b.gene, CAST(SUM(CASE WHEN {IS_LOH} THEN overlap_bp ELSE 0 END) AS DOUBLE) / MAX(gene_bp) AS loh_proportion,
  CAST(SUM(CASE WHEN total_cn = 0 THEN overlap_bp ELSE 0 END) AS DOUBLE) / MAX(gene_bp) AS deep_loss_proportion,
  CAST(MAX(probes) AS BIGINT) AS deep_loss_probes
 FROM b JOIN n ON n.analysis_id = b.analysis_id AND n.gene = b.gene GROUP BY 1, 2""")
def _(t):
    return gene_losses(t.v_overlapping, t.v_genes)


@query("sweep_join", """
 SELECT analysis_id, s.chrom, seg_start, seg_end, probe, LEAST(seg_end, probe_end) - GREATEST(seg_start, probe_start) AS overlap_bp
 FROM v_overlapping s JOIN v_probes p ON s.chrom = p.chrom AND seg_start < probe_end AND probe_start < seg_end""")
def _(t):
    segments = t.v_overlapping.select("analysis_id", "chrom", "seg_start", "seg_end")
    pairs = sweep_join(segments, t.v_probes, "chrom", ("seg_start", "seg_end"), ("probe_start", "probe_end"))
    return pairs.drop("probe_start", "probe_end")


# -- gene level


@query("pathogenic_count", """
 SELECT analysis_id, CAST(SUM(CASE WHEN alteration = 'short' AND classification = 'pathogenic' THEN 1 ELSE 0 END) AS BIGINT)
  AS pathogenic_var_count FROM v_variants WHERE gene IN (SELECT gene FROM v_genes WHERE reported) GROUP BY analysis_id""")
def _(t):
    return pathogenic_count(t.v_variants, t.v_genes)


@query("gene_variant_counts", f"""
 SELECT analysis_id, gene, somatic_pathogenic_count, germline_pathogenic_count, somatic_vus_count, germline_vus_count
 FROM ({SQL_GENES}) g""")
def _(t):
    table = gene_table(t.v_analyses, t.v_segments, t.v_variants, t.v_genes, loss_rules=RULES)
    return table.select(
        "analysis_id",
        "gene",
        "somatic_pathogenic_count",
        "germline_pathogenic_count",
        "somatic_vus_count",
        "germline_vus_count",
    )


@query("vaf_difference", f"SELECT analysis_id, gene, vaf_difference FROM ({SQL_VARIANTS}) v")
def _(t):
    gap = F.round("vaf_difference", 6).alias("vaf_difference")
    return variant_summary(t.v_variants).select("analysis_id", "gene", gap)


REFERENCE_CHUNK = 80


def _matched(t: Tables):
    return match_variants(t.v_reported_variants, t.v_raw_variants, t.v_reference, REFERENCE_CHUNK, tolerance=2)


@query("matched_variants", """
 SELECT analysis_id, gene, chrom, base + CASE kind WHEN 0 THEN 10 WHEN 3 THEN 60 ELSE 30 END AS pos,
  CASE WHEN quantity <= 45 THEN base + CASE kind WHEN 0 THEN 10 + units % 3 WHEN 3 THEN 58 ELSE 30 + 2 * units END END AS raw_pos,
  CASE WHEN quantity <= 45 THEN CASE kind WHEN 0 THEN units % 3 ELSE 0 END END::BIGINT AS distance
 FROM v_mutations WHERE quantity >= 10""")
def _(t):
    return _matched(t).select("analysis_id", "gene", "chrom", "pos", "raw_pos", "distance")


@query("vaf_from_raw", """
 SELECT analysis_id, gene, ROUND(MAX(CASE WHEN quantity <= 45 THEN somatic_vaf - germline_vaf END), 6) AS vaf_difference
 FROM v_mutations WHERE origin = 'germline' AND quantity >= 10 GROUP BY analysis_id, gene""")
def _(t):
    return vaf_gap(_matched(t)).withColumn("vaf_difference", F.round("vaf_difference", 6))


SQL_RAW_VARIANTS = f"""
 SELECT analysis_id, gene, {_counted('somatic', 'pathogenic')}, {_counted('germline', 'pathogenic')},
  {_counted('somatic', 'vus')}, {_counted('germline', 'vus')}, 0 AS loh_reported, 0 AS deep_loss_reported,
  ROUND(MAX(CASE WHEN origin = 'germline' AND quantity <= 45 THEN somatic_vaf - germline_vaf END), 6) AS vaf_difference
 FROM (SELECT *, 'short' AS alteration, CASE WHEN quantity < 20 THEN 'pathogenic' WHEN quantity < 35 THEN 'vus' ELSE 'benign' END
   AS classification FROM v_mutations WHERE quantity >= 10) reported GROUP BY analysis_id, gene"""


@query("gene_level_from_raw", f"SELECT * EXCLUDE (analysis_id) FROM ({SQL_HITS.replace(SQL_VARIANTS, SQL_RAW_VARIANTS)}) h")
def _(t):
    rows = gene_level_from_raw(
        t.v_analyses, t.v_segments, t.v_reported_variants, t.v_raw_variants, t.v_reference, REFERENCE_CHUNK, t.v_genes, 2, RULES
    )
    return rows.withColumn("vaf_difference", F.round("vaf_difference", 6))


@query("gene_reported", f"SELECT analysis_id, gene, loh_reported, deep_loss_reported FROM ({SQL_VARIANTS}) v")
def _(t):
    return variant_summary(t.v_variants).select("analysis_id", "gene", "loh_reported", "deep_loss_reported")


@query("gene_loh_proportion", f"SELECT analysis_id, gene, loh_proportion FROM ({SQL_LOSSES}) l")
def _(t):
    return gene_losses(t.v_segments, t.v_genes, rules=RULES).select("analysis_id", "gene", "loh_proportion")


@query("gene_deep_loss", f"SELECT analysis_id, gene, deep_loss_proportion, deep_loss_probes FROM ({SQL_LOSSES}) l")
def _(t):
    return gene_losses(t.v_segments, t.v_genes, rules=RULES).select("analysis_id", "gene", "deep_loss_proportion", "deep_loss_probes")


@query("gene_reportable", f"""
 SELECT analysis_id, gene, CASE WHEN loh_proportion >= 0.8 THEN 1 ELSE 0 END AS loh_reportable,
  CASE WHEN deep_loss_proportion >= 0.8 AND deep_loss_probes >= 1 THEN 1 ELSE 0 END AS deep_loss_reportable
 FROM ({SQL_LOSSES}) l""")
def _(t):
    losses = add_reportable(gene_losses(t.v_segments, t.v_genes, rules=RULES), RULES)
    return losses.select("analysis_id", "gene", "loh_reportable", "deep_loss_reportable")


@query("gene_flags", """
 SELECT v.analysis_id, v.gene, v.classification, CASE WHEN g.interested THEN 1 ELSE 0 END AS interested_gene,
  CASE WHEN g.reported THEN 1 ELSE 0 END AS reported_gene
 FROM v_variants v LEFT JOIN v_panel g ON v.gene = g.gene""")
def _(t):
    return gene_flags(t.v_variants.select("analysis_id", "gene", "classification"), t.v_genes)


def _gene_table(t: Tables):
    return gene_table(t.v_analyses, t.v_segments, t.v_variants, t.v_genes, loss_rules=RULES)


def _order_hits(t: Tables):
    """From evidence alone: genes without any add nothing to an order."""
    table = order_table(t.v_analyses, t.v_segments, t.v_arms, t.v_variants, t.v_genes, loss_rules=RULES)
    return table.select("analysis_id", "order_id", "cancer_cohort", "pathogenic_var_count", *HIT_FLAGS)


@query("gene_hits", f"SELECT analysis_id, gene, single_hit, double_hit FROM ({SQL_HITS}) h")
def _(t):
    return _gene_table(t).select("analysis_id", "gene", "single_hit", "double_hit")


@query("order_hits", f"SELECT * FROM ({SQL_ORDER_HITS}) h")
def _(t):
    return _order_hits(t)


@query("hrd_cohort", f"SELECT analysis_id, {SQL_COHORT} FROM ({SQL_ORDER_HITS}) h")
def _(t):
    return _order_hits(t).select("analysis_id", hrd_cohort().alias("hrd_cohort"))


@query("gene_level", f"SELECT * EXCLUDE (analysis_id) FROM ({SQL_HITS}) h")
def _(t):
    rows = gene_level(t.v_analyses, t.v_segments, t.v_variants, t.v_genes, RULES)
    return rows.withColumn("vaf_difference", F.round("vaf_difference", 6))


@query("order_level", f"SELECT * FROM ({SQL_ORDERS}) o")
def _(t):
    return order_level(t.v_analyses, t.v_segments, t.v_arms, t.v_variants, t.v_genes, RULES)


# -- cohort scores


def _dna(t: Tables, scores, column: str):
    metadata = t.v_analyses.select("analysis_id", "cancer_cohort", "url", "assay", "match_type")
    return dna_scores(metadata, scores.withColumnRenamed(column, "hrd_score"), t.v_thresholds, METRIC)


def _dna_exclusive(t: Tables):
    return _dna(t, gwloh_exclusive(t.v_segments, t.v_arms, rules=RULES), "genome_wide_loh_proportion_exclusive")


@query("dna_call", _sql_dna(SQL_INCLUSIVE, "inclusive"))
def _(t):
    return _dna(t, gwloh_inclusive(t.v_segments, rules=RULES), "genome_wide_loh_proportion_inclusive")


@query("dna_scores", _sql_dna(SQL_EXCLUSIVE, "exclusive"))
def _(t):
    return _dna_exclusive(t)


BROKEN = 7  # analyses of the remainders 0 to 3 have a broken file
IS_BROKEN = "{key} % 7 IN (0, 1, 2, 3)"


def _cut_gzip(text: str) -> str:
    """A gzip file of which the end is missing, as the hex of its bytes."""
    return gzip.compress(text.encode(), mtime=0)[:-12].hex()


def _broken_lines(key: str, header: str, good: str, bad: str):
    """What stands in the file of an analysis, by its remainder: another header, a cut gzip, nothing, a bad line."""
    texts = {0: "another header\n1", 2: "", 3: f"{header}\n{good}\n{bad}"}
    kind = F.pmod(F.col(key), F.lit(BROKEN))
    chosen = F.when(kind == 1, F.unhex(F.lit(_cut_gzip(header + f"\n{good}" * 40))).cast("string"))
    for value, text in texts.items():
        chosen = chosen.when(kind == value, F.lit(text))
    return chosen


def _write_files(t: Tables, rows, key: str, columns: list[str], sep: str, bad: str, is_broken: str = IS_BROKEN):
    """A file of rows per analysis, broken ones among them, and where each is."""
    folder = shared_dir(t.spark, f"files-of-{key}")
    header, is_broken = sep.join(columns), is_broken.format(key=key)
    whole = rows.filter(~F.expr(is_broken))
    heads = whole.select(key).distinct().select(key, F.lit(0).alias("place"), F.lit(header).alias("line"))
    lines = whole.select(key, F.lit(1).alias("place"), F.concat_ws(sep, *columns).alias("line"))
    broken = rows.filter(is_broken).select(key).distinct()
    good = sep.join(["1"] * len(columns))
    wrong = broken.select(key, F.lit(0).alias("place"), _broken_lines(key, header, good, bad).alias("line"))
    return folder, write_file_per_key(heads.unionByName(lines).unionByName(wrong), key, ["place"], "line", folder)


def _write_segments(t: Tables):
    columns = ["chrom", "seg_start", "seg_end", "total_cn", "minor_cn"]
    return _write_files(t, t.v_segments, "analysis_id", columns, ",", "1,0,5")


def _write_rna(t: Tables):
    rows = t.v_abundance.withColumn("analysis_id", F.substring("sample", 2, 20).cast("bigint"))
    return _write_files(t, rows, "analysis_id", ["gene", "counts"], "\t", "view\tmany")


SQL_FAULT = """CASE WHEN {has_file} THEN CASE {key} % 7
  WHEN 0 THEN 'ValueError: header is another header, expected ' || '{header}'
  WHEN 1 THEN 'EOFError: Compressed file ended before the end-of-stream marker was reached'
  WHEN 2 THEN 'ValueError: no header, the file is empty'
  WHEN 3 THEN '{fault}' END ELSE 'absent' END"""


def _sql_batch(scored: str, has_file: str, header: str, fault: str, key: str = "analysis_id") -> str:
    """Scores as without files, but none for analyses with a broken file."""
    broken = IS_BROKEN.format(key=key)
    return f"""
 SELECT * REPLACE (CASE WHEN {broken} THEN NULL ELSE hrd_score END AS hrd_score,
   CASE WHEN {broken} THEN 'Not Detected' ELSE hrd_call END AS hrd_call),
  {SQL_FAULT.format(has_file=has_file, key=key, header=header, fault=fault)} AS score_error
 FROM ({scored}) scored"""


DNA_BATCH = _sql_batch(
    f"""SELECT * EXCLUDE (url) FROM ({_sql_dna(SQL_EXCLUSIVE, "exclusive")}) d
   WHERE match_type = 'match' AND analysis_id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 10)""",
    "analysis_id IN (SELECT analysis_id FROM v_segments)",
    "chrom,seg_start,seg_end,total_cn,minor_cn",
    "line 3: 3 fields, expected 5",
)
RNA_BATCH = _sql_batch(
    SQL_RNA,
    "analysis_id IN (SELECT user_id FROM events WHERE user_id % 10 <> 0)",
    "gene' || chr(9) || 'counts",
    "line 3: counts does not fit its type",
)


def _batch_error():
    """Errors of absent files name the path, which differs from run to run."""
    return F.when(F.col("score_error").startswith("FileNotFoundError"), F.lit("absent")).otherwise(F.col("score_error"))


def _dna_batch(t: Tables):
    """Manifest with unlisted files, repeated rows, analyses whose file is not there and broken files."""
    _, files = t.once(_write_segments)
    known = t.v_analyses.join(files, "analysis_id", "left").withColumn("url", F.coalesce("file", "url"))
    metadata = known.select("analysis_id", "cancer_cohort", "url", "assay", "match_type")
    keys = t.lineitem.filter("l_quantity > 10").select(F.col("l_suppkey").alias("analysis_id"))

    def score(rows):
        return gwloh_exclusive(rows, t.v_arms).withColumnRenamed("genome_wide_loh_proportion_exclusive", "hrd_score")

    batch = dna_batch(metadata.union(metadata), t.v_thresholds, METRIC, SEGMENT_FILE, score, "match", keys)
    return batch.drop("url").withColumn("score_error", _batch_error())


def _rna_batch(t: Tables):
    _, files = t.once(_write_rna)
    known = t.v_rna_analyses.join(files, "analysis_id", "left").withColumn("url", F.coalesce("file", F.lit("/absent.tsv")))

    def score(normalized):
        return weighted_score(normalized, t.v_weights, ["analysis_id"])

    batch = rna_batch(known.drop("file"), t.v_thresholds, RNA_THRESHOLD, "gene STRING, counts BIGINT", score)
    rounded = batch.withColumn("hrd_score", F.round("hrd_score", 6))
    return rounded.drop("url").withColumn("score_error", _batch_error())


@query("cohort_batch", DNA_BATCH)
def _(t):
    return _dna_batch(t)


@query("rna_batch", RNA_BATCH)
def _(t):
    return _rna_batch(t)


@query("score_batch", f"SELECT * FROM ({DNA_BATCH}) d UNION ALL BY NAME SELECT * FROM ({RNA_BATCH}) r")
def _(t):
    """Both halves from their files to one CSV, read back."""
    scores = union_scores(_dna_batch(t), _rna_batch(t))
    folder = shared_dir(t.spark, "score-batch")
    write_csv(scores, folder)
    return read_csv(t.spark, folder, scores.schema)


@query("final_call", f"""
 SELECT d.analysis_id, d.cancer_cohort, d.threshold, d.hrd_score, h.double_hit_interested_genes,
  CASE WHEN h.double_hit_interested_genes OR d.hrd_score > d.threshold THEN 'Positive' ELSE 'Not Detected' END AS hrd_call
 FROM ({_sql_dna(SQL_EXCLUSIVE, "exclusive")}) d JOIN ({SQL_ORDER_HITS}) h ON h.analysis_id = d.analysis_id""")
def _(t):
    return hrd_calls(
        t.v_analyses, t.v_segments, t.v_arms, t.v_variants, t.v_genes, t.v_thresholds, METRIC, RULES
    )


@query("normalize_abundance", f"SELECT sample, gene, counts, ROUND(normalized, 6) AS normalized FROM ({SQL_NORMALIZED}) n")
def _(t):
    return normalize_abundance(t.v_abundance).withColumn("normalized", F.round("normalized", 6))


@query("abundance_matrix", "SELECT sample, " + ", ".join(
    f'MAX(CASE WHEN gene = \'{gene}\' THEN ROUND(normalized, 6) END) AS "{gene}"' for gene in EVENT_GENES
) + f" FROM ({SQL_NORMALIZED}) n GROUP BY sample")
def _(t):
    matrix = abundance_matrix(normalize_abundance(t.v_abundance), EVENT_GENES)
    return matrix.select("sample", *(F.round(gene, 6).alias(gene) for gene in EVENT_GENES))


def _rna(t: Tables, scores):
    metadata = default_category(t.v_rna_analyses, "cancer_cohort", t.v_thresholds, DEFAULT_COHORT)
    return rna_scores(metadata, scores, RNA_THRESHOLD).withColumn("hrd_score", F.round("hrd_score", 6))


def _weighted(t: Tables):
    normalized = normalize_abundance(t.v_abundance).withColumnRenamed("sample", "sample_id")
    return weighted_score(normalized, t.v_weights, ["sample_id"])


@query("rna_scores", SQL_RNA)
def _(t):
    return _rna(t, _weighted(t))


@query("rna_scores_custom", f"""
 SELECT * REPLACE (CASE WHEN assay = 'A3' THEN NULL ELSE hrd_score END AS hrd_score,
  CASE WHEN assay = 'A3' THEN 'Not Detected' ELSE hrd_call END AS hrd_call),
  CASE WHEN assay = 'A3' AND hrd_score IS NOT NULL THEN 'ValueError: assay A3' END AS hrd_score_error FROM ({SQL_RNA}) r""")
def _(t):
    weights = {"click": 0.5, "view": 1.25, "error": 0.75, "purchase": -0.5, "signup": 0.8}

    def model(batch):
        if (batch["assay"] == "A3").any():  # an assay this model does not take
            raise ValueError("assay A3")
        return sum(batch[gene].fillna(0.0) * weight for gene, weight in weights.items())

    normalized = normalize_abundance(t.v_abundance).withColumnRenamed("sample", "sample_id")
    assays = t.v_rna_analyses.select("sample_id", "assay").distinct()
    scores = score_groups(normalized.join(assays, "sample_id"), ["sample_id", "assay"], "gene", list(weights), "normalized", model)
    return _rna(t, scores)


@query("score_union", f"""
 SELECT * FROM ({_sql_dna(SQL_EXCLUSIVE, "exclusive")}) d UNION ALL BY NAME SELECT * FROM ({SQL_RNA}) r""")
def _(t):
    return union_scores(_dna_exclusive(t), _rna(t, _weighted(t)))


# -- replicate sets

REPLICATE_BROKEN = "{key} % 7 = 3"
SQL_REPLICATES = f"""
 WITH c AS (SELECT * FROM v_replicates WHERE NOT {REPLICATE_BROKEN.format(key='analysis_id')}),
 s AS (SELECT replicate_set, count(DISTINCT analysis_id) AS samples FROM c GROUP BY 1),
 r AS (SELECT c.replicate_set, gene, avg(ln(counts)) AS reference FROM c JOIN s ON s.replicate_set = c.replicate_set
  GROUP BY c.replicate_set, gene, samples HAVING count(*) = samples),
 f AS (SELECT c.replicate_set, analysis_id, exp(median(ln(counts) - reference)) AS size_factor
  FROM c JOIN r ON r.replicate_set = c.replicate_set AND r.gene = c.gene GROUP BY 1, 2)
 SELECT c.*, size_factor, log2(1 + counts / size_factor) AS normalized
 FROM c LEFT JOIN f ON f.replicate_set = c.replicate_set AND f.analysis_id = c.analysis_id"""


def _write_replicates(t: Tables):
    rows = t.v_replicates
    _, files = _write_files(t, rows, "analysis_id", ["gene", "counts"], "\t", "G0\tmany", REPLICATE_BROKEN)
    metadata = rows.select("analysis_id", "replicate_set", "run").distinct().join(files, "analysis_id")
    return write_replicates(metadata.withColumnRenamed("file", "url"), shared_dir(t.spark, "replicates"))


@query("replicate_long", f"""
 SELECT replicate_set, run, analysis_id, gene, counts, ROUND(size_factor, 6) AS size_factor, ROUND(normalized, 6) AS normalized
 FROM ({SQL_REPLICATES}) r""")
def _(t):
    long = t.once(_write_replicates).read(t.spark, "long")
    return long.withColumns({name: F.round(name, 6) for name in ("size_factor", "normalized")})


@query("replicate_folded", f"""
 SELECT replicate_set, run, analysis_id, gene, ROUND(normalized, 6) AS normalized FROM ({SQL_REPLICATES}) r""")
def _(t):
    folded = t.once(_write_replicates).read(t.spark, "folded")
    unfolded = folded.select("replicate_set", "run", "analysis_id", F.explode("values").alias("gene", "normalized"))
    return unfolded.withColumn("normalized", F.round("normalized", 6))


@query("replicate_precision", f"""
 WITH n AS ({SQL_REPLICATES}),
 r AS (SELECT replicate_set, gene, run, count(*) AS n, avg(normalized) AS mean, var_pop(normalized) AS variance FROM n GROUP BY 1, 2, 3),
 g AS (SELECT replicate_set, gene, avg(normalized) AS mean FROM n GROUP BY 1, 2),
 q AS (SELECT r.replicate_set, r.gene, sum(n) AS samples, count(*) AS runs, max(g.mean) AS mean, sum(n * variance) AS inside,
   sum(n * (r.mean - g.mean) * (r.mean - g.mean)) AS between_squares, sum(n * n) AS squares
  FROM r JOIN g ON g.replicate_set = r.replicate_set AND g.gene = r.gene GROUP BY 1, 2)
 SELECT replicate_set, gene, samples::BIGINT AS samples, runs, ROUND(mean, 6) AS mean,
  ROUND(inside / NULLIF(samples - runs, 0), 6) AS within_variance,
  ROUND(CASE WHEN samples > runs AND runs > 1 THEN greatest((between_squares / (runs - 1) - inside / (samples - runs))
   / ((samples - squares / samples) / (runs - 1)), 0) END, 6) AS between_variance FROM q""")
def _(t):
    table = t.once(_write_replicates).read(t.spark, "precision")
    return table.withColumns({name: F.round(name, 6) for name in ("mean", "within_variance", "between_variance")})


@query("replicate_faults", f"""
 SELECT DISTINCT analysis_id, 'line 3: counts does not fit its type' AS score_error FROM v_replicates
 WHERE {REPLICATE_BROKEN.format(key='analysis_id')}""")
def _(t):
    return t.once(_write_replicates).faults
