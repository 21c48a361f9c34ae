"""Queries for projections, filters, joins, aggregations, windows and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.bindings.registry import query
from lociframe.functions.arrays import first_of_type
from lociframe.functions.scalars import RUN_LABEL, agreement, json_text, run_label, score_or_null, threshold_call
from lociframe.operators.aggregates import (
    agreement_table,
    best_checkpoint,
    latest_version,
    overfit_onset,
    trainable_share,
)
from lociframe.operators.joins import default_category, filter_in, natural_join, threshold_lookup
from lociframe.operators.ordering import batch_plan, every_k, row_at
from lociframe.plans.concordance import concordance, discrepant
from lociframe.plans.reports import eligible_reports, report_rollup, report_rows
from lociframe.session import written
from lociframe.sources import document_paths, load_split, merge_profiles, parse_documents, profile, profile_parts, read_profile

ANALYSIS_PATH = "$[0].data['$metadata'].analysisId[0]"
RESULT_PATH = "$[0].data.reportModuleNormal['$moduleData'].result[0]"
SQL_TEXTS = """
 json_extract_string(source_data, '$[0].data."$metadata".analysisId[0]') AS analysis_id,
 json_extract_string(source_data, '$[0].data.reportModuleNormal."$moduleData".result[0]') AS hrd_result"""
SQL_REPORT_ROWS = f"""
 SELECT r.order_id, r.uploaded, s.analysis_id, s.hrd_result, d.update_reason
 FROM v_reports r JOIN v_drafts d ON r.report_id = d.report_id
 JOIN (SELECT id, {SQL_TEXTS} FROM v_source) s ON d.source_data_id = s.id
 WHERE r.report_type = 'hrd' AND NOT r.is_test"""
ASSAYS = ("A1", "A3")


# -- projections and filters


@query(
    "metadata_projection",
    "SELECT analysis_id, order_id, cancer_cohort AS cohort, url AS source_url, assay, match_type FROM v_analyses",
)
def _(t):
    return t.v_analyses.select(
        "analysis_id",
        "order_id",
        F.col("cancer_cohort").alias("cohort"),
        F.col("url").alias("source_url"),
        "assay",
        "match_type",
    )


@query("distinct_metadata", "SELECT DISTINCT cancer_cohort, assay, match_type FROM v_analyses")
def _(t):
    return t.v_analyses.select("cancer_cohort", "assay", "match_type").distinct()


@query(
    "eligible_reports",
    "SELECT report_id, order_id, uploaded FROM v_reports WHERE report_type = 'hrd' AND is_test = false",
)
def _(t):
    return eligible_reports(t.v_reports, "hrd").select("report_id", "order_id", "uploaded")


@query("assay_filter", "SELECT analysis_id, assay FROM v_analyses WHERE assay IN ('A1', 'A3')")
def _(t):
    return t.v_analyses.filter(F.col("assay").isin(list(ASSAYS))).select("analysis_id", "assay")


@query(
    "key_list_semi",
    """SELECT analysis_id, gene, origin, classification FROM v_variants
    WHERE analysis_id IN (SELECT analysis_id FROM v_analyses WHERE match_type = 'match')""",
)
def _(t):
    matched = t.v_analyses.filter(F.col("match_type") == "match")
    return filter_in(t.v_variants, matched, "analysis_id").select("analysis_id", "gene", "origin", "classification")


@query(
    "cohort_default",
    """SELECT analysis_id, CASE WHEN cancer_cohort IN (SELECT cancer_cohort FROM v_thresholds)
     THEN cancer_cohort ELSE 'Pan Cancer' END AS cancer_cohort FROM v_analyses""",
)
def _(t):
    return default_category(t.v_analyses.select("analysis_id", "cancer_cohort"), "cancer_cohort", t.v_thresholds, "Pan Cancer")


SQL_RATES = """
 SELECT analysis_id, total_cn, minor_cn, seg_end - seg_start AS bases,
  CASE WHEN total_cn = 0 THEN CAST('NaN' AS DOUBLE) WHEN total_cn = 1 THEN NULL
   ELSE CAST(minor_cn AS DOUBLE) / total_cn END AS score FROM v_segments"""


@query(
    "threshold_call",
    f"""SELECT total_cn, minor_cn, CASE WHEN NOT isnan(score) AND score > 0.25 THEN 'Positive'
     ELSE 'Not Detected' END AS hrd_call, CAST(COUNT(*) AS BIGINT) AS segments
    FROM ({SQL_RATES}) r GROUP BY 1, 2, 3""",
)
def _(t):
    score = (
        F.when(F.col("total_cn") == 0, F.lit(float("nan")))
        .when(F.col("total_cn") == 1, None)
        .otherwise(F.try_divide(F.col("minor_cn").cast("double"), F.col("total_cn")))
    )
    called = t.v_segments.select("total_cn", "minor_cn", threshold_call(score, 0.25).alias("hrd_call"))
    return called.groupBy("total_cn", "minor_cn", "hrd_call").agg(F.count(F.lit(1)).alias("segments"))


@query(
    "safe_score",
    """SELECT analysis_id, chrom, CASE WHEN SUM(total_cn) = 0 THEN NULL
     ELSE CAST(SUM(minor_cn) AS DOUBLE) / SUM(total_cn) END AS score
    FROM v_segments GROUP BY analysis_id, chrom""",
)
def _(t):
    sums = t.v_segments.groupBy("analysis_id", "chrom").agg(
        F.sum("minor_cn").cast("string").alias("minor"), F.sum("total_cn").cast("string").alias("total")
    )
    return sums.select("analysis_id", "chrom", score_or_null(F.col("minor"), F.col("total")).alias("score"))


@query("json_extract", f"SELECT id, {SQL_TEXTS}, json_extract_string(source_data, '$[0].data[0]') AS indexed_object FROM v_source")
def _(t):
    document = F.col("source_data")
    return t.v_source.select(
        "id",
        json_text(document, ANALYSIS_PATH).alias("analysis_id"),
        json_text(document, RESULT_PATH).alias("hrd_result"),
        json_text(document, "$[0].data[0]").alias("indexed_object"),
    )


SQL_DOCUMENTS = """SELECT id, CASE WHEN id % 50 = 7 THEN substr(source_data, 1, 30) WHEN id % 50 <> 8 THEN source_data END AS text
 FROM v_source"""


def _write_documents(t: Tables):
    """The documents, a fiftieth of them cut off, and a fiftieth NULL."""
    kind = F.col("id") % 50
    text = F.when(kind == 7, F.substring("source_data", 1, 30)).when(kind != 8, F.col("source_data"))
    return parse_documents(t.v_source.select("id", text.alias("text")), "text")


@query(
    "document_paths",
    f"""SELECT id, {SQL_TEXTS.replace('source_data', 'text')}, CAST(substr(json_extract_string(text,
     '$[0].data."$metadata".analysisId[0]'), 2) AS BIGINT) AS number, json_extract_string(text, '$[0].data[0]') AS indexed_object
    FROM ({SQL_DOCUMENTS}) d WHERE id % 50 <> 7""",
)
def _(t):
    documents = t.once(_write_documents).good
    paths = {name: (path, "string") for name, path in (("analysis_id", ANALYSIS_PATH), ("hrd_result", RESULT_PATH))}
    found = document_paths(documents, paths | {"indexed_object": ("$[0].data[0]", "string")})
    return found.withColumn("number", F.substring("analysis_id", 2, 20).cast("bigint"))


@query("bad_documents", f"SELECT id, text FROM ({SQL_DOCUMENTS}) d WHERE id % 50 = 7")
def _(t):
    return t.once(_write_documents).bad


@query("typed_paths", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::BIGINT AS misfit FROM events")
def _(t):
    documents = parse_documents(t.events.select("event_id", "props"), "props").good
    return document_paths(documents, {"k": ("$.k", "bigint"), "misfit": ("$.k.deeper", "bigint")})


@query(
    "merged_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{kind}' AS type, count(*) AS rows, count(*) - count({name}) AS nulls,
     {f'min({name})::DOUBLE' if number else 'NULL::DOUBLE'} AS low, {f'max({name})::DOUBLE' if number else 'NULL::DOUBLE'} AS high,
     {'NULL' if number else f'min({name})'} AS least, {'NULL' if number else f'max({name})'} AS greatest, true AS distinct_is_close
     FROM events"""
        for name, kind, number in (("event_id", "bigint", True), ("user_id", "bigint", True), ("value", "double", True), ("props", "string", False))
    ),
)
def _(t):
    """One stored profile per event type, merged; the distinct count is compared with the exact one."""
    columns = ["event_id", "user_id", "value", "props"]
    stored = written(profile_parts(t.events.select("event_type", *columns), ["event_type"]), "profile")
    merged = read_profile(merge_profiles(stored)).drop("quantiles")
    counts = t.events.agg(*[F.count_distinct(name).alias(name) for name in columns])
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("exact")) for name in columns])
    close = F.abs(F.col("distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return merged.join(counts.select(F.inline(pairs)), "column").withColumn("distinct_is_close", close).drop("distinct", "exact")


@query(
    "run_label",
    "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS file_label, strftime(ts, '%Y-%m-%d-%H-%M') AS run_label FROM events",
)
def _(t):
    return t.events.select(
        "event_id", run_label(F.col("ts")).alias("file_label"), run_label(F.col("ts"), RUN_LABEL).alias("run_label")
    )


@query(
    "split_select",
    "SELECT doc_id, n_chars FROM v_splits WHERE split = 'validation'",
)
def _(t):
    return load_split(t.v_splits, "validation").select("doc_id", "n_chars")


@query(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{kind}' AS "type", CAST(COUNT(*) AS BIGINT) AS "rows",
        CAST(COUNT(*) - COUNT({name}) AS BIGINT) AS "nulls", MIN(CAST({name} AS VARCHAR)) AS sample FROM v_gene_calls"""
        for name, kind in (
            ("analysis_id", "bigint"),
            ("gene_id", "bigint"),
            ("line", "int"),
            ("interested_gene", "int"),
            ("single_hit", "int"),
            ("deep_loss_reported", "int"),
            ("deep_loss_reportable", "int"),
            ("loh_reported", "int"),
            ("loh_reportable", "int"),
        )
    ),
)
def _(t):
    return profile(t.v_gene_calls)


# -- joins


@query("report_join", SQL_REPORT_ROWS)
def _(t):
    reports = eligible_reports(t.v_reports, "hrd")
    return report_rows(reports, t.v_drafts, t.v_source, ANALYSIS_PATH, RESULT_PATH)


@query(
    "report_rollup",
    f"""SELECT *, CASE WHEN report_notes ILIKE '%aneup%' THEN 1 ELSE 0 END AS aneuploidy FROM (
     SELECT order_id, uploaded, analysis_id, hrd_result,
      string_agg(update_reason, ', ' ORDER BY update_reason) AS report_notes
     FROM ({SQL_REPORT_ROWS}) rows GROUP BY 1, 2, 3, 4) rolled""",
)
def _(t):
    return report_rollup(t.v_reports, t.v_drafts, t.v_source, "hrd", ANALYSIS_PATH, RESULT_PATH, "aneup")


@query(
    "using_join",
    "SELECT analysis_id, assay, gene, classification FROM v_analyses JOIN v_variants USING (analysis_id)",
)
def _(t):
    return t.v_analyses.join(t.v_variants, on=["analysis_id"]).select("analysis_id", "assay", "gene", "classification")


@query(
    "sample_metadata",
    """SELECT DISTINCT v.analysis_id, v.gene, a.assay FROM v_variants v
    LEFT JOIN v_analyses a ON v.analysis_id = a.analysis_id WHERE a.assay IN ('A1', 'A3')""",
)
def _(t):
    pairs = t.v_variants.select("analysis_id", "gene").distinct()  # fewer rows to join, and a large analysis is spread
    joined = pairs.join(t.v_analyses.select("analysis_id", "assay"), "analysis_id", "left")
    return joined.filter(F.col("assay").isin(list(ASSAYS))).select("analysis_id", "gene", "assay").distinct()


@query(
    "natural_join",
    """SELECT a.analysis_id, a.cancer_cohort, b.threshold FROM
     (SELECT analysis_id, NULLIF(cancer_cohort, 'MIDDLE EAST') AS cancer_cohort FROM v_analyses) a
     JOIN (SELECT NULLIF(cancer_cohort, 'Pan Cancer') AS cancer_cohort, threshold FROM v_thresholds) b
     ON a.cancer_cohort IS NOT DISTINCT FROM b.cancer_cohort""",
)
def _(t):
    cohort = F.col("cancer_cohort")
    left = t.v_analyses.select("analysis_id", F.nullif(cohort, F.lit("MIDDLE EAST")).alias("cancer_cohort"))
    right = t.v_thresholds.select(F.nullif(cohort, F.lit("Pan Cancer")).alias("cancer_cohort"), "threshold")
    return natural_join(left, right)


@query(
    "threshold_lookup",
    """SELECT a.analysis_id, a.cancer_cohort, t.threshold FROM v_analyses a
    LEFT JOIN v_thresholds t ON a.cancer_cohort = t.cancer_cohort AND t.hrd_metric = 'dna_gwloh'""",
)
def _(t):
    cohorts = t.v_analyses.select("analysis_id", "cancer_cohort")
    return threshold_lookup(cohorts, t.v_thresholds, "dna_gwloh").select("analysis_id", "cancer_cohort", "threshold")


# -- aggregations over parameters and logs


@query(
    "parameter_share",
    """SELECT model, CAST(SUM(CASE WHEN requires_grad THEN numel ELSE 0 END) AS BIGINT) AS trainable_params,
     CAST(SUM(numel) AS BIGINT) AS all_params,
     ROUND(100.0 * SUM(CASE WHEN requires_grad THEN numel ELSE 0 END) / SUM(numel), 6) AS trainable_percent
    FROM v_params GROUP BY model""",
)
def _(t):
    return trainable_share(t.v_params, ["model"]).withColumn("trainable_percent", F.round("trainable_percent", 6))


@query(
    "best_checkpoint",
    """SELECT run, step AS best_step, eval_loss AS best_loss FROM (
     SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY eval_loss, step) AS rn FROM v_log) l WHERE rn = 1""",
)
def _(t):
    return best_checkpoint(t.v_log)


@query(
    "overfit_onset",
    """SELECT run, MIN(CASE WHEN eval_loss > prev_eval AND train_loss < prev_train THEN step END) AS onset_step FROM (
     SELECT *, LAG(eval_loss) OVER (PARTITION BY run ORDER BY step) AS prev_eval,
      LAG(train_loss) OVER (PARTITION BY run ORDER BY step) AS prev_train FROM v_log) l GROUP BY run""",
)
def _(t):
    return overfit_onset(t.v_log)


@query("every_k_steps", "SELECT run, step, eval_loss, train_loss FROM v_log WHERE step % 100 = 0")
def _(t):
    return every_k(t.v_log, 100)


# -- agreement of two callers

SQL_LABEL = """CASE WHEN {0}_reported = 0 AND {0}_reportable = 0 THEN 'Both negative'
 WHEN {0}_reported = 1 AND {0}_reportable = 1 THEN 'Both positive'
 WHEN {0}_reported = 1 AND {0}_reportable = 0 THEN 'Pathology only'
 WHEN {0}_reported = 0 AND {0}_reportable = 1 THEN 'Bioinformatics only' END AS {0}_summary"""
SQL_LABELLED = f"""
 SELECT g.*, {SQL_LABEL.format('deep_loss')}, {SQL_LABEL.format('loh')} FROM v_gene_calls g
 JOIN (SELECT analysis_id FROM v_analyses WHERE match_type = 'match' AND assay IN ('A1', 'A3')) o
 ON g.analysis_id = o.analysis_id WHERE g.interested_gene = 1 AND g.single_hit = 0"""


@query("concordance_label", SQL_LABELLED)
def _(t):
    return concordance(t.v_analyses, t.v_gene_calls, ASSAYS)


@query("concordance_discrepant", f"SELECT * FROM ({SQL_LABELLED}) l WHERE deep_loss_summary = 'Bioinformatics only'")
def _(t):
    return discrepant(concordance(t.v_analyses, t.v_gene_calls, ASSAYS))


@query(
    "concordance_table",
    f"""SELECT deep_loss_summary, loh_summary, CAST(COUNT(*) AS BIGINT) AS "rows" FROM (
     SELECT {SQL_LABEL.format('deep_loss')}, {SQL_LABEL.format('loh')} FROM v_gene_calls) l GROUP BY 1, 2""",
)
def _(t):
    labelled = t.v_gene_calls.select(
        agreement(F.col("deep_loss_reported"), F.col("deep_loss_reportable")).alias("deep_loss_summary"),
        agreement(F.col("loh_reported"), F.col("loh_reportable")).alias("loh_summary"),
    )
    return agreement_table(labelled, ["deep_loss_summary", "loh_summary"])


# -- positions


@query(
    "latest_version",
    """SELECT order_id, product_type, product_id, last_modified FROM (
     SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, product_type ORDER BY last_modified DESC, product_id) AS rn
     FROM v_versions) v WHERE rn = 1""",
)
def _(t):
    return latest_version(t.v_versions, ["order_id", "product_type"], "last_modified", "product_id")


@query(
    "first_of_type",
    r"""SELECT doc_id, list_filter(regexp_split_to_array(text, '\n'), lambda line: line LIKE '%.')[1] AS first_sentence,
     list_filter(regexp_split_to_array(text, '\n'), lambda line: line NOT LIKE '%.')[1] AS first_other FROM documents""",
)
def _(t):
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(F.when(line.endswith("."), "sentence").otherwise("other").alias("type"), line.alias("line")),
    )
    return t.documents.select("doc_id", lines.alias("items")).select(
        "doc_id",
        first_of_type(F.col("items"), "sentence")["line"].alias("first_sentence"),
        first_of_type(F.col("items"), "other")["line"].alias("first_other"),
    )


@query("row_at", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 1 OFFSET 4")
def _(t):
    return row_at(t.documents.select("doc_id", "lang", "n_chars"), ["doc_id"], 4)


@query(
    "batch_plan",
    """SELECT doc_id, n AS ordinal, n // 8 + 1 AS step, n % 8 AS slot FROM (
     SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS n
     FROM documents) d""",
)
def _(t):
    return batch_plan(t.documents.select("doc_id"), "doc_id", seed=42, per_device=2, accumulation=4)


@query(
    "batch_plan_capped",
    """SELECT doc_id, n AS ordinal, n // 16 + 1 AS step, n % 16 AS slot FROM (
     SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5(concat('7:', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS n
     FROM documents) d WHERE n // 16 < 10""",
)
def _(t):
    """The first ten steps of training on two devices."""
    keys = t.documents.select("doc_id")
    return batch_plan(keys, "doc_id", seed=7, per_device=4, accumulation=2, max_steps=10, devices=2)


