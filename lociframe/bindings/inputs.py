"""The library's input tables, derived from the test tables.

Every view reads its whole base table and grows with it, except the gene, arm
and threshold tables, which are panels of fixed size by nature. The texts run
unchanged in Spark SQL and in the engine that checks the results.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

VIEWS: dict[str, str] = {
    # -- reports and their JSON documents
    "v_reports": """
        SELECT o_orderkey AS report_id, o_custkey AS order_id, o_orderdate AS uploaded,
         CASE WHEN o_orderstatus = 'F' THEN 'hrd' ELSE 'other' END AS report_type,
         o_orderpriority = '5-LOW' AS is_test
        FROM orders""",
    "v_drafts": """
        SELECT l_orderkey AS report_id, l_partkey AS source_data_id,
         CASE l_returnflag WHEN 'R' THEN 'Aneuploidy noted' WHEN 'A' THEN 'amended' END AS update_reason
        FROM lineitem""",
    "v_source": """
        SELECT event_id AS id, concat('[{"data":{"$metadata":{"analysisId":["a', CAST(user_id AS STRING),
         '"]},"reportModuleNormal":{"$moduleData":{"result":["', event_type, '"]}}}}]') AS source_data
        FROM events""",
    # -- analyses (one per supplier; a tenth has no segments) and their copy-number segments: one per analysis,
    #    chromosome and 10 Mb bin, so segments of an analysis never overlap and are bounded in number
    "v_analyses": """
        SELECT s_suppkey AS analysis_id, concat('O', CAST(s_suppkey AS STRING)) AS order_id,
         r_name AS cancer_cohort, CASE WHEN s_acctbal < 0 THEN 'unmatched' ELSE 'match' END AS match_type,
         concat('A', CAST(s_nationkey % 4 AS STRING)) AS assay,
         concat('cnv/', s_name, '.csv') AS url
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_segments": """
        SELECT l_suppkey AS analysis_id, l_partkey % 22 + 1 AS chrom,
         CAST(FLOOR(l_extendedprice / 10000) AS BIGINT) * 10000000 AS seg_start,
         CAST(FLOOR(l_extendedprice / 10000) AS BIGINT) * 10000000 + 3000000 + MAX(l_linenumber) * 1000000 AS seg_end,
         CAST(MIN(l_quantity) AS INT) % 8 AS total_cn,
         CASE WHEN CAST(MIN(l_quantity) AS INT) % 8 < 2 THEN 0 ELSE CAST(MAX(l_quantity) AS INT) % 3 END AS minor_cn
        FROM lineitem WHERE l_suppkey % 10 <> 0
        GROUP BY l_suppkey, l_partkey % 22 + 1, CAST(FLOOR(l_extendedprice / 10000) AS BIGINT)""",
    # segments that overlap: one per line item, of 100 b to 10 Mb, some of 250 Mb
    "v_overlapping": """
        SELECT analysis_id, chrom, seg_start, seg_start + CASE WHEN is_long THEN 250000000
         ELSE 100 + quantity * quantity * (quantity % 5) * 1000 END AS seg_end,
         CAST(quantity % 4 AS INT) AS total_cn, CAST(CASE WHEN quantity % 4 < 2 THEN 0 ELSE quantity % 3 END AS INT) AS minor_cn
        FROM (SELECT l_suppkey AS analysis_id, l_partkey % 22 + 1 AS chrom,
          CAST(FLOOR(l_extendedprice) AS BIGINT) * 1000 + l_orderkey % 1000 AS seg_start,
          CAST(l_quantity AS BIGINT) AS quantity, l_linenumber = 7 AND l_quantity >= 45 AS is_long FROM lineitem) AS l""",
    # probes of 100 bases
    "v_probes": """
        SELECT p_partkey AS probe, p_partkey % 22 + 1 AS chrom, p_partkey * 7919 % 100000 * 1000 AS probe_start,
         p_partkey * 7919 % 100000 * 1000 + 100 AS probe_end FROM part""",
    "v_variants": """
        SELECT l_suppkey AS analysis_id, concat('G', CAST(l_partkey % 100 AS STRING)) AS gene,
         CASE l_linestatus WHEN 'F' THEN 'somatic' ELSE 'germline' END AS origin,
         CASE WHEN l_linenumber = 7 AND l_tax >= 0.07 THEN 'loh'
          WHEN l_linenumber = 7 AND l_tax <= 0.01 THEN 'deep_loss' ELSE 'short' END AS alteration,
         CASE WHEN l_quantity <= 1 THEN 'pathogenic' WHEN l_quantity <= 3 THEN 'vus' ELSE 'benign' END AS classification,
         l_discount AS somatic_vaf, l_tax AS germline_vaf
        FROM lineitem""",
    # -- reported and raw variants of the same mutations, spelled differently: a reference in chunks of 80 bases with a
    #    repeat in the middle; substitutions, a lost and a gained repeat unit, and substitutions of two bases
    "v_reference": """
        SELECT p_partkey AS part, p_partkey % 22 + 1 AS chrom, CAST(FLOOR(p_partkey / 22) AS BIGINT) AS chunk,
         concat(translate(substr(md5(concat('l', CAST(p_partkey AS STRING))), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT'),
          'CACACACACACACACACACA',
          translate(substr(md5(concat('r', CAST(p_partkey AS STRING))), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS bases
        FROM part""",
    "v_mutations": """
        SELECT analysis_id, part, gene, origin, kind, units, quantity, somatic_vaf, germline_vaf, chrom, chunk * 80 AS base, bases,
         CASE substr(bases, 10, 1) WHEN 'A' THEN 'C' ELSE 'A' END AS other,
         concat(CASE substr(bases, 60, 1) WHEN 'A' THEN 'C' ELSE 'A' END, CASE substr(bases, 61, 1) WHEN 'A' THEN 'C' ELSE 'A' END)
          AS others
        FROM (SELECT l_suppkey AS analysis_id, l_partkey, l_linenumber % 4 AS kind,
          concat('G', CAST(l_partkey % 100 AS STRING)) AS gene,
          CASE MIN(l_linestatus) WHEN 'F' THEN 'somatic' ELSE 'germline' END AS origin, CAST(MIN(l_orderkey % 7) AS INT) AS units,
          MAX(l_quantity) AS quantity, MAX(l_discount) AS somatic_vaf, MAX(l_tax) AS germline_vaf
         FROM lineitem GROUP BY l_suppkey, l_partkey, l_linenumber % 4) AS m JOIN v_reference ON l_partkey = part""",
    "v_reported_variants": """
        SELECT analysis_id, gene, origin, 'short' AS alteration,
         CASE WHEN quantity < 20 THEN 'pathogenic' WHEN quantity < 35 THEN 'vus' ELSE 'benign' END AS classification,
         chrom, base + CASE kind WHEN 0 THEN 10 WHEN 3 THEN 60 ELSE 30 END AS pos,
         CASE kind WHEN 0 THEN substr(bases, 10, 1) WHEN 1 THEN substr(bases, 30, 3) WHEN 2 THEN substr(bases, 30, 1)
          ELSE substr(bases, 60, 2) END AS ref,
         CASE kind WHEN 0 THEN other WHEN 1 THEN substr(bases, 30, 1) WHEN 2 THEN concat(substr(bases, 30, 1), 'CACA')
          ELSE others END AS alt
        FROM v_mutations WHERE quantity >= 10""",
    "v_raw_variants": """
        SELECT analysis_id, chrom, base + CASE kind WHEN 0 THEN 10 + units % 3 WHEN 3 THEN 58 ELSE 30 + 2 * units END AS pos,
         CASE kind WHEN 0 THEN substr(bases, 10, 1) WHEN 1 THEN substr(bases, 30 + 2 * units, 3)
          WHEN 2 THEN lower(substr(bases, 30 + 2 * units, 1)) ELSE substr(bases, 58, 6) END AS ref,
         CASE kind WHEN 0 THEN other WHEN 1 THEN substr(bases, 30 + 2 * units, 1)
          WHEN 2 THEN lower(concat(substr(bases, 30 + 2 * units, 1), 'CACA'))
          ELSE concat(substr(bases, 58, 2), others, substr(bases, 62, 2)) END AS alt, somatic_vaf, germline_vaf
        FROM v_mutations WHERE quantity <= 45""",
    # -- panels: 100 genes (three of them listed twice, with and without the interested mark), 44 arms, thresholds ('MIDDLE EAST' is left out, so the default cohort is used,
    #    'ASIA' is listed for the other metric only, so it has no threshold)
    "v_gene_parts": """
        SELECT p_partkey % 100 AS number, concat('G', CAST(p_partkey % 100 AS STRING)) AS gene,
         p_partkey % 100 % 22 + 1 AS chrom, (p_partkey % 100 * 7 % 97) * 1000000 AS gene_start,
         (p_partkey % 100 * 7 % 97) * 1000000 + MAX(p_size) * 50000 AS gene_end
        FROM part GROUP BY p_partkey % 100""",
    "v_genes": """
        SELECT gene, chrom, gene_start, gene_end, number < 2 AS interested, number < 6 AS reported FROM v_gene_parts
        UNION ALL
        SELECT gene, chrom, gene_start, gene_end, false AS interested, true AS reported FROM v_gene_parts WHERE number < 3""",
    "v_panel": """
        SELECT gene, chrom, gene_start, gene_end, bool_or(interested) AS interested, bool_or(reported) AS reported
        FROM v_genes GROUP BY gene, chrom, gene_start, gene_end""",
    "v_arms": """
        SELECT DISTINCT p_partkey % 22 + 1 AS chrom, 'p' AS arm, 0 AS arm_start, 50000000 AS arm_end FROM part
        UNION ALL
        SELECT DISTINCT p_partkey % 22 + 1 AS chrom, 'q' AS arm, 50000000 AS arm_start, 120000000 AS arm_end FROM part""",
    "v_thresholds": """
        SELECT cancer_cohort, hrd_metric, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES
         ('Pan Cancer', 'dna_gwloh', 0.38), ('AFRICA', 'dna_gwloh', 0.37), ('AMERICA', 'dna_gwloh', 0.39),
         ('ASIA', 'rna', 50.0), ('EUROPE', 'dna_gwloh', 0.38), ('Pan Cancer', 'rna', 50.0),
         ('BUILDING', 'rna', 50.0), ('MACHINERY', 'rna', 50.0)
        ) AS t(cancer_cohort, hrd_metric, threshold)""",
    # -- RNA: samples (a tenth has no abundance), abundance, gene weights
    "v_abundance": """
        SELECT concat('S', CAST(user_id AS STRING)) AS sample, event_type AS gene,
         CAST(SUM(FLOOR(value)) AS BIGINT) AS counts
        FROM events WHERE user_id % 10 <> 0 GROUP BY user_id, event_type""",
    "v_rna_analyses": """
        SELECT DISTINCT user_id AS analysis_id, concat('S', CAST(user_id AS STRING)) AS sample_id,
         concat('P', CAST(user_id AS STRING)) AS patient_id, c_mktsegment AS cancer_cohort,
         concat('A', CAST(c_nationkey % 4 AS STRING)) AS assay
        FROM events JOIN customer ON user_id = c_custkey""",
    "v_weights": """
        SELECT gene, CAST(weight AS DOUBLE) AS weight FROM (VALUES
         ('click', 0.5), ('view', 1.25), ('error', 0.75), ('purchase', -0.5), ('signup', 0.8)
        ) AS t(gene, weight)""",
    "v_replicates": """
        SELECT l_suppkey AS analysis_id, CASE WHEN l_suppkey % 2 = 0 THEN 'intra' ELSE 'inter' END AS replicate_set,
         CAST(l_suppkey % 5 AS INT) AS run, concat('G', CAST(l_partkey % 100 AS STRING)) AS gene,
         CAST(SUM(l_quantity) AS BIGINT) AS counts
        FROM lineitem GROUP BY l_suppkey, l_partkey % 100""",
    # -- callers compared gene by gene
    "v_gene_calls": """
        SELECT l_suppkey AS analysis_id, l_partkey AS gene_id, l_linenumber AS line,
         CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END AS interested_gene,
         CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS single_hit,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS deep_loss_reported,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS deep_loss_reportable,
         CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS loh_reported,
         CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS loh_reportable
        FROM lineitem""",
    # -- versions, parameters, training logs
    "v_versions": """
        SELECT user_id AS order_id, event_type AS product_type, event_id AS product_id, ts AS last_modified
        FROM events""",
    "v_params": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS model, CAST(p_size AS BIGINT) * 1000 AS numel,
         p_type = 'ECONOMY' AS requires_grad
        FROM part""",
    "v_log": """
        SELECT user_id AS run, (event_id % 20 + 1) * 50 AS step, MIN(value) AS eval_loss, MAX(value) AS train_loss
        FROM events GROUP BY user_id, event_id % 20""",
    # -- texts
    "v_labels": """
        SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 2 THEN concat('  ', p_name, ' ')
         WHEN 3 THEN concat('say "', p_name, '", twice') WHEN 4 THEN p_name END AS label
        FROM part""",
    "v_qa": """
        SELECT a.conv_id, a.turn, a.text AS input, b.text AS output
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'""",
    "v_records": """
        SELECT concat('qa-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, input, output,
         CAST(NULL AS STRING) AS note FROM v_qa
        UNION ALL
        SELECT concat('note-', CAST(doc_id AS STRING)) AS id, CAST(NULL AS STRING) AS input,
         CAST(NULL AS STRING) AS output, text AS note FROM documents""",
    "v_splits": """
        SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'test'
         WHEN source IN ('src2', 'src3') THEN 'validation' ELSE 'train' END AS split, n_chars
        FROM documents""",
}

_READS = re.compile(r"\b(FROM|JOIN) (\w+)")


def reads(sql: str) -> list[str]:
    """Names of the tables and views a text reads, in order of first use."""
    known = {*BASE_TABLES, *VIEWS}
    return list(dict.fromkeys(name for _, name in _READS.findall(sql) if name in known))


def with_inputs(sql: str) -> str:
    """Put the definitions of the views ``sql`` needs in front of it."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in reads(text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed[name] = None

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


@functools.lru_cache(maxsize=8)
def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder)


class Tables:
    """Test tables and derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._written = {}

    def __getattr__(self, name: str) -> DataFrame:
        """A table or view by name; its (lazy) frame is kept, so footers are read once."""
        if name in BASE_TABLES:
            frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            frame = self.sql(VIEWS[name])
        else:
            raise AttributeError(name)
        setattr(self, name, frame)
        return frame

    def once(self, write):
        """What ``write(self)`` returns; its files are written once for this session and folder."""
        if write not in self._written:
            self._written[write] = write(self)
        return self._written[write]

    def sql(self, text: str) -> DataFrame:
        frames = {name: getattr(self, name) for name in reads(text)}
        escaped = text.replace("{", "{{").replace("}", "}}")
        named = _READS.sub(lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], escaped)
        return self.spark.sql(named, **frames)
