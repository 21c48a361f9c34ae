from lociframe.sources.checked import CheckedRows, read_checked
from lociframe.sources.commented import read_commented_tsv, read_file_metadata
from lociframe.sources.guarded import scan_files
from lociframe.sources.manifest_source import scan_manifest_source
from lociframe.sources.documents import ParsedDocuments, document_paths, parse_documents
from lociframe.sources.profile import merge_profiles, profile, profile_parts, read_profile
from lociframe.sources.readers import (
    jdbc_options,
    load_split,
    normalized_uri,
    read_csv,
    read_jsonl,
    read_table,
    read_tsv,
    scan_manifest,
)
from lociframe.sources.sinks import write_csv, write_file_per_key, write_parquet, write_tsv

__all__ = [
    "CheckedRows",
    "ParsedDocuments",
    "document_paths",
    "jdbc_options",
    "load_split",
    "normalized_uri",
    "merge_profiles",
    "parse_documents",
    "profile",
    "profile_parts",
    "read_checked",
    "read_commented_tsv",
    "read_csv",
    "read_file_metadata",
    "read_jsonl",
    "read_profile",
    "read_table",
    "read_tsv",
    "scan_files",
    "scan_manifest",
    "scan_manifest_source",
    "write_csv",
    "write_file_per_key",
    "write_parquet",
    "write_tsv",
]
