"""The engine's tables. Every scan states its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType


def struct(ddl: str) -> StructType:
    """The type of one of the tables below; needs a session."""
    return StructType.fromDDL(ddl)


FILINGS = "adsh STRING, cik BIGINT, name STRING, sic BIGINT, form STRING, period DATE, fiscal_year BIGINT, fiscal_period STRING, filed DATE"
FACTS = "adsh STRING, tag STRING, version STRING, ddate DATE, qtrs BIGINT, uom STRING, value DOUBLE"
TAG_NORMALIZATION = "raw_tag STRING, canonical_tag STRING"
TRANSCRIPTS = "cik INT, accession_no STRING, company_name STRING, filed_date DATE, period_of_report DATE, form_type STRING, exhibit_url STRING"
TRANSCRIPT_SECTIONS = "accession_no STRING, section_item STRING, section_text STRING"
PATENTS = "patent_id STRING, patent_title STRING, grant_date DATE, assignee_organization STRING, cpc_codes ARRAY<STRING>, citation_count INT"
PATENT_CLAIMS = "patent_id STRING, claim_number INT, claim_text STRING, is_independent BOOLEAN"
LITIGATION_CASES = "case_id STRING, case_name STRING, court STRING, court_citation STRING, date_filed DATE, docket_number STRING, status STRING, company_name STRING, url STRING, cite_count INT"
LITIGATION_OPINIONS = "opinion_id STRING, case_id STRING, opinion_type STRING, plain_text STRING, snippet STRING"
BULK = {  # patent bulk files
    "g_patent": "patent_id STRING, patent_date DATE, patent_title STRING",
    "g_assignee": "patent_id STRING, assignee_id STRING, disambig_assignee_organization STRING",
    "g_cpc": "patent_id STRING, cpc_group STRING",
    "g_claims": "patent_id STRING, claim_number INT, claim_text STRING, dependent STRING",
}
PATENT_CSV = "patent_id STRING, patent_title STRING, grant_date STRING, assignee_organization STRING, cpc_codes STRING, citation_count STRING, created_at STRING"
SUBMISSIONS = "cik STRING, name STRING, filings STRUCT<recent: STRUCT<accessionNumber: ARRAY<STRING>, filingDate: ARRAY<STRING>, reportDate: ARRAY<STRING>, form: ARRAY<STRING>, items: ARRAY<STRING>, primaryDocument: ARRAY<STRING>>>"
FILING_INDEX = "directory STRUCT<item: ARRAY<STRUCT<name: STRING, type: STRING>>>"
DOCLING = (
    "source STRING, ticker STRING, year INT, form_type STRING, report_date STRING, filing_date STRING, company_title STRING, "
    "docling STRUCT<texts: ARRAY<STRUCT<text: STRING, label: STRING, content_layer: STRING, self_ref: STRING, hyperlink: STRING>>, "
    "tables: ARRAY<STRUCT<captions: ARRAY<STRUCT<text: STRING>>, data: STRUCT<num_rows: INT, num_cols: INT, table_cells: ARRAY<STRUCT<start_row_offset_idx: INT, start_col_offset_idx: INT, text: STRING>>>>>, "
    "origin: STRUCT<filename: STRING>>"
)
SUBSIDIARIES = "ticker STRING, company_title STRING, form_type STRING, subsidiaries_by_year ARRAY<STRUCT<year: INT, accession: STRING, exhibit_21_url: STRING, subsidiaries: ARRAY<STRING>>>"
BOARD = "ticker STRING, company_title STRING, form_type STRING, board_members_by_year ARRAY<STRUCT<year: INT, members: ARRAY<STRUCT<name: STRING, title: STRING>>>>"
XBRL_FACTS = (
    "source STRING, tag STRING, name STRING, value_num DOUBLE, value_text STRING, unit STRING, context STRING, year INT, fiscal_year INT, fiscal_quarter STRING, period_label STRING, period_type STRING, "
    "start_date STRING, end_date STRING, instant STRING, dimension STRING, dimension_member STRING"
)
CHUNKS = "id STRING, text STRING, metadata STRUCT<source: STRING, ticker: STRING, form_type: STRING, year: INT, company_title: STRING, content_type: STRING, part_title: STRING, item_title: STRING, note_title: STRING, subsection_title: STRING, table_headers: ARRAY<STRING>, table_row_count: INT, chunk_index: INT>"
TREE_NODES = "id STRING, text STRING, level INT, node_type STRING, child_ids ARRAY<STRING>, parent_id STRING, source_doc_id STRING, form_type STRING, filename STRING, year INT"
VECTORS = "namespace STRING, id STRING, values ARRAY<FLOAT>, metadata MAP<STRING, STRING>"
CACHE = "tier STRING, key STRING, question STRING, embedding ARRAY<FLOAT>, answer STRING, sources_json STRING, source_filter STRING, doc_version INT, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, hit_count BIGINT, last_hit_at TIMESTAMP_NTZ"
AUDIT = (
    "query_id STRING, timestamp TIMESTAMP_NTZ, tenant_id STRING, user_id STRING, question STRING, route STRING, tier STRING, sources_retrieved ARRAY<STRING>, retrieval_scores ARRAY<DOUBLE>, graph_paths_traversed ARRAY<STRING>, "
    "answer STRING, confidence DOUBLE, cache_hit BOOLEAN, cache_tier STRING, latency_ms BIGINT, contradiction_score INT, error STRING, model STRING"
)
GOLDEN_QUERIES = "id STRING, tier INT, query STRING, expected_answer STRING, expected_sources ARRAY<STRING>, expected_entities ARRAY<STRING>, expected_numbers ARRAY<DOUBLE>, expected_contradictions ARRAY<STRING>, route STRING"
EVAL_RESULTS = "run_id STRING, completed_at TIMESTAMP_NTZ, config STRING, tier INT, item STRING, metric STRING, value DOUBLE"
LIFECYCLE = "file STRING, ingested_at STRING, stage STRING, ticker STRING, year INT, form_type STRING"

#: child, its column, parent, its column
FOREIGN_KEYS = (("facts", "adsh", "filings", "adsh"), ("transcript_sections", "accession_no", "transcripts", "accession_no"), ("patent_claims", "patent_id", "patents", "patent_id"), ("litigation_opinions", "case_id", "litigation_cases", "case_id"))
