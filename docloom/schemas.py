"""Declared schemas of the knowledge-base tables, as DDL."""

from __future__ import annotations

DOCUMENTS = (
    "id BIGINT, file_name STRING, file_hash STRING, source_type STRING, category STRING, display_name STRING, report_group STRING, "
    "`group` STRING, company STRING, language STRING, publish_date DATE, fiscal_year STRING, fiscal_period STRING, status STRING, "
    "tags ARRAY<STRING>, confidentiality STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
METADATA = "STRUCT<section_title: STRING, heading_level: INT, page_start: INT, page_end: INT>"
CHUNKS = (
    f"id BIGINT, document_id BIGINT, chunk_index INT, text_content STRING, embedding ARRAY<FLOAT>, metadata {METADATA}, "
    "chunk_type STRING, parent_chunk_id BIGINT, created_at TIMESTAMP"
)
TERMS = ("id BIGINT, term STRING, full_name STRING, category STRING, language STRING, created_at TIMESTAMP")
CONFIG = ("key STRING, value STRING, note STRING, updated_at TIMESTAMP")
FEEDBACK = (
    "id BIGINT, question STRING, answer STRING, rating STRING, reason STRING, comment STRING, session_id STRING, source STRING, "
    "chunk_ids ARRAY<BIGINT>, search_mode STRING, fiscal_year STRING, created_at TIMESTAMP"
)
USAGE = (
    "id BIGINT, source STRING, question STRING, model STRING, input_tokens INT, output_tokens INT, total_tokens INT, "
    "search_mode STRING, fiscal_year STRING, latency_ms INT, created_at TIMESTAMP"
)
TABLES = {"documents": DOCUMENTS, "document_chunks": CHUNKS, "terms_dictionary": TERMS, "rag_config": CONFIG, "qa_feedback": FEEDBACK, "usage_log": USAGE}

#: Chunk ids are document_id * CHUNKS_PER_DOCUMENT + chunk_index.
CHUNKS_PER_DOCUMENT = 1_000_000
