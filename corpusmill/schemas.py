"""Schemas of the engine's records; nothing is inferred."""

PAGE = "doc_id string, page int, raw_text string, clean_text string"
INGEST = "struct<embedding_model: string, embedding_model_dimension: int, ingest_config_version: string, ingested_at: string>"
CHUNK = f"schema_version int, doc_id string, chunk_id string, url string, document_title string, section_title string, section_path array<string>, chunk_index bigint, page_start bigint, page_end bigint, tags array<string>, content_hash string, chunking_version string, chunk_created_at string, text string, ingest {INGEST}"
GOLDEN = "version string, scenario string, questions array<struct<question_id: string, question: string, soft_positive_chunk_ids: array<string>, strict_positive_chunk_ids: array<string>, graded_relevance: array<struct<chunk_id: string, score: float>>>>"
QUESTION_TAGS = "question_id string, tags array<string>"
MANIFEST = "run_id string, status string, started_at string, completed_at string, run_scope_request_ids array<string>"
REJECT = "chunk_id string, chunk_index bigint, stage string, error string"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
