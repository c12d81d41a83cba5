"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


CHUNKS = _table(
    "chunk_id STRING, doc_id STRING, parent_id STRING, chunk_type STRING, seq INT, char_start INT, text STRING, "
    "collection STRING, source_id STRING, doc_revision STRING, doc_hash STRING, source_url STRING, scenario STRING, "
    "status STRING, access STRING, risk STRING, action STRING, version STRING, error_codes ARRAY<STRING>, "
    "tags ARRAY<STRING>, valid_from INT, valid_to INT, media_type STRING, media_ref STRING, extra MAP<STRING,STRING>, "
    "embedding ARRAY<FLOAT>"
)
TENANTS = _table("id BIGINT, code STRING, name STRING, created_at TIMESTAMP")
USERS = _table("id BIGINT, username STRING, display_name STRING, role STRING, tenant_id BIGINT, active INT, created_at TIMESTAMP")
LLM_CONFIGS = _table("id BIGINT, owner_user_id BIGINT, name STRING, base_url STRING, model STRING, json_mode BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP")
AUDIT_LOGS = _table("id BIGINT, tenant_id BIGINT, user_id STRING, action STRING, detail STRING, ip STRING, created_at TIMESTAMP")
EXECUTION_OPERATIONS = _table("id BIGINT, operation_id STRING, action STRING, actor_id BIGINT, target_user_id BIGINT, tenant_id BIGINT, source STRING, status STRING, result STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
AGENT_REQUESTS = _table("id BIGINT, conversation_id BIGINT, actor_id BIGINT, request_id STRING, fingerprint STRING, status STRING, terminal_event STRING, created_at TIMESTAMP")
TICKET_STATUS_LOGS = _table("id BIGINT, conversation_id BIGINT, from_status STRING, to_status STRING, reason STRING, created_at TIMESTAMP")
CONVERSATIONS = _table("id BIGINT, user_id BIGINT, tenant_id BIGINT, intent STRING, request_type STRING, device STRING, error_code STRING, username STRING, status STRING, ticket_id STRING, created_at TIMESTAMP")
MESSAGES = _table("id BIGINT, conversation_id BIGINT, role STRING, content STRING, elapsed_ms DOUBLE, feedback STRING, created_at TIMESTAMP")
TRACES = _table("id BIGINT, conversation_id BIGINT, node STRING, result STRING, elapsed_ms DOUBLE, created_at TIMESTAMP")
KB_DOCUMENTS = _table("id BIGINT, kb_name STRING, path STRING, doc_id STRING, doc_hash STRING, chunk_count INT, status STRING, valid_to STRING, changelog STRING, updated_at TIMESTAMP")
KB_SOURCES = _table("id STRING, desired_seq BIGINT, active_job STRING, previous_job STRING, denied ARRAY<STRING>, known MAP<STRING,ARRAY<STRING>>, updated_at TIMESTAMP")
KB_SYNC_JOBS = _table("id STRING, source_id STRING, seq BIGINT, commit_sha STRING, snapshot_hash STRING, profile STRING, status STRING, fence INT, attempts INT, lease_until TIMESTAMP, collection STRING, manifest STRING, next_attempt_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP")
