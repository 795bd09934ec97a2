"""The columnar model: schemas of the fact and dimension tables, and `conform`, which brings a table to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_KEY = "session_id string, project_id long, user_id long, host_id long"
_OUTCOME = "tool_call_id string, is_error int, duration_ms long, error_text string"

TABLES = {
    "sessions": f"{_KEY}, ts_raw string, display string, summary string, project string, model string, total_tokens long, message_count long, tools_used array<string>, cwd string, git_branch string, parent_session_id string, agent_id string, workflow_id string",
    "messages": f"id long, {_KEY}, uuid string, type string, content string, ts_raw string, tokens_in long, tokens_out long, model string, api_message_id string, agent_id string",
    "tool_calls": f"id long, {_KEY}, ts_raw string, family string, name string, tool string, file_path string, command string, cmd_name string, target_file string, pattern string, path string, skill_name string, subagent_type string, spawn_tool string, workflow_id string, server_name string, kind string, exit_code int, {_OUTCOME}",
    "token_usage": f"id long, {_KEY}, ts_raw string, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cwd string, api_message_id string",
    "session_sources": "session_id string, project_id long, source string, client_version string, meta_json string",
    "metadata": "session_id string, project_id long, summary string, abstract string, classification string, data_sensitivity string, topics array<string>, people array<string>, clients array<string>, tags array<string>, model_used string, created_at string, updated_at string",
    "pricing": "model string, provider string, input_price double, output_price double, cache_write_price double, cache_read_price double, from_date string, to_date string, notes string",
    "state": "key string, project_id long, source string, host_id long, value string",
}

#: Natural keys by which tables are deduplicated and merged.
KEYS = {
    "sessions": ["session_id", "project_id"],
    "messages": ["session_id", "project_id", "uuid"],
    "token_usage": ["ts_raw", "session_id", "project_id"],
    "session_sources": ["session_id", "project_id"],
    "metadata": ["session_id", "project_id"],
    "pricing": ["model", "from_date"],
    "state": ["key", "project_id", "source", "host_id"],
}


def schema(table: str) -> StructType:
    return _parse_datatype_string(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, cast to their types; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(table)])
