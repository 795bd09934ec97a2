"""The model's tables as deterministic views over the star-schema test tables.

Each view is one SELECT that Spark and other engines both run, but for a few functions that `DIALECTS` spells out; so
queries and the SQL that checks them see the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {"iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", "us": "unix_micros(to_timestamp({0}))", "text": "string", "words": "split({0}, ' ')"},
    "duckdb": {"iso": "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')", "us": "epoch_us({0})", "text": "varchar", "words": "string_split({0}, ' ')"},
}

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

# Shapes of inputs of scalar functions, by kind; `|` stands for a line break, `~` for a word of a document, `#` for two digits.
CASES = {
    "date": ("2026-07-10", "2026-07-10T00:00:00Z", "2026-07-10T02:00:00+02:00", "2026-07-10T12:#:56.789Z", "2026-07-10T12:34:#", "2026-01-10T23:59:59.5-05:30"),
    "host": ("mini-~.local", "~.localdomain", "Mac", "macbook-pro.local", "", " ", "localhost", "build-#", "UNKNOWN", "a.local.localdomain"),
    "agent": ("a1e94cf", "~", "acompact-1f", "abb5998eb0fb929#", "aside_question-2", "dead-beef", "", "-x", "Abc"),
    "path": (
        "/Users/me/work/~", "-Users-me-my-code-~-peaks", "-Users-me", "/sessions/x/mnt/~/a.md", "/Users/me/OneDrive-Acme/~/b.md", "/tmp/x", "/Users/me/Documents/notes.txt", "/Claude_Coworks/alpha/outputs", "/mnt/outputs/beta", "relative/path",
        "/var/folders/ab/c", "/Users/me/Downloads/.claude/gamma", "/a/local-agent-mode-sessions/mnt/x", "/p/11111111-2222-3333-4444-555555555555/subagents/agent-a1b#.jsonl", "/p/11111111-2222-3333-4444-555555555555/subagents/workflows/wf_#-~/agent-c#.jsonl", "/p/q/agent-d4.jsonl", "/p/s.jsonl",
    ),
    "spawn": ('{"subagent_type": "~", "prompt": "look"}', '{"name": "n#"}', '{"resume": "x"}', "{}", '{"name": " flow ", "args": "a"}', '{"title": "~"}', '{"scriptPath": "/x/find-~-wf_#.js"}', '{"resumeFromRunId": "wf_77", "script": "export const meta = { name: \'deep\' }"}', '{"run_in_background": true, "model": "m"}'),
    "reply": ('{"~": 1}', '```json|{"a": 2}|```', '<think>x|y</think> {"a": 3} done', "  ", "no ~", 'say {"a": {"b": 4}} end }'),
    "tools": ("Using ~ tool and Tool: find#", '<invoke name="edit">', "Tool: a Tool: a Using b tool", "none", ""),
    "marker": ("|--- tool_use: ~ ---|{}|", "text|--- tool_result: web (ok) ---|x|--- tool_result: sh (error) ---|y", " --- tool_use: ~ ---", "plain"),
    "result": ('[{"type": "text", "text": "~"}, {"type": "text", "text": "b"}]', "plain ~", '{"type": "text", "text": "c"}', '["d", "e", ""]', "", '[{"type": "image"}]'),
    "noise": ("data:image/png;base64,AAA= x", "<thinking>~ #", "[Request interrupted by user] y", "The user opened the file a.py in the IDE. go", "</system-reminder>z", "plain"),
    "error": ("Exit code 1#|~", "Exit code x", "no", "Exit code 1", "false", "0", "NULL", " none ", "true", "", "1"),
    "command": ("cat -n ~.txt b", "mv -f ~ b#", "cp a", "grep a", "ls", "/bin/rm x", "tail f g", "", "  head  y ", "chmod 1 z"),
    "tool": ("mcp__~__do", "mcp__srv__do__more", "mcp__x", "Read", "mcp____y", ""),
    "source": ("codex_work_desktop", "Codex Desktop", "codex_vscode", "codex_cli_rs", "codex-tui", "codex_exec", "banana_client", ""),
    "tagged": ("<system-reminder>~</system-reminder> hi # ", "~ <b>c</b>", "x <ide_selection> y", "<command-name>a</command-name>", "plain"),
}


def _cases() -> str:
    """Each document gives one case of each kind: the shape that its number picks, with a word of its text and digits of its number."""
    rows = [f"('{kind}', {i}, {len(values)}, '{x.replace(chr(39), chr(39) * 2)}')" for kind, values in CASES.items() for i, x in enumerate(values)]
    word = "lower(coalesce(nullif(regexp_extract(text, '([A-Za-z]{2,6})', 1), ''), 'word'))"
    filled = f"replace(replace(replace(shape, '|', chr(10)), '~', {word}), '#', lpad(concat('', doc_id % 60), 2, '0'))"
    return f"SELECT kind, doc_id AS n, {filled} AS x FROM documents JOIN (VALUES {', '.join(rows)}) AS t(kind, i, size, shape) ON doc_id % size = i"


VIEWS = {
    "cases": ("documents", _cases()),
    "chat_log": (
        "conversations",
        """SELECT concat('c', conv_id) AS session_id, conv_id % 7 AS project_id, turn AS seq, role AS type, CASE WHEN conv_id % 5 = 0 AND turn < 2 THEN concat('<system-reminder>', substr(text, 1, 20), '</system-reminder>') ELSE text END AS content,
        concat('2024-01-', lpad(concat('', 1 + conv_id % 28), 2, '0'), 'T10:', lpad(concat('', turn), 2, '0'), ':00.000Z') AS ts_raw, conv_id % 50 AS tokens_in, turn AS tokens_out, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('m', turn % 2) END AS model FROM conversations""",
    ),
    "chat_usage": (
        "conversations",
        """SELECT concat('c', conv_id) AS session_id, conv_id % 7 AS project_id, concat('u', turn % 3) AS model, conv_id % 11 AS input_tokens, turn AS output_tokens, 1 AS cache_creation_tokens, turn % 2 AS cache_read_tokens FROM conversations WHERE conv_id % 2 = 0""",
    ),
    "chat_calls": (
        "conversations",
        """SELECT concat('c', conv_id) AS session_id, conv_id % 7 AS project_id, turn AS id, CASE turn % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'skill' ELSE 'subagent' END AS family, concat('tool', turn % 2) AS tool, concat('skill', conv_id % 3) AS skill_name,
        CASE WHEN turn % 2 = 0 THEN '' ELSE 'Explore' END AS subagent_type FROM conversations""",
    ),
    "people": ("token_usage", "SELECT DISTINCT user_id AS id, concat('user', user_id) AS name FROM token_usage WHERE user_id % 3 <> 0"),
    "machines": ("token_usage", "SELECT DISTINCT host_id AS id, concat('Host-', host_id) AS name FROM token_usage"),
    "workplaces": ("token_usage", "SELECT DISTINCT project_id AS id, concat('project', project_id) AS name FROM token_usage WHERE project_id <> 6"),
    "session_meta": (
        "token_usage",
        """SELECT DISTINCT session_id, project_id, CASE user_id % 5 WHEN 0 THEN 'development' WHEN 1 THEN 'meeting' WHEN 2 THEN 'unheard' ELSE 'support' END AS classification, CASE user_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'secret' ELSE 'internal' END AS data_sensitivity,
        {words:concat('a b c d e f g', user_id)} AS topics, {words:CASE WHEN user_id % 2 = 0 THEN 'Ann' ELSE 'Bob Eve' END} AS people, concat('model-', user_id % 4) AS model_used, concat(substr(ts_raw, 1, 10), 'T12:00:00') AS updated_at FROM token_usage WHERE user_id % 4 <> 0""",
    ),
    "agents": (
        "token_usage",
        """SELECT concat('s', user_id) AS session_id, user_id % 2 AS project_id, CASE WHEN user_id % 5 = 1 THEN concat('a', user_id) WHEN user_id % 5 = 2 THEN concat('a', user_id + 1) END AS agent_id, CASE WHEN user_id % 5 = 3 THEN concat('s', user_id - 2) END AS parent_session_id,
        count(*) AS message_count, CAST(sum(input_tokens) AS BIGINT) AS total_tokens FROM token_usage GROUP BY user_id""",
    ),
    "token_usage": (
        "events",
        f"""SELECT event_id AS id, concat('u', user_id, '-', substr({{iso:ts}}, 1, 10)) AS session_id, user_id % 7 AS project_id, user_id, user_id % 3 AS host_id, {{iso:ts}} AS ts_raw,
        event_type AS model, {_K} AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, event_id % 50 AS cache_creation_tokens, event_id % 200 AS cache_read_tokens,
        concat('m', event_id) AS api_message_id FROM events""",
    ),
    "tool_calls": (
        "events",
        f"""SELECT event_id AS id, concat('u', user_id, '-', substr({{iso:ts}}, 1, 10)) AS session_id, user_id % 7 AS project_id, user_id, user_id % 3 AS host_id, {{iso:ts}} AS ts_raw,
        CASE event_id % 7 WHEN 0 THEN 'bash' WHEN 1 THEN 'file' WHEN 2 THEN 'search' WHEN 3 THEN 'skill' WHEN 4 THEN 'subagent' WHEN 5 THEN 'mcp' ELSE 'builtin_host' END AS family,
        concat(event_type, '_', user_id % 5) AS name, CASE event_id % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Edit' ELSE 'Write' END AS tool,
        concat('/src/f', {_K} % 40, '.py') AS file_path, concat('cd /w && run', {_K}, ' x') AS command, concat('cmd', user_id % 23) AS cmd_name,
        CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN '' ELSE concat('/t/', {_K} % 30) END AS target_file,
        concat('p', {_K} % 33) AS pattern, CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('/d', {_K} % 11) END AS path, concat('skill', user_id % 25) AS skill_name,
        CASE WHEN user_id % 6 = 0 THEN '' ELSE concat('type', user_id % 24) END AS subagent_type, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Task' ELSE 'Agent' END AS spawn_tool,
        concat('srv', user_id % 6) AS server_name, CASE WHEN event_type = 'error' THEN user_id % 4 END AS exit_code,
        CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN NULL ELSE 0 END AS is_error,
        CASE WHEN event_type <> 'error' THEN '' ELSE CASE event_id % 8 WHEN 0 THEN 'Sibling tool call errored: Permission to use Bash' WHEN 1 THEN 'The user doesn''t want to proceed'
          WHEN 2 THEN 'AbortError' WHEN 3 THEN 'InputValidationError: x' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE concat('boom ', user_id % 9) END END AS error_text
        FROM events""",
    ),
    "session_sources": (
        "token_usage",
        "SELECT DISTINCT session_id, project_id, CASE user_id % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'desktop' WHEN 2 THEN 'web' ELSE 'agent' END AS source FROM token_usage WHERE user_id % 10 <> 0",
    ),
    "pricing": (
        "part",
        """SELECT model, CAST(input_price AS DOUBLE) AS input_price, CAST(output_price AS DOUBLE) AS output_price, CAST(cache_write_price AS DOUBLE) AS cache_write_price,
        CAST(cache_read_price AS DOUBLE) AS cache_read_price, from_date, to_date FROM (VALUES ('view', 3.0, 15.0, 3.75, 0.3, '2024-01-01', '2024-01-15'), ('view', 2.0, 10.0, 2.5, 0.2, '2024-01-15', NULL),
        ('click', 5.0, 25.0, 6.25, 0.5, '2024-01-01', '2024-01-15'), ('click', 4.0, 20.0, 5.0, 0.4, '2024-01-15', NULL), ('purchase', 1.75, 14.0, 0.0, 0.175, '2024-01-01', NULL),
        ('error', 1.0, 5.0, 1.25, 0.1, '2024-01-10', NULL)) AS t(model, input_price, output_price, cache_write_price, cache_read_price, from_date, to_date)
        UNION ALL SELECT concat('part', p_partkey) AS model, CAST(p_size AS DOUBLE) AS input_price, p_size * 5.0 AS output_price, p_size * 1.25 AS cache_write_price, p_size * 0.125 AS cache_read_price,
        CASE WHEN k = 0 THEN '2024-01-01' ELSE concat('2024-01-', lpad(concat('', 10 + p_partkey % 9), 2, '0')) END AS from_date, CASE WHEN k = 0 THEN concat('2024-01-', lpad(concat('', 10 + p_partkey % 9), 2, '0')) END AS to_date FROM part CROSS JOIN (VALUES (0), (1)) AS s(k)""",
    ),
    "sessions": (
        "token_usage",
        """SELECT session_id, project_id, user_id, host_id, min(ts_raw) AS ts_raw, max(model) AS model, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, count(*) AS message_count,
        concat('title ', session_id) AS summary FROM token_usage GROUP BY session_id, project_id, user_id, host_id""",
    ),
    "tree": (
        "token_usage",
        """SELECT concat('n', user_id) AS session_id, user_id % 2 AS project_id, CASE WHEN user_id % 17 = 3 THEN 'gone' ELSE concat('n', CAST(floor(user_id / 3) AS BIGINT)) END AS parent_session_id,
        min(ts_raw) AS ts_raw, CAST(sum(input_tokens) AS BIGINT) AS total_tokens FROM token_usage GROUP BY user_id""",
    ),
    "metadata": (
        "documents",
        """SELECT concat('d', doc_id) AS session_id, doc_id % 7 AS project_id, CASE doc_id % 5 WHEN 0 THEN 'development' WHEN 1 THEN 'meeting' WHEN 2 THEN 'marketing' WHEN 3 THEN 'support' ELSE NULL END AS classification,
        CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END AS data_sensitivity, {words:substr(text, 1, 30)} AS topics, source AS client, text FROM documents""",
    ),
    "messages": (
        "conversations",
        """SELECT concat('c', conv_id) AS session_id, conv_id % 7 AS project_id, turn AS seq, role AS type, text AS content, 1704067200 + conv_id * 3600 + turn * (60 + conv_id % 9 * 45) AS t FROM conversations""",
    ),
    "activity": (
        "events",
        """SELECT event_id AS id, concat('u', user_id) AS session_id, substr({iso:ts}, 1, 10) AS day, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE event_type END AS type,
        CAST({us:ts} AS BIGINT) AS us, user_id % 7 AS project_id FROM events""",
    ),
}


def _rendered(sql: str, dialect: str) -> str:
    return re.sub(r"\{(iso|us|text|words):([^}]*)\}", lambda m: DIALECTS[dialect][m[1]].format(m[2]), sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    sql = _rendered(sql, "spark")
    if base is None:
        return spark.sql(sql)
    source = view(spark, sf_dir, base) if base in VIEWS else spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {base}", "FROM {source}"), source=source)


def with_views(sql: str, *names: str) -> str:
    """`sql` for DuckDB with the named views, and those they stand on, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        base = VIEWS[name][0]
        if base in VIEWS:
            add(base)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    # a view may be named like the table below it
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_rendered(VIEWS[n][1], 'duckdb')})" for n in order) + " " + sql
