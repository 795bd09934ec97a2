"""Registered queries of functions, sessions, the knowledge base, maintenance and the remaining report legs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import commands, dates, identity, outcomes, text
from tracemill.operators import graph, knowledge, maintenance, merge, reports, sessions

from .catalogue import _DAY, _ERRORS, _MEASURED, _OUTCOME, _PRICED, CALLS, USAGE, Report, Tables, _counted, _of

CASES = ("cases",)
_KEYS = ["session_id", "project_id"]


def _case(t: Tables, kind: str, **columns: Callable[[Column], Column]) -> DataFrame:
    """Functions of the literal inputs of a kind."""
    return t("cases").filter(F.col("kind") == kind).select("n", *[f(F.col("x")).alias(name) for name, f in columns.items()])


def _cases_sql(kind: str, columns: str) -> str:
    return f"SELECT n, {columns} FROM cases WHERE kind = '{kind}'"


_AWARE = "CASE WHEN regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN x WHEN length(x) = 10 THEN x || 'T00:00:00Z' ELSE x || 'Z' END"
_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%gZ')"
_TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_BASE = "list_extract(string_split(regexp_replace(x, '/+$', ''), '/'), -1)"
_PARTS = f"list_filter(string_split({_BASE}, '-'), lambda p: p NOT IN ('', 'Users', 'Library', 'CloudStorage'))"
_GENERIC = "(" + ", ".join(f"'{g}'" for g in identity.GENERIC_FOLDERS) + ")"
_ROOTS = "(" + ", ".join(f"'{g}'" for g in identity.PROJECT_ROOTS) + ")"
_FITS = f"({{0}} <> '' AND NOT starts_with({{0}}, '-') AND NOT (contains({{0}}, '.') AND NOT starts_with({{0}}, '.')) AND lower({{0}}) NOT IN {_GENERIC})"
_AWAY = " OR ".join(["starts_with(lower(x), '/tmp')", "starts_with(lower(x), '/private/tmp')", *[f"contains(lower(x), '{p}')" for p in identity.NO_PROJECT_PATHS]])
_INFER = f"""WITH segs AS (SELECT n, x, list_filter(string_split(x, '/'), lambda s: s <> '') AS s FROM cases WHERE kind = 'path')
SELECT n, CASE WHEN NOT starts_with(x, '/') OR {_AWAY} THEN NULL ELSE coalesce(
  list_extract(list_transform(list_filter(range(1, len(s)), lambda i: lower(s[i]) IN {_ROOTS} AND {_FITS.format('s[i + 1]')}), lambda i: s[i + 1]), 1),
  CASE WHEN len(s) > 2 AND lower(s[1]) = 'users' THEN list_extract(list_filter(s[3:], lambda p: NOT starts_with(lower(p), 'onedrive') AND {_FITS.format('p')}), 1) END) END AS project FROM segs"""
_UUID = "[^/-]*-[^/-]*-[^/-]*-[^/-]*-[^/-]*"
_SPAWN = """SELECT n, tool AS spawn_tool, CASE WHEN tool <> 'Workflow' THEN coalesce(nullif(json_extract_string(x, '$.subagent_type'), ''), nullif(json_extract_string(x, '$.name'), ''), CASE WHEN json_extract_string(x, '$.resume') IS NOT NULL THEN '(resumed)' ELSE '(unspecified)' END)
  ELSE coalesce(nullif(trim(json_extract_string(x, '$.name')), ''), nullif(trim(json_extract_string(x, '$.title')), ''), nullif(regexp_extract(json_extract_string(x, '$.script'), 'name\\s*:\\s*[''"]([^''"]+)[''"]', 1), ''),
    nullif(regexp_replace(regexp_replace(list_extract(string_split(json_extract_string(x, '$.scriptPath'), '/'), -1), '-wf_[A-Za-z0-9._-]+\\.js$', ''), '\\.js$', ''), ''), '(inline-script)') END AS subagent_type,
  CASE WHEN tool = 'Workflow' THEN coalesce(nullif(json_extract_string(x, '$.args'), ''), json_extract_string(x, '$.script'), '') ELSE coalesce(json_extract_string(x, '$.prompt'), '') END AS prompt,
  CASE WHEN tool = 'Workflow' OR json_extract_string(x, '$.run_in_background') = 'true' THEN 1 ELSE 0 END AS run_in_background,
  CASE WHEN tool <> 'Workflow' THEN '' WHEN starts_with(json_extract_string(x, '$.resumeFromRunId'), 'wf_') THEN json_extract_string(x, '$.resumeFromRunId') ELSE coalesce(regexp_extract(json_extract_string(x, '$.scriptPath'), '-(wf_[A-Za-z0-9._-]+)\\.js$', 1), '') END AS workflow_id
FROM cases, (VALUES ('Task'), ('Agent'), ('Workflow')) AS t(tool) WHERE kind = 'spawn'"""
_NOISE_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{0}', '[image]', 'g'), '{1}', '[blob]', 'g'), '{2}', ' ', 'g'), '{3}', ' ', 'g')".format(*[p for p, _ in text.NOISE])
_TAGS = "|".join(text.SYSTEM_TAGS)
_PROGRAM = "list_extract(string_split(list_extract(regexp_split_to_array(trim(x), '\\s+'), 1), '/'), -1)"
_WORDS = "list_filter(regexp_split_to_array(trim(x), '\\s+')[2:], lambda w: NOT starts_with(w, '-'))"
_FIRST_WORDS = "(" + ", ".join(f"'{w}'" for w in commands.FIRST_WORD) + ")"
_FILES = "(" + ", ".join(f"'{w}'" for w in commands.FILE_COMMANDS) + ")"


def _spawns(t: Tables) -> DataFrame:
    tools = F.explode(F.array(*map(F.lit, identity.SPAWN_TOOLS)))
    return _case(t, "spawn", x=lambda x: x).withColumn("tool", tools).withColumn("r", identity.spawned(F.col("tool"), F.col("x"))).select("n", "r.spawn_tool", "r.subagent_type", "r.prompt", "r.run_in_background", "r.workflow_id")


# session table
_WHO = "session_id, project_id"
_CLEAN = "regexp_replace(regexp_replace(content, '(?is)<system-reminder>.*?</system-reminder>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
_AGGREGATED = f""", firsts AS (SELECT {_WHO}, seq, ts_raw, content, {_CLEAN} AS clean, row_number() OVER (PARTITION BY {_WHO} ORDER BY ts_raw, seq) AS place FROM chat_log WHERE type = 'user'),
shown AS (SELECT {_WHO}, coalesce(first(clean ORDER BY place) FILTER (clean <> ''), first(content ORDER BY place) FILTER (content <> '')) AS display FROM firsts WHERE place <= 10 GROUP BY ALL),
base AS (SELECT {_WHO}, min(ts_raw) AS ts_raw, count(*) AS message_count, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS own, max(model) AS own_model FROM chat_log GROUP BY ALL),
spent AS (SELECT {_WHO}, CAST(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS BIGINT) AS used, max(model) AS used_model FROM chat_usage GROUP BY ALL),
tools AS (SELECT {_WHO}, list_sort(list(DISTINCT name)) AS tools_used FROM (SELECT {_WHO}, CASE family WHEN 'file' THEN tool WHEN 'skill' THEN skill_name ELSE subagent_type END AS name FROM chat_calls) WHERE name <> '' GROUP BY ALL) """
_TITLED = "CASE WHEN display IS NULL OR display = '' THEN NULL WHEN strpos(substr(display, 1, 100), '. ') > 0 THEN substr(display, 1, strpos(substr(display, 1, 100), '. ')) WHEN length(display) > 80 THEN substr(display, 1, 80) || '...' ELSE display END"
_STAR = """, starred AS (SELECT s.*, coalesce(ss.source, 'unknown') AS client_source, m.classification AS meta_classification, m.data_sensitivity AS meta_sensitivity, p.name AS project_name, u.name AS username, h.name AS hostname FROM sessions s
  LEFT JOIN session_sources ss USING (session_id, project_id) LEFT JOIN session_meta m USING (session_id, project_id) LEFT JOIN workplaces p ON p.id = s.project_id LEFT JOIN people u ON u.id = s.user_id LEFT JOIN machines h ON h.id = s.host_id) """
STAR = ("sessions", "session_sources", "session_meta", "workplaces", "people", "machines")


def _starred(t: Tables) -> DataFrame:
    return sessions.starred(t("sessions"), t("session_sources"), t("session_meta"), t("workplaces"), t("people"), t("machines"))


def _tree_sessions(t: Tables) -> DataFrame:
    """Sessions of a user hang below that user's first one."""
    first = t("sessions").groupBy("user_id").agg(F.min("session_id").alias("first"))
    return t("sessions").join(first, "user_id").withColumn("parent_session_id", F.when(F.col("session_id") != F.col("first"), F.col("first"))).drop("first")


_TREE = ", kin AS (SELECT s.*, CASE WHEN s.session_id <> f.first THEN f.first END AS parent_session_id FROM sessions s JOIN (SELECT user_id, min(session_id) AS first FROM sessions GROUP BY 1) f USING (user_id)) "
_HIT = ", hit AS (SELECT DISTINCT session_id FROM tool_calls WHERE name = 'click_3') "
_COSTS = ", costs AS (SELECT session_id, project_id, round(sum(cost), 4) AS cost_usd FROM priced GROUP BY 1, 2) "


def _bash(t: Tables, name: str = "cmd3") -> DataFrame:
    return _of(t, "bash").filter(F.col("cmd_name") == name)


_BASH = "FROM tool_calls WHERE family = 'bash' AND cmd_name = 'cmd3'"


def _points(t: Tables) -> DataFrame:
    """Points with two tags each for half of the sessions."""
    tags = F.array(F.concat(F.lit("t"), F.col("user_id") % 3), F.concat(F.lit("t"), F.col("user_id") % 4))
    return t("sessions").filter("user_id % 2 = 0").select("session_id", tags.alias("tags"), F.col("model").alias("kind"))


_POINTS = ", points AS (SELECT session_id, [concat('t', user_id % 3), concat('t', user_id % 4)] AS tags, model AS kind FROM sessions WHERE user_id % 2 = 0) "
_VALID_CLASS = "CASE WHEN classification IN (" + ", ".join(f"'{c}'" for c in knowledge.CLASSIFICATIONS) + ") THEN classification ELSE 'development' END"
_VALID_LEVEL = "CASE WHEN data_sensitivity IN ('internal', 'confidential', 'restricted') THEN data_sensitivity WHEN data_sensitivity = 'public' AND len(people) = 0 THEN 'public' ELSE 'internal' END"


def _rule(words: Column) -> Column:
    """A stand-in for a model: long sessions are support, others an unknown class."""
    return F.struct(F.when(F.length(words) > 400, "support").otherwise("chatter").alias("classification"), F.lit("public").alias("data_sensitivity"), F.split(F.substring(words, 1, 20), " ").alias("topics"))


def _half(t: Tables, name: str, n: int) -> DataFrame:
    return t(name).filter(F.col("id") % 3 != n)


_DAILY = {"skills": "skill", "subagents": "subagent", "mcp": "mcp", "bash": "bash", "search": "search"}

REPORTS: tuple[Report, ...] = (
    # dates
    Report("fn_since", lambda t: _case(t, "date", s=dates.since).select("n", "s.text", "s.epoch"), CASES, _cases_sql("date", f"{_ISO.format(f'epoch_us(CAST({_AWARE} AS TIMESTAMPTZ))')} AS text, epoch_us(CAST({_AWARE} AS TIMESTAMPTZ)) / 1e6 AS epoch")),
    Report("fn_codex_ts", lambda t: _case(t, "date", event=lambda x: F.unix_millis(dates.event_time(x)), mark=lambda x: F.unix_millis(dates.watermark_time(x, "Etc/GMT-2"))), CASES,
           _cases_sql("date", f"epoch_ms(CAST({_AWARE} AS TIMESTAMPTZ)) AS event, epoch_ms(CAST({_AWARE} AS TIMESTAMPTZ)) - CASE WHEN regexp_matches(x, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN 0 ELSE 7200000 END AS mark")),
    Report("fn_epoch_iso", lambda t: t("events").select("event_id", dates.epoch_iso(F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 86_400.25).otherwise(0)).alias("iso")), (), "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(make_timestamp(CAST(event_id * 86400250 * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso FROM events"),
    Report("fn_duration_min", lambda t: t("token_usage").groupBy("session_id").agg(dates.duration_minutes(F.min("ts_raw"), F.max("ts_raw")).alias("minutes")), ("token_usage",), "SELECT session_id, round(date_diff('second', CAST(substr(min(ts_raw), 1, 19) AS TIMESTAMP), CAST(substr(max(ts_raw), 1, 19) AS TIMESTAMP)) / 6e1 + 1e-9, 1) AS minutes FROM token_usage GROUP BY 1"),
    # identity
    Report("fn_hostname", lambda t: _case(t, "host", host=identity.hostname), CASES, ", short AS (SELECT n, regexp_replace(regexp_replace(x, '\\.localdomain$', ''), '\\.local$', '') AS h FROM cases WHERE kind = 'host') SELECT n, CASE WHEN lower(trim(h)) IN (" + ", ".join(f"'{g}'" for g in identity.GENERIC_HOSTS) + ") THEN NULL ELSE h END AS host FROM short"),
    Report("fn_agent_hex", lambda t: _case(t, "agent", real=identity.is_agent_id), CASES, _cases_sql("agent", "regexp_matches(x, '^[0-9a-f]+(-|$)') AS real")),
    Report("fn_project_name", lambda t: _case(t, "path", project=identity.project_name), CASES, _cases_sql("path", f"CASE WHEN starts_with({_BASE}, '-') THEN coalesce(list_extract({_PARTS}, -1), {_BASE}) ELSE {_BASE} END AS project")),
    Report("fn_infer_project", lambda t: _case(t, "path", project=identity.infer_project), CASES, _INFER.replace("WITH segs", ", segs")),
    Report("fn_session_prefix", lambda t: t("messages").select("session_id", "seq", identity.prefixed(F.col("session_id"), "c1").alias("id")), ("messages",), "SELECT session_id, seq, CASE WHEN starts_with(session_id, 'c1') THEN session_id ELSE 'c1' || session_id END AS id FROM messages"),
    Report("fn_chatgpt_project", lambda t: t("events").select("event_id", identity.chat_project(F.when(F.col("event_id") % 3 == 0, "snorlax").when(F.col("event_id") % 3 == 1, "gpt"), F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("project")), (),
           "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'chatgpt:' || event_type WHEN event_id % 2 = 0 AND event_id % 3 = 1 THEN 'chatgpt:gpt:' || event_type ELSE 'chatgpt' END AS project FROM events"),
    Report("fn_spawn_row", _spawns, CASES, _SPAWN),
    Report("fn_workflow_id", lambda t: _case(t, "path", of_path=identity.workflow_of_path, of_result=identity.workflow_of_result), CASES, _cases_sql("path", "regexp_extract(x, '/subagents/workflows/(wf_[^/]*)/', 1) AS of_path, regexp_extract(x, 'workflows/(wf_[A-Za-z0-9._-]+)', 1) AS of_result")),
    Report("ing_parent_from_path", lambda t: _case(t, "path", agent=identity.agent_of_file, parent=identity.parent_of_path), CASES, _cases_sql("path", f"nullif(regexp_extract(x, '(?:^|/)agent-([^/]+)\\.jsonl$', 1), '') AS agent, nullif(regexp_extract(x, '({_UUID})/subagents/(?:[^/]+/)*agent-[^/]+\\.jsonl$', 1), '') AS parent")),
    Report("ing_agent_identity", lambda t: t("agents").select("session_id", identity.agent_session(F.col("session_id"), F.col("agent_id")).alias("own"), identity.is_agent_id(F.col("agent_id")).alias("real")), ("agents",), "SELECT session_id, CASE WHEN agent_id IS NULL THEN session_id ELSE session_id || '::agent-' || agent_id END AS own, coalesce(regexp_matches(agent_id, '^[0-9a-f]+(-|$)'), false) AS real FROM agents"),
    # texts
    Report("fn_flatten_result", lambda t: _case(t, "result", text=text.flatten_result), CASES, """, items AS (SELECT n, x, CASE WHEN starts_with(x, '[') THEN CAST(x AS JSON[]) WHEN starts_with(x, '{') THEN [CAST(x AS JSON)] END AS a FROM cases WHERE kind = 'result')
SELECT n, CASE WHEN a IS NULL THEN x ELSE coalesce(array_to_string(list_filter(list_transform(a, lambda j: CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(j->>'$.text', '') ELSE j->>'$' END), lambda s: s <> ''), chr(10)), '') END AS text FROM items"""),
    Report("fn_parse_llm_json", lambda t: _case(t, "reply", json=text.model_json), CASES, _cases_sql("reply", "CASE WHEN trim(x) = '' THEN '{}' WHEN regexp_matches(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'), '(?s)\\{.*\\}') THEN regexp_extract(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'), '(?s)\\{.*\\}') ELSE trim(x) END AS json")),
    Report("fn_tools_from_text", lambda t: _case(t, "tools", tools=text.tools_in_text), CASES, _cases_sql("tools", "list_sort(list_distinct(list_concat(regexp_extract_all(x, 'Using (\\w+) tool', 1), regexp_extract_all(x, '<invoke name=\"(\\w+)\"', 1), regexp_extract_all(x, 'Tool: (\\w+)', 1)))) AS tools")),
    Report("fn_marker_regex", lambda t: _case(t, "marker", found=lambda x: F.transform(text.markers(x), lambda m: F.concat_ws("/", m["kind"], m["name"], m["result"]))), CASES,
           _cases_sql("marker", "list_transform(regexp_extract_all(x, '(?m)^--- tool_(?:use|result): .+?(?: \\((?:ok|error)\\))? ---$'), lambda m: concat_ws('/', regexp_extract(m, 'tool_(use|result)', 1), regexp_extract(m, ': (.+?)(?: \\((?:ok|error)\\))? ---$', 1), regexp_extract(m, '\\((ok|error)\\) ---$', 1))) AS found")),
    Report("fn_clean_noise", lambda t: _case(t, "noise", text=text.clean_noise), CASES, _cases_sql("noise", f"{_NOISE_SQL} AS text")),
    Report("fn_strip_system_tags", lambda t: _case(t, "tagged", text=text.strip_system_tags), CASES, _cases_sql("tagged", _TRIMMED.format(f"regexp_replace(regexp_replace(x, '(?is)<(?:{_TAGS})>.*?</(?:{_TAGS})>', '', 'g'), '(?i)</?(?:{_TAGS})/?>', '', 'g')") + " AS text")),
    Report("fn_kb_text", lambda t: text.session_text(t("chat_log"), 40), ("chat_log",), "SELECT session_id, array_to_string(list(CASE WHEN type = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(content, 1, 40) ORDER BY seq), chr(10) || chr(10)) AS text FROM chat_log WHERE trim(substr(content, 1, 40)) <> '' GROUP BY 1"),
    Report("fn_prepare_text", lambda t: text.classifier_text(t("chat_log"), width=500), ("chat_log",), f""", lines AS (SELECT session_id, seq, type, {_TRIMMED.format("regexp_replace(content, '(?i)</?system-reminder>', ' ', 'g')")} AS w FROM chat_log)
SELECT session_id, substr(array_to_string(list(CASE WHEN type = 'user' THEN 'User: ' || w ELSE 'Assistant: ' || substr(string_split(w, chr(10))[1], 1, 300) END ORDER BY seq), chr(10) || chr(10)), 1, 500) AS text FROM lines WHERE w <> '' AND type IN ('user', 'assistant') GROUP BY 1"""),
    Report("fn_full_scan_text", lambda t: text.full_text(t("chat_log")), ("chat_log",), "SELECT session_id, regexp_replace(array_to_string(list(content ORDER BY seq), ' '), '(?i)</?system-reminder>', ' ', 'g') AS text FROM chat_log GROUP BY 1"),
    Report("fn_exit_code", lambda t: _case(t, "error", code=outcomes.exit_code, flag=outcomes.clean_flag), CASES, _cases_sql("error", "TRY_CAST(nullif(regexp_extract(x, '^\\s*Exit code (\\d+)', 1), '') AS INT) AS code, CASE WHEN lower(trim(x)) IN ('', 'false', '0', 'no', 'none', 'null') THEN 0 ELSE 1 END AS flag")),
    Report("fn_target_file", lambda t: _case(t, "command", file=commands.target_file, category=commands.category, related=commands.is_file_related), CASES, _cases_sql("command", f"""CASE WHEN {_PROGRAM} IN ('cp', 'mv') THEN coalesce(list_extract({_WORDS}, 2), list_extract({_WORDS}, 1)) WHEN {_PROGRAM} IN {_FIRST_WORDS} THEN list_extract({_WORDS}, 1) END AS file,
  CASE WHEN {_PROGRAM} IN ('cat', 'head', 'tail', 'less', 'more') THEN 'BashRead' WHEN {_PROGRAM} IN ('cp', 'mv', 'touch') THEN 'BashWrite' END AS category, {_PROGRAM} IN {_FILES} AS related""")),
    Report("fn_mcp_split", lambda t: _case(t, "tool", s=text.split_mcp).select("n", "s.tool", "s.server"), CASES, _cases_sql("tool", "CASE WHEN starts_with(x, 'mcp__') AND len(string_split(x, '__')) >= 3 THEN array_to_string(string_split(x, '__')[3:], '__') ELSE x END AS tool, CASE WHEN starts_with(x, 'mcp__') AND len(string_split(x, '__')) >= 3 THEN string_split(x, '__')[2] ELSE '' END AS server")),
    Report("fn_source_map", lambda t: _case(t, "source", s=text.rollout_source).select("n", "s.source", "s.recognised"), CASES, _cases_sql("source", """CASE lower(x) WHEN '' THEN 'codex_cli' WHEN 'codex_work_desktop' THEN 'chatgpt_work_desktop' WHEN 'codex desktop' THEN 'codex_desktop' WHEN 'codex_vscode' THEN 'codex_vscode' WHEN 'banana_client' THEN 'codex_local' ELSE 'codex_cli' END AS source,
  x NOT IN ('', 'banana_client') AS recognised""")),
    Report("fn_tool_kind", lambda t: t("tool_calls").select("id", text.tool_kind(F.when(F.col("id") % 3 == 0, "chatgpt:1").when(F.col("id") % 3 == 1, "claudeai:2").otherwise("s"), F.when(F.col("id") % 2 == 0, "claude_ai").otherwise("srv"), F.when(F.col("id") % 5 == 0, "web_search").otherwise("x")).alias("kind")), CALLS,
           "SELECT id, CASE WHEN id % 3 = 0 OR (id % 3 = 1 AND id % 2 = 0 AND id % 5 = 0) THEN 'builtin_host' ELSE 'mcp' END AS kind FROM tool_calls"),
    Report("fn_duration_ms", lambda t: t("events").select("event_id", outcomes.duration_ms(F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp") + F.make_interval(secs=(F.col("event_id") % 700_000 - 10).cast("double"))).alias("ms")), (), "SELECT event_id, CASE WHEN event_id % 700000 - 10 BETWEEN 0 AND 604800 THEN (event_id % 700000 - 10) * 1000 END AS ms FROM events"),
    # the session table
    Report("ing_interaction_aggregate", lambda t: sessions.aggregated(t("chat_log"), t("chat_usage"), t("chat_calls")), ("chat_log", "chat_usage", "chat_calls"), _AGGREGATED + f"""SELECT {_WHO}, ts_raw, message_count, coalesce(used, own) AS total_tokens, coalesce(own_model, used_model) AS model, substr(coalesce(display, ''), 1, 200) AS display, {_TITLED} AS summary, coalesce(tools_used, []) AS tools_used
FROM base LEFT JOIN spent USING ({_WHO}) LEFT JOIN shown USING ({_WHO}) LEFT JOIN tools USING ({_WHO})"""),
    Report("set_union_distinct", lambda t: sessions.tools_used(t("chat_calls")), ("chat_log", "chat_usage", "chat_calls"), _AGGREGATED + "SELECT * FROM tools"),
    Report("ing_meta_purge", lambda t: sessions.without_phantoms(t("agents").withColumn("session_id", F.when(F.col("agent_id").isNull(), F.col("session_id")).otherwise(F.concat("session_id", F.lit("::agent-"), F.when(F.col("total_tokens") % 2 == 0, "prompt-1").otherwise(F.col("agent_id")))))).select("session_id"), ("agents",),
           "SELECT CASE WHEN agent_id IS NULL THEN session_id ELSE session_id || '::agent-' || agent_id END AS session_id FROM agents WHERE agent_id IS NULL OR total_tokens % 2 <> 0"),
    Report("ing_husk_heal", lambda t: sessions.healed(t("agents"), t("token_usage").select(F.concat(F.lit("s"), "user_id").alias("session_id"), (F.col("user_id") % 2).alias("project_id")).filter("project_id = 1"), t("token_usage").filter("user_id % 4 = 0").withColumn("session_id", F.concat(F.lit("s"), "user_id")).withColumn("project_id", F.col("user_id") % 2)).select("session_id", "agent_id", "parent_session_id", "message_count", "total_tokens"), ("agents", "token_usage"),
           """, husks AS (SELECT a.session_id, a.project_id FROM agents a JOIN agents c ON c.parent_session_id = a.session_id AND c.project_id = a.project_id AND c.agent_id = a.agent_id), counts AS (SELECT concat('s', user_id) AS session_id, count(*) AS n FROM token_usage WHERE user_id % 2 = 1 GROUP BY 1),
spent AS (SELECT concat('s', user_id) AS session_id, CAST(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS BIGINT) AS n FROM token_usage WHERE user_id % 4 = 0 GROUP BY 1)
SELECT a.session_id, CASE WHEN h.session_id IS NULL THEN agent_id END AS agent_id, CASE WHEN h.session_id IS NULL THEN parent_session_id END AS parent_session_id, CASE WHEN h.session_id IS NULL THEN message_count ELSE coalesce(c.n, 0) END AS message_count, CASE WHEN h.session_id IS NULL THEN total_tokens ELSE coalesce(p.n, 0) END AS total_tokens
FROM agents a LEFT JOIN husks h USING (session_id, project_id) LEFT JOIN counts c USING (session_id) LEFT JOIN spent p USING (session_id)"""),
    Report("join_mapping_lookup", lambda t: sessions.mentioned_parents(t("chat_log").withColumn("content", F.concat(F.lit("see agent-"), F.lower(F.hex(F.col("seq") * 7)), F.lit(".jsonl and agent-zz.jsonl")))), ("chat_log",), """, named AS (SELECT project_id, session_id, seq, ts_raw, lower(to_hex(seq * 7)) AS agent_id FROM chat_log)
SELECT project_id, agent_id, session_id AS parent FROM named QUALIFY row_number() OVER (PARTITION BY project_id, agent_id ORDER BY ts_raw, session_id, seq) = 1"""),
    Report("ing_get_or_create_dim", lambda t: sessions.dimension(t("people").withColumn("last_seen", F.lit("2024-01-01")), t("token_usage").select(F.concat(F.lit("user"), "user_id").alias("name"), "ts_raw").withColumnRenamed("ts_raw", "seen")).select("name", (F.col("id") == F.substring("name", 5, 20).cast("long")).alias("old"), "last_seen"), ("token_usage", "people"),
           "SELECT concat('user', user_id) AS name, user_id % 3 <> 0 AS old, max(ts_raw) AS last_seen FROM token_usage GROUP BY ALL"),
    Report("ing_source_upsert", lambda t: sessions.upsert_sources(t("session_sources").withColumn("client_version", F.lit("")).withColumn("meta_json", F.lit(None).cast("string")), t("sessions").select("session_id", "project_id", F.lit("seen").alias("source"), F.concat(F.lit("v"), F.col("user_id") % 2).alias("client_version"), F.lit("{}").alias("meta_json"), F.lit(1).alias("at")), ("cli",)), ("session_sources", "sessions"),
           "SELECT session_id, project_id, CASE WHEN ss.source IS NULL OR ss.source = 'cli' THEN 'seen' ELSE ss.source END AS source, concat('v', user_id % 2) AS client_version, '{}' AS meta_json FROM sessions LEFT JOIN session_sources ss USING (session_id, project_id)"),
    Report("ing_workflow_stamp", lambda t: sessions.stamped_workflows(_of(t, "subagent").select("id", "session_id", "project_id", F.concat(F.lit("t"), "id").alias("tool_call_id"), F.when(F.col("id") % 3 == 0, "wf_old").alias("workflow_id")), t("tool_calls").filter("id % 2 = 0").select("session_id", "project_id", F.concat(F.lit("t"), "id").alias("tool_call_id"), F.lit("wf_new").alias("workflow_id"))).select("id", "workflow_id"), CALLS,
           "SELECT id, CASE WHEN id % 3 = 0 THEN 'wf_old' WHEN id % 2 = 0 THEN 'wf_new' ELSE '' END AS workflow_id FROM tool_calls WHERE family = 'subagent'"),
    # lists
    Report("join_star", _starred, STAR, _STAR + "SELECT * FROM starred"),
    Report("rep_interactions_list", lambda t: sessions.page(sessions.listed(_tree_sessions(t), t("token_usage"), t("pricing")), 40, 10, F.desc("ts_raw"), F.col("session_id"))[0].select("session_id", "derived_count", "total_tokens", F.round("cost_usd", 3).alias("cost_usd")), ("sessions", *USAGE), _PRICED + _COSTS + _TREE + """, one AS (SELECT k.*, coalesce(cost_usd, 0) AS cost FROM kin k LEFT JOIN costs USING (session_id, project_id))
SELECT m.session_id, count(c.session_id) AS derived_count, CAST(m.total_tokens + coalesce(sum(c.total_tokens), 0) AS BIGINT) AS total_tokens, round(m.cost + coalesce(sum(c.cost), 0), 3) AS cost_usd FROM one m LEFT JOIN one c ON c.parent_session_id = m.session_id WHERE m.parent_session_id IS NULL GROUP BY m.session_id, m.ts_raw, m.total_tokens, m.cost ORDER BY m.ts_raw DESC, m.session_id LIMIT 40 OFFSET 10"""),
    Report("lim_offset", lambda t: graph.paged(t("sessions"), 25, 50, F.desc("ts_raw"), F.col("session_id")).select("session_id", "ts_raw"), ("sessions",), "SELECT session_id, ts_raw FROM sessions ORDER BY ts_raw DESC, session_id LIMIT 25 OFFSET 50"),
    Report("lim_truncated_flag", lambda t: sessions.truncated(t("sessions").select("session_id", "total_tokens"), 20, F.desc("total_tokens"), "session_id"), ("sessions",), "SELECT session_id, total_tokens, (SELECT count(*) > 20 FROM sessions) AS truncated FROM sessions ORDER BY total_tokens DESC, session_id LIMIT 20"),
    Report("join_in_subquery", lambda t: sessions.matching(_tree_sessions(t), t("tool_calls").filter("name = 'click_3'"), True).select("session_id"), ("sessions", "tool_calls"), _TREE + _HIT + "SELECT session_id FROM kin WHERE session_id IN (SELECT session_id FROM hit) OR session_id IN (SELECT parent_session_id FROM kin WHERE session_id IN (SELECT session_id FROM hit))"),
    Report("flt_uuid_search", lambda t: sessions.matching(_tree_sessions(t), t("sessions").filter("session_id like 'u7-%'"), True).select("session_id", F.lit(sessions.is_id("0a1b2c3d-0001-x")).alias("by_id"), F.lit(sessions.is_id("some words")).alias("by_words")), ("sessions",), _TREE + "SELECT session_id, true AS by_id, false AS by_words FROM kin WHERE session_id LIKE 'u7-%' OR session_id IN (SELECT parent_session_id FROM kin WHERE session_id LIKE 'u7-%')"),
    Report("flt_metadata", lambda t: sessions.with_metadata(t("sessions"), t("session_meta"), "support", "internal").select("session_id", "project_id"), ("sessions", "session_meta"), "SELECT session_id, project_id FROM session_meta WHERE classification = 'support' AND data_sensitivity = 'internal'"),
    Report("flt_json_member", lambda t: t("session_meta").filter(F.array_contains("topics", "g7")).select("session_id"), ("session_meta",), "SELECT session_id FROM session_meta WHERE list_contains(topics, 'g7')"),
    Report("flt_like_lookup", lambda t: _starred(t).filter(F.col("hostname").ilike("%ost-1%")).select("session_id"), STAR, _STAR + "SELECT session_id FROM starred WHERE hostname ILIKE '%ost-1%'"),
    Report("flt_tuple_in", lambda t: t("sessions").join(t("session_sources").select(*_KEYS), _KEYS, "left_semi").select(*_KEYS), ("sessions", "session_sources"), "SELECT session_id, project_id FROM sessions WHERE (session_id, project_id) IN (SELECT session_id, project_id FROM session_sources)"),
    Report("flt_null_anti", lambda t: knowledge.candidates(t("sessions"), t("session_meta")).select(*_KEYS), ("sessions", "session_meta"), "SELECT session_id, project_id FROM sessions WHERE (session_id, project_id) NOT IN (SELECT session_id, project_id FROM session_meta)"),
    Report("rep_children", lambda t: graph.children(_tree_sessions(t), "u3-2024-01-01").select("session_id", "ts_raw"), ("sessions",), _TREE + "SELECT session_id, ts_raw FROM kin WHERE parent_session_id = 'u3-2024-01-01'"),
    Report("rep_detail", lambda t: _starred(t).filter("session_id like 'u3-%'").join(t("tool_calls").groupBy(*_KEYS, "family").agg(F.count("*").alias("n")).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.concat_ws("=", "family", "n"))).alias("families")), _KEYS, "left").select("session_id", "client_source", "username", "families"), (*STAR, "tool_calls"), _STAR + """, fams AS (SELECT session_id, project_id, list_sort(list(family || '=' || n)) AS families FROM (SELECT session_id, project_id, family, count(*) AS n FROM tool_calls GROUP BY ALL) GROUP BY ALL)
SELECT session_id, client_source, username, families FROM starred LEFT JOIN fams USING (session_id, project_id) WHERE session_id LIKE 'u3-%'"""),
    Report("day_enrich", lambda t: t("sessions").join(t("session_meta").select(*_KEYS, "classification", "data_sensitivity"), _KEYS, "left").select(*_KEYS, "summary", "classification", "data_sensitivity"), ("sessions", "session_meta"), "SELECT session_id, project_id, summary, classification, data_sensitivity FROM sessions LEFT JOIN session_meta USING (session_id, project_id)"),
    # legs of reports
    *[Report(f"rep_{name}_daily", lambda t, f=family: reports.counted(_of(t, f), reports.day(), outcome=True), CALLS, f'SELECT {_DAY} AS date, count(*) AS "count", {_OUTCOME} FROM tool_calls WHERE family = \'{family}\' GROUP BY 1') for name, family in _DAILY.items()],
    *[Report(f"rep_{name}_totals", lambda t, f=family: _of(t, f).agg(F.count("*").alias("count"), F.count_distinct(*_KEYS).alias("sessions"), *outcomes.outcome_aggregates()), CALLS, f'SELECT count(*) AS "count", count(DISTINCT (session_id, project_id)) AS sessions, {_OUTCOME} FROM tool_calls WHERE family = \'{family}\'') for name, family in _DAILY.items()],
    Report("rep_search_by_tool", lambda t: reports.counted(_of(t, "search"), "tool", outcome=True), CALLS, _counted("search", "tool", True)),
    Report("rep_client_messages", lambda t: reports.by_source(t("token_usage"), t("session_sources"), F.count("*").alias("messages")), ("token_usage", "session_sources"), "SELECT coalesce(source, 'unknown') AS source, count(*) AS messages FROM token_usage LEFT JOIN session_sources USING (session_id, project_id) GROUP BY 1"),
    Report("rep_client_fileops", lambda t: reports.by_source(_of(t, "file"), t("session_sources"), F.count("*").alias("operations"), F.count_distinct("file_path").alias("files")), ("tool_calls", "session_sources"), "SELECT coalesce(source, 'unknown') AS source, count(*) AS operations, count(DISTINCT file_path) AS files FROM tool_calls LEFT JOIN session_sources USING (session_id, project_id) WHERE family = 'file' GROUP BY 1"),
    Report("rep_hosts", lambda t: t("sessions").groupBy("host_id").agg(F.count("*").alias("sessions"), F.count_distinct("user_id").alias("users"), F.sum("total_tokens").alias("tokens"), F.max("ts_raw").alias("last_seen")), ("sessions",), "SELECT host_id, count(*) AS sessions, count(DISTINCT user_id) AS users, CAST(sum(total_tokens) AS BIGINT) AS tokens, max(ts_raw) AS last_seen FROM sessions GROUP BY 1"),
    Report("rep_projects", lambda t: t("sessions").groupBy("project_id").agg(F.count("*").alias("sessions"), F.count_distinct("user_id").alias("users"), F.sum("message_count").alias("messages"), F.min("ts_raw").alias("first_seen")), ("sessions",), "SELECT project_id, count(*) AS sessions, count(DISTINCT user_id) AS users, CAST(sum(message_count) AS BIGINT) AS messages, min(ts_raw) AS first_seen FROM sessions GROUP BY 1"),
    Report("rep_info", lambda t: t("token_usage").agg(F.count("*").alias("rows"), F.count_distinct(*_KEYS).alias("sessions"), F.count_distinct("user_id").alias("users"), F.min("ts_raw").alias("oldest"), F.max("ts_raw").alias("newest")), ("token_usage",), "SELECT count(*) AS rows, count(DISTINCT (session_id, project_id)) AS sessions, count(DISTINCT user_id) AS users, min(ts_raw) AS oldest, max(ts_raw) AS newest FROM token_usage"),
    Report("rep_api_data", lambda t: reduce(DataFrame.unionByName, [t("token_usage").groupBy(F.lit(k).alias("by"), F.col(c).cast("string").alias("key")).agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("tokens")) for k, c in (("project", "project_id"), ("user", "user_id"), ("model", "model"))]), ("token_usage",),
           " UNION ALL ".join(f"SELECT '{k}' AS by, CAST({c} AS VARCHAR) AS key, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM token_usage GROUP BY ALL" for k, c in (("project", "project_id"), ("user", "user_id"), ("model", "model")))),
    Report("rep_bash_drilldown", lambda t: _bash(t).agg(F.count("*").alias("calls"), *outcomes.outcome_aggregates(), *outcomes.never_executed_aggregates()), CALLS, f"SELECT count(*) AS calls, {_OUTCOME}, count(*) FILTER (is_error = 1 AND (contains(error_text, 'Sibling') OR contains(error_text, 'doesn''t want to') OR contains(error_text, 'AbortError') OR contains(error_text, 'InputValidationError'))) AS never_executed, count(*) FILTER (is_error = 1 AND coalesce(error_text, '') = '') AS errors_unclassified {_BASH}"),
    Report("rep_bash_drilldown_codes", lambda t: reports.exit_codes(_bash(t)), CALLS, f"SELECT exit_code, count(*) AS n {_BASH} AND is_error = 1 GROUP BY 1"),
    Report("rep_bash_drilldown_variants", lambda t: reports.command_variants(_bash(t)), CALLS, f"SELECT substr(command, 1, 160) AS command, count(*) AS n, {_ERRORS} AS errors {_BASH} GROUP BY 1 ORDER BY n DESC, command LIMIT 15"),
    Report("rep_bash_drilldown_recent", lambda t: reports.recent_failures(_bash(t), t("workplaces")), ("tool_calls", "token_usage", "workplaces"), f"SELECT ts_raw, session_id, p.name AS project, exit_code, substr(coalesce(error_text, ''), 1, 400) AS error_text, substr(command, 1, 200) AS command FROM tool_calls c JOIN workplaces p ON p.id = c.project_id WHERE family = 'bash' AND cmd_name = 'cmd3' AND is_error = 1 ORDER BY ts_raw DESC, c.id LIMIT 20"),
    Report("set_union_all", lambda t: reduce(DataFrame.unionByName, [_of(t, f).select(F.lit(f).alias("family"), "name", "is_error", "ts_raw") for f in reports.FAMILIES]).groupBy("family", "name").agg(F.count("*").alias("count"), F.max("ts_raw").alias("last_at")), CALLS, 'SELECT family, name, count(*) AS "count", max(ts_raw) AS last_at FROM tool_calls GROUP BY ALL'),
    Report("set_python_union", lambda t: _of(t, "skill").select(reports.day()).union(_of(t, "mcp").select(reports.day())).distinct(), CALLS, f"SELECT DISTINCT {_DAY} AS date FROM tool_calls WHERE family IN ('skill', 'mcp')"),
    Report("srt_case_order", lambda t: reports.counted(t("tool_calls"), "family").withColumn("place", F.array_position(F.array(*map(F.lit, reports.FAMILIES)), F.col("family"))).orderBy("place"), CALLS, f'SELECT family, count(*) AS "count", list_position({list(reports.FAMILIES)}, family) AS place FROM tool_calls GROUP BY 1'),
    Report("agg_any_bare", lambda t: t("tool_calls").groupBy("session_id").agg(F.max_by("error_text", F.struct("ts_raw", "id")).alias("last_text"), F.count("is_error").alias("measured")), CALLS, f"SELECT session_id, struct_extract(max(struct_pack(t := ts_raw, i := id, x := error_text)), 'x') AS last_text, {_MEASURED} AS measured FROM tool_calls GROUP BY 1"),
    # knowledge base and classification
    Report("sch_kb_crud", lambda t: knowledge.retagged(knowledge.removed(knowledge.put(_points(t), t("sessions").filter("user_id % 6 = 1").select("session_id", F.array(F.lit("new")).alias("tags"), F.lit("k").alias("kind"))), t("sessions").filter("user_id % 10 = 4")), t("sessions").filter("user_id % 10 = 2").select("session_id", F.array(F.lit("hand")).alias("tags"))), ("sessions",),
           "SELECT session_id, CASE WHEN user_id % 10 = 2 THEN ['hand'] WHEN user_id % 6 = 1 THEN ['new'] ELSE [concat('t', user_id % 3), concat('t', user_id % 4)] END AS tags, CASE WHEN user_id % 6 = 1 THEN 'k' ELSE model END AS kind FROM sessions WHERE (user_id % 2 = 0 OR user_id % 6 = 1) AND user_id % 10 <> 4"),
    Report("sch_kb_tags", lambda t: knowledge.tag_counts(_points(t)), ("sessions",), _POINTS + 'SELECT tag, count(*) AS "count" FROM (SELECT unnest(tags) AS tag FROM points) GROUP BY 1'),
    Report("sch_kb_count", lambda t: knowledge.where(_points(t), kind=["view", "click"], tags=["t0", "t3"]).groupBy("kind").count(), ("sessions",), _POINTS + """SELECT kind, count(*) AS "count" FROM points WHERE kind IN ('view', 'click') AND list_has_any(tags, ['t0', 't3']) GROUP BY 1"""),
    Report("sch_kb_payload", lambda t: knowledge.payloads(t("sessions"), t("session_meta").drop("people"), t("tool_calls").select("session_id", F.concat(F.lit("mcp__s__"), "tool").alias("tool")), _points(t)).select("session_id", "classification", "data_sensitivity", "topics", "tools_used", "tags"), ("sessions", "session_meta", "tool_calls"), _POINTS + f""", used AS (SELECT session_id, list_sort(list(DISTINCT tool)) AS tools_used FROM tool_calls GROUP BY 1)
SELECT s.session_id, coalesce({_VALID_CLASS}, 'development') AS classification, CASE WHEN data_sensitivity IN ('public', 'internal', 'confidential', 'restricted') THEN data_sensitivity ELSE 'internal' END AS data_sensitivity, coalesce(topics[1:5], []) AS topics, coalesce(tools_used, []) AS tools_used, coalesce(tags, []) AS tags FROM sessions s LEFT JOIN session_meta USING (session_id) LEFT JOIN used USING (session_id) LEFT JOIN points USING (session_id)"""),
    Report("sch_kb_meta", lambda t: t("sessions").join(t("session_meta").withColumn("topics", F.from_json(F.to_json("topics"), "array<string>")), _KEYS).select("session_id", "classification", "topics"), ("sessions", "session_meta"), "SELECT session_id, classification, topics FROM session_meta"),
    Report("sch_kb_select", lambda t: knowledge.candidates(_starred(t), t("session_meta"), full=True, min_messages=2, since="2024-01-10", host="ost-2").select("session_id"), STAR, _STAR + "SELECT session_id FROM starred WHERE message_count >= 2 AND ts_raw >= '2024-01-10' AND hostname ILIKE '%ost-2%'"),
    Report("sch_kb_index", lambda t: knowledge.not_indexed(t("sessions"), _points(t)).join(t("session_meta").select(*_KEYS, "classification"), _KEYS, "left").select("session_id", F.col("classification").isNull().alias("to_classify")), ("sessions", "session_meta"), "SELECT session_id, classification IS NULL AS to_classify FROM sessions LEFT JOIN session_meta USING (session_id, project_id) WHERE user_id % 2 <> 0"),
    Report("fn_sanitize_meta", lambda t: knowledge.sanitized(t("session_meta")).select("session_id", "classification", "data_sensitivity", "topics"), ("session_meta",), f"SELECT session_id, {_VALID_CLASS} AS classification, {_VALID_LEVEL} AS data_sensitivity, topics[1:5] AS topics FROM session_meta"),
    Report("cls_candidates", lambda t: knowledge.candidates(t("sessions"), t("session_meta"), meta_since="2024-01-12", meta_model="model-%", limit=30).select("session_id"), ("sessions", "session_meta"), "SELECT session_id FROM sessions s JOIN session_meta m USING (session_id, project_id) WHERE updated_at >= '2024-01-12' AND model_used ILIKE 'model-%' ORDER BY s.ts_raw DESC, session_id LIMIT 30"),
    Report("cls_run", lambda t: knowledge.classified(text.session_text(t("chat_log")), _rule).groupBy("classification", "data_sensitivity").count(), ("chat_log",), """, texts AS (SELECT session_id, array_to_string(list(CASE WHEN type = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(content, 1, 2000) ORDER BY seq), chr(10) || chr(10)) AS text FROM chat_log WHERE trim(substr(content, 1, 2000)) <> '' GROUP BY 1)
SELECT CASE WHEN length(text) > 400 THEN 'support' ELSE 'development' END AS classification, 'public' AS data_sensitivity, count(*) AS "count" FROM texts GROUP BY ALL"""),
    Report("cls_upsert", lambda t: knowledge.upserted(t("session_meta").select(*_KEYS, "classification", F.lit("old").alias("created_at")), t("sessions").filter("user_id % 3 = 0").select(*_KEYS, F.lit("support").alias("classification"), F.lit("new").alias("created_at"))), ("session_meta", "sessions"), "SELECT session_id, project_id, CASE WHEN user_id % 3 = 0 THEN 'support' ELSE classification END AS classification, CASE WHEN classification IS NOT NULL THEN 'old' ELSE 'new' END AS created_at FROM sessions LEFT JOIN session_meta USING (session_id, project_id) WHERE classification IS NOT NULL OR user_id % 3 = 0"),
    # replication and maintenance
    Report("rpl_ingest", lambda t: maintenance.ingested(_half(t, "token_usage", 0).select("id", "session_id", "model", F.when(F.col("id") % 2 == 0, F.col("input_tokens")).alias("input_tokens")), _half(t, "token_usage", 1).select("id", "session_id", F.lit("theirs").alias("model"), "input_tokens"), ["id", "session_id"], ("input_tokens",)), ("token_usage",), "SELECT id, session_id, CASE WHEN id % 3 <> 0 THEN model ELSE 'theirs' END AS model, CASE WHEN id % 3 = 1 AND id % 2 <> 0 THEN NULL ELSE input_tokens END AS input_tokens FROM token_usage"),
    Report("join_id_translate", lambda t: maintenance.translated(t("sessions").select("session_id", "user_id"), t("people"), t("people").withColumn("id", F.col("id") + 1000), "user_id"), ("sessions", "people"), "SELECT session_id, user_id + 1000 AS user_id FROM sessions WHERE user_id % 3 <> 0"),
    Report("rpl_since", lambda t: t("sessions").groupBy("project_id").agg(F.max("ts_raw").alias("stored")).withColumn("gate", maintenance.gate(F.col("stored"), F.lit("2024-01-30T12:00:00.000Z"))), ("sessions",), "SELECT project_id, max(ts_raw) AS stored, least(max(ts_raw), '2024-01-30T12:00:00.000Z') AS gate FROM sessions GROUP BY 1"),
    Report("rpl_monotonic", lambda t: merge.advance(t("sessions").filter("user_id % 2 = 0").groupBy("project_id").agg(F.max("ts_raw").alias("value")), t("sessions").filter("user_id % 2 = 1").groupBy("project_id").agg(F.max("ts_raw").alias("value")), ["project_id"]), ("sessions",), "SELECT project_id, max(ts_raw) AS value FROM sessions GROUP BY 1"),
    Report("rpl_heal", lambda t: merge.fill_only(t("sessions").select(*_KEYS, F.when(F.col("user_id") % 2 == 0, F.col("model")).alias("model")), t("sessions").select(*_KEYS, F.lit("healed").alias("model")), _KEYS, ["model"]), ("sessions",), "SELECT session_id, project_id, CASE WHEN user_id % 2 = 0 THEN model ELSE 'healed' END AS model FROM sessions"),
    Report("rpl_export", lambda t: merge.export_package(t("sessions").select(*_KEYS, "ts_raw"), {"messages": t("token_usage").select(*_KEYS, "ts_raw", "id")}, "2024-01-20T00:00:00.000Z", 50).select("session_id", "active_at", F.size("messages").alias("fresh")), ("sessions", "token_usage"), "SELECT session_id, max(u.ts_raw) AS active_at, CAST(count(*) FILTER (u.ts_raw > '2024-01-20T00:00:00.000Z') AS INT) AS fresh FROM sessions JOIN token_usage u USING (session_id, project_id) GROUP BY session_id HAVING max(u.ts_raw) > '2024-01-20T00:00:00.000Z' ORDER BY active_at, session_id LIMIT 50"),
    Report("mnt_backfill_kind", lambda t: maintenance.with_kinds(t("tool_calls").withColumn("session_id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("chatgpt:"), "session_id")).otherwise(F.col("session_id")))).groupBy("kind").count(), CALLS, """SELECT CASE WHEN id % 4 = 0 THEN 'builtin_host' ELSE 'mcp' END AS kind, count(*) AS "count" FROM tool_calls GROUP BY 1"""),
    Report("mnt_backfill_cmdname", lambda t: maintenance.with_command_names(t("tool_calls").withColumn("cmd_name", F.when(F.col("id") % 2 == 0, F.col("cmd_name")).when(F.col("id") % 3 == 0, F.lit("")))).select("id", "cmd_name"), CALLS, "SELECT id, CASE WHEN id % 2 = 0 THEN cmd_name ELSE regexp_extract(command, 'run[0-9]+') END AS cmd_name FROM tool_calls"),
    Report("mnt_spawn_seed", lambda t: maintenance.with_spawn_tools(t("tool_calls")).select("id", "spawn_tool"), CALLS, "SELECT id, CASE WHEN family = 'subagent' AND coalesce(spawn_tool, '') = '' AND ts_raw < '2026-03-01' THEN 'Task' ELSE spawn_tool END AS spawn_tool FROM tool_calls"),
    Report("join_stamp_backfill", lambda t: maintenance.stamped(t("tool_calls").select("id", *_KEYS, "ts_raw", "family", F.col("path").alias("input"), F.when(F.col("id") % 5 == 0, "kept").alias("tool_call_id")), t("tool_calls").filter("id % 2 = 0").select(*_KEYS, "ts_raw", "family", F.col("path").alias("input"), F.concat(F.lit("t"), "id").alias("tool_call_id"))).select("id", "tool_call_id"), CALLS,
           "SELECT id, CASE WHEN id % 5 = 0 THEN 'kept' WHEN id % 2 = 0 THEN concat('t', id) END AS tool_call_id FROM tool_calls"),
    Report("mnt_backfill_outcomes", lambda t: maintenance.with_outcomes(t("tool_calls").select("id", *_KEYS, F.concat(F.lit("t"), "id").alias("tool_call_id"), F.when(F.col("id") % 2 == 0, F.lit(0)).alias("is_error"), F.lit(None).cast("string").alias("error_text")), t("tool_calls").filter("id % 3 = 0").select(*_KEYS, F.concat(F.lit("t"), "id").alias("tool_call_id"), F.lit(1).alias("is_error"), F.lit("boom").alias("error_text"), F.col("id").alias("seq"))).select("id", "is_error", "error_text"), CALLS,
           "SELECT id, CASE WHEN id % 2 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 END AS is_error, CASE WHEN id % 2 <> 0 AND id % 3 = 0 THEN 'boom' END AS error_text FROM tool_calls"),
    Report("mnt_backfill_claude_ai", lambda t: maintenance.marker_outcomes(t("chat_log").select(*_KEYS, "seq", F.when(F.col("seq") % 2 == 0, "\n--- tool_use: web ---\nx\n").otherwise(F.concat(F.lit("\n--- tool_result: web ("), F.when(F.col("seq") % 4 == 1, "ok").otherwise("error"), F.lit(") ---\ny\n"))).alias("content"))), ("chat_log",), """, u AS (SELECT session_id, project_id, row_number() OVER (PARTITION BY session_id, project_id ORDER BY seq) AS k FROM chat_log WHERE seq % 2 = 0),
r AS (SELECT session_id, project_id, row_number() OVER (PARTITION BY session_id, project_id ORDER BY seq) AS k, CASE WHEN seq % 4 = 1 THEN 0 ELSE 1 END AS is_error FROM chat_log WHERE seq % 2 = 1)
SELECT session_id, project_id, 'web' AS name, CAST(k AS INT) AS k, is_error FROM u LEFT JOIN r USING (session_id, project_id, k)"""),
    Report("grf_retroject", lambda t: maintenance.moved_projects(t("sessions").select("session_id", F.concat(F.lit("p"), F.col("user_id") % 3).alias("project")), t("token_usage").select("session_id", F.col("id").alias("place"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("/mnt/p"), F.col("user_id") % 4, F.lit("/a.md"))).otherwise("/tmp/x").alias("path")), identity.infer_project), ("sessions", "token_usage"),
           "SELECT DISTINCT s.session_id, concat('p', s.user_id % 4) AS project FROM sessions s JOIN token_usage u USING (session_id) WHERE u.id % 2 = 0 AND s.user_id % 4 <> s.user_id % 3"),
)

QUERIES = {r.name: r.query for r in REPORTS}
ORACLE_SQL = {r.name: sql for r in REPORTS if (sql := r.oracle())}
