"""Who and where: sessions, agents, hosts, projects and workflows out of names, paths and inputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commands import stripped

# Host names that tell nothing, parts of encoded folders that are no project.
GENERIC_HOSTS = ("", "mac", "macbook", "macbookpro", "macbook-pro", "macbookair", "macbook-air", "imac", "localhost", "unknown")
NO_PROJECT = ("Users", "Library", "CloudStorage")
# Folders of sandboxes and systems that are no project, and names before which a project stands.
GENERIC_FOLDERS = (
    "outputs", "output", "uploads", "upload", "mnt", "home", "cache", "tmp", "temp", "downloads", "desktop", "documents", "applications", "movies", "music", "pictures", "public", "library", "cloudstorage",
    "tool-results", "tool_results", "sessions", "artifacts", "shared", "var", "folders", "private", "users", "skills", ".claude", ".skills", ".config", ".local-plugins", ".git", "node_modules",
)
PROJECT_ROOTS = ("mnt", "claude_coworks", "artifacts")
NO_PROJECT_PATHS = ("local-agent-mode-sessions", "claude-code-sessions", "/var/folders/", "claude-hostloop")
# Labels of spawned agents that name no type.
RESUMED, UNSPECIFIED, INLINE = "(resumed)", "(unspecified)", "(inline-script)"
SPAWN_TOOLS = ("Task", "Agent", "Workflow")
_SCRIPT_ID = r"-(wf_[A-Za-z0-9._-]+)\.js$"


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def hostname(name: Column) -> Column:
    """Without its local domain; null for empty, generic or corrupted names."""
    short = F.regexp_replace(F.regexp_replace(name, r"\.localdomain$", ""), r"\.local$", "")
    corrupted = F.rlike(short, F.lit("[\\x00-\\x1F\\x7F-\\x9F\\uFFFD]"))
    return F.when(~corrupted & ~F.lower(stripped(short)).isin(*GENERIC_HOSTS), short)


def is_agent_id(agent_id: Column) -> Column:
    """Genuine agents have a hexadecimal first segment; never null."""
    return F.coalesce(F.rlike(agent_id, F.lit("^[0-9a-f]+(-|$)")), F.lit(False))


def agent_of_file(file: Column) -> Column:
    """The agent id in the name of an agent's log, else null."""
    return _none_if_empty(F.regexp_extract(file, r"(?:^|/)agent-([^/]+)\.jsonl$", 1))


def agent_session(session_id: Column, agent_id: Column) -> Column:
    """Agents write under their parent's session; they get one of their own. An id that was rewritten before stays."""
    plain = F.contains(session_id, F.lit("::agent-")) | (session_id == "") | (F.coalesce(agent_id, F.lit("")) == "")
    return F.when(plain, session_id).otherwise(F.concat(session_id, F.lit("::agent-"), agent_id))


def parent_of_path(file: Column) -> Column:
    """The session whose folder holds an agent's log below `subagents`, else null."""
    return _none_if_empty(F.regexp_extract(file, r"([^/-]*-[^/-]*-[^/-]*-[^/-]*-[^/-]*)/subagents/(?:[^/]+/)*agent-[^/]+\.jsonl$", 1)).alias("parent")


def workflow_of_path(file: Column) -> Column:
    return F.regexp_extract(file, r"/subagents/workflows/(wf_[^/]*)/", 1)


def workflow_of_result(text: Column) -> Column:
    """The workflow that a result announces; empty if none."""
    return F.coalesce(F.regexp_extract(text, r"workflows/(wf_[A-Za-z0-9._-]+)", 1), F.lit(""))


def _given(input_: Column, key: str) -> Column:
    return F.get_json_object(input_, f"$.{key}")


def workflow_of_input(input_: Column) -> Column:
    """The workflow that a resumed call names; empty if it is not known yet."""
    run, script = _given(input_, "resumeFromRunId"), _given(input_, "scriptPath")
    return F.when(F.startswith(run, F.lit("wf_")), run).otherwise(F.coalesce(F.regexp_extract(script, _SCRIPT_ID, 1), F.lit("")))


def workflow_label(input_: Column) -> Column:
    """A workflow's name: given, else its title, else the one in the head of its script, else the script's file name
    without the run's id. Never empty."""
    name, title = (_none_if_empty(stripped(_given(input_, k))) for k in ("name", "title"))
    meta = _none_if_empty(F.regexp_extract(F.substring(_given(input_, "script"), 1, 600), r"""name\s*:\s*['"]([^'"]+)['"]""", 1))
    stem = F.element_at(F.split(_given(input_, "scriptPath"), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(F.concat(F.regexp_replace(stem, r"\.js$", ""), F.lit(".js")), _SCRIPT_ID, ""), r"\.js$", "")
    return F.coalesce(name, title, meta, _none_if_empty(stem), F.lit(INLINE))


def spawned(tool: Column, input_: Column) -> Column:
    """struct(subagent_type, description, prompt, model, run_in_background, spawn_tool, workflow_id) of a call that spawns
    an agent, whatever of its input is missing; null for other tools."""
    flow = tool == "Workflow"
    resumed = F.coalesce(_none_if_empty(_given(input_, "resume")), F.lit("false")) != "false"
    kind = F.coalesce(_none_if_empty(_given(input_, "subagent_type")), _none_if_empty(_given(input_, "name")), F.when(resumed, RESUMED).otherwise(UNSPECIFIED))
    text = lambda key: F.coalesce(_given(input_, key), F.lit(""))
    prompt = F.when(flow, F.coalesce(_none_if_empty(_given(input_, "args")), text("script"))).otherwise(text("prompt"))
    behind = F.when(flow | (text("run_in_background") == "true"), 1).otherwise(0)
    row = F.struct(
        F.when(flow, workflow_label(input_)).otherwise(kind).alias("subagent_type"), text("description").alias("description"), prompt.alias("prompt"), text("model").alias("model"), behind.alias("run_in_background"),
        tool.alias("spawn_tool"), F.when(flow, workflow_of_input(input_)).otherwise("").alias("workflow_id"),
    )
    return F.when(tool.isin(*SPAWN_TOOLS), row)


def project_name(folder: Column, user: str = "") -> Column:
    """The last part of a path; of a folder's dash-encoded path the last part that means something. Folders of executors are
    not probed."""
    name = F.element_at(F.split(F.regexp_replace(folder, "/+$", ""), "/"), -1)
    parts = F.filter(F.split(name, "-"), lambda p: ~p.isin("", *NO_PROJECT, *([user] if user else [])))
    return F.when(F.startswith(name, F.lit("-")), F.coalesce(F.get(parts, F.size(parts) - 1), name)).otherwise(name)


def infer_project(path: Column) -> Column:
    """The project that a sandboxed path belongs to, or null: what stands behind a known root, else the first folder of a
    user's home that is neither a system's nor a cloud's; never a file, a scratch folder or a temporary place."""
    low = F.lower(path)
    away = F.startswith(low, F.lit("/tmp")) | F.startswith(low, F.lit("/private/tmp"))
    for part in NO_PROJECT_PATHS:
        away = away | F.contains(low, F.lit(part))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    fits = lambda s: (stripped(s) != "") & ~F.startswith(stripped(s), F.lit("-")) & ~(F.contains(stripped(s), F.lit(".")) & ~F.startswith(stripped(s), F.lit("."))) & ~F.lower(stripped(s)).isin(*GENERIC_FOLDERS)
    n = F.size(segments)
    pairs = F.arrays_zip(F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("root"), F.slice(segments, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("next"))
    behind_root = F.get(F.filter(pairs, lambda p: F.lower(p["root"]).isin(*PROJECT_ROOTS) & fits(p["next"])), F.lit(0))["next"]
    at_home = F.get(F.filter(F.slice(segments, F.lit(3), F.greatest(n - 2, F.lit(0))), lambda s: ~F.startswith(F.lower(s), F.lit("onedrive")) & fits(s)), F.lit(0))
    found = F.coalesce(behind_root, F.when((F.lower(F.get(segments, F.lit(0))) == "users") & (n > 2), at_home))
    return F.when(F.startswith(path, F.lit("/")) & ~away, stripped(found))


def chat_project(kind: Column, gizmo: Column) -> Column:
    """The project of a chat: a project of the host, a custom assistant, or the host itself."""
    some = F.coalesce(gizmo, F.lit("")) != ""
    return F.when((kind == "snorlax") & some, F.concat(F.lit("chatgpt:"), gizmo)).when((kind == "gpt") & some, F.concat(F.lit("chatgpt:gpt:"), gizmo)).otherwise("chatgpt")


def prefixed(session_id: Column, prefix: str) -> Column:
    """A session id with the prefix of its host, once."""
    return F.when(F.startswith(session_id, F.lit(prefix)), session_id).when(F.coalesce(session_id, F.lit("")) != "", F.concat(F.lit(prefix), session_id))
