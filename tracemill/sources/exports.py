"""Exports of a chat service whose messages form a graph, and audit logs of a sandboxed host, as tables of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.dates import epoch_iso
from tracemill.functions.identity import chat_project, infer_project, prefixed
from tracemill.functions.text import json_blocks, smart_title, stripped

_CONTENT = "struct<content_type:string,parts:array<string>,thoughts:array<struct<summary:string,content:string>>,content:string,text:string,language:string>"
_NODE = f"struct<parent:string,message:struct<id:string,author:struct<role:string,name:string>,create_time:double,content:{_CONTENT},metadata:struct<model_slug:string>>>"
CHAT_RECORD = f"conversation_id string, title string, create_time double, update_time double, default_model_slug string, gizmo_type string, gizmo_id string, current_node string, mapping map<string,{_NODE}>"
AUDIT_RECORD = "type string, _audit_timestamp string, session_id string, uuid string, cwd string, subtype string, model string, message struct<role:string,model:string,id:string,content:string>"


def chats(spark: SparkSession, path: str, updated_after: float = 0.0) -> DataFrame:
    """Conversations of an export that changed after a time, with their session id and project."""
    rows = spark.read.schema(CHAT_RECORD).json(path, multiLine=True).filter((F.coalesce("update_time", F.lit(0.0)) > updated_after) & (F.coalesce("conversation_id", F.lit("")) != ""))
    return rows.withColumn("session_id", prefixed(F.col("conversation_id"), "chatgpt:")).withColumn("project", chat_project(F.col("gizmo_type"), F.col("gizmo_id")))


def linearised(conversations: DataFrame) -> DataFrame:
    """session_id, seq, node, message: the path from a conversation's first message to its current one. The walk goes up
    from the current node as often as there are nodes, so that a circle ends; system messages and empty nodes are left out."""
    up = lambda at: F.try_element_at("mapping", at)["parent"]
    start = F.struct(F.array(F.col("current_node")).alias("path"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        at = F.get(s["path"], F.size(s["path"]) - 1)
        parent = up(at)
        end = s["done"] | parent.isNull() | (parent == "") | ~F.map_contains_key("mapping", parent) | F.array_contains(s["path"], parent)
        return F.when(end, F.struct(s["path"].alias("path"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(s["path"], F.array(parent)).alias("path"), F.lit(False).alias("done")))

    known = conversations.filter(F.col("current_node").isNotNull() & F.map_contains_key("mapping", F.col("current_node")))
    walked = known.withColumn("path", F.reverse(F.aggregate(F.map_keys("mapping"), start, step, lambda s: s["path"])))
    rows = walked.select("session_id", "default_model_slug", "mapping", F.posexplode("path").alias("seq", "node"))
    message = F.element_at("mapping", F.col("node"))["message"]
    return rows.select("session_id", "default_model_slug", "seq", "node", message.alias("message")).filter(F.col("message").isNotNull() & (F.coalesce("message.author.role", F.lit("")) != "system"))


def message_text(content: Column) -> Column:
    """The text of a message: parts joined by lines, reasoning steps with their headings, a recap, or a fenced block."""
    texts = F.transform(F.coalesce(content["parts"], F.array().cast("array<string>")), lambda p: F.when(F.rlike(p, F.lit(r"^\s*\{.*\}\s*$")), F.get_json_object(p, "$.text")).otherwise(p))
    parts = F.array_join(F.filter(texts, lambda p: p.isNotNull()), "\n")
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    step = lambda t: F.when(some(t["summary"]) & some(t["content"]), F.concat(F.lit("**"), t["summary"], F.lit("**\n"), t["content"])).when(some(t["content"]), t["content"]).when(some(t["summary"]), t["summary"])
    thoughts = F.array_join(F.filter(F.transform(F.coalesce(content["thoughts"], F.array().cast("array<struct<summary:string,content:string>>")), step), lambda t: t.isNotNull()), "\n\n")
    text, body, kind = F.coalesce(content["text"], F.lit("")), F.coalesce(content["content"], F.lit("")), F.coalesce(content["content_type"], F.lit("text"))
    code = F.when(text != "", F.concat(F.lit("```"), F.coalesce(content["language"], F.lit("")), F.lit("\n"), text, F.lit("\n```"))).otherwise("")
    rest = F.when(parts != "", parts).when(text != "", text).otherwise(body)
    return F.when(kind == "text", parts).when(kind == "thoughts", thoughts).when(kind == "reasoning_recap", body).when(kind == "code", code).otherwise(rest)


def chat_turns(conversations: DataFrame) -> DataFrame:
    """Messages with a text, in order: session_id, seq, type, content, ts_raw, model, uuid."""
    m = F.col("message")
    rows = linearised(conversations).select("session_id", "seq", F.when(m["author"]["role"] == "user", "user").otherwise("assistant").alias("type"), message_text(m["content"]).alias("content"), epoch_iso(m["create_time"]).alias("ts_raw"), F.coalesce(m["metadata"]["model_slug"], F.col("default_model_slug")).alias("model"), F.coalesce(m["id"], F.col("node")).alias("uuid"))
    return rows.filter(F.trim("content") != "")


def chat_tools(conversations: DataFrame) -> DataFrame:
    """session_id, tools: names of the tools that answered in any branch, sorted."""
    named = F.filter(F.map_values("mapping"), lambda n: (n["message"]["author"]["role"] == "tool") & (F.coalesce(n["message"]["author"]["name"], F.lit("")) != ""))
    return conversations.select("session_id", F.array_sort(F.array_distinct(F.transform(named, lambda n: n["message"]["author"]["name"]))).alias("tools"))


# audit logs: one file for each conversation


def _paths(message: Column) -> Column:
    """Paths that a record's tool calls name: arguments first, then absolute words of commands."""
    inputs = F.transform(F.filter(json_blocks(message), lambda b: b["type"] == "tool_use"), lambda b: b["input"])
    named = F.flatten(F.transform(inputs, lambda i: F.array(F.get_json_object(i, "$.file_path"), F.get_json_object(i, "$.path"))))
    words = F.flatten(F.transform(inputs, lambda i: F.filter(F.split(F.coalesce(F.get_json_object(i, "$.command"), F.lit("")), r"[\s'\"]+"), lambda w: F.startswith(w, F.lit("/")))))
    return F.filter(F.concat(named, words), lambda p: p.isNotNull())


def audited(records: DataFrame, default_project: str = "cowork_default") -> DataFrame:
    """Records of audit logs (file, line_no and AUDIT_RECORD) with the session, project and title of their conversation.

    A file is one conversation: its folder names a shell that holds the user's turns alone, and inner sessions repeat those
    and hold the work. Where there is an inner session all records go to the folder's, and the shell's own are left out. The
    first record that tells a project (by its folder, its calls' paths, or its commands) tells it for the whole file. The
    first words that a user said to the shell are the title."""
    master = F.nullif(F.regexp_extract("file", r"/local_([^/]+)/audit\.jsonl$", 1), F.lit(""))
    rows = records.withColumn("master", master)
    guesses = F.concat(F.array("cwd"), F.when(F.col("type") == "assistant", _paths(F.col("message.content"))).otherwise(F.array().cast("array<string>")))
    project = F.get(F.filter(F.transform(guesses, infer_project), lambda p: p.isNotNull()), F.lit(0))
    shell = F.coalesce(F.col("session_id") == F.col("master"), F.lit(False))
    words = F.get(F.filter(json_blocks(F.col("message.content")), lambda b: b["type"] == "text"), F.lit(0))["text"]
    said = F.when(shell & (F.col("type") == "user") & (stripped(F.coalesce(words, F.lit(""))) != ""), words)
    told = rows.withColumn("project_", project).withColumn("said", said)
    per = told.groupBy("file").agg(
        F.min_by("project_", F.when(F.col("project_").isNotNull(), F.col("line_no"))).alias("project"), F.min_by("said", F.when(F.col("said").isNotNull(), F.col("line_no"))).alias("said"),
        F.bool_or(F.col("master").isNotNull() & (F.coalesce("session_id", F.lit("")) != "") & ~shell).alias("inner"),
    )
    joined = rows.join(per, "file").filter((F.coalesce("session_id", F.lit("")) != "") & (F.coalesce("_audit_timestamp", F.lit("")) != "") & ~(F.col("inner") & shell))
    session = F.when(F.col("inner"), F.col("master")).otherwise(F.col("session_id"))
    kept = [c for c in records.columns if c != "session_id"]
    return joined.select(prefixed(session, "cowork:").alias("session_id"), F.coalesce("project", F.lit(default_project)).alias("project"), F.when(F.col("said").isNotNull(), smart_title(F.col("said"))).alias("title"), *kept)


# rollouts: what their calls do


def call_arguments(raw: Column) -> Column:
    """A call's arguments as JSON; a text that is no JSON object becomes one, under `_raw`."""
    good = F.rlike(raw, F.lit(r"^\s*\{")) & F.from_json(raw, "map<string,string>").isNotNull()
    return F.when(F.coalesce(raw, F.lit("")) == "", "{}").when(good, raw).otherwise(F.to_json(F.struct(raw.alias("_raw"))))


def patch_text(arguments: Column) -> Column:
    """The patch that a call applies."""
    return F.coalesce(F.get_json_object(arguments, "$.patch"), F.get_json_object(arguments, "$.input"), F.get_json_object(arguments, "$._raw"), F.lit(""))


def patch_entries(patch: Column) -> Column:
    """array of (tool, file_path): files that a patch adds are written, those that it updates, deletes or moves are edited."""
    # The lines that begin a file's part of a patch.
    pattern = r"(?m)^[^\S\n]*\*\*\* (Add File|Update File|Delete File|Move to): (.*)$"
    found = F.transform(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.struct(F.when(F.regexp_extract(x, pattern, 1) == "Add File", "Write").otherwise("Edit").alias("tool"), stripped(F.regexp_extract(x, pattern, 2)).alias("file_path")))
    return F.filter(found, lambda x: x["file_path"] != "")


def rollout_calls(filled: DataFrame) -> DataFrame:
    """Calls of rollouts (see `transcripts.rollout`): shell commands as `bash`, files of patches as `file`, all others whose
    arguments name a server as `mcp`. Their outcome is never measured."""
    calls = filled.filter("type = 'response_item' and payload.type in ('function_call', 'custom_tool_call')").withColumn("arguments", call_arguments(F.col("payload.arguments")))
    name = F.col("payload.name")
    command = F.coalesce(F.get_json_object("arguments", "$.command"), F.get_json_object("arguments", "$.cmd"))
    server = F.get_json_object("arguments", "$.server")
    none = F.lit(None).cast("string")
    base = ["session_id", "source", F.col("timestamp").alias("ts_raw"), "line_no"]
    patched = calls.filter(name == "apply_patch").select(*base, F.explode(patch_entries(patch_text(F.col("arguments")))).alias("f")).select("session_id", "source", "ts_raw", "line_no", F.lit("file").alias("family"), F.col("f.tool").alias("name"), F.col("f.file_path").alias("file_path"), none.alias("command"), none.alias("server_name"))
    shell = calls.filter(name.isin("shell_command", "shell", "exec_command") & (F.coalesce(command, F.lit("")) != "")).select(*base, F.lit("bash").alias("family"), F.lit("Bash").alias("name"), none.alias("file_path"), command.alias("command"), none.alias("server_name"))
    tools = calls.filter(server.isNotNull()).select(*base, F.lit("mcp").alias("family"), name.alias("name"), none.alias("file_path"), none.alias("command"), server.alias("server_name"))
    return patched.unionByName(shell).unionByName(tools).withColumn("is_error", F.lit(None).cast("int"))
