"""Messages of exported chats as text: their content blocks in order, then attachments and file references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import flatten_result, stripped

CONTENT = "array<struct<type:string,text:string,thinking:string,name:string,input:string,is_error:string,content:string,title:string>>"
ATTACHMENTS = "array<struct<file_name:string,file_type:string,file_size:string,extracted_content:string>>"
FILES = "array<struct<file_name:string>>"
# Longest input of a call and longest result, in characters, and what stands where they are cut.
INPUT_CAP, RESULT_CAP, CUT = 2000, 5000, " ... [truncated]"


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _capped(c: Column, cap: int) -> Column:
    return F.when(F.length(c) > cap, F.concat(F.left(c, F.lit(cap)), F.lit(CUT))).otherwise(c)


def _section(head: Column | str, body: Column, end: str = "\n") -> Column:
    return F.concat(F.lit("\n--- "), F.lit(head) if isinstance(head, str) else head, F.lit(" ---\n"), body, F.lit(end))


def block_text(b: Column) -> Column:
    """One block: texts as they are; thinking, calls, results and voice notes under a marker line; other kinds are empty. The
    input of a call is its JSON as the export has it."""
    status = F.when(F.lower(F.coalesce(b["is_error"], F.lit(""))).isin("", "false", "0", "null"), "ok").otherwise("error")
    name = _or(b["name"], "tool")
    return (
        F.when(b["type"] == "text", F.coalesce(b["text"], F.lit("")))
        .when((b["type"] == "thinking") & (_or(b["thinking"], "") != ""), _section("thinking", b["thinking"]))
        .when(b["type"] == "tool_use", _section(F.concat(F.lit("tool_use: "), name), _capped(F.coalesce(b["input"], F.lit("null")), INPUT_CAP)))
        .when(b["type"] == "tool_result", _section(F.concat(F.lit("tool_result: "), name, F.lit(" ("), status, F.lit(")")), _capped(F.coalesce(flatten_result(b["content"]), F.lit("")), RESULT_CAP)))
        .when(b["type"] == "voice_note", _section(F.concat(F.lit("voice note"), F.when(_or(b["title"], "") != "", F.concat(F.lit(": "), b["title"])).otherwise("")), F.coalesce(b["text"], F.lit(""))))
        .otherwise("")
    )


def _attachment(a: Column) -> Column:
    facts = F.array_compact(F.array(F.nullif(a["file_type"], F.lit("")), F.when(a["file_size"].isNotNull(), F.concat(a["file_size"], F.lit("B")))))
    return _section(F.concat(F.lit("attachment: "), _or(a["file_name"], "attachment"), F.when(F.size(facts) > 0, F.concat(F.lit(" ("), F.array_join(facts, ", "), F.lit(")"))).otherwise("")), F.coalesce(a["extracted_content"], F.lit("")), "")


def message_text(content: Column, text: Column, attachments: Column, files: Column) -> Column:
    """The whole message (columns of the types CONTENT, string, ATTACHMENTS and FILES; nulls are nothing). `text` stands in where
    the blocks give nothing, as in older exports."""
    joined = lambda items, f: F.coalesce(F.array_join(F.transform(items, f), ""), F.lit(""))
    body = stripped(joined(content, block_text))
    body = F.when(body == "", F.coalesce(text, F.lit(""))).otherwise(body)
    names = F.array_join(F.transform(files, lambda f: F.coalesce(f["file_name"], F.lit("?"))), ", ")
    listed = F.when(F.size(files) > 0, F.concat(F.lit("\n--- file references: "), names, F.lit(" ---"))).otherwise("")
    return stripped(F.concat(body, joined(attachments, _attachment), listed))
