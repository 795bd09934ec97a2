"""Readers of agent transcripts: line logs of two hosts and the exports of two chat services, as tables of the model.

Line logs are read line by line, in splits of files: lines are numbered, and what holds from one line on is carried forward,
by split first and then over the splits of a file, so that no task ever sees a whole file; nothing comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tracemill.functions import commands
from tracemill.functions.text import json_blocks, rollout_source, split_mcp, tool_kind
from tracemill.operators.scan import running
from tracemill.operators.storage import written

from . import rendering

_USAGE = "input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long"
SESSION_RECORD = f"type string, sessionId string, timestamp string, uuid string, version string, cwd string, gitBranch string, agentId string, summary string, aiTitle string, customTitle string, message struct<role:string,model:string,id:string,content:string,usage:struct<{_USAGE}>>"
ROLLOUT_RECORD = "timestamp string, type string, payload struct<type:string,role:string,name:string,arguments:string,content:string,id:string,session_id:string,cwd:string,originator:string,model:string,info:struct<total_token_usage:map<string,long>,last_token_usage:map<string,long>>>"

# The tools of each family, and the order in which titles are preferred.
FILE_TOOLS, SEARCH_TOOLS, SPAWN_TOOLS = ("Read", "Write", "Edit"), ("Grep", "Glob"), ("Task", "Agent", "Workflow")
TITLES = (("customTitle", 3), ("aiTitle", 2), ("summary", 1))


def _numbered(spark: SparkSession, path: str, glob: str, modified_after: str | None = None) -> DataFrame:
    """file, block (where the split begins), line_no (from 1) and value of each line below `path` in files named like `glob`."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    # lines of a split follow each other in `row`; one row for each split tells where it starts and how many lines come before
    splits = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(_earlier_splits()), F.lit(0)).alias("before"))
    return raw.join(splits, ["file", "block"]).select("file", "block", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line_no"), "value")


def _parsed(rows: DataFrame, record: str) -> DataFrame:
    good = rows.filter(F.rlike("value", F.lit(r"^\s*\{.*\}\s*$"))).withColumn("r", F.from_json("value", record)).filter("r.type is not null")
    return good.select("file", "block", "line_no", "r.*")


def lines(spark: SparkSession, path: str, record: str, modified_after: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """file, block (where the split begins), line_no (from 1, counting all lines of the file) and the fields of each record below
    `path` in files named like `glob`; blank and malformed lines are skipped."""
    return _parsed(_numbered(spark, path, glob, modified_after), record)


def packed(logs: DataFrame, by: str, order: list[str], path: str) -> None:
    """Write `logs` (by, order, value) as packs: the lines of each log, in order, below a line that names it. There are as many
    packs as the data need, not as there are logs, so that many small logs cost no file each."""
    name = F.concat(F.lit("==> "), F.coalesce(F.col(by).cast("string"), F.lit("")), F.lit(" <=="))
    rows = logs.select(by, F.lit(True).alias("line_"), *order, "value")
    heads = logs.select(by).distinct().select(by, F.lit(False).alias("line_"), *[F.lit(None).cast(logs.schema[c].dataType).alias(c) for c in order], name.alias("value"))
    rows.unionByName(heads).repartition(by).sortWithinPartitions(by, "line_", *order).select("value").write.text(path)


def packed_lines(spark: SparkSession, path: str, record: str, glob: str = "*.txt") -> DataFrame:
    """Like `lines`, of packs (see `packed`): file is the pack's and the log's name, and lines count from 1 in each log. A pack
    is read by split like any file, in the order of its lines; a log may go on over several splits, and gets from those before
    where it began."""
    head = F.when(F.rlike("value", F.lit(r"^==> .* <==$")), F.regexp_extract("value", r"^==> (.*) <==$", 1))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", head.alias("log"))
    rows = written(raw.mapInArrow(_held_within, "file string, block long, value string, log string, n long, head long"), "lines")
    ends = rows.groupBy("file", "block").agg(F.max("n").alias("n"), F.max_by(F.struct("log", "head"), "n").alias("e"))
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(_earlier_splits()), F.lit(0)))
    last = lambda c: F.last(c, ignorenulls=True).over(_earlier_splits())
    given = ends.select("file", "block", "before", last(F.col("e.log")).alias("log_before"), last(F.col("e.head") + F.col("before")).alias("head_before"))
    own = F.col("log").isNotNull()
    line_no = F.when(own, F.col("n") - F.col("head")).otherwise(F.col("n") + F.col("before") - F.col("head_before"))
    # one row for each split, of which there are as many as megabytes
    logs = rows.join(F.broadcast(given), ["file", "block"]).select(F.concat_ws("#", "file", F.coalesce("log", "log_before")).alias("file"), "block", line_no.alias("line_no"), "value")
    return _parsed(logs.filter("line_no > 0"), record)


def _held_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value, log) in their order, with the log that holds at each since its split began, the number of the
    line in the split (n), and that of the line which names the log (head)."""
    split, count, log, head = None, 0, None, None
    for b in batches:
        at = np.arange(b.num_rows)
        file, block, named = b.column(0), np.asarray(b.column(1)), b.column(3)
        new = np.ones(b.num_rows, bool)
        new[1:] = (block[1:] != block[:-1]) | np.asarray(pc.not_equal(file.slice(1), file.slice(0, max(b.num_rows - 1, 0))))
        cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if (now := (file[a].as_py(), int(block[a]))) != split:
                split, count, log, head = now, 0, None, None
            names = named.slice(a, z - a)
            place = np.maximum.accumulate(np.where(np.asarray(names.is_valid()), at[: z - a], -1))
            inside = place >= 0
            k = int((~inside).sum())  # they are the first rows
            logs = pa.concat_arrays([pa.repeat(pa.scalar(log, pa.string()), k), names.take(pa.array(place[k:]))])
            n = count + 1 + at[: z - a]
            heads = pa.concat_arrays([pa.repeat(pa.scalar(head, pa.int64()), k), pa.array(n[place[k:]], pa.int64())])
            count, log, head = int(n[-1]), logs[-1].as_py(), heads[-1].as_py()
            yield pa.RecordBatch.from_arrays([*[c.slice(a, z - a) for c in b.columns[:3]], logs, pa.array(n, pa.int64()), heads], ["file", "block", "value", "log", "n", "head"])


def _earlier_splits() -> WindowSpec:
    """Over one row for each split of a file, of which there are as many as megabytes, not as lines."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def carried(records: DataFrame, values: dict[str, Column]) -> DataFrame:
    """`records` with columns that hold the last value so far, in their file, that is not null."""
    rows = records.withColumns(values)
    ends = rows.groupBy("file", "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in values])
    given = ends.select("file", "block", *[F.last(c, ignorenulls=True).over(_earlier_splits()).alias(f"_{c}") for c in values])
    within = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in values}).join(given, ["file", "block"], "left")
    return filled.withColumns({c: F.coalesce(c, f"_{c}") for c in values}).drop(*[f"_{c}" for c in values])


def session_messages(records: DataFrame) -> DataFrame:
    """User and assistant records; a message's tokens go to the first block of its API message."""
    rows = records.filter(F.col("type").isin("user", "assistant"))
    out = rows.select(
        F.col("sessionId").alias("session_id"), F.col("uuid"), "type", F.col("message.content").alias("content"), F.col("timestamp").alias("ts_raw"), F.col("message.model").alias("model"), F.col("message.id").alias("api_message_id"),
        F.coalesce("message.usage.input_tokens", F.lit(0)).alias("tokens_in"), F.coalesce("message.usage.output_tokens", F.lit(0)).alias("tokens_out"), F.col("agentId").alias("agent_id"), "file", "line_no",
    )
    order = Window.partitionBy("session_id", "api_message_id").orderBy((F.col("tokens_in") + F.col("tokens_out") > 0).cast("int").desc(), "line_no")
    first = F.col("api_message_id").isNull() | (F.row_number().over(order) == 1)
    return out.withColumn("credit", first).withColumns({c: F.when(F.col("credit"), F.col(c)).otherwise(0) for c in ("tokens_in", "tokens_out")}).drop("credit")


def session_usage(records: DataFrame) -> DataFrame:
    """Token usage of assistant records; one row for each time of a session."""
    u = F.col("message.usage")
    rows = records.filter((F.col("type") == "assistant") & u.isNotNull()).select(
        F.col("sessionId").alias("session_id"), F.col("timestamp").alias("ts_raw"), F.col("message.model").alias("model"), F.coalesce(u["input_tokens"], F.lit(0)).alias("input_tokens"), F.coalesce(u["output_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(u["cache_creation_input_tokens"], F.lit(0)).alias("cache_creation_tokens"), F.coalesce(u["cache_read_input_tokens"], F.lit(0)).alias("cache_read_tokens"), F.col("message.id").alias("api_message_id"), "cwd", "line_no",
    )
    place = F.row_number().over(Window.partitionBy("session_id", "ts_raw").orderBy("line_no"))
    return rows.withColumn("place", place).filter("place = 1").drop("place", "line_no")


def session_titles(records: DataFrame) -> DataFrame:
    """The title of each session: pinned before generated before summary; of one kind the first."""
    kinds = F.array(*[F.struct(F.lit(-p).alias("rank"), F.col(c).alias("title")) for c, p in TITLES])
    found = records.select(F.col("sessionId").alias("session_id"), "line_no", F.explode(kinds).alias("t")).filter("t.title <> ''")
    return found.groupBy("session_id").agg(F.min(F.struct("t.rank", "line_no", "t.title"))["title"].alias("title"))


def _argument(name: str) -> Column:
    return F.get_json_object("b.input", f"$.{name}")


def routed_calls(blocks: DataFrame) -> DataFrame:
    """Tool calls by family from blocks `b` (name, id, input): a call of no family, or without what its family needs, goes;
    a command that reads or writes a file also counts as a file operation."""
    name, command = F.col("b.name"), _argument("command")
    file_path, pattern, skill, kind = _argument("file_path"), _argument("pattern"), _argument("skill"), F.coalesce(_argument("subagent_type"), F.lit(""))
    mcp = split_mcp(name)
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    family = (
        F.when(name.isin(*FILE_TOOLS) & some(file_path), "file").when((name == "Bash") & some(command), "bash").when(name.isin(*SEARCH_TOOLS) & some(pattern), "search")
        .when((name == "Skill") & some(skill), "skill").when(name.isin(*SPAWN_TOOLS), "subagent").when(F.startswith(name, F.lit("mcp__")), tool_kind(F.col("session_id"), mcp["server"], mcp["tool"]))
    )
    as_file = (family == "bash") & commands.category(command).isNotNull() & commands.target_file(command).isNotNull()
    families = F.when(as_file, F.array(family, F.lit("bash_file"))).otherwise(F.array(family))
    rows = blocks.select("*", F.explode(families).alias("family_")).filter("family_ is not null")
    doubled = F.col("family_") == "bash_file"
    bash = F.col("family_") == "bash"
    return rows.select(
        "session_id", "ts_raw", F.when(doubled, "file").otherwise(F.col("family_")).alias("family"), F.when(doubled, commands.category(command)).when(F.startswith(name, F.lit("mcp__")), mcp["tool"]).otherwise(name).alias("name"),
        F.when(doubled, commands.target_file(command)).otherwise(file_path).alias("file_path"), F.when(bash, command).alias("command"), F.when(bash, commands.target_file(command)).alias("target_file"),
        pattern.alias("pattern"), skill.alias("skill_name"), kind.alias("subagent_type"), F.when(F.col("family_") == "subagent", name).alias("spawn_tool"), mcp["server"].alias("server_name"), F.col("b.id").alias("tool_call_id"),
    )


def session_calls(records: DataFrame) -> DataFrame:
    blocks = records.filter("type = 'assistant'").select(F.col("sessionId").alias("session_id"), F.col("timestamp").alias("ts_raw"), F.explode(json_blocks(F.col("message.content"))).alias("b"))
    return routed_calls(blocks.filter("b.type = 'tool_use'"))


def rollout(records: DataFrame) -> DataFrame:
    """Records with the session, source, model and folder that hold at their line."""
    meta = F.col("type") == "session_meta"
    held = {
        "session_id": F.when(meta, F.coalesce("payload.session_id", "payload.id")), "source": F.when(meta, rollout_source(F.col("payload.originator"))["source"]),
        "model": F.when(F.col("type") == "turn_context", F.col("payload.model")), "cwd": F.when(F.col("type").isin("session_meta", "turn_context"), F.col("payload.cwd")),
    }
    return carried(records, held)


def rollout_messages(filled: DataFrame) -> DataFrame:
    rows = filled.filter("type = 'response_item' and payload.type = 'message'")
    texts = F.array_join(F.transform(F.filter(json_blocks(F.col("payload.content")), lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    kind = F.when(F.col("payload.role") == "assistant", "assistant").otherwise("user")
    return rows.select("session_id", "source", kind.alias("type"), texts.alias("content"), F.col("timestamp").alias("ts_raw"), "model", "line_no").withColumn("uuid", F.sha1(F.concat_ws("|", "session_id", "ts_raw", "type", "content"))).dropDuplicates(["session_id", "uuid"])


def rollout_usage(filled: DataFrame) -> DataFrame:
    """Token usage of each file: increments of its running totals, or, at events without totals, the usage of the last request,
    unless it repeats that of the event of this kind before. If any total falls all have begun anew; increments of nothing
    are dropped; input is net of what was cached. Of one time of a session the first row stays, with the first model."""
    known = lambda m: F.when(F.size(m) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))))
    rows = filled.filter((F.col("type") == "event_msg") & (F.col("payload.type") == "token_count")).select(
        "file", "line_no", "session_id", "source", "model", "cwd", F.col("timestamp").alias("ts_raw"), known(F.col("payload.info.total_token_usage")).alias("total"), known(F.col("payload.info.last_token_usage")).alias("last")
    )
    rows = written(rows, "counts")  # both scans deal them out by ranges, which reads them twice
    parsed = lambda c: F.from_json(c, "map<string,long>")
    totals = running(rows.filter("total is not null"), ["file"], [F.col("line_no")], "nth", lags={"previous": "total"})
    now, then = parsed(F.col("total")), F.coalesce(parsed(F.col("previous")), F.create_map().cast("map<string,long>"))
    delta = F.transform_values(now, lambda k, v: v - F.coalesce(F.element_at(then, k), F.lit(0)))
    usage = F.when(F.exists(F.map_values(delta), lambda v: v < 0), now).otherwise(delta)
    totals = totals.withColumn("usage", usage).filter(F.exists(F.map_values("usage"), lambda v: v > 0))
    lasts = running(rows.filter("total is null and last is not null"), ["file"], [F.col("line_no")], "nth", lags={"previous": "last"})
    lasts = lasts.filter(~F.col("last").eqNullSafe(F.col("previous"))).withColumn("usage", parsed(F.col("last")))
    every = totals.unionByName(lasts).filter("coalesce(ts_raw, '') <> '' and coalesce(session_id, '') <> ''")
    part = lambda name: F.coalesce(F.element_at("usage", F.lit(name)), F.lit(0))
    cells = every.select("file", "line_no", "session_id", "source", "ts_raw", "cwd", F.nullif("model", F.lit("")).alias("model"), part("input_tokens").alias("all_in"), part("cached_input_tokens").alias("cache_read_tokens"), part("output_tokens").alias("output_tokens"))
    place = F.struct("file", "line_no")
    kept = cells.groupBy("session_id", "ts_raw").agg(F.min_by(F.struct("source", "cwd", "all_in", "cache_read_tokens", "output_tokens"), place).alias("u"), F.min_by("model", F.when(F.col("model").isNotNull(), place)).alias("model"))
    net = F.greatest(F.lit(0), F.col("u.all_in") - F.col("u.cache_read_tokens"))
    return kept.select("session_id", "u.source", "model", "ts_raw", "u.cwd", net.alias("input_tokens"), "u.cache_read_tokens", "u.output_tokens")


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an export with `chat_messages` arrays: one row for each, rendered with its blocks, attachments and files."""
    schema = f"uuid string, name string, chat_messages array<struct<uuid:string,sender:string,created_at:string,text:string,content:{rendering.CONTENT},attachments:{rendering.ATTACHMENTS},files:{rendering.FILES}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("uuid", "name", F.posexplode("chat_messages").alias("seq", "m"))
    content = rendering.message_text(F.col("m.content"), F.col("m.text"), F.col("m.attachments"), F.col("m.files"))
    kind = F.when(F.col("m.sender") == "human", "user").otherwise("assistant")
    return rows.select(F.concat(F.lit("claudeai:"), "uuid").alias("session_id"), "seq", kind.alias("type"), content.alias("content"), F.col("m.created_at").alias("ts_raw"), F.concat(F.lit("claudeai:"), F.sha1(F.concat_ws("|", "uuid", "m.uuid"))).alias("uuid"))
