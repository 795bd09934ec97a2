"""Incremental ingest of session logs: new files are read once, rows merge by key, and a watermark for each project, source
and host tells which rows of a grown log are new.

Each micro-batch is merged into tables in place (`operators.tables`): messages first, the watermark last. The file source
remembers which files it has read; if a batch dies half-way it is run again, and as all merges are keyed it then changes
only what is missing. Logs of agents carry times before their parent's last message, so they are taken whole, whatever the
watermark; logs of meta agents (compactions, suggestions) are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.identity import agent_of_file, agent_session, is_agent_id
from tracemill.operators import tables
from tracemill.sources.transcripts import SESSION_RECORD

MESSAGES, STATE = "messages", "state"
MESSAGE_KEY, STATE_KEY = ["session_id", "project", "uuid"], ["key", "project", "source", "host"]
_MESSAGE = "session_id string, project string, uuid string, type string, content string, ts_raw string, model string, agent_id string, parent_session_id string"
_STATE = "key string, project string, source string, host string, value string"
LAST_PARSED = "last_parsed"


def create(spark: SparkSession, folder: str, buckets: int = 64) -> None:
    """Empty tables below `folder`."""
    for name, schema, keys in ((MESSAGES, _MESSAGE, MESSAGE_KEY), (STATE, _STATE, STATE_KEY)):
        path = f"{folder}/{name}"
        tables.create(spark.createDataFrame([], schema), path, keys, buckets)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read(spark, f"{folder}/{name}", like=spark.createDataFrame([], _MESSAGE if name == MESSAGES else _STATE))


def project_of(file: Column) -> Column:
    """The folder of the project: the one that holds the log, or for an agent's log the session's folder."""
    return F.regexp_extract(file, r"([^/]+)/(?:[^/]+/subagents/(?:.*/)?)?[^/]+\.jsonl$", 1)


def messages(lines: DataFrame) -> DataFrame:
    """Messages of lines (file, value): user and assistant records with a time and a uuid; an agent's messages belong to a session
    of its own, whose parent is the session that it wrote under."""
    r = lines.withColumn("r", F.from_json("value", SESSION_RECORD)).filter(F.col("r.type").isin("user", "assistant") & (F.coalesce("r.uuid", F.lit("")) != "") & (F.coalesce("r.timestamp", F.lit("")) != "") & (F.coalesce("r.sessionId", F.lit("")) != ""))
    agent = agent_of_file(F.col("file"))
    own = agent_session(F.col("r.sessionId"), agent)
    rows = r.withColumn("agent", agent).filter(F.col("agent").isNull() | is_agent_id(F.col("agent")))
    return rows.select(own.alias("session_id"), project_of(F.col("file")).alias("project"), "r.uuid", "r.type", F.col("r.message.content").alias("content"), F.col("r.timestamp").alias("ts_raw"), F.col("r.message.model").alias("model"), F.col("agent").alias("agent_id"), F.when(own != F.col("r.sessionId"), F.col("r.sessionId")).alias("parent_session_id"))


def merge_batch(lines: DataFrame, folder: str, source: str, host: str, since: str | None = None, buckets: int = 64) -> dict[str, int]:
    """Merge one batch. Rows of ordinary logs count if they are later than their project's watermark, or than `since` if that is
    earlier; the watermark itself only moves forward. Returns how many buckets of each table were rewritten."""
    spark = lines.sparkSession
    known = table(spark, folder, STATE).filter((F.col("key") == LAST_PARSED) & (F.col("source") == source) & (F.col("host") == host))
    gate = F.least(F.col("value"), F.lit(since)) if since else F.col("value")
    rows = messages(lines).join(known.select("project", "value"), "project", "left")
    fresh = rows.filter(F.col("agent_id").isNotNull() | F.col("value").isNull() | (F.col("ts_raw") > gate)).drop("value")
    done = {MESSAGES: tables.insert_new(f"{folder}/{MESSAGES}", fresh.select(*[f.name for f in spark.createDataFrame([], _MESSAGE).schema]), MESSAGE_KEY, F.col("ts_raw"), buckets=buckets)["changed"]}
    # last, so that a batch that dies before is taken up whole again
    reached = rows.filter("agent_id is null").groupBy("project").agg(F.max("ts_raw").alias("reached"), F.max("value").alias("value")).filter("value is null or reached > value")
    state = reached.select(F.lit(LAST_PARSED).alias("key"), "project", F.lit(source).alias("source"), F.lit(host).alias("host"), F.col("reached").alias("value"))
    done[STATE] = tables.upsert(f"{folder}/{STATE}", state, STATE_KEY, buckets=buckets)["changed"]
    return done


def ingest(spark: SparkSession, path: str, folder: str, checkpoint: str, source: str, host: str, since: str | None = None, files_per_trigger: int = 1000, buckets: int = 64) -> None:
    """Read the logs below `path` (<project>/<session>.jsonl and agents' logs below it) that are new since the last call."""
    stream = spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_trigger).text(path)
    lines = stream.select(F.col("_metadata.file_path").alias("file"), "value")
    query = lines.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, folder, source, host, since, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
