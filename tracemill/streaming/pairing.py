"""Pairing tool calls with their results as both arrive, in any order: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "session_id string, tool_call_id string, called_at timestamp, answered_at timestamp, name string, is_error int, status string"


class _Calls(StatefulProcessor):
    """For one (session_id, tool_call_id): the call that waits for its result, or the result that came before its call. Either is
    given up when the watermark passes its time by `wait_ms`. A pair leaves a mark, so that repeated rows are not paired
    again; the mark goes by the same timer."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "ms long, name string")
        self.result = handle.getValueState("result", "ms long, is_error int")
        self.paired = handle.getValueState("paired", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        call, result = self.call.get(), self.result.get()
        done, changed = self.paired.exists(), False
        for batch in rows:
            for kind, ms, name, is_error in zip(batch["kind"], batch["ms"], batch["name"], batch["is_error"], strict=True):
                # of several calls or results with one id the earliest counts
                if kind == "use" and (call is None or ms < call[0]):
                    call, changed = (int(ms), None if pd.isna(name) else str(name)), True
                if kind == "result" and (result is None or ms < result[0]):
                    result, changed = (int(ms), 0 if pd.isna(is_error) else int(is_error)), True
        if done or not changed:
            return
        if call is not None and result is not None:
            self.paired.update((max(call[0], result[0]),))
            self.call.clear()
            self.result.clear()
            self._timer(max(call[0], result[0]))
            yield self._row(key, call, result, "paired")
            return
        if call is not None:
            self.call.update(call)
            self._timer(call[0])
        if result is not None:
            self.result.update(result)
            self._timer(result[0])

    def _timer(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        call, result = self.call.get(), self.result.get()
        self.call.clear()
        self.result.clear()
        self.paired.clear()
        if call is not None:
            yield self._row(key, call, None, "unanswered")
        elif result is not None:
            yield self._row(key, None, result, "orphan")

    def _row(self, key, call, result, status: str) -> pd.DataFrame:
        at = lambda x: pd.NaT if x is None else pd.Timestamp(x[0], unit="ms")
        row = {"session_id": [key[0]], "tool_call_id": [key[1]], "called_at": [at(call)], "answered_at": [at(result)], "name": [call[1] if call else None], "is_error": [result[1] if result else None], "status": [status]}
        return pd.DataFrame(row).astype({"called_at": "datetime64[us]", "answered_at": "datetime64[us]", "is_error": "Int32"})

    def close(self) -> None:
        pass


def paired_calls(uses: DataFrame, results: DataFrame, wait: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Streams of calls (session_id, tool_call_id, ts, name) and results (session_id, tool_call_id, ts, is_error) joined by id.

    Each call comes out once: `paired` as soon as its result is there, whichever came first, or `unanswered` when the watermark
    (the latest time seen less `delay`) has passed it by `wait`; a result whose call has not come by then is an `orphan`.
    Rows older than the watermark are dropped by the engine, as in any stream; rows with a null id are left out. The session
    needs the RocksDB state store (`state_store`)."""
    ms = lambda df: F.unix_millis(df["ts"]).alias("ms")
    a = uses.select("session_id", "tool_call_id", "ts", F.lit("use").alias("kind"), ms(uses), F.col("name").cast("string").alias("name"), F.lit(None).cast("int").alias("is_error"))
    b = results.select("session_id", "tool_call_id", "ts", F.lit("result").alias("kind"), ms(results), F.lit(None).cast("string").alias("name"), F.col("is_error").cast("int").alias("is_error"))
    both = a.unionByName(b).filter("session_id is not null and tool_call_id is not null and ts is not null").withWatermark("ts", delay)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    return both.groupBy("session_id", "tool_call_id").transformWithStateInPandas(statefulProcessor=_Calls(wait_ms), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def state_store(spark) -> None:
    """State with timers needs a store that keeps several column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
