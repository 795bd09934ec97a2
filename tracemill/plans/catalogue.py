"""The registered queries: every report and operator over the model's views of the test tables, with the SQL that checks it.

`run` receives a function that gives a view or a base table by name; `sql` is for DuckDB, over the views in `views` (they
precede it as common table expressions; SQL that begins with a comma adds more of them)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import commands, text
from tracemill.functions.outcomes import ERROR_MARKERS, NEVER_EXECUTED, UNKNOWN, error_class
from tracemill.operators import evaluation, graph, intervals, merge, pricing, reports, search
from tracemill.operators.filters import Filters, apply_filters, like

from .views import VIEWS, view, with_views

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Report:
    name: str
    run: Callable[[Tables], DataFrame]
    views: tuple[str, ...] = ()
    sql: str | None = None

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(lambda name: view(spark, sf_dir, name) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def oracle(self) -> str | None:
        return with_views(self.sql, *self.views) if self.sql and self.views else self.sql


# fragments of SQL that many reports share

_ERRORS, _MEASURED = "count(*) FILTER (is_error = 1)", "count(is_error)"
_OUTCOME = f"{_ERRORS} AS errors, {_MEASURED} AS measured, CASE WHEN {_MEASURED} > 0 THEN round({_ERRORS} / {_MEASURED}, 4) END AS error_rate"
_QUOTED = {name: [m.replace("'", "''") for m in markers] for name, markers in ERROR_MARKERS}
_CLASS = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(error_text, '{m}')''' for m in markers)} THEN '{name}'" for name, markers in _QUOTED.items()) + f" WHEN coalesce(error_text, '') = '' THEN '{UNKNOWN}' ELSE 'failed' END"
_NEVER_LIST = ", ".join(f"'{c}'" for c in NEVER_EXECUTED)
_NEVER = f"count(*) FILTER (is_error = 1 AND {_CLASS} IN ({_NEVER_LIST})) AS never_executed, count(*) FILTER (is_error = 1 AND {_CLASS} = '{UNKNOWN}') AS errors_unclassified"
_REAL = "CASE WHEN measured - never_executed > 0 THEN round((errors - never_executed) / (measured - never_executed), 4) END AS real_error_rate"
_DAY, _HOUR = "substr(ts_raw, 1, 10)", "CAST(substr(ts_raw, 12, 2) AS INT)"
_SUMS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t, _ in pricing.KINDS)
_COST = " + ".join(f"coalesce({t}, 0) * coalesce({p}, 0) / 1e6" for t, p in pricing.KINDS)
_COSTS = ", ".join(f"round(sum(coalesce({t}, 0) * coalesce({p}, 0) / 1e6), 4) AS {p.replace('_price', '_cost')}" for t, p in pricing.KINDS)
_PRICED = f""", priced AS (SELECT u.*, p.model AS p_model, {', '.join(p for _, p in pricing.KINDS)}, {_COST} AS cost FROM token_usage u LEFT JOIN pricing p
  ON u.model = p.model AND ts_raw >= from_date AND (to_date IS NULL OR ts_raw < to_date)) """
_ALL_IN = "sum(input_tokens + cache_read_tokens + cache_creation_tokens)"
_HIT = f"CASE WHEN {_ALL_IN} > 0 THEN round(1e2 * sum(cache_read_tokens) / {_ALL_IN}, 1) ELSE 0 END AS cache_hit_rate"
_PER_SESSION = _PRICED + f", per AS (SELECT session_id, project_id, count(*) AS calls, round(sum(cost), 4) AS cost, {_HIT} FROM priced GROUP BY 1, 2) "
_COUNT = 'count(*) AS "count"'
USAGE, CALLS = ("token_usage", "pricing"), ("tool_calls",)


def _counted(family: str, keys: str, outcome: bool = False, where: str = "TRUE", limit: int = 0) -> str:
    n = keys.count(",") + 1
    last = ", ".join(str(i + 1) for i in range(n))
    return f"SELECT {keys}, {_COUNT}{', ' + _OUTCOME if outcome else ''} FROM tool_calls WHERE family = '{family}' AND {where} GROUP BY {last}" + (f' ORDER BY "count" DESC, {last} LIMIT {limit}' if limit else "")


def _of(t: Tables, family: str) -> DataFrame:
    return reports.of(t("tool_calls"), family)


def _top(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return reports.top(df, n, F.desc("count"), *keys)


def _some(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _with_prices(f):
    return lambda t: f(t("token_usage"), t("pricing"))


def _union_sql(source: str, by: str, name: str) -> str:
    """Common table expressions that merge the intervals of `source` into `name`."""
    w = f"OVER (PARTITION BY {by} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f""", {name}_r AS (SELECT *, max(end_us) {w} 1 PRECEDING) AS reach FROM {source}),
{name}_f AS (SELECT *, CASE WHEN start_us <= reach THEN 0 ELSE 1 END AS fresh FROM {name}_r), {name}_n AS (SELECT *, sum(fresh) {w} CURRENT ROW) AS n FROM {name}_f),
{name} AS (SELECT {by}, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_n GROUP BY {by}, n) """


_ISLANDS = f""", flagged AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY day, session_id ORDER BY us, id) <= {intervals.GAP_US} THEN 0 ELSE 1 END AS fresh FROM activity),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY day, session_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
islands AS (SELECT day, session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM numbered GROUP BY day, session_id, island) """
_REPLIES = f""", nexts AS (SELECT *, first_value(CASE WHEN type = 'assistant' THEN us END IGNORE NULLS) OVER (PARTITION BY day, session_id ORDER BY us, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply FROM activity),
replies AS (SELECT day, session_id, us AS start_us, least(reply, us + {intervals.CAP_US}) AS end_us FROM nexts WHERE type = 'user' AND reply IS NOT NULL) """
_SPANS = ", spans AS (SELECT day, session_id, min(us) AS start_us, max(us) AS end_us FROM activity GROUP BY 1, 2) "
_CURVE = """, edges AS (SELECT day, start_us AS us, 1 AS delta FROM spans UNION ALL SELECT day, end_us, -1 FROM spans), steps AS (SELECT day, us, delta, sum(delta) AS change FROM edges GROUP BY ALL),
curve AS (SELECT *, CAST(sum(change) OVER (PARTITION BY day ORDER BY us, delta DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM steps),
peaks AS (SELECT day, us AS peak_us, open AS peak FROM curve QUALIFY row_number() OVER (PARTITION BY day ORDER BY open DESC, us) = 1) """
_GANTT = ", gantt AS (SELECT day, session_id, project_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events, round((max(us) - min(us)) / 6e7, 2) AS duration_min FROM activity GROUP BY 1, 2, 3) "
_TOPS = ", tops AS (SELECT * FROM tree t WHERE parent_session_id IS NULL OR parent_session_id = session_id OR NOT EXISTS (SELECT 1 FROM tree p WHERE p.session_id = t.parent_session_id)) "
_DOWN = """, down(master, session_id, project_id) AS (SELECT session_id, session_id, project_id FROM tops
  UNION SELECT d.master, t.session_id, t.project_id FROM down d JOIN tree t ON t.parent_session_id = d.session_id AND t.parent_session_id <> t.session_id) """

# scalar arguments of registered searches
_PHRASE, _NEEDLE = "a OR de", "an"
_VECTOR = [((7 * i) % 11 - 5) / 5 for i in range(64)]
_FILTER = Filters(project_id=3, start="2024-01-05", end="2024-01-20", source="desktop")


def _pairs(t: Tables) -> DataFrame:
    return t("metadata").select(F.col("data_sensitivity").alias("gold"), F.when(F.length("text") % 3 == 0, "internal").otherwise(F.col("data_sensitivity")).alias("pred"))


_PAIRS = ", pairs AS (SELECT data_sensitivity AS gold, CASE WHEN length(text) % 3 = 0 THEN 'internal' ELSE data_sensitivity END AS pred FROM metadata) "
_PER_CLASS = """, sides AS (SELECT gold AS label, 1 AS support, 0 AS predicted, CASE WHEN gold = pred THEN 1 ELSE 0 END AS hit FROM pairs UNION ALL SELECT pred, 0, 1, 0 FROM pairs),
by_label AS (SELECT label, CAST(sum(support) AS BIGINT) AS support, sum(predicted) AS predicted, sum(hit) AS hit FROM sides GROUP BY 1),
rates AS (SELECT label, support, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM by_label),
per_class AS (SELECT label, support, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM rates) """


def _old(t: Tables) -> DataFrame:
    return t("customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")


def _new(t: Tables) -> DataFrame:
    return t("customer").filter("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("+")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))


_MERGE = "WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, c_name || '+' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) "


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tool calls as uses (even ids) and as results (odd ids) of the same call ids."""
    calls = t("tool_calls").withColumn("tool_call_id", F.concat(F.lit("t"), F.floor(F.col("id") / 4)))
    uses = calls.filter("id % 2 = 0").select("id", "session_id", "project_id", "name", "tool_call_id", F.col("id").alias("seq"))
    results = calls.filter("id % 2 = 1").select("session_id", "project_id", "name", "tool_call_id", F.col("id").alias("seq"), "is_error", "error_text", "exit_code", F.col("ts_raw").alias("ts"))
    return uses, results


_HALVES = """, calls AS (SELECT *, concat('t', CAST(floor(id / 4) AS BIGINT)) AS tool_call_id, id AS seq FROM tool_calls) """


def _asof(t: Tables) -> DataFrame:
    rows = t("activity").select(F.col("id").alias("event_id"), "project_id", "session_id", "us", "type")
    return graph.nearest_before(rows, rows.filter("type = 'assistant'").withColumnRenamed("event_id", "call_id"), key="project_id")


_FTS = r", words AS (SELECT *, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(content, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM messages) "

REPORTS: tuple[Report, ...] = (
    # tokens and cost
    Report("rep_tokens_by_model", _with_prices(reports.tokens_by_model), USAGE, _PRICED + f"SELECT model, count(*) AS calls, {_SUMS}, {_COSTS}, round(sum(cost), 4) AS cost_usd, max(CASE WHEN p_model IS NULL THEN 0 ELSE 1 END) AS has_price FROM priced GROUP BY 1"),
    Report("rep_tokens_daily", _with_prices(reports.tokens_daily), USAGE, _PRICED + f"SELECT {_DAY} AS date, {_SUMS}, round(sum(cost), 4) AS cost_usd FROM priced GROUP BY 1"),
    Report("rep_tokens_totals", _with_prices(reports.tokens_totals), USAGE, _PRICED + f"SELECT count(*) AS calls, {_SUMS}, round(sum(cost), 4) AS cost_usd FROM priced"),
    Report("rep_qa_counts", lambda t: reports.question_counts(t("messages")), ("messages",), "SELECT count(*) FILTER (type = 'user') AS questions, count(*) FILTER (type = 'assistant') AS answers FROM messages"),
    Report("join_range_temporal", lambda t: pricing.priced(t("token_usage"), t("pricing")).select("id", "model", "ts_raw", "from_date", F.round("cost", 9).alias("cost")), USAGE,
           f"SELECT id, u.model, ts_raw, from_date, round({_COST}, 9) AS cost FROM token_usage u LEFT JOIN pricing p ON u.model = p.model AND ts_raw >= from_date AND (to_date IS NULL OR ts_raw < to_date)"),
    Report("rep_work_by_hour", _with_prices(reports.work_by_hour), USAGE, _PRICED + f"SELECT {_HOUR} AS hour, count(DISTINCT (session_id, project_id)) AS session_count, round(sum(round(cost, 6)), 4) AS total_cost, round(avg(round(cost, 6)), 4) AS avg_cost, CAST(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS BIGINT) AS total_tokens FROM priced GROUP BY 1"),
    Report("rep_work_by_dow", _with_prices(reports.work_by_weekday), USAGE, _PRICED + f"SELECT CAST(dayofweek(CAST({_DAY} AS DATE)) AS INT) AS day, count(DISTINCT (session_id, project_id)) AS session_count, round(sum(round(cost, 6)), 4) AS total_cost, round(avg(round(cost, 6)), 4) AS avg_cost, dayname(CAST({_DAY} AS DATE)) AS day_name FROM priced GROUP BY 1, 5"),
    Report("rep_work_by_complexity", _with_prices(reports.work_by_complexity), USAGE, _PER_SESSION + "SELECT CASE WHEN calls < 10 THEN 'quick' WHEN calls < 50 THEN 'medium' ELSE 'deep' END AS bucket, " + _COUNT + ", round(avg(cost), 4) AS avg_cost, round(avg(cache_hit_rate), 1) AS avg_cache_hit_rate, round(sum(cost), 4) AS total_cost FROM per GROUP BY 1"),
    Report("rep_work_by_length", lambda t: reports.work_by_length(t("messages")), ("messages",), "SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' WHEN n <= 60 THEN '31-60' ELSE '60+' END AS bin, count(*) AS sessions, round(avg(n), 2) AS avg_messages FROM (SELECT count(*) AS n FROM messages GROUP BY session_id, project_id) GROUP BY 1"),
    Report("rep_eff_cache_trend", lambda t: reports.cache_trend(t("token_usage")), ("token_usage",), f"SELECT {_DAY} AS date, {_HIT}, count(*) AS calls FROM token_usage GROUP BY 1"),
    Report("rep_eff_cost_per_call", _with_prices(reports.cost_per_call), USAGE, _PRICED + f"SELECT {_DAY} AS date, round(sum(cost) / count(*), 6) AS avg_cost_per_call, count(*) AS calls FROM priced GROUP BY 1"),
    Report("rep_eff_model", _with_prices(reports.model_efficiency), USAGE, _PRICED + "SELECT model, count(*) AS sessions, round(avg(cost), 4) AS avg_cost_per_session, round(avg(calls), 2) AS avg_calls FROM (SELECT model, session_id, project_id, sum(cost) AS cost, count(*) AS calls FROM priced GROUP BY 1, 2, 3) GROUP BY 1"),
    Report("rep_eff_source", lambda t: reports.source_comparison(t("token_usage"), t("pricing"), t("session_sources")), (*USAGE, "session_sources"), _PER_SESSION + "SELECT coalesce(source, 'unknown') AS source, count(*) AS sessions, round(avg(cost), 4) AS avg_cost_per_session FROM per LEFT JOIN session_sources USING (session_id, project_id) GROUP BY 1"),
    Report("rep_task_type_costs", lambda t: reports.task_type_costs(t("token_usage").withColumn("session_id", F.concat(F.lit("d"), "user_id")), t("pricing"), t("metadata").select("session_id", "project_id", "classification")), (*USAGE, "metadata"),
           _PRICED + ", per AS (SELECT concat('d', user_id) AS session_id, project_id, round(sum(cost), 4) AS cost FROM priced GROUP BY 1, 2) SELECT coalesce(classification, 'unclassified') AS classification, count(*) AS sessions, round(avg(cost), 4) AS avg_cost, round(sum(cost), 4) AS total_cost FROM per LEFT JOIN metadata USING (session_id, project_id) GROUP BY 1"),
    # decimal ties such as 0.0002445 round half up in Spark; in binary they may lie below the tie, so the SQL lifts them
    Report("rep_session_cost_profile", _with_prices(reports.session_profile), USAGE, _PRICED + """, seq AS (SELECT *, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY session_id, project_id) // 3, 1) AS third,
  sum(cost) OVER (PARTITION BY session_id, project_id ORDER BY ts_raw, id ROWS UNBOUNDED PRECEDING) AS running FROM priced WINDOW w AS (PARTITION BY session_id, project_id ORDER BY ts_raw, id))
SELECT session_id, project_id, id, round(round(cost, 12) + 1e-13, 6) AS cost, round(round(running, 12) + 1e-13, 4) AS cumulative_cost, CASE WHEN place <= third THEN 'early' WHEN place <= 2 * third THEN 'mid' ELSE 'late' END AS phase FROM seq"""),
    Report("join_self_overlap", lambda t: pricing.overlaps(t("pricing").withColumn("to_date", F.when(F.col("model") == "view", "2024-02-01").otherwise(F.col("to_date")))), ("pricing",),
           ", p AS (SELECT model, from_date, CASE WHEN model = 'view' THEN '2024-02-01' ELSE to_date END AS to_date FROM pricing) SELECT model, count(*) AS overlaps FROM (SELECT *, lead(from_date) OVER (PARTITION BY model ORDER BY from_date) AS next FROM p) WHERE next IS NOT NULL AND (to_date IS NULL OR to_date > next) GROUP BY 1"),
    Report("prc_seed", lambda t: pricing.seed(t("pricing").filter("model <> 'click'"), t("pricing")), ("pricing",), "SELECT * FROM pricing"),
    # files, commands, searches, skills, subagents, servers
    Report("rep_files_by_tool", lambda t: reports.counted(_of(t, "file"), "tool", outcome=True), CALLS, _counted("file", "tool", True)),
    Report("rep_files_top", lambda t: _top(reports.counted(_of(t, "file"), "file_path"), 20, "file_path"), CALLS, _counted("file", "file_path", limit=20)),
    Report("rep_files_top_by_tool", lambda t: _top(reports.counted(_of(t, "file"), "file_path", "tool"), 30, "file_path", "tool"), CALLS, _counted("file", "file_path, tool", limit=30)),
    Report("rep_files_daily", lambda t: reports.counted(_of(t, "file"), reports.day(), "tool"), CALLS, f"SELECT {_DAY} AS date, tool, {_COUNT} FROM tool_calls WHERE family = 'file' GROUP BY 1, 2"),
    Report("rep_files_hourly", lambda t: reports.counted(_of(t, "file"), reports.hour()), CALLS, f"SELECT {_HOUR} AS hour, {_COUNT} FROM tool_calls WHERE family = 'file' GROUP BY 1"),
    Report("rep_files_totals", lambda t: reports.files_totals(t("tool_calls")), CALLS, f"SELECT {_COUNT}, count(DISTINCT file_path) AS files, count(DISTINCT (session_id, project_id)) AS sessions, {_OUTCOME} FROM tool_calls WHERE family = 'file'"),
    Report("rep_skills_top", lambda t: _top(reports.counted(_of(t, "skill"), "skill_name", outcome=True), 20, "skill_name"), CALLS, _counted("skill", "skill_name", True, limit=20)),
    Report("rep_subagents_top", lambda t: _top(reports.counted(_of(t, "subagent").filter(_some("subagent_type")), "subagent_type", outcome=True), 20, "subagent_type"), CALLS, _counted("subagent", "subagent_type", True, "subagent_type <> ''", 20)),
    Report("rep_subagents_by_spawn", lambda t: reports.subagents_by_spawn(t("tool_calls")), CALLS, _counted("subagent", "coalesce(nullif(spawn_tool, ''), '(unknown)') AS spawn_tool", True).replace("GROUP BY 1, 2, 3", "GROUP BY 1")),
    Report("rep_mcp_by_server", lambda t: reports.counted(_of(t, "mcp"), "server_name", outcome=True), CALLS, _counted("mcp", "server_name", True)),
    Report("rep_mcp_top_tools", lambda t: _top(reports.counted(_of(t, "mcp"), "name", "server_name"), 20, "name", "server_name"), CALLS, _counted("mcp", "name, server_name", limit=20)),
    Report("rep_mcp_top_errors", lambda t: reports.top_errors(_of(t, "mcp"), "name", "server_name"), CALLS, """SELECT name, server_name, count(*) AS errors, max(ts_raw) AS last_error_at, struct_extract(max(struct_pack(t := ts_raw, i := id, x := error_text)), 'x') AS last_error_text
FROM tool_calls WHERE family = 'mcp' AND is_error = 1 GROUP BY 1, 2 ORDER BY errors DESC, last_error_at DESC, 1, 2 LIMIT 20"""),
    Report("rep_bash_by_type", lambda t: reports.bash_by_type(t("tool_calls")), CALLS, f""", by_name AS (SELECT cmd_name AS cmd_type, count(*) AS n, {_ERRORS} AS e, {_MEASURED} AS m FROM tool_calls WHERE family = 'bash' GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY n DESC, cmd_type) AS place FROM by_name)
SELECT CASE WHEN place > 15 THEN 'other' ELSE cmd_type END AS cmd_type, CAST(sum(n) AS BIGINT) AS "count", CAST(sum(e) AS BIGINT) AS errors, CAST(sum(m) AS BIGINT) AS measured, CASE WHEN sum(m) > 0 THEN round(sum(e) / sum(m), 4) END AS error_rate FROM placed GROUP BY 1"""),
    Report("rep_bash_top_files", lambda t: _top(reports.counted(_of(t, "bash").filter(_some("target_file")), "target_file"), 20, "target_file"), CALLS, _counted("bash", "target_file", where="target_file IS NOT NULL AND target_file <> ''", limit=20)),
    Report("rep_bash_top_errors", lambda t: reports.bash_top_errors(t("tool_calls")), CALLS, """, failed AS (SELECT * FROM tool_calls WHERE family = 'bash' AND is_error = 1),
top AS (SELECT cmd_name, count(*) AS errors, max(ts_raw) AS last_error_at, struct_extract(max(struct_pack(t := ts_raw, i := id, x := error_text)), 'x') AS sample FROM failed GROUP BY 1 ORDER BY errors DESC, last_error_at DESC, cmd_name LIMIT 20),
codes AS (SELECT cmd_name, exit_code AS top_exit_code, count(*) AS top_exit_count FROM failed WHERE exit_code IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cmd_name ORDER BY count(*) DESC, exit_code) = 1)
SELECT cmd_name, errors, last_error_at, sample, top_exit_code, top_exit_count FROM top LEFT JOIN codes USING (cmd_name)"""),
    Report("rep_search_top_patterns", lambda t: _top(reports.counted(_of(t, "search").filter(_some("pattern")), "pattern"), 20, "pattern"), CALLS, _counted("search", "pattern", where="pattern <> ''", limit=20)),
    Report("rep_search_top_paths", lambda t: _top(reports.counted(_of(t, "search").filter(_some("path")), "path"), 15, "path"), CALLS, _counted("search", "path", where="path <> ''", limit=15)),
    Report("rep_tools_overview", lambda t: reports.tools_overview(t("tool_calls")), CALLS, f', by_family AS (SELECT family, {_COUNT}, {_OUTCOME}, {_NEVER} FROM tool_calls GROUP BY 1) SELECT *, round(measured / "count", 4) AS measured_coverage, {_REAL} FROM by_family'),
    Report("rep_tools_totals", lambda t: reports.tools_totals(t("tool_calls")), CALLS, f', totals AS (SELECT {_COUNT}, {_OUTCOME}, {_NEVER} FROM tool_calls) SELECT *, round(measured / "count", 4) AS measured_coverage, {_REAL} FROM totals'),
    Report("rep_tools_leaderboard", lambda t: reports.leaderboard(t("tool_calls")), CALLS, f""", by_tool AS (SELECT family, name, count(*) AS calls, {_OUTCOME}, {_NEVER}, max(CASE WHEN is_error = 1 THEN ts_raw END) AS last_error_at FROM tool_calls GROUP BY 1, 2)
SELECT *, errors - never_executed AS errors_executed, {_REAL} FROM by_tool WHERE measured >= 10 ORDER BY error_rate DESC NULLS LAST, errors DESC, calls DESC, family, name LIMIT 301"""),
    Report("rep_mcp_hierarchy", lambda t: reports.mcp_hierarchy(t("tool_calls"), n=3), CALLS, f""", by_tool AS (SELECT family, server_name, name AS tool, count(*) AS n, {_ERRORS} AS e, {_MEASURED} AS m FROM tool_calls WHERE family IN ('mcp', 'builtin_host') GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY family, server_name ORDER BY n DESC, tool) AS place FROM by_tool)
SELECT family, server_name, CASE WHEN place > 3 THEN 'other' ELSE tool END AS tool, CAST(sum(n) AS BIGINT) AS "count", CAST(sum(e) AS BIGINT) AS errors, CAST(sum(m) AS BIGINT) AS measured, CASE WHEN sum(m) > 0 THEN round(sum(e) / sum(m), 4) END AS error_rate FROM placed GROUP BY 1, 2, 3"""),
    Report("rep_error_samples", lambda t: reports.error_samples(t("tool_calls")), CALLS, f""", texts AS (SELECT family, name, substr(coalesce(error_text, ''), 1, 200) AS text, {_CLASS} AS class, {_COUNT}, max(ts_raw) AS last_at FROM tool_calls WHERE is_error = 1 GROUP BY 1, 2, 3, 4)
SELECT *, CAST(row_number() OVER (PARTITION BY family, name ORDER BY "count" DESC, last_at DESC, text) AS INT) AS place FROM texts QUALIFY place <= 5"""),
    Report("agg_error_class", lambda t: t("tool_calls").select(error_class(F.col("is_error"), F.col("error_text")).alias("class")).groupBy("class").agg(F.count("*").alias("count")), CALLS, f"SELECT CASE WHEN is_error = 1 THEN {_CLASS} END AS class, {_COUNT} FROM tool_calls GROUP BY 1"),
    Report("rep_backfill_breakdown", lambda t: reports.coverage(t("tool_calls")), CALLS, f"SELECT family, count(*) AS total, {_ERRORS} AS failed, count(*) FILTER (is_error = 0) AS ok, count(*) FILTER (is_error IS NULL) AS unmeasured, round(1e2 * count(is_error) / count(*), 2) AS pct_measured FROM tool_calls GROUP BY 1"),
    Report("rep_timeline", lambda t: reports.timeline(t("tool_calls")), CALLS, f"SELECT {_DAY} AS date, count(*) FILTER (family = 'skill') AS skill, count(*) FILTER (family = 'subagent') AS subagent, count(*) FILTER (family = 'mcp') AS mcp FROM tool_calls WHERE family IN ('skill', 'subagent', 'mcp') GROUP BY 1"),
    Report("rep_client_tokens", lambda t: reports.by_source(t("token_usage"), t("session_sources"), *reports.token_sums()), ("token_usage", "session_sources"), f"SELECT coalesce(source, 'unknown') AS source, {_SUMS} FROM token_usage LEFT JOIN session_sources USING (session_id, project_id) GROUP BY 1"),
    Report("rep_date_range", lambda t: reports.date_range(t("token_usage")), ("token_usage",), "SELECT substr(min(ts_raw), 1, 10) AS first_day, substr(max(ts_raw), 1, 10) AS last_day FROM token_usage"),
    # people and metadata
    Report("rep_users", lambda t: reports.users(t("token_usage"), t("pricing"), t("session_sources")).withColumn("sources", F.array_join("sources", ",")), (*USAGE, "session_sources"), _PRICED + """SELECT user_id, count(DISTINCT (session_id, project_id)) AS sessions, count(DISTINCT host_id) AS hosts, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost,
  coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM priced LEFT JOIN session_sources USING (session_id, project_id) GROUP BY 1"""),
    Report("rep_user_top_model", lambda t: reports.top_model(t("token_usage")), ("token_usage",), "SELECT user_id, model FROM token_usage GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, model) = 1"),
    Report("rep_user_heatmap", lambda t: reports.heatmap(t("token_usage")), ("token_usage",), f"SELECT CAST(dayofweek(CAST({_DAY} AS DATE)) AS INT) AS day, {_HOUR} AS hour, count(*) AS calls FROM token_usage GROUP BY 1, 2"),
    Report("rep_class_stats", lambda t: t("metadata").groupBy("classification", "data_sensitivity").agg(F.count("*").alias("count")), ("metadata",), f"SELECT classification, data_sensitivity, {_COUNT} FROM metadata GROUP BY 1, 2"),
    Report("rep_tagcloud", lambda t: reports.tag_cloud(t("metadata")), ("metadata",), f"""SELECT tag, {_COUNT} FROM (SELECT trim(unnest(topics), ' ') AS tag FROM metadata) WHERE tag <> '' GROUP BY 1 ORDER BY "count" DESC, tag LIMIT 100"""),
    # filters and joins
    Report("flt_4d", lambda t: apply_filters(t("token_usage"), _FILTER, t("session_sources")).select("id", "session_id", "ts_raw"), ("token_usage", "session_sources"), f"""SELECT id, u.session_id, ts_raw FROM token_usage u JOIN session_sources s ON u.session_id = s.session_id AND u.project_id = s.project_id
WHERE source = '{_FILTER.source}' AND u.project_id = {_FILTER.project_id} AND ts_raw >= '{_FILTER.start}' AND ts_raw <= '{_FILTER.end}T23:59:59'"""),
    Report("flt_like", lambda t: t("messages").filter(like("content", _NEEDLE)).select("session_id", "seq"), ("messages",), f"SELECT session_id, seq FROM messages WHERE content ILIKE '%{_NEEDLE}%'"),
    Report("join_asof_nearest", _asof, ("activity",), """, near AS (SELECT e.id AS event_id, c.id AS call_id, c.session_id AS parent, e.us - c.us AS gap_us FROM activity e JOIN activity c ON e.project_id = c.project_id AND c.type = 'assistant' AND e.session_id <> c.session_id AND e.us - c.us BETWEEN 0 AND 119999999)
SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap_us, call_id) = 1"""),
    Report("join_tool_result", lambda t: merge.attach_outcomes(_halves(t)[0].drop("name", "seq"), _halves(t)[1].drop("name")), CALLS, _HALVES + """, last AS (SELECT session_id, project_id, tool_call_id, is_error, error_text, exit_code, ts_raw AS result_ts FROM calls WHERE id % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY session_id, project_id, tool_call_id ORDER BY seq DESC) = 1)
SELECT c.id, c.session_id, c.project_id, c.tool_call_id, l.is_error, CASE WHEN l.is_error = 1 THEN substr(l.error_text, 1, 2000) END AS error_text, l.exit_code, l.result_ts FROM calls c LEFT JOIN last l USING (session_id, project_id, tool_call_id) WHERE c.id % 2 = 0"""),
    Report("join_rank_pair", lambda t: merge.paired_by_rank(_halves(t)[0].select("session_id", "name", "seq"), _halves(t)[1].select("session_id", "name", "seq"), ["session_id", "name"]), CALLS, """, ranked AS (SELECT session_id, name, id, id % 2 AS half, row_number() OVER (PARTITION BY session_id, name, id % 2 ORDER BY id) AS k FROM tool_calls)
SELECT a.session_id, a.name, a.id AS seq, CAST(a.k AS INT) AS k, b.id AS result_seq FROM ranked a LEFT JOIN ranked b ON a.session_id = b.session_id AND a.name = b.name AND a.k = b.k AND b.half = 1 WHERE a.half = 0"""),
    # windows over logs
    Report("win_lag_delta", lambda t: merge.counter_deltas(t("token_usage").select("user_id", F.col("id").alias("seq"), F.col("input_tokens").alias("total")), ["user_id"]), ("token_usage",), """, steps AS (SELECT user_id, id AS seq, input_tokens AS total, input_tokens - coalesce(lag(input_tokens) OVER (PARTITION BY user_id ORDER BY id), 0) AS step FROM token_usage)
SELECT user_id, seq, total, CASE WHEN step < 0 THEN total ELSE step END AS delta FROM steps WHERE CASE WHEN step < 0 THEN total ELSE step END > 0"""),
    Report("win_first_token_credit", lambda t: merge.first_credit(t("token_usage").select("session_id", "project_id", F.concat(F.lit("m"), F.floor(F.col("id") / 40)).alias("api_message_id"), F.col("id").alias("seq"), F.col("input_tokens").alias("tokens"))), ("token_usage",), """, blocks AS (SELECT session_id, project_id, concat('m', CAST(floor(id / 40) AS BIGINT)) AS api_message_id, id AS seq, input_tokens AS tokens FROM token_usage)
SELECT session_id, project_id, api_message_id, seq, CASE WHEN row_number() OVER (PARTITION BY session_id, project_id, api_message_id ORDER BY CASE WHEN tokens > 0 THEN 0 ELSE 1 END, seq) = 1 THEN tokens ELSE 0 END AS tokens FROM blocks"""),
    Report("win_context_fill", lambda t: merge.filled_forward(t("token_usage").select("user_id", F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, F.col("model")).alias("model")), ["user_id"], ["model"]), ("token_usage",), "SELECT user_id, id AS line_no, last_value(CASE WHEN id % 3 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS model FROM token_usage"),
    # the day view
    Report("win_gap_sessionise", lambda t: intervals.islands(t("activity"), ["day", "session_id"]), ("activity",), _ISLANDS + "SELECT * FROM islands"),
    Report("win_next_assistant", lambda t: intervals.reply_intervals(t("activity"), ["day", "session_id"]), ("activity",), _REPLIES + "SELECT * FROM replies"),
    Report("win_interval_union", lambda t: intervals.union(intervals.islands(t("activity"), ["day", "session_id"], 3_600_000_000), ["day"]), ("activity",), _ISLANDS.replace(str(intervals.GAP_US), "3600000000") + _union_sql("islands", "day", "merged") + "SELECT * FROM merged"),
    Report("win_concurrency_sweep", lambda t: intervals.concurrency(intervals.gantt(t("activity")), ["day"]), ("activity",), _SPANS + _CURVE + "SELECT day, us, delta, CAST(change AS BIGINT) AS change, open FROM curve"),
    Report("day_gantt_rows", lambda t: intervals.gantt(t("activity")), ("activity",), _GANTT + "SELECT * FROM gantt"),
    Report("day_projects", lambda t: intervals.day_projects(t("activity")), ("activity",), _GANTT + """, by_project AS (SELECT day, project_id, count(*) AS session_count, round(sum(duration_min), 2) AS total_min FROM gantt GROUP BY 1, 2)
SELECT *, CAST((row_number() OVER (PARTITION BY day ORDER BY total_min DESC, project_id) - 1) % 8 AS INT) AS colour FROM by_project"""),
    Report("rep_day_bundle", lambda t: intervals.day_report(t("activity")), ("activity",), _ISLANDS + _REPLIES + _SPANS + _CURVE + _union_sql("islands", "day", "active") + _union_sql("replies", "day", "answering") + """
SELECT day, sessions, questions, events, active_seconds, coalesce(assistant_seconds, 0) AS assistant_seconds, peak, peak_us
FROM (SELECT day, count(DISTINCT session_id) AS sessions, count(*) FILTER (type = 'user') AS questions, count(*) AS events FROM activity GROUP BY 1)
LEFT JOIN (SELECT day, round(sum(end_us - start_us) / 1e6, 2) AS active_seconds FROM active GROUP BY 1) USING (day)
LEFT JOIN (SELECT day, round(sum(end_us - start_us) / 1e6, 2) AS assistant_seconds FROM answering GROUP BY 1) USING (day) LEFT JOIN peaks USING (day)"""),
    # trees
    Report("join_anti_notexists", lambda t: graph.top_level(t("tree")).select("session_id", "project_id"), ("tree",), _TOPS + "SELECT session_id, project_id FROM tops"),
    Report("grf_rollup", lambda t: graph.rolled_up(t("tree"), "total_tokens"), ("tree",), _TOPS + _DOWN + """SELECT m.session_id, m.project_id, count(t.session_id) AS derived_count, CAST(m.total_tokens + coalesce(sum(t.total_tokens), 0) AS BIGINT) AS total_tokens_rolled
FROM tops m LEFT JOIN (SELECT d.master, t.* FROM down d JOIN tree t ON t.session_id = d.session_id AND t.project_id = d.project_id WHERE d.master <> d.session_id) t ON t.master = m.session_id GROUP BY m.session_id, m.project_id, m.total_tokens"""),
    # search
    Report("sch_fts", lambda t: search.search(t("messages"), _PHRASE).select("session_id", "seq"), ("messages",), _FTS + "SELECT session_id, seq FROM words WHERE list_contains(w, 'a') OR list_contains(w, 'de')"),
    Report("sch_like", lambda t: search.sessions_like(t("messages"), _NEEDLE), ("messages",), f"SELECT session_id, project_id, substr(first(content ORDER BY seq), 1, 200) AS snippet, count(*) AS hits FROM messages WHERE content ILIKE '%{_NEEDLE}%' GROUP BY 1, 2"),
    Report("sch_knn", lambda t: search.nearest(t("embeddings"), _VECTOR, 10).select("vec_id", F.round("score", 6).alias("score")), (), f"""WITH q AS (SELECT CAST({_VECTOR} AS DOUBLE[]) AS q), s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q, q)) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10"""),
    Report("snk_vector_upsert", lambda t: t("messages").select("session_id").distinct().select("session_id", search.point_id(F.col("session_id")).alias("point")), ("messages",), "SELECT DISTINCT session_id, CAST(('0x' || substr(md5(session_id), 1, 15)) AS BIGINT) AS point FROM messages"),
    # evaluation
    Report("evl_confusion", lambda t: evaluation.confusion(_pairs(t)), ("metadata",), _PAIRS + "SELECT gold, pred, count(*) AS n FROM pairs GROUP BY 1, 2"),
    Report("evl_per_class", lambda t: evaluation.per_class(_pairs(t)), ("metadata",), _PAIRS + _PER_CLASS + "SELECT * FROM per_class"),
    Report("evl_summary", lambda t: evaluation.summary(_pairs(t)), ("metadata",), _PAIRS + _PER_CLASS + "SELECT (SELECT round(avg(f1), 4) FROM per_class WHERE support > 0) AS macro_f1, round(avg(CASE WHEN gold = pred THEN 1e0 ELSE 0 END), 4) AS accuracy, count(*) AS n FROM pairs"),
    Report("evl_directions", lambda t: evaluation.directions(_pairs(t), {s: i for i, s in enumerate(text.SENSITIVITY)}), ("metadata",), _PAIRS + f""", ranks AS (SELECT list_position({list(text.SENSITIVITY)}, pred) - list_position({list(text.SENSITIVITY)}, gold) AS gap FROM pairs)
SELECT count(*) FILTER (gap < 0) AS under, count(*) FILTER (gap > 0) AS over, count(*) FILTER (gap = 0) AS correct, count(*) FILTER (gap <= -2) AS severe FROM ranks"""),
    # merges
    Report("snk_table_insert", lambda t: merge.keep_first(_old(t), _new(t), ["c_custkey"], "c_name"), (), _MERGE + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)"),
    Report("snk_replace", lambda t: merge.keep_last(_old(t), _new(t), ["c_custkey"], F.desc("c_name")), (), _MERGE + "SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)"),
    Report("snk_upsert", lambda t: merge.upsert(_old(t), _new(t), ["c_custkey"], preserve=("c_name",)), (), _MERGE + "SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey"),
    Report("snk_delete_scope", lambda t: merge.delete_scope(_old(t), _new(t), ["c_custkey"]), (), _MERGE + "SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)"),
    # scalar functions that SQL cannot express are tested case by case
    Report("fn_cmd_name", lambda t: t("tool_calls").select(commands.cmd_name("command").alias("cmd")).groupBy("cmd").agg(F.count("*").alias("count"))),
    Report("fn_sensitivity_floor", lambda t: t("metadata").select("session_id", text.sensitivity_floor(F.col("text"), F.col("classification"), F.array(F.col("client")), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("floor"))),
    Report("fn_smart_title", lambda t: t("messages").select("session_id", "seq", text.smart_title(F.col("content")).alias("title"))),
)

QUERIES = {r.name: r.query for r in REPORTS}
ORACLE_SQL = {r.name: sql for r in REPORTS if (sql := r.oracle())}
