"""Registered queries of single operators that reports are made of, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import outcomes, text
from tracemill.operators import evaluation, graph, intervals, merge, pricing, reports, search
from tracemill.operators.filters import Filters, apply_filters, ids_of

from .catalogue import _CLASS, _CURVE, _DAY, _DOWN, _GANTT, _HIT, _HOUR, _ISLANDS, _MERGE, _NEVER, _NEVER_LIST, _OUTCOME, _PRICED, _REPLIES, _SPANS, _TOPS, CALLS, USAGE, Report, Tables, _new, _of, _old, _union_sql

_KEYS = ["session_id", "project_id"]


def _calls(t: Tables) -> DataFrame:
    return t("tool_calls")


def _changed_prices(t: Tables) -> DataFrame:
    """New prices of two models, one of which would overlap."""
    open_ = t("pricing").filter("to_date is null and model in ('view', 'purchase')").drop("to_date")
    return pricing.upsert(t("pricing"), open_.select("model", *[(F.col(p) + 1).alias(p) for _, p in pricing.KINDS], F.when(F.col("model") == "view", "2024-01-10").otherwise("2024-01-20").alias("from_date"), F.lit(None).cast("string").alias("to_date")))


_ACT = ("activity",)

REPORTS: tuple[Report, ...] = (
    # filters
    Report("flt_and_clause", lambda t: apply_filters(_calls(t), Filters(user_id=7, host_id=1, start="2024-01-03")).select("id"), CALLS, "SELECT id FROM tool_calls WHERE user_id = 7 AND host_id = 1 AND ts_raw >= '2024-01-03'"),
    Report("flt_source_join", lambda t: apply_filters(_calls(t), Filters(source="web"), t("session_sources")).groupBy("family").count(), ("tool_calls", "session_sources"), """SELECT family, count(*) AS "count" FROM tool_calls JOIN session_sources USING (session_id, project_id) WHERE source = 'web' GROUP BY 1"""),
    Report("flt_name_to_id", lambda t: t("sessions").join(ids_of(t("people"), "user7").withColumnRenamed("id", "user_id"), "user_id", "left_semi").select("session_id"), ("sessions", "people"), "SELECT session_id FROM sessions WHERE user_id = (SELECT id FROM people WHERE name = 'user7')"),
    Report("flt_nonempty", lambda t: _calls(t).filter(F.coalesce("target_file", F.lit("")) != "").groupBy("target_file").count(), CALLS, """SELECT target_file, count(*) AS "count" FROM tool_calls WHERE target_file <> '' GROUP BY 1"""),
    Report("flt_incremental", lambda t: t("sessions").join(t("sessions").groupBy("project_id").agg(F.min("ts_raw").alias("mark")), "project_id").filter("ts_raw > mark").select("session_id"), ("sessions",), "SELECT session_id FROM sessions JOIN (SELECT project_id, min(ts_raw) AS mark FROM sessions GROUP BY 1) USING (project_id) WHERE ts_raw > mark"),
    Report("prj_coalesce_nullif", lambda t: _calls(t).select("id", text.first_or_unknown(F.col("spawn_tool")).alias("spawn_tool")), CALLS, "SELECT id, coalesce(nullif(spawn_tool, ''), '(unknown)') AS spawn_tool FROM tool_calls"),
    Report("prj_truncate", lambda t: t("messages").select("session_id", "seq", F.substring("content", 1, 40).alias("head")), ("messages",), "SELECT session_id, seq, substr(content, 1, 40) AS head FROM messages"),
    # joins
    Report("join_left_equi", lambda t: t("sessions").join(t("session_sources"), _KEYS, "left").select("session_id", F.coalesce("source", F.lit("unknown")).alias("source")), ("sessions", "session_sources"), "SELECT session_id, coalesce(source, 'unknown') AS source FROM sessions LEFT JOIN session_sources USING (session_id, project_id)"),
    Report("join_inner", lambda t: _calls(t).join(t("workplaces").select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").groupBy("project").count(), ("tool_calls", "token_usage", "workplaces"), 'SELECT p.name AS project, count(*) AS "count" FROM tool_calls c JOIN workplaces p ON p.id = c.project_id GROUP BY 1'),
    Report("join_semi_exists", lambda t: t("sessions").join(_of(t, "bash"), _KEYS, "left_semi").select("session_id"), ("sessions", "tool_calls"), "SELECT session_id FROM sessions s WHERE EXISTS (SELECT 1 FROM tool_calls c WHERE c.session_id = s.session_id AND c.project_id = s.project_id AND family = 'bash')"),
    Report("join_correlated_scalar", lambda t: t("sessions").join(_calls(t).groupBy(*_KEYS).agg(F.count("*").alias("calls")), _KEYS, "left").select("session_id", F.coalesce("calls", F.lit(0)).alias("calls")), ("sessions", "tool_calls"), "SELECT session_id, (SELECT count(*) FROM tool_calls c WHERE c.session_id = s.session_id AND c.project_id = s.project_id) AS calls FROM sessions s"),
    Report("join_correlated_top1", lambda t: _calls(t).groupBy("session_id").agg(F.max_by("name", F.struct("ts_raw", "id")).alias("last_call")), CALLS, "SELECT DISTINCT session_id, (SELECT name FROM tool_calls c WHERE c.session_id = t.session_id ORDER BY ts_raw DESC, id DESC LIMIT 1) AS last_call FROM tool_calls t"),
    Report("join_knn", lambda t: search.nearest(t("embeddings"), [1.0] * 64, 5, label=[1, 2]).select("vec_id", F.round("score", 6).alias("score")), (), "WITH s AS (SELECT vec_id, list_sum(CAST(embedding AS DOUBLE[])) / (8 * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS score FROM embeddings WHERE label IN (1, 2)) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 5"),
    # aggregates
    Report("agg_outcome", lambda t: _calls(t).groupBy("user_id").agg(*outcomes.outcome_aggregates()), CALLS, f"SELECT user_id, {_OUTCOME} FROM tool_calls GROUP BY 1"),
    Report("agg_never_executed", lambda t: _calls(t).groupBy("user_id").agg(*outcomes.never_executed_aggregates()), CALLS, f"SELECT user_id, {_NEVER} FROM tool_calls GROUP BY 1"),
    Report("agg_real_rate", lambda t: _calls(t).groupBy("name").agg(*outcomes.outcome_aggregates(), *outcomes.never_executed_aggregates()).select("name", outcomes.real_error_rate().alias("rate")), CALLS, f"SELECT name, CASE WHEN count(is_error) > count(*) FILTER (is_error = 1 AND {_CLASS} IN ({_NEVER_LIST})) THEN round(count(*) FILTER (is_error = 1 AND {_CLASS} NOT IN ({_NEVER_LIST})) / (count(is_error) - count(*) FILTER (is_error = 1 AND {_CLASS} IN ({_NEVER_LIST}))), 4) END AS rate FROM tool_calls GROUP BY 1"),
    Report("agg_cost", lambda t: pricing.priced(t("token_usage"), t("pricing")).groupBy("user_id").agg(F.round(F.sum("cost"), 4).alias("cost")), USAGE, _PRICED + "SELECT user_id, round(sum(cost), 4) AS cost FROM priced GROUP BY 1"),
    Report("agg_cache_hit", lambda t: t("token_usage").groupBy("user_id").agg(reports.cache_hit_rate().alias("cache_hit_rate")), ("token_usage",), f"SELECT user_id, {_HIT} FROM token_usage GROUP BY 1"),
    Report("agg_bare_max", lambda t: reports.top_errors(_calls(t), "family", "name", n=12), CALLS, "SELECT family, name, count(*) AS errors, max(ts_raw) AS last_error_at, struct_extract(max(struct_pack(t := ts_raw, i := id, x := error_text)), 'x') AS last_error_text FROM tool_calls WHERE is_error = 1 GROUP BY 1, 2 ORDER BY errors DESC, last_error_at DESC, family, name LIMIT 12"),
    Report("agg_distinct_pair", lambda t: t("token_usage").groupBy("model").agg(F.count_distinct(*_KEYS).alias("sessions")), ("token_usage",), "SELECT model, count(DISTINCT (session_id, project_id)) AS sessions FROM token_usage GROUP BY 1"),
    Report("agg_group_concat", lambda t: t("session_sources").groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")), ("session_sources",), "SELECT project_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM session_sources GROUP BY 1"),
    Report("agg_mode", lambda t: reports.top_model(t("token_usage")), ("token_usage",), "SELECT user_id, model FROM token_usage GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, model) = 1"),
    Report("agg_rollup_tail", lambda t: reports.bash_by_type(_calls(t), 5).select("cmd_type", "count"), CALLS, """, n AS (SELECT cmd_name, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, cmd_name) AS place FROM tool_calls WHERE family = 'bash' GROUP BY 1) SELECT CASE WHEN place <= 5 THEN cmd_name ELSE 'other' END AS cmd_type, CAST(sum(c) AS BIGINT) AS "count" FROM n GROUP BY 1"""),
    Report("rep_bash_like_ladder", lambda t: t("documents").select(F.concat_ws(" ", F.element_at(F.array(*map(F.lit, (*reports.LADDER, "git", "lsx"))), (F.col("doc_id") % 20 + 1).cast("int")), F.when(F.col("doc_id") % 3 != 0, "x")).alias("c")).groupBy(reports.command_ladder(F.col("c")).alias("kind")).count(), (), f"""WITH c AS (SELECT {[*reports.LADDER, 'git', 'lsx']}[doc_id % 20 + 1] AS w, doc_id % 3 <> 0 AS more FROM documents) SELECT CASE WHEN w IN ('git', 'lsx') OR (NOT more AND w NOT IN ('ls', 'tree')) THEN 'other' ELSE w END AS kind, count(*) AS "count" FROM c GROUP BY 1"""),
    Report("rep_insights", lambda t: reports.insights(*[f(t("token_usage"), t("pricing")) for f in (reports.work_by_hour, reports.work_by_weekday, reports.work_by_complexity)], reports.cache_trend(t("token_usage")), reports.cost_per_call(t("token_usage"), t("pricing")), reports.source_comparison(t("token_usage"), t("pricing"), t("session_sources")))),
    Report("rep_user_detail", lambda t: reports.user_detail(t("sessions"), t("token_usage")), ("sessions",), f"""SELECT user_id, 'projects' AS section, project_id, NULL AS host_id, count(DISTINCT session_id) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS tokens, NULL AS model, NULL AS day, NULL AS hour, NULL AS calls FROM sessions GROUP BY user_id, project_id
  UNION ALL SELECT user_id, 'hosts', NULL, host_id, count(DISTINCT session_id), CAST(sum(total_tokens) AS BIGINT), NULL, NULL, NULL, NULL FROM sessions GROUP BY user_id, host_id
  UNION ALL SELECT user_id, 'models', NULL, NULL, NULL, CAST(sum(input_tokens + output_tokens) AS BIGINT), model, NULL, NULL, count(*) FROM token_usage GROUP BY user_id, model
  UNION ALL SELECT user_id, 'heatmap', NULL, NULL, NULL, NULL, NULL, CAST(dayofweek(CAST({_DAY} AS DATE)) AS INT), {_HOUR}, count(*) FROM token_usage GROUP BY user_id, CAST(dayofweek(CAST({_DAY} AS DATE)) AS INT), {_HOUR}"""),
    # windows
    Report("win_cumulative_cost", lambda t: reports.session_profile(t("token_usage"), t("pricing")).groupBy(*_KEYS).agg(F.max("cumulative_cost").alias("last")), USAGE, _PRICED + "SELECT session_id, project_id, round(round(sum(cost), 12) + 1e-13, 4) AS last FROM priced GROUP BY 1, 2"),
    Report("win_phase_thirds", lambda t: reports.session_profile(t("token_usage"), t("pricing")).groupBy("phase").count(), USAGE, """, n AS (SELECT session_id, project_id, count(*) AS n FROM token_usage GROUP BY 1, 2), p AS (SELECT n, greatest(n // 3, 1) AS third FROM n)
SELECT phase, CAST(sum(c) AS BIGINT) AS "count" FROM (SELECT 'early' AS phase, least(n, third) AS c FROM p UNION ALL SELECT 'mid', greatest(least(n, 2 * third) - third, 0) FROM p UNION ALL SELECT 'late', greatest(n - 2 * third, 0) FROM p) WHERE c > 0 GROUP BY 1"""),
    Report("win_dedup_keep_first", lambda t: merge.keep_first(_calls(t).limit(0).select("name", "ts_raw", "id"), _calls(t).select("name", "ts_raw", "id"), ["name"], "ts_raw", "id"), CALLS, "SELECT name, ts_raw, id FROM tool_calls QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts_raw, id) = 1"),
    Report("win_dedup_keep_last", lambda t: merge.keep_last(_calls(t).limit(0).select("name", "ts_raw", "id"), _calls(t).select("name", "ts_raw", "id"), ["name"], F.desc("ts_raw"), F.desc("id")), CALLS, "SELECT name, ts_raw, id FROM tool_calls QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts_raw DESC, id DESC) = 1"),
    Report("win_rank_top_n", lambda t: graph.ranked(t("token_usage").select("model", "id", "output_tokens"), 3, ["model"], F.desc("output_tokens"), "id"), ("token_usage",), "SELECT model, id, output_tokens, CAST(row_number() OVER (PARTITION BY model ORDER BY output_tokens DESC, id) AS INT) AS place FROM token_usage QUALIFY place <= 3"),
    Report("win_halves", lambda t: reports.cache_trend(t("token_usage")).withColumn("half", F.ntile(2).over(Window.orderBy("date"))).groupBy("half").agg(F.round(F.avg("cache_hit_rate"), 3).alias("rate")), ("token_usage",), f", days AS (SELECT {_DAY} AS date, {_HIT} FROM token_usage GROUP BY 1), h AS (SELECT *, ntile(2) OVER (ORDER BY date) AS half FROM days) SELECT CAST(half AS INT) AS half, round(avg(cache_hit_rate), 3) AS rate FROM h GROUP BY 1"),
    # the day view
    Report("day_sessions", lambda t: intervals.gantt(t("activity")).groupBy("day").agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions")), _ACT, _GANTT + "SELECT day, count(*) AS rows, count(DISTINCT session_id) AS sessions FROM gantt GROUP BY 1"),
    Report("day_active_wallclock", lambda t: intervals.seconds(intervals.islands(t("activity"), ["day", "session_id"]), ["day"], "active_seconds"), _ACT, _ISLANDS + _union_sql("islands", "day", "active") + "SELECT day, round(sum(end_us - start_us) / 1e6, 2) AS active_seconds FROM active GROUP BY 1"),
    Report("day_assistant_wallclock", lambda t: intervals.seconds(intervals.reply_intervals(t("activity"), ["day", "session_id"]), ["day"], "assistant_seconds"), _ACT, _REPLIES + _union_sql("replies", "day", "answering") + "SELECT day, round(sum(end_us - start_us) / 1e6, 2) AS assistant_seconds FROM answering GROUP BY 1"),
    Report("day_concurrency", lambda t: intervals.peak(intervals.gantt(t("activity")), ["day"]), _ACT, _SPANS + _CURVE + "SELECT day, peak, peak_us FROM peaks"),
    Report("day_meta", lambda t: intervals.day_report(t("activity")).select("day", "sessions", "questions", "events"), _ACT, "SELECT day, count(DISTINCT session_id) AS sessions, count(*) FILTER (type = 'user') AS questions, count(*) AS events FROM activity GROUP BY 1"),
    Report("fn_date_hour_dow", lambda t: t("token_usage").groupBy(reports.day(), reports.hour(), (F.dayofweek(F.to_date(F.substring("ts_raw", 1, 10))) - 1).alias("dow")).count(), ("token_usage",), f'SELECT {_DAY} AS date, {_HOUR} AS hour, CAST(dayofweek(CAST({_DAY} AS DATE)) AS INT) AS dow, count(*) AS "count" FROM token_usage GROUP BY ALL'),
    # order, limits, sets, trees
    Report("srt_multi", lambda t: reports.top(reports.counted(_calls(t), "family", "name"), 10, F.desc("count"), "family", "name"), CALLS, 'SELECT family, name, count(*) AS "count" FROM tool_calls GROUP BY 1, 2 ORDER BY "count" DESC, family, name LIMIT 10'),
    Report("srt_fixed_family", lambda t: reports.tools_overview(_calls(t)).withColumn("place", F.array_position(F.array(*map(F.lit, reports.FAMILIES)), F.col("family"))).select("family", "place", "count"), CALLS, f'SELECT family, list_position({list(reports.FAMILIES)}, family) AS place, count(*) AS "count" FROM tool_calls GROUP BY 1'),
    Report("lim_topk", lambda t: reports.top(t("token_usage").select("id", "output_tokens"), 7, F.desc("output_tokens"), "id"), ("token_usage",), "SELECT id, output_tokens FROM token_usage ORDER BY output_tokens DESC, id LIMIT 7"),
    Report("set_intersection", lambda t: t("session_meta").select("session_id", F.array_sort(F.array_intersect("topics", F.array(*map(F.lit, ("a", "c", "g7"))))).alias("both")), ("session_meta",), "SELECT session_id, list_sort(list_intersect(topics, ['a', 'c', 'g7'])) AS both FROM session_meta"),
    Report("set_visited_guard", lambda t: graph.descendants(t("tree"), graph.top_level(t("tree"))).groupBy("master").count(), ("tree",), _TOPS + _DOWN + 'SELECT master, count(*) AS "count" FROM down WHERE master <> session_id GROUP BY 1'),
    # prices and evaluation
    Report("prc_guard", lambda t: pricing.conflicts(t("pricing"), t("pricing").filter("to_date is null").select("model", F.lit("2024-01-10").alias("from_date"), F.lit("2024-01-12").alias("to_date"))), ("pricing",), "SELECT DISTINCT p.model, '2024-01-10' AS from_date FROM pricing p WHERE p.model IN (SELECT model FROM pricing WHERE to_date IS NULL) AND from_date <> '2024-01-10' AND NOT (to_date IS NULL AND from_date < '2024-01-10') AND from_date < '2024-01-12' AND (to_date IS NULL OR to_date > '2024-01-10')"),
    Report("prc_upsert", _changed_prices, ("pricing",), "SELECT model, input_price, output_price, cache_write_price, cache_read_price, from_date, CASE WHEN model = 'purchase' THEN '2024-01-20' ELSE to_date END AS to_date FROM pricing UNION ALL SELECT model, input_price + 1, output_price + 1, cache_write_price + 1, cache_read_price + 1, '2024-01-20', NULL FROM pricing WHERE model = 'purchase'"),
    Report("prc_list", lambda t: pricing.listed(t("pricing"), "view").select("model", "from_date", "to_date"), ("pricing",), "SELECT model, from_date, to_date FROM pricing WHERE model = 'view'"),
    Report("evl_gold_rule", lambda t: t("metadata").select("session_id", evaluation.gold_label(F.when(F.col("project_id") % 2 == 0, F.concat(F.lit(" "), "client")).otherwise(" "), F.col("data_sensitivity")).alias("gold")), ("metadata",), "SELECT session_id, CASE WHEN project_id % 2 = 0 THEN client ELSE data_sensitivity END AS gold FROM metadata"),
    Report("evl_floor", lambda t: t("metadata").select("session_id", text.at_least(F.col("data_sensitivity"), (F.col("project_id") % 4).cast("int")).alias("level")), ("metadata",), f"SELECT session_id, {list(text.SENSITIVITY)}[greatest(list_position({list(text.SENSITIVITY)}, data_sensitivity), project_id % 4 + 1)] AS level FROM metadata"),
    # merges
    Report("snk_guarded_insert", lambda t: _old(t).unionByName(_new(t).join(_old(t).select("c_custkey"), "c_custkey", "left_anti")), (), _MERGE + "SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.c_custkey = n.c_custkey)"),
    Report("fn_kb_point_id", lambda t: t("sessions").select("session_id", search.point_id(F.col("session_id")).alias("point")), ("sessions",), "SELECT session_id, CAST(('0x' || substr(md5(session_id), 1, 15)) AS BIGINT) AS point FROM sessions"),
    Report("rpl_pull_cursor", lambda t: merge.advance(t("sessions").groupBy("project_id").agg(F.min("ts_raw").alias("value")), t("token_usage").groupBy("project_id").agg(F.max("ts_raw").alias("value")), ["project_id"], force=True), ("sessions", "token_usage"), "SELECT project_id, max(ts_raw) AS value FROM token_usage GROUP BY 1"),
    Report("rpl_state_read", lambda t: t("sessions").groupBy("host_id", "project_id").agg(F.max("ts_raw").alias("value")).filter("host_id = 1").select("project_id", "value"), ("sessions",), "SELECT project_id, max(ts_raw) AS value FROM sessions WHERE host_id = 1 GROUP BY 1"),
)

QUERIES = {r.name: r.query for r in REPORTS}
ORACLE_SQL = {r.name: sql for r in REPORTS if (sql := r.oracle())}
