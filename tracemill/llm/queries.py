"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language, mixing, mixlm, quality, repair, simhash, tokens, topk, trie, urls
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs, ~language.held_out(F.col("doc_id"))))


_PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    probe = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{_PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.format_digest(chat.from_turns(turns.select("conv_id", "turn", "role", "text").union(probe)))


def _op2_sql() -> str:
    rest = "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in s[1:]) for s in chat.CONTROLS)
    pattern, rewrite = rf"([<\[])(\\*)({rest})", r"\1\\\2\3"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} + length(role) + length(regexp_replace(text, '{pattern}', '{rewrite}', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


_OP3_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.HOST_RULES + urls.PATTERN_RULES))


def _op4_sql() -> str:
    """All rules against every url; the longest host rule, else any pattern rule."""
    cases, names = [], []
    for r in sorted(urls.HOST_RULES, key=lambda r: -r.rank):
        host, path = r.name[: r.name.index("/")], r.name[r.name.index("/") :]
        fits = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
        cases.append(f"WHEN {fits} THEN '{r.verdict}'")
        names.append(f"WHEN {fits} THEN '{r.name}'")
    patterns = " OR ".join(f"regexp_matches(subject, '{r.pattern}', 's')" for r in urls.PATTERN_RULES)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
lowered AS (SELECT *, lower(replace(host, chr(10), chr(1)) || chr(10) || path) AS subject FROM parts)
SELECT page_id, host, path, CASE {" ".join(names)} ELSE NULL END AS rule,
  CASE {" ".join(cases)} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict FROM lowered"""


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.graded_labels(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.grade(docs, model, n_grades=3)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).drop("shards")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {byte}), 4294967295)"


#: Prefixes spelt out as digests of their turns; a subtree is all prefixes that begin with its top's.
_OP11_SQL = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
both_ AS (SELECT c.conv_id, 0 AS own, o.n, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.n <= c.h UNION ALL SELECT c.conv_id, 1, o.n, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, n) AS depth, sha256(role || chr(10) || sha256(text)) AS label, strlen(text) AS bytes FROM both_),
paths AS (SELECT conv_id, depth, string_agg(label, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, bytes FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
sizes AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY 1),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth) AS ends FROM paths JOIN sizes USING (conv_id) GROUP BY 1, 2),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND starts_with(n.path, p.path)),
sums AS (SELECT t.path, t.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens FROM linked t JOIN linked b ON b.depth >= t.depth AND starts_with(b.path, t.path) GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM linked JOIN sums USING (path, depth)"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    """The same grammar walked over whole conversations, with the repaired text carried along."""
    moves = ", ".join(f"('{s}', '{i}', '{letters}', '{n}', {c}, {k})" for s, i, letters, n, c, k in repair.moves())
    white = "".join(f"chr({ord(c)})" if i == 0 else f" || chr({ord(c)})" for i, c in enumerate(repair.SPACE))
    user = "CASE WHEN {0} IN ('0', 'S', 'A') THEN 'user' ELSE 'assistant' END"
    inserted = "CASE length(m.letters) WHEN 1 THEN '' WHEN 2 THEN x.made || ':' || chr(10) ELSE x.made || ':' || chr(10) || x.other || ':' || chr(10) END"
    last = "CASE WHEN length(m.letters) = 2 THEN x.other ELSE x.made END"
    return f"""
WITH RECURSIVE base AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
kinds AS (SELECT *, {_crc32_sql("concat(c, ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM base),
hurt AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, (VALUES (0), (1)) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial, rtrim(text, {white}) AS trimmed FROM hurt),
faulty AS (SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY c ORDER BY n) AS before FROM numbered),
moves(state, initial, letters, next, cost, keeps) AS (VALUES {moves}),
step AS (
  SELECT c, '0' AS state, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS repaired FROM (SELECT DISTINCT c FROM faulty)
  UNION ALL
  SELECT c, state, n, best.cost, best.audit, best.repaired FROM (
    SELECT p.c, m.next AS state, t.n, min(struct_pack(cost := p.cost + m.cost + CASE WHEN m.keeps AND t.fault = 3 THEN 5 ELSE 0 END, audit := p.audit || m.letters,
      repaired := p.repaired || {inserted} || CASE WHEN NOT m.keeps THEN '' WHEN right(m.letters, 1) = 'K' THEN t.role || ':' || t.text || chr(10) ELSE {last} || ':' || t.text || chr(10) END)) AS best
    FROM (SELECT *, {user.format("state")} AS made, CASE WHEN state = 'U' THEN 'user' ELSE 'assistant' END AS other FROM step) p JOIN faulty t ON t.c = p.c AND t.n = p.n + 1
      JOIN moves m ON m.state = p.state AND m.initial = CASE WHEN t.initial IN ('s', 'u', 'a') THEN t.initial ELSE '' END, LATERAL (SELECT p.made, p.other) x
    WHERE NOT (m.keeps AND t.fault IN (1, 2)) GROUP BY p.c, m.next, t.n)),
ended AS (SELECT c, min(struct_pack(cost := cost + CASE state WHEN 'U' THEN 5 WHEN 'S' THEN 10 ELSE 0 END, audit := audit || CASE state WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END,
  repaired := repaired || CASE state WHEN 'U' THEN 'assistant:' || chr(10) WHEN 'S' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END)) AS best
  FROM step JOIN (SELECT c, max(n) AS size FROM faulty GROUP BY 1) USING (c) WHERE n = size GROUP BY 1),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(CASE WHEN best.repaired = '' THEN '' ELSE left(best.repaired, length(best.repaired) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM base) o LEFT JOIN counts USING (c) LEFT JOIN ended USING (c)"""


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_exact_topk, op4_url_filters, op5_token_output, op6_lm_scoring, op7_benchmark_decontamination, op8_quality_classifier, op9_simhash_near_dedup, op10_source_mixing, op11_conversation_trie, op12_byte_bpe, op13_structure_repair)}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": _op2_sql(), "op3_exact_topk": _OP3_SQL, "op4_url_filters": _op4_sql(), "op11_conversation_trie": _OP11_SQL, "op13_structure_repair": _op13_sql()}
