"""URL filters: pattern rules indexed by their rarest literal token. DataFrame and SQL functions only.

A rule is a regular expression and the literal tokens that every URL it fits must hold. Each rule is indexed by the one of
its tokens that is rarest among the URLs at hand (counted over all of them). The tokens of a URL fetch the candidate rules
from this index by a join, and only those run their expression. Host rules (`example.org/en/`) are rules like any others.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits_broadcast, small_side

ALLOW, BLOCK = "allow", "block"
#: Rules up to which their index is broadcast; beyond, the join is a shuffle.
SMALL_RULES = 100_000
SALTS = 32
HOST_BREAK = "\x01"
TOKEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Rule:
    """`rank` decides between fitting rules, the highest first; `name` is reported for host rules only. `cased`: whether the
    expression sees the path as it is written; else host and path are lower-cased."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    name: str | None = None
    cased: bool = False


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.lower()) if t]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits URLs of `host` and all its subdomains whose path starts with `path`; the longest such rule wins over all
    pattern rules. Its tokens are those of the host, and those of the path that end within it."""
    host = host.lower()
    whole = _tokens(host) + [t for t in _tokens(path[: max((i + 1 for i, c in enumerate(path) if not c.isalnum()), default=0)])]
    if not whole:
        raise ValueError("a host rule needs a host")
    # the expression sees `host` (whose own line breaks are HOST_BREAK) + newline + `path`
    return Rule(f"^(?:[^\\n]*\\.)?{_quoted(host)}\\n{_quoted(path)}", tuple(dict.fromkeys(whole)), verdict, 1000 + len(host) + len(path), host + path, True)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def pattern_rule(pattern: str, tokens: tuple[str, ...], verdict: str = BLOCK, rank: int = 1) -> Rule:
    """`pattern` is searched for in the lower-cased `host` + newline + `path`; every fit must hold all `tokens` whole."""
    if not tokens:
        raise ValueError("a pattern rule needs a literal token")
    return Rule(pattern, tokens, verdict, rank)


_SEPARATOR = r"(?:[^a-z0-9_.%\-]|$)"


def filter_rule(line: str) -> Rule | None:
    """A rule of the plain syntax of public filter lists: literal text, `*` for anything, `^` for a separator or the end,
    `||` before a host and its subdomains, `|` for the end, `@@` for exceptions, which outrank all blocking filters.
    Comments, element rules and filters with options give None; so do those without a whole literal token."""
    line = line.strip().lower()
    if not line or line[0] in "![" or "##" in line or "#@#" in line or "$" in line:
        return None
    verdict, rank = (ALLOW, 2) if line.startswith("@@") else (BLOCK, 1)
    body = line[2:] if verdict == ALLOW else line
    at_host, body = body.startswith("||"), body[2:] if body.startswith("||") else body
    at_end, body = body.endswith("|"), body[:-1] if body.endswith("|") else body
    if "|" in body or not body.strip("*"):
        return None
    pieces, in_host = [], at_host
    for c in body:
        if c == "/" and in_host:
            pieces.append(r"\n/")
        else:
            pieces.append(".*" if c == "*" else _SEPARATOR if c == "^" else _quoted(c))
        in_host = in_host and c not in "/*^"
    pattern = "(?s)" + (r"^(?:[^\n]*\.)?" if at_host else "") + "".join(pieces) + ("$" if at_end else "")
    # runs that a wildcard or an open end cannot lengthen are whole tokens of every fit
    shown = ("" if at_host else "*") + body + ("" if at_end else "*")
    whole = [m[0] for m in re.finditer(r"(?<![a-z0-9*\x80-\U0010ffff])[a-z0-9\x80-\U0010ffff]+(?![a-z0-9*\x80-\U0010ffff])", shown)]
    return Rule(pattern, tuple(dict.fromkeys(whole)), verdict, rank) if whole else None


HOST_RULES = (
    host_rule("org", "/", ALLOW),
    host_rule("example.org", "/es/", BLOCK),
    host_rule("example.org", "/en/1", BLOCK),
    host_rule("com", "/fr/", ALLOW),
    host_rule("com", "/de/", BLOCK),
)

#: What pages of no use to a corpus are called: the second part is the other tokens that must be near.
_BLOCKED_LABELS = ("spam", "pills", "casino", "casinos", "porn", "xxx", "viagra", "poker", "betting", "malware", "warez", "doubleclick", "adserver", "adservice")
_BLOCKED_PATHS = ("login", "signin", "signup", "logout", "cart", "checkout", "captcha", "unsubscribe", "trackback", "wp-login", "wp-admin", "xmlrpc", "cgi-bin")

PATTERN_RULES = (
    *(pattern_rule(rf"^(?:[^\n]*[.-])?{w}(?:[.-][^\n]*)?\n", (w,)) for w in _BLOCKED_LABELS),
    *(pattern_rule(rf"\n(?:.*/)?{_quoted(w)}(?:[/.].*)?$", tuple(_tokens(w))) for w in _BLOCKED_PATHS),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the
    end. Both are empty without `://` and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each rule, from a literal: no worker takes part."""
    rows = [{"rule_id": i, "pattern": r.pattern, "tokens": r.tokens, "rule_verdict": r.verdict, "rank": r.rank, "name": r.name, "cased": r.cased} for i, r in enumerate(rules)]
    schema = "array<struct<rule_id:long,pattern:string,tokens:array<string>,rule_verdict:string,rank:int,name:string,cased:boolean>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("rule")).select("rule.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of `pages` (page_id, url): the fitting rule of the highest rank
    decides (of equal rank, the first given); `rule` is its name. Where none fits, the verdict is `default`, as for null
    urls and those without `://`. Repeated rows give repeated rows, an empty table none; other columns are ignored."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    # each distinct host and path is judged once
    urls = parts.select("host", "path").distinct()
    # the first line break divides host and path; those of a host show as another control character
    subject = F.concat_ws("\n", F.translate("host", "\n", HOST_BREAK), "path")
    # a host without a path can fit pattern rules for hosts as well; tokens are whole runs of letters and digits
    tokens = F.array_distinct(F.filter(F.split(F.lower(subject), TOKEN), lambda t: t != ""))
    words = urls.withColumns({"subject": subject, "token": F.explode(tokens)})
    wanted = small_side(rules.select(F.explode("tokens").alias("token")).distinct(), SMALL_RULES * 4)
    counts = words.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # the rarest token of each rule; one that no URL holds makes the rule's index entry unreachable, as it should
    listed = rules.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = listed.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("key")).select("rule_id", F.col("key.token").alias("token"))
    index = rules.drop("tokens").join(rarest, "rule_id")
    if fits_broadcast(index, SMALL_RULES):
        candidates = words.join(F.broadcast(index), "token")
    else:
        # a token that most urls hold may index rules too: both sides meet in SALTS parts
        spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = words.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(spread, ["token", "salt"])
    fits = candidates.filter(F.expr("rlike(if(cased, subject, lower(subject)), pattern)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", (-F.col("rule_id")).alias("first"), "name", "rule_verdict")).alias("best"))
    judged = parts.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
