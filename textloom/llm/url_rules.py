"""URL filter: pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, UPPER

#: Rules live in one constant that every task holds, so their number is bounded.
MAX_RULES = 50_000
#: Buckets of the index; a token is looked up by its hash.
BUCKETS = 1024
RESULT = ("host", "path", "rule", "verdict")

#: Fixed values: (action, rule) of the site list. A rule is a host suffix and a path prefix.
SITE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: What the method itself blocks when no site rule fits. ``^`` is a separator or the end, ``*`` any run, ``|`` at the
#: start the address's start.
PATTERN_RULES = (
    "*/login^", "*/signin^", "*/signup^", "*/cart^", "*/checkout^", "*/wp-admin^", "*/cgi-bin/", "*^casino^", "*^poker^", "*^bets^",
    "*^porn^", "*^xxx^", "*^adult^", "*^viagra^", "*^torrent^", "*^warez^", "*^exe^", "*^apk^",
)


def site_regex(rule: str) -> str:
    """Runs on host and path put together; a host has no slash."""
    return rf"^(?:[^/]*\.)?{re.escape(rule)}"


def pattern_regex(pattern: str) -> str:
    start, body = pattern.startswith("|"), pattern.lstrip("|")
    parts = {"*": ".*", "^": r"(?:[^a-z0-9]|$)"}
    return ("^" if start else "") + "".join(parts.get(c) or re.escape(c) for c in body).removeprefix(".*")


def safe_tokens(pattern: str) -> list[str]:
    """Literal tokens that any address that matches has as whole tokens: bounded by separators on both sides."""
    framed = pattern.lower()
    return [m[2] for m in re.finditer(r"(^|[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", framed) if m[1]]


def site_tokens(rule: str) -> list[str]:
    """The host's labels stand between dots or the host's ends, and all but an open last part of the path between
    slashes."""
    host, _, path = rule.lower().partition("/")
    return re.findall(r"[a-z0-9]+", host) + [t for t in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path)]


def compiled(sites=SITE_RULES, patterns=PATTERN_RULES) -> list[dict]:
    """Rules with regex, action, length (a site rule ranks above any pattern, the longest first) and index tokens."""
    rules = [{"rule": r, "regex": site_regex(r), "site": True, "verdict": a, "rank": 1_000_000 + len(r), "tokens": site_tokens(r)} for a, r in sites]
    rules += [{"rule": p, "regex": "(?i)" + pattern_regex(p), "site": False, "verdict": "block", "rank": len(p), "tokens": safe_tokens(p)} for p in patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index is a constant in every task and holds at most {MAX_RULES}")
    return rules


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, url_col: str, wanted: list[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs; at most one row per token comes to the driver."""
    if not wanted:
        return {}
    listed = F.lit(json.dumps({t: 1 for t in wanted}))
    hits = urls.select(F.explode(F.array_intersect(url_tokens(F.col(url_col)), F.map_keys(F.from_json(listed, "map<string,int>")))).alias("t"))
    return {r["t"]: r["count"] for r in hits.groupBy("t").count().collect()}


def _bucket(token: Column) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % BUCKETS + 1).cast("int")


def _bucket_of(token: str) -> int:
    import hashlib

    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % BUCKETS


def index_of(rules: list[dict], counts: dict[str, int]) -> tuple[list[list[dict]], list[dict]]:
    """Puts each rule under its rarest token (ties: the longer, then the first in order); rules without a token are
    tried on every address."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    always = []
    for r in rules:
        entry = {k: r[k] for k in ("rule", "regex", "site", "verdict", "rank")}
        if r["tokens"]:
            token = min(r["tokens"], key=lambda t: (counts.get(t, 0), -len(t), t))
            buckets[_bucket_of(token)].append(entry | {"token": token})
        else:
            always.append(entry | {"token": ""})
    return buckets, always


def judge(urls: DataFrame, url_col: str = "url", sites=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """Adds host, path, rule (the site rule that decides, else null) and verdict to every row.

    Rules hang under their rarest literal token in an index that is one constant of at most MAX_RULES rules; a row's
    tokens fetch candidates from it, and only their regular expressions run. Site rules outrank patterns, the longest
    wins; without any, the verdict is allow. There is no join and no shuffle: rows stay where they are, so hot hosts
    cost nothing; one small aggregation counts the rules' tokens beforehand.

    Null url or none with ``://``: host and path empty, rule null, verdict allow unless a pattern fits. Repeated rows
    are judged alike. Empty table: empty result. Input columns named like a result column are replaced.
    """
    rules = compiled(sites, patterns)
    buckets, always = index_of(rules, token_counts(urls, url_col, sorted({t for r in rules for t in r["tokens"]})))
    entry = "struct<token:string,rule:string,regex:string,site:boolean,verdict:string,rank:int>"
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{entry}>>")
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in RESULT]
    url = F.coalesce(F.col(url_col), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    rows = urls.select(*kept, url.alias("__url"), F.substring_index(F.substring_index(after, "#", 1), "?", 1).alias("__rest"))
    rows = rows.withColumn("host", F.translate(F.substring_index("__rest", "/", 1), UPPER, LOWER))
    rows = rows.withColumn("path", F.expr("substr(__rest, length(host) + 1)"))
    fetched = F.flatten(F.transform(url_tokens(F.col("__url")), lambda t: F.filter(F.element_at(index, _bucket(t)), lambda e: e["token"] == t)))
    if always:
        fetched = F.concat(fetched, F.from_json(F.lit(json.dumps(always)), f"array<{entry}>"))
    fits = F.filter(fetched, lambda e: F.rlike(F.when(e["site"], F.concat("host", "path")).otherwise(F.col("__url")), e["regex"]))
    best = F.array_max(F.transform(fits, lambda e: F.struct(e["rank"].alias("rank"), e["site"].alias("site"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))))
    rows = rows.withColumn("__best", best)
    return rows.select(*kept, "host", "path", F.when(F.col("__best.site"), F.col("__best.rule")).alias("rule"), F.coalesce("__best.verdict", F.lit("allow")).alias("verdict"))
