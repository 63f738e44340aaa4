"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import read, scratch, settle
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.line_rules import BOILERPLATE, MARKED_WORD, MENU, SENTENCE_INSIDE, SEPARATOR, TERMINAL, clean_lines
from textloom.llm.mixing import mix
from textloom.llm.near_dedup import near_components
from textloom.llm.packing import pack
from textloom.llm.quality import document_statistics, score_quality, train_quality
from textloom.llm.substring_dedup import repeated_passages
from textloom.llm.token_store import read_store, write_store
from textloom.llm.toxicity import score_toxicity, train_toxicity
from textloom.llm.url_rules import PATTERN_RULES, SITE_RULES, judge, pattern_regex


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def _remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scores = score_toxicity(docs, train_toxicity(docs, labels, _remainder(5) != 0))
    return scores.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup(docs, hash_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id", "source"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    stats = settle(document_statistics(docs), "statistics")
    scores = score_quality(stats, train_quality(stats, labels, _remainder(3) != 1))
    return scores.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_store(read(spark, sf_dir, "documents"), folder)
    return read_store(spark, folder, manifest)


OP3_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, coalesce(max(doc_id) OVER (PARTITION BY t), doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::DOUBLE)) AS lv
      FROM c WINDOW f AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(cap, weight * (SELECT arg_min(lv, ratio) FROM l WHERE lv <= ratio)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.doc_id) AS n,
             CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS e,
             ('0x' || substr(md5('7|' || d.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.k = t.k),
m AS (SELECT *, (floor(e * n + u) - floor(e * (n - 1) + u))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM m
"""


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS gs FROM d),
n AS (SELECT doc_id, len(gs)::BIGINT AS n FROM g),
s AS (SELECT doc_id, unnest(gs) AS gram FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STRIP = r"regexp_replace({0}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format('t')} AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 8) AS x(k) GROUP BY doc_id),
l AS (SELECT doc_id, n, line, {_WORDS.format('line')} AS ws, {_STRIP.format('line')} AS s
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d)),
q AS (SELECT *, len(list_filter(ws, lambda w: regexp_matches(w, {_quoted(SEPARATOR)}))) AS seps, len(ws) AS nw,
             row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS dup FROM l WHERE len(ws) > 0),
f AS (SELECT doc_id, nw, dup, (seps >= 3 AND nw - seps <= 4 * (seps + 1)) OR (nw <= 5 AND regexp_matches(s, {_quoted(MENU)}))
             OR regexp_matches(s, {_quoted(BOILERPLATE)})
             OR (NOT regexp_matches(s, {_quoted(TERMINAL)}) AND NOT regexp_matches(s, {_quoted(SENTENCE_INSIDE)}))
             OR 100 * len(list_filter(ws, lambda w: regexp_matches(w, {_quoted(MARKED_WORD)}))) > 30 * nw AS bad FROM q),
a AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup, coalesce(sum(nw) FILTER (WHERE bad), 0) AS lost FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words
      FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN p ON p.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_words <= 50 * n_words AS kept FROM b
"""


def _op9_sql() -> str:
    blocked = " OR ".join("regexp_matches(u, '(?i)%s')" % pattern_regex(p).replace("'", "''") for p in PATTERN_RULES)
    cases = []
    for action, rule in sorted(SITE_RULES, key=lambda x: (-len(x[1]), x[1]), reverse=False):
        host, _, path = rule.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, action))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in cases)
    return f"""
WITH a AS (SELECT page_id, url, coalesce(url, '') AS u,
                  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, u, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM a)
SELECT page_id, url, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM b
"""


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_toxicity": op2_toxicity,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_minhash": op4_minhash,
        "op5_passages": op5_passages,
        "op6_line_rules": op6_line_rules,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_url_filter": op9_url_filter,
        "op10_token_store": op10_token_store,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_minhash": OP4_SQL, "op6_line_rules": OP6_SQL, "op7_mixing": OP7_SQL, "op9_url_filter": _op9_sql()}
