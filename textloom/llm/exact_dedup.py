"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, discard, look_up, settle, without

RESULT = ("keep_id", "group_size", "kept", "full_hash")


def _length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def _prefix(text: Column, chars: int) -> Column:
    return F.xxhash64(ascii_lower(F.substring(text, 1, chars)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 512,
                hash_all: bool = False, limit: int | None = None) -> DataFrame:
    """Adds keep_id, group_size, kept and full_hash (SHA-256 of the text with A-Z lower-cased) to every row.

    Refinement: 1. count rows by byte length (lower-casing A-Z keeps it) and go on with lengths that occur twice;
    2. among those, count by (length, hash of the first ``prefix_chars`` characters); 3. only rows whose pair occurs
    twice have their whole text hashed, and equal hashes form a group. Every count is combined before its shuffle, so
    a group that holds a third of all rows arrives as one row per task. What a step left over is told to the rows by
    broadcast if it is counted to be small (``limit`` sets that bound in rows), and by a join otherwise, which
    adaptive execution splits at hot keys; the steps are the same at every size.

    ``hash_all``: also give rows without a copy their full_hash (else null); it is made before the join then, so that
    texts need not pass through it.
    Null text: empty text. Null id: stays only in a group without any other id. Rows that repeat id and text: one
    document, kept or dropped together, each counted in group_size. Empty table: empty result. Input columns named
    like a result column are replaced; other columns pass through.
    """
    docs = without(docs, RESULT)
    text, key, full = F.col(text_col), ["__len", "__prefix"], F.sha2(ascii_lower(F.col(text_col)), 256)
    lengths = settle(docs.select(_length(text).alias("__len")).groupBy("__len").count().where("count > 1").select("__len"), "lengths")
    rows = docs.select(text.alias("__text")).withColumn("__len", _length(F.col("__text"))).withColumn("__prefix", _prefix(F.col("__text"), prefix_chars))
    rows = look_up(rows.drop("__text"), lengths, ["__len"], "left_semi", limit)
    pairs = settle(rows.groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("__again")), "pairs")
    marked = docs.withColumn("__len", _length(text)).withColumn("__prefix", _prefix(text, prefix_chars))
    if hash_all:
        hashed = look_up(marked.withColumn("full_hash", full), pairs, key, "left", limit)
    else:
        hashed = look_up(marked, pairs, key, "left", limit).withColumn("full_hash", F.when(F.col("__again"), full))
    groups = hashed.where("__again").groupBy("full_hash").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(groups.where("group_size > 1"), "groups")
    discard(lengths)
    out = look_up(hashed.drop("__len", "__prefix", "__again"), groups, ["full_hash"], "left", limit)
    out = out.withColumn("keep_id", F.coalesce("keep_id", id_col)).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
