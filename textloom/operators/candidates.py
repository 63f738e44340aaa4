"""Words within one edit, by enumeration and by an index of deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.edits import deletes, edits, within_one
from textloom.session import settle, small


def by_enumeration(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, w): every edit of q that is a word, q itself excluded. The edits meet the vocabulary by equality."""
    built = queries.select("q").distinct().select("q", F.explode(edits(F.col("q"))).alias("w"))
    return built.join(small(vocabulary), "w").where("w <> q").select("q", "w")


def delete_index(vocabulary: DataFrame) -> DataFrame:
    """(variant, w): each word under itself and under each of its deletions."""
    return vocabulary.select("w", F.explode(F.array_union(F.array("w"), deletes(F.col("w")))).alias("variant"))


def by_index(queries: DataFrame, index: DataFrame, verify: bool = True) -> DataFrame:
    """(q, w): words that share a variant with q. An equality join in place of a distance join; ``verify`` removes the
    few pairs at distance two."""
    probes = queries.select("q").distinct().select("q", F.explode(F.array_union(F.array("q"), deletes(F.col("q")))).alias("variant"))
    probes = small(settle(probes, "probes"))  # few probes meet the index where it is made
    pairs = probes.join(index, "variant").where("w <> q")
    if verify:
        pairs = pairs.where(within_one(F.col("q"), F.col("w")))
    return pairs.select("q", "w").distinct()


def candidates(queries: DataFrame, vocabulary: DataFrame, method: str = "B") -> DataFrame:
    """Method A enumerates, B uses the index; "both" equals either, as they agree, and so runs B."""
    if method == "A":
        return by_enumeration(queries, vocabulary)
    if method in ("B", "both"):
        return by_index(queries, delete_index(vocabulary))
    raise ValueError(f"unknown method {method!r}")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries for which two candidate tables differ."""
    return a.exceptAll(b).union(b.exceptAll(a)).select("q").distinct()


def index_statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("variant").alias("keys"), F.count(F.lit(1)).alias("postings"))
