"""Near-duplicate documents by word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, look_up, settle, small
from textloom.llm.components import connected_components
from textloom.llm.simjoin import SKETCH, linked
from textloom.llm.words import gram_hashes, word_hashes

RESULT = ("n_shingles", "component_id", "kept")


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of ``words`` words; with fewer words the whole sequence is one
    shingle, without words there is none. A-Z count as a-z. Two of a text's shingles collide with a probability of
    about n^2 / 2^65."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    h = word_hashes(found)
    return np.unique(gram_hashes(h, min(words, len(h))).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def set_id(items: np.ndarray) -> int:
    """Names a set; two sets of a table of n collide with a probability of about n^2 / 2^65."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - 2**63


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, set (its id; null if empty) and the SKETCH least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t or "", words) for t in part.column(1).to_pylist()]
                keys = [set_id(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), _lists([s[:SKETCH] for s in sets])],
                    ["id", "n", "set", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, set long, sketch array<long>")


def _full(docs: DataFrame, owners: DataFrame, words: int, id_col: str, text_col: str, limit: int | None):
    """From a table of sets to (id, items): read from the text of one document each, ``owners`` (set, rep)."""

    def full_sets(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    sets = [shingles(t or "", words) for t in batch.column(0).slice(at, 500).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), _lists(sets)], ["id", "items"])

        sets = settle(owners.join(small(wanted.withColumnRenamed("id", "set"), limit), "set", "left_semi"), "set-owners")
        ids = settle(sets.select(F.col("rep").alias("id")).distinct(), "owner-ids")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(ids, limit), "id", "left_semi")
        found = rows.select("text").mapInArrow(run, "id long, items array<long>")
        # an id may have rows with other sets, and one set in several rows
        return found.join(small(wanted, limit), "id", "left_semi").dropDuplicates(["id"])

    return full_sets


def near_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id and kept.

    Documents whose shingle sets have intersection / union >= num / den are linked; component_id is the least id
    reachable over links, kept tells whether it is the document's own. Equal sets are one set from the start, so exact
    copies cost one row; links between different sets come from bottom-k sketches (see simjoin), confirmed on full
    sets. Shingles and sets are compared by 64-bit hashes.

    Null or empty text, or white space alone: no shingles, a component of its own. Null id: not linked, component_id
    null, kept. Rows that repeat an id: one document, the rows' links put together, so all of them get one
    component_id; n_shingles is each row's own. Ties do not arise: the least id decides. Very long texts: whole, one at
    a time. Empty table: empty result. Other columns are not read. ``limit`` replaces the bound of broadcasts, in rows.
    """
    made = settle(sketches(docs, words, id_col, text_col), "sketches")
    whole = made.where("set IS NOT NULL AND id IS NOT NULL")
    owners = settle(whole.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "owners")
    several = settle(owners.where("copies > 1").select("set", "rep"), "several")
    alone = look_up(whole.select("set", "n", "sketch"), several.select("set"), ["set"], "left_anti", limit)
    copied = look_up(whole.select("id", "set", "n", "sketch"), several, ["set"], "inner", limit).where("id = rep").drop("id", "rep").dropDuplicates(["set"])
    sets = settle(alone.unionByName(copied).withColumnRenamed("set", "id"), "sets")
    found = linked(sets, _full(docs, owners, words, id_col, text_col, limit), num, den)
    twins = settle(whole.groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a < b").select("id", "b"), "twins")
    if twins.limit(1).count():
        # rows that repeat an id with other texts: their sets are one document's, as if linked
        same = look_up(whole.select("id", F.col("set").alias("a")), twins, ["id"], "inner", limit).select("a", "b")
        found = connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same))
    named = found.join(owners.select(F.col("set").alias("id"), "rep"), "id")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("id").alias("set"), "least")
    rest = owners.where("copies > 1").join(found.select(F.col("id").alias("set")), "set", "left_anti").select("set", F.col("rep").alias("least"))
    named = settle(named.unionByName(rest), "named")
    out = look_up(made.select("id", "n", "set"), named, ["set"], "left", limit)
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    discard(owners, several, sets, twins, found)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is kept by near_components: one of each group. The dropped ids
    are joined away: broadcast if they were counted to be few, else by a join on the id.

    Nulls, empty texts, ties and empty tables as in near_components: rows with a null id or without words stay, and all
    rows of a repeated id stay or go together."""
    found = near_components(docs, words, num, den, id_col, text_col, limit)
    dropped = settle(found.where("NOT kept").select(F.col(id_col).alias("__id")).distinct(), "dropped")
    return docs.join(small(dropped, limit), F.col(id_col) == F.col("__id"), "left_anti")
