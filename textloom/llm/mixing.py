"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle, small, without, word_count

RESULT = ("size", "source_size", "target", "copies", "taken")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _in_order(df: DataFrame, columns: list, name: str) -> DataFrame:
    """Settles the rows dealt out by ranges of ``columns``, with __task and __at: the task, in order, and the row's place
    in it. A range is one task's, so a source, or a size in it, however frequent, is spread over tasks."""
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id())
    return settle(ranged.withColumn("__task", F.shiftright("__at", 33).cast("int")), name)


def _before(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per task (and ``by``): the sums over all tasks before it, and __first, its first place. One row per task and key
    goes to the window."""
    each = rows.groupBy("__task", *by).agg(F.min("__at").alias("__first"), *[c.alias(n) for n, c in sums.items()])
    over = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    return settle(each.select("__task", *by, "__first", *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in sums]), "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources, from (source, source_size), one row per source.

    Sources in code point order, null last, get ``weights`` in turn and share ``total`` times all sizes; a target stops
    at ``most`` times its source's size, and the excess is shared by weight among the others until none is above. That
    end point is one level L with target = min(cap, weight * L): sources sorted by cap / weight fill up one after
    another, so L follows from running sums. Order and sums are distributed; one row, with L, comes to the driver.

    A source of size 0 gets target 0. Repeated sources are not expected: sizes are per source. Empty table: no rows.
    """
    named = _in_order(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "sources")
    before = _before(named, [], {"__n": F.count(F.lit(1))})
    rank = F.col("__n") + F.col("__at") - F.col("__first")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = named.join(small(before), "__task").withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = t.select("source", "__null", "source_size", "weight", "cap", (F.col("cap") / F.col("weight")).alias("ratio"))
    t = _in_order(t, ["ratio", "__null", "source"], "filling")
    all_size, all_weight = t.agg(F.sum("source_size"), F.sum("weight")).first()
    before_t = _before(t, [], {"__c": F.sum("cap"), "__w": F.sum("weight")})
    over = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    cap, share = (F.col(n) + F.coalesce(F.sum(c).over(over), F.lit(0.0)) for n, c in (("__c", "cap"), ("__w", "weight")))
    level = (F.lit(float(total) * (all_size or 0)) - cap) / (F.lit(all_weight or 0.0) - share)
    found = t.join(small(before_t), "__task").select("ratio", level.alias("level")).where("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("x")).first()["x"]
    target = F.col("cap") if found is None else F.least("cap", F.col("weight") * F.lit(float(found["level"])))
    out = settle(t.select("source", "source_size", target.alias("target")), "targets")
    discard(named, before, t, before_t)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
        weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 7,
        carry: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Adds size, source_size, target, copies and taken to every row; ``copies`` says how often the mix takes it.

    Within a source every document expects target / source_size copies. The prefix sum of these runs over documents in
    order of size (then id), shifted by one random offset per source, and a document is emitted once per integer it
    crosses. Sorted by size, neighbours differ little, so the words taken miss the target by about one long document.
    The prefix sum is distributed: rows are dealt out by ranges of (source, size, id), each row knows its place in its
    task, and per task and source the rows of earlier tasks are added; a hot source or size thus spans many tasks. The
    offset is a hash of ``seed`` and source: reruns agree.

    ``carry``: of the input columns only these stay; the narrow rows are written once, so texts are read once. Without
    it, whole rows go through one shuffle.
    ``size`` defaults to the words of column text. Null source: a source of its own, last. Null or empty text: size 0,
    still sampled. Null id: before the others of its source and size. Rows that repeat an id are separate rows, in order
    of a hash of the whole row; equal rows are interchangeable. Empty table: empty result. Input columns named like a
    result column are replaced. ``limit`` replaces the bound of broadcasts, in rows.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = docs.withColumn("__size", size).withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    if carry is not None:
        rows = settle(rows.select(*carry, "__size", "__tie"), "sizes")
    rows = without(rows, RESULT).withColumnRenamed("__size", "size").withColumn("__key", _key(F.col(source_col)))
    ranged = _in_order(rows, ["__key", "size", id_col, "__tie"], "ranged")
    sources = ranged.groupBy("__key").agg(F.sum("size").alias("source_size"))
    sources = settle(sources.select(F.when(F.col("__key") != "n", F.expr("substr(__key, 2)")).alias("source"), "source_size"), "source-sizes")
    targets = source_targets(sources, weights, total, most)
    before = _before(ranged, ["__key"], {"__n": F.count(F.lit(1))})
    starts = before.join(small(targets.select(_key(F.col("source")).alias("__key"), "source_size", "target"), limit), "__key")
    starts = settle(starts, "starts")
    rank = F.col("__n") + F.col("__at") - F.col("__first") + 1
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "__key")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    each = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    crossed = F.floor(each * F.col("__rank") + offset) - F.floor(each * (F.col("__rank") - 1) + offset)
    out = ranged.join(small(starts, limit), ["__task", "__key"]).withColumn("__rank", rank)
    out = out.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    discard(sources, targets, before, *([rows] if carry is not None else []))
    return out.drop("__key", "__task", "__at", "__first", "__n", "__tie", "__rank")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it; rows it does not take, or whose copies are null, go. Nulls, ties and
    repeated rows are kept as they are; an empty table gives an empty one."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")
