"""Reproducible splits, samples and corruptions; what would be drawn is ordered by an md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.edits import single_edits
from textloom.functions.tokens import NUM
from textloom.session import settle, small


def draw(seed: int, *keys: Column) -> Column:
    """A hexadecimal number that stands for a random one."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column) -> Column:
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sequential_split(rows: DataFrame, order: str, ratio: float = 0.8) -> DataFrame:
    """Adds split: the first floor(ratio n) rows in ``order`` train, the rest test. The order's values are ranked by
    range partitions, whose counts alone meet on the driver."""
    cut = int(rows.count() * ratio)
    ranged = settle(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    table = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __at long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) + F.col("__at")
    return ranged.join(F.broadcast(table), "__part").withColumn("split", F.when(rank <= cut, "train").otherwise("test")).drop("__part", "__at")


def shuffled_split(rows: DataFrame, key: str, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: the round(ratio n) rows with the least draws, equal ones by the key, are the test set; rows of the key
    at the bound stay together.

    Rows are counted by the first four digits of their draws, 65,536 counts at most. Only the rows whose draws begin
    like the bound are put in order to find it."""
    drawn = rows.withColumn("__d", draw(seed, F.col(key)))
    first = F.substring("__d", 1, 4)
    counts = sorted((r["first"], r["count"]) for r in drawn.groupBy(first.alias("first")).count().collect())
    n, below = round(sum(c for _, c in counts) * test_ratio), 0
    if not n:
        return rows.withColumn("split", F.lit("train"))
    for digits, count in counts:
        if below + count >= n:
            break
        below += count
    pairs = drawn.where(first == digits).select(F.struct("__d", F.col(key).alias("k")).alias("s"))
    last = pairs.orderBy("s").limit(n - below).agg(F.max("s")).first()[0]
    upto = F.col(key).isNull() if last["k"] is None else F.coalesce(F.col(key) <= F.lit(last["k"]), F.lit(True))
    chosen = (F.col("__d") < last["__d"]) | ((F.col("__d") == last["__d"]) & upto)
    return drawn.withColumn("split", F.when(chosen, "test").otherwise("train")).drop("__d")


def corrupt(words: DataFrame, vocabulary: DataFrame, into_words: bool, seed: int = 7) -> DataFrame:
    """(w, corrupted): one single edit of each distinct word, a word of the vocabulary or none of it; words without
    such an edit are left out. The edit with the least draw is taken."""
    made = words.select("w").distinct().select("w", F.explode(single_edits(F.col("w"))).alias("e")).where("e <> ''")
    kept = made.join(small(vocabulary.withColumnRenamed("w", "e")), "e", "left_semi" if into_words else "left_anti")
    return kept.groupBy("w").agg(F.min(F.struct(draw(seed, F.col("w"), F.col("e")).alias("d"), "e")).alias("b")).select("w", F.col("b.e").alias("corrupted"))


def paired_test_set(sents: DataFrame, vocabulary: DataFrame, ids: list[str], seed: int = 7) -> DataFrame:
    """One case per sentence: the target with the least draw among its words of three letters or more that have both a
    word and a non-word corruption: ids, pos, original, non_word, real_word."""
    tokens = sents.select(*ids, F.posexplode("tokens").alias("pos", "w")).where((F.col("w") != NUM) & (F.length("w") >= 3))
    tokens = settle(tokens.join(small(vocabulary), "w", "left_semi"), "targets")
    real, none = corrupt(tokens, vocabulary, True, seed), corrupt(tokens, vocabulary, False, seed)
    both = settle(real.withColumnRenamed("corrupted", "real_word").join(none.withColumnRenamed("corrupted", "non_word"), "w"), "corruptions")
    cases = tokens.join(small(both), "w").withColumn("d", draw(seed, *[F.col(i) for i in ids], F.col("pos")))
    best = cases.groupBy(*ids).agg(F.min(F.struct("d", "pos", F.col("w").alias("original"), "non_word", "real_word")).alias("b"))
    return best.select(*ids, "b.pos", "b.original", "b.non_word", "b.real_word")


def misspelling_batch(tokens: DataFrame, vocabulary: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Exactly n (w, corrupted) in order of their draws; an error if there are fewer. Tokens are not made distinct."""
    pairs = tokens.join(corrupt(tokens, vocabulary, False, seed), "w").withColumn("d", draw(seed, F.col("id"), F.col("w")))
    out = settle(pairs.orderBy("d", "id").limit(n).select("id", "w", "corrupted"), "batch")
    if out.count() < n:
        raise ValueError(f"fewer than {n} words can be misspelt")
    return out


def sample_passages(sents: DataFrame, doc: str, sent: str, least: int = 5, most: int = 8, seed: int = 42) -> DataFrame:
    """The sentences of one run of ``least`` to ``most`` neighbours per document, placed by its draw."""
    n = sents.groupBy(doc).agg(F.count(F.lit(1)).alias("__n"), F.min(sent).alias("__min"))
    size = F.lit(least) + F.floor(uniform(seed, F.col(doc), F.lit("n")) * (most - least + 1))
    n = n.withColumn("__size", F.least(size, F.col("__n")))
    n = n.withColumn("__from", F.floor(uniform(seed, F.col(doc), F.lit("at")) * (F.col("__n") - F.col("__size") + 1)))
    ranked = sents.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(sent)) - 1)
    return ranked.join(n, doc).where("__r >= __from AND __r < __from + __size").drop("__n", "__min", "__size", "__from", "__r")


def merge_tokens(sents: DataFrame, ids: list[str], p: float = 0.08, seed: int = 42) -> DataFrame:
    """A stream of tokens in which neighbours are merged with probability p: ids, token_index, text, gold_words,
    is_merge. Merges do not overlap: in a run of positions whose draw is below p, every other one starts a merge,
    beginning with the first, and a sentence's last word starts none. Runs are found inside the sentence's array."""
    at = F.col("i")
    rows = sents.select(*ids, F.posexplode("tokens").alias("i", "w"), F.size("tokens").alias("n"))
    rows = rows.withColumn("hit", (uniform(seed, *[F.col(c) for c in ids], at) < p) & (at < F.col("n") - 1))
    own = Window.partitionBy(*ids).orderBy("i")
    rows = rows.withColumn("run", at - F.sum(F.col("hit").cast("int")).over(own)).withColumn("nth", F.when(F.col("hit"), F.row_number().over(Window.partitionBy(*ids, "run", "hit").orderBy("i"))))
    rows = rows.withColumn("starts", F.col("hit") & (F.col("nth") % 2 == 1)).withColumn("next", F.lead("w").over(own)).withColumn("second", F.coalesce(F.lag("starts").over(own), F.lit(False)))
    rows = rows.where(~F.col("second"))
    index = F.row_number().over(own) - 1
    gold = F.when(F.col("starts"), F.array("w", "next")).otherwise(F.array("w"))
    return rows.withColumn("token_index", index).select(*ids, "token_index", F.lower(F.array_join(gold, "")).alias("text"), F.transform(gold, lambda w: F.lower(w)).alias("gold_words"), F.col("starts").alias("is_merge"))


def passage_texts(tokens: DataFrame, sents: DataFrame, passage: str, sent: str) -> DataFrame:
    """(passage, plain_text, gold_text): the stream's tokens as they are, and the sentences' words as they should be,
    each joined by spaces in order. A passage without tokens has an empty plain text."""
    def joined(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        parts = rows.groupBy(passage).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("v")))).alias("l"))
        return parts.select(passage, F.array_join(F.transform("l", lambda x: x["v"]), " ").alias(name))

    plain = joined(tokens, "token_index", F.col("text"), "plain_text")
    gold = joined(sents.where(F.size("tokens") > 0), sent, F.array_join("tokens", " "), "gold_text")
    return gold.join(plain, passage, "left").na.fill("", ["plain_text"]).select(passage, "plain_text", "gold_text")
