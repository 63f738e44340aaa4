"""Tag models as aggregates: a trigram hidden Markov model, the most frequent tag, morphological tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import START, ngrams, padded
from textloom.session import settle, small


def sentences_of(tagged: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """Arrays of words and tags per sentence from one row per token."""
    rows = tagged.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct(*order, "word", "tag"))).alias("__s"))
    return rows.select(*ids, F.transform("__s", lambda x: F.lower(x["word"])).alias("words"), F.transform("__s", lambda x: x["tag"]).alias("tags"))


@dataclass(frozen=True)
class HmmModel:
    """emit (word, tag, c), tag (tag, c), context (w1, w2, c) and trigram (w1, w2, w3, c) of tags, numbers of words and
    tags. Words are in lower case, tags as given."""

    emit: DataFrame
    tag: DataFrame
    context: DataFrame
    trigram: DataFrame
    n_words: int
    n_tags: int

    def word_tags(self) -> DataFrame:
        return self.emit.groupBy("word").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def train_hmm(sents: DataFrame) -> HmmModel:
    """Counts over (words, tags); two <START> tags before a sentence, none after."""
    pairs = sents.select(F.explode(F.arrays_zip("words", "tags")).alias("p")).select(F.col("p.words").alias("word"), F.col("p.tags").alias("tag"))
    emit = settle(pairs.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("c")), "emit")
    tag = settle(emit.groupBy("tag").agg(F.sum("c").alias("c")), "tag")
    grams = sents.select(F.explode(ngrams(padded(F.col("tags"), [START, START], []), 3)).alias("g")).select("g.*")
    trigram = settle(grams.groupBy("w1", "w2", "w3").agg(F.count(F.lit(1)).alias("c")), "tag-trigram")
    context = settle(trigram.groupBy("w1", "w2").agg(F.sum("c").alias("c")), "tag-context")
    return HmmModel(emit, tag, context, trigram, emit.select("word").distinct().count(), tag.count())


def emission(model: HmmModel) -> DataFrame:
    """Add-one log probability of each word seen under a tag."""
    rows = model.emit.join(small(model.tag.select("tag", F.col("c").alias("ct"))), "tag")
    return rows.select("word", "tag", F.log((F.col("c") + 1) / (F.col("ct") + F.lit(model.n_words))).alias("log_p"))


def transition(model: HmmModel) -> DataFrame:
    rows = model.trigram.join(small(model.context.withColumnRenamed("c", "c2")), ["w1", "w2"])
    return rows.select("w1", "w2", "w3", F.log((F.col("c") + 1) / (F.col("c2") + F.lit(model.n_tags))).alias("log_p"))


def most_frequent_tags(tagged: DataFrame, order: list[str]) -> DataFrame:
    """(word, tag): the most frequent tag of a word in lower case; ties by the first occurrence in ``order``."""
    counts = tagged.groupBy(F.lower("word").alias("word"), "tag").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*order)).alias("first"))
    return counts.groupBy("word").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "tag")).alias("b")).select("word", F.col("b.tag").alias("tag"))


def tag_by_frequency(tokens: DataFrame, tags: DataFrame, word: str = "word") -> DataFrame:
    """Adds pred: the word's most frequent tag, or UNKNOWN."""
    right = small(settle(tags.select(F.col("word").alias("__w"), F.col("tag").alias("pred")), "mft"))
    return tokens.join(right, F.lower(word) == F.col("__w"), "left").drop("__w").withColumn("pred", F.coalesce("pred", F.lit("UNKNOWN")))


def morph_tag(upos: Column, feats: Column) -> Column:
    """UPOS with gender and number where the features name them."""
    gender, number = F.try_element_at(feats, F.lit("Gender")), F.try_element_at(feats, F.lit("Number"))
    return F.concat(upos, F.when(gender.isin("Masc", "Fem", "Neut"), F.concat(F.lit("-"), gender)).otherwise(F.lit("")),
                    F.when(number == "Sing", F.lit("-Sg")).when(number == "Plur", F.lit("-Pl")).otherwise(F.lit("")))
