"""One bundle of the models an analysis needs: trained on the first part of a tagged corpus, saved, loaded, measured."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import decode as de
from textloom.operators import evaluate as ev
from textloom.operators import grammar as gr
from textloom.operators.corrupt import sequential_split
from textloom.operators.lm import NgramModel, train_add_one
from textloom.operators.tagging import HmmModel, morph_tag, most_frequent_tags, sentences_of, tag_by_frequency, train_hmm
from textloom.session import settle
from textloom.sources.corpus import load_hmm, load_ngrams, save_hmm, save_ngrams

_GRAMMAR = "lhs string, rhs string, lexical boolean, count long, prob double"


@dataclass(frozen=True)
class Bundle:
    """Add-one trigrams of words, the tag model, (word, tag) of the most frequent tags, and rules of a grammar or None."""

    lm: NgramModel
    hmm: HmmModel
    frequent: DataFrame
    grammar: DataFrame | None = None

    def segment(self, texts: DataFrame, how: str = "viterbi", config: de.DecoderConfig = de.DecoderConfig()) -> DataFrame:
        return de.decode_all(texts, self.lm, how, self.hmm, config)

    def tag(self, sents: DataFrame, ids: list[str]) -> DataFrame:
        return de.tag_sentences(sents, self.hmm, ids)

    def parse(self, sents: DataFrame, ids: list[str]) -> DataFrame:
        if self.grammar is None:
            raise ValueError("this bundle has no grammar")
        return gr.parse(sents, self.grammar, ids)


def _tokens(sents: DataFrame, sent: str) -> DataFrame:
    rows = sents.select(sent, F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "p"))
    return rows.select(sent, "pos", F.col("p.words").alias("word"), F.col("p.tags").alias("tag"))


def train_bundle(tagged: DataFrame, sent: str, order: list[str], ratio: float = 0.8, trees: DataFrame | None = None) -> tuple[Bundle, DataFrame]:
    """A bundle from the first ``ratio`` of the sentences in order of ``sent``, and (sent, words, tags) of the others.

    ``tagged`` has one row per token: sent, ``order``, word, tag. ``trees`` (tree) are for the grammar alone."""
    parts = settle(sequential_split(sentences_of(tagged, [sent], order), sent, ratio), "split-sentences")
    first = parts.where("split = 'train'")
    frequent = settle(most_frequent_tags(_tokens(first, sent), [sent, "pos"]), "frequent")
    grammar = settle(gr.induce(trees), "grammar") if trees is not None else None
    return Bundle(train_add_one(first.select(F.col("words").alias("tokens"))), train_hmm(first), frequent, grammar), parts.where("split = 'test'").drop("split")


def morph_tokens(conllu: DataFrame) -> DataFrame:
    """Rows of ``parse_conllu`` as tokens for ``train_bundle``: id (path and sentence), pos, word, tag with gender and
    number."""
    return conllu.select(F.struct("path", "sent").alias("id"), "pos", F.col("form").alias("word"), morph_tag(F.col("upos"), F.col("feats")).alias("tag"))


def save_bundle(bundle: Bundle, folder: str) -> None:
    """Parquet tables, the grammar last; a bundle without one writes an empty table."""
    save_ngrams(bundle.lm, f"{folder}/lm")
    save_hmm(bundle.hmm, f"{folder}/hmm")
    bundle.frequent.write.mode("overwrite").parquet(f"{folder}/frequent")
    grammar = bundle.grammar if bundle.grammar is not None else bundle.frequent.sparkSession.createDataFrame([], _GRAMMAR)
    grammar.write.mode("overwrite").parquet(f"{folder}/grammar")


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    grammar = spark.read.parquet(f"{folder}/grammar")
    return Bundle(load_ngrams(spark, f"{folder}/lm"), load_hmm(spark, f"{folder}/hmm"), spark.read.parquet(f"{folder}/frequent"), None if grammar.isEmpty() else grammar)


def experiment(bundle: Bundle, test: DataFrame, sent: str, hows: tuple[str, ...] = ("greedy", "viterbi", "joint"), config: de.DecoderConfig = de.DecoderConfig()) -> DataFrame:
    """(metric, n, correct, accuracy) on sentences (sent, words, tags): tokens tagged by frequency and by the tag model,
    and sentences cut exactly right after their spaces were left out, by each decoder of ``hows``."""
    by_frequency = tag_by_frequency(_tokens(test, sent), bundle.frequent).withColumnRenamed("tag", "gold")
    by_model = bundle.tag(test.withColumnRenamed("tags", "gold"), [sent, "gold"]).select(F.explode(F.arrays_zip("gold", F.col("tags").alias("pred"))).alias("p")).select("p.*")
    out = [ev.pos_accuracy(by_frequency).withColumn("metric", F.lit("tags frequency")), ev.pos_accuracy(by_model).withColumn("metric", F.lit("tags model"))]
    glued = test.select(F.array_join("words", "").alias("text"), F.col("words").alias("gold"))
    for how in hows:
        cut = bundle.segment(glued.select("text").distinct(), how, config).select("text", F.col("words").alias("pred"))
        out.append(ev.exact_match(glued.join(cut, "text"), F.col("gold"), F.col("pred")).withColumn("metric", F.lit(f"segmentation {how}")))
    return reduce(DataFrame.unionByName, out).select("metric", "n", "correct", "accuracy")
