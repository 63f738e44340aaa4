"""Corpora and models: sentences of documents, tagged rows, treebanks, model tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.tokens import MIN_SENTENCE_WORDS, sentences, words
from textloom.operators.lm import NgramModel
from textloom.operators.tagging import HmmModel


def document_sentences(docs: DataFrame, id_col: str = "doc_id", min_words: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, sent, sentence, raw): sentences of texts and their words; ``min_words`` leaves out the short ones. Sentences
    keep the columns ``more`` of their text."""
    rows = docs.where("text IS NOT NULL").select(id_col, *more, F.posexplode(sentences(F.col("text"))).alias("sent", "sentence"))
    rows = rows.withColumn("raw", words(F.col("sentence")))
    return rows.where(F.size("raw") >= min_words) if min_words else rows


def passage_sentences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return document_sentences(docs, id_col, MIN_SENTENCE_WORDS)


def event_sentences(events: DataFrame) -> DataFrame:
    """A tagged corpus of events: one sentence per user in order of time, tag the event's type, word its value's bucket."""
    word = F.concat(F.lit("V"), F.floor(F.col("value") / 5).cast("int").cast("string"))
    return events.where("user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL").select("user_id", "ts", "event_id", word.alias("word"), F.col("event_type").alias("tag"))


def read_treebank(spark: SparkSession, path: str, max_trees: int | None = None) -> DataFrame:
    """(tree): one bracketed tree per line; the first ``max_trees`` of them."""
    trees = spark.read.text(path).select(F.trim("value").alias("tree")).where("tree <> ''")
    if max_trees is None:
        return trees
    return trees.withColumn("at", F.monotonically_increasing_id()).orderBy("at").limit(max_trees).drop("at")


def save_ngrams(model: NgramModel, folder: str) -> None:
    """One Parquet table per counter and a table of the numbers; never pickles."""
    for name in ("unigram", "ngram", "context"):
        getattr(model, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = model.unigram.sparkSession
    spark.createDataFrame([(model.order, model.total, model.vocab)], "order int, total long, vocab long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/numbers")


def load_ngrams(spark: SparkSession, folder: str) -> NgramModel:
    n = spark.read.parquet(f"{folder}/numbers").first()
    return NgramModel(n["order"], *(spark.read.parquet(f"{folder}/{name}") for name in ("unigram", "ngram", "context")), n["total"], n["vocab"])


def save_hmm(model: HmmModel, folder: str) -> None:
    for name in ("emit", "tag", "context", "trigram"):
        getattr(model, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    model.emit.sparkSession.createDataFrame([(model.n_words, model.n_tags)], "n_words long, n_tags long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/numbers")


def load_hmm(spark: SparkSession, folder: str) -> HmmModel:
    n = spark.read.parquet(f"{folder}/numbers").first()
    return HmmModel(*(spark.read.parquet(f"{folder}/{name}") for name in ("emit", "tag", "context", "trigram")), n["n_words"], n["n_tags"])


def load_or_train(spark: SparkSession, folder: str, config: dict, train: Callable[[], Any], save: Callable = save_ngrams, load: Callable = load_ngrams, last: str = "numbers") -> Any:
    """Reads a model that was saved under this configuration, or trains and saves it. The configuration is part of the
    folder's name, so a change of it trains anew. ``last`` is the table that ``save`` writes last."""
    key = "-".join(f"{k}={v}" for k, v in sorted(config.items()))
    path = f"{folder.rstrip('/')}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{last}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return load(spark, path)
    model = train()
    save(model, path)
    return model


def to_json(rows: DataFrame) -> str:
    """A small result as JSON text."""
    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], ensure_ascii=False, default=str)
