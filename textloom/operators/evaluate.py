"""Metrics as joins and aggregates over gold and predicted rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.candidates import by_enumeration, by_index, delete_index
from textloom.operators.correct import CorrectorConfig, Fold, apply_changes, correct_token_arrays, model_numbers, row_part, with_reach
from textloom.operators.lm import NgramModel
from textloom.session import settle

OUTCOMES = ("target_correct", "untouched", "wrong", "sentence_exact", "collateral")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def pos_accuracy(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(n, correct, accuracy) over rows that have both; 0 without rows."""
    out = rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col(gold) == F.col(pred)).cast("long")), F.lit(0)).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def confusion_matrix(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def top_confusion(rows: DataFrame, top: int = 5, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The matrix of the most frequent gold tags (ties by tag) against themselves, zeros included."""
    tags = [r["gold"] for r in rows.groupBy(F.col(gold).alias("gold")).count().orderBy(F.desc("count"), "gold").limit(top).collect()]
    wide = rows.where(F.col(gold).isin(tags)).groupBy(F.col(gold).alias("gold")).pivot(pred, tags).count()
    return wide.na.fill(0)


def exact_match(rows: DataFrame, gold: Column, pred: Column) -> DataFrame:
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((gold == pred).cast("long")), F.lit(0)).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def spans(words: DataFrame, ids: list[str]) -> DataFrame:
    """Adds from and to, in characters, to rows (ids, pos, word)."""
    upto = F.sum(F.length("word")).over(Window.partitionBy(*ids).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("to", upto).withColumn("from", upto - F.length("word"))


def error_sources(gold: DataFrame, predicted: DataFrame, ids: list[str]) -> DataFrame:
    """Whether tag errors come from segmentation: a gold span that exactly one predicted span equals has a genuine
    error if the tags differ; without such a span, the error is the segmentation's. Fractions are null without errors."""
    g = spans(gold, ids)
    p = spans(predicted, ids).groupBy(*ids, "from", "to").agg(F.count(F.lit(1)).alias("m"), F.first("tag").alias("ptag"))
    rows = g.join(p, [*ids, "from", "to"], "left")
    one = F.coalesce(F.col("m"), F.lit(0)) == 1
    out = rows.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum((~one).cast("long")), F.lit(0)).alias("segmentation_errors"),
                   F.coalesce(F.sum((one & (F.col("ptag") != F.col("tag"))).cast("long")), F.lit(0)).alias("genuine_errors"))
    errors = F.col("segmentation_errors") + F.col("genuine_errors")
    return out.withColumn("segmentation_share", F.when(errors > 0, F.col("segmentation_errors") / errors)).withColumn("genuine_share", F.when(errors > 0, F.col("genuine_errors") / errors))


def correction_cases(cases: DataFrame, model: NgramModel, ids: list[str], config: CorrectorConfig = CorrectorConfig(), real_words: bool = True, part: dict | None = None) -> DataFrame:
    """The fold over noisy sentences (ids, tokens, noisy, pos, original, corrupted), with the outcome per case."""
    noisy = settle(cases.withColumnRenamed("tokens", "gold").withColumnRenamed("noisy", "tokens"), "cases")
    changes = settle(correct_token_arrays(noisy, model, ids, config, real_words, part), "changes")
    out = apply_changes(noisy, changes, ids).withColumn("got", F.element_at("fixed", F.col("pos") + 1))
    others = F.exists(F.zip_with("gold", F.transform("fixed", lambda w, i: F.when(i == F.col("pos"), F.lit(None)).otherwise(w)), lambda g, w: w.isNotNull() & (g != w)), lambda x: x)
    return out.withColumn("target_correct", F.col("got") == F.col("original")).withColumn("untouched", F.col("got") == F.col("corrupted")).withColumn("wrong", ~F.col("target_correct") & ~F.col("untouched")) \
        .withColumn("sentence_exact", F.col("fixed") == F.col("gold")).withColumn("collateral", others)


def _accuracy(cases) -> DataFrame:
    out = cases.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in OUTCOMES])
    return out.withColumn("accuracy", ratio(F.col("target_correct"), F.col("n")))


def accuracy_of(cases: DataFrame) -> DataFrame:
    return _accuracy(cases)


def false_alarms(sents: DataFrame, model: NgramModel, ids: list[str], config: CorrectorConfig = CorrectorConfig()) -> DataFrame:
    """Changes to clean sentences: counts by kind, sentences touched, rates per word and per sentence."""
    changes = settle(correct_token_arrays(sents, model, ids, config), "alarms")
    total = sents.agg(F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum(F.size("tokens")).cast("long"), F.lit(0)).alias("words"))
    found = changes.agg(F.coalesce(F.sum((F.col("kind") == "real-word").cast("long")), F.lit(0)).alias("real_word"), F.coalesce(F.sum((F.col("kind") == "non-word").cast("long")), F.lit(0)).alias("non_word"))
    hit = changes.select(*ids).distinct().agg(F.count(F.lit(1)).alias("damaged"))
    out = total.join(found, F.lit(True)).join(hit, F.lit(True))
    return out.withColumn("per_word", ratio(F.col("real_word") + F.col("non_word"), F.col("words"))).withColumn("per_sentence", ratio(F.col("damaged"), F.col("sentences")))


def sweep(cases: DataFrame, model: NgramModel, ids: list[str], configs: dict[str, CorrectorConfig]) -> DataFrame:
    """Accuracy per configuration, in one pass over the cases. Each configuration is a fold of its own, as the corrected
    left context depends on it; the part of the model that the cases reach is the same for all."""

    def outcome(fold: Fold, gold: list[str], noisy: list[str], pos: int, original: str, corrupted: str) -> tuple:
        got = list(noisy)
        for i, _, fixed, _, _ in fold.run(noisy):
            got[i] = fixed
        right, same = got[pos] == original, got[pos] == corrupted
        return right, same, not right and not same, got == gold, any(g != w for i, (g, w) in enumerate(zip(gold, got, strict=True)) if i != pos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = {name: [] for name in configs}
            for i in range(batch.num_rows):
                *row, found, pairs = (c[i].as_py() for c in batch.columns)
                part = row_part(found, pairs, numbers)
                for name, c in configs.items():
                    flags[name].append(outcome(Fold(part, c), *row))
            for name, rows in flags.items():
                columns = list(zip(*rows, strict=True)) or [()] * len(OUTCOMES)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(f, pa.bool_()) for f in columns)], ["config", *OUTCOMES])

    numbers, first = model_numbers(model), next(iter(configs.values()))
    least = replace(first, min_length=min(c.min_length for c in configs.values()))
    rows = with_reach(cases.select("tokens", "noisy", "pos", "original", "corrupted"), model, least, "noisy")
    return _accuracy(rows.mapInArrow(run, "config string, " + ", ".join(f"{c} boolean" for c in OUTCOMES)).groupBy("config"))


def threshold_sweep(cases: DataFrame, model: NgramModel, ids: list[str], thresholds=(1, 2, 3, 4, 5, 6, 8, 10)) -> DataFrame:
    return sweep(cases, model, ids, {str(t): CorrectorConfig(method="B", threshold=float(t)) for t in thresholds})


def scoring_grid(cases: DataFrame, model: NgramModel, ids: list[str]) -> DataFrame:
    grid = {"add-k": CorrectorConfig(scoring="add-k"), **{f"interpolated beta={b:g}": CorrectorConfig(beta=b) for b in (0.0, 0.5, 1.0)}}
    return sweep(cases, model, ids, grid)


def residual_errors(cases: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent (original, corrupted, got) of cases not corrected."""
    rows = cases.where("NOT target_correct").groupBy("original", "corrupted", "got").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "original", "corrupted", "got").limit(top)


def timing(queries: DataFrame, vocabulary: DataFrame, repeats: int = 3) -> list[dict]:
    """Best seconds of enumerating, indexing and raw indexing candidates for the queries."""
    index = settle(delete_index(vocabulary), "index")
    n, out = queries.count(), []
    for name, run in (("A", lambda: by_enumeration(queries, vocabulary)), ("B", lambda: by_index(queries, index)), ("raw", lambda: by_index(queries, index, verify=False))):
        best = min(_timed(run) for _ in range(repeats))
        out.append({"method": name, "seconds": best, "words_per_second": n / best if best else 0.0, "candidates": run().count()})
    return out


def _timed(run) -> float:
    import time

    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
