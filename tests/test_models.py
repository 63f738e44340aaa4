"""Language models, candidates and correction on the toy corpus of eight sentences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.tokens import BOS, END, EOS, START
from textloom.operators import candidates as ca
from textloom.operators import correct as co
from textloom.operators import lm
from textloom.sources import corpus

TOY = """the quick brown fox jumps over the lazy dog
i would like to see the world
please meet me at the station
the dog sat on the mat
she is a very good student
this is a test sentence
i have a good feeling about this
the cat and the dog and the fox""".split("\n")


@pytest.fixture(scope="module")
def sents(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(TOY)], "id int, tokens array<string>")


@pytest.fixture(scope="module")
def model(sents):
    return lm.train_bigram(sents)


def counts(df):
    return {tuple(r)[:-1]: r["c"] for r in df.collect()}


def test_counts(model):
    uni, bi, ctx = counts(model.unigram), counts(model.ngram), counts(model.context)
    assert (model.vocab, model.total, len(bi)) == (36, 54, 56)
    assert uni["the",] == 9 and uni["she",] == 1 and ctx["the",] == 9


@pytest.mark.parametrize(("a", "b", "add_k", "interpolated"), [("the", "dog", 0.214285714, 0.196080670), ("the", "station", 0.107675906, 0.097526636), ("zzz", "dog", 0.026315789, 0.007191781), (BOS, "the", 0.359188544, 0.338270548), ("dog", EOS, 0.298816568, 0.284360731)])
def test_probabilities(spark, model, a, b, add_k, interpolated):
    rows = lm.look_up(lm.look_up(lm.look_up(spark.createDataFrame([(a, b)], "x string, y string"), model.ngram, ["x", "y"], "c2"), model.context, ["x"], "c1"), model.unigram, ["y"], "c")
    p, q = rows.select(lm.add_k(F.col("c2"), F.col("c1"), model.vocab, 0.01), lm.interpolated(F.col("c2"), F.col("c1"), F.col("c"), model.total, model.vocab)).first()
    assert p == pytest.approx(add_k, abs=1e-8) and q == pytest.approx(interpolated, abs=1e-8)


def test_sentence_score(sents, model):
    row = lm.sentence_scores(sents.where("id = 3"), model, BOS, EOS, 0.01, ["id"]).first()
    assert row["log_prob"] == pytest.approx(-6.937307, abs=1e-5) and row["perplexity"] == pytest.approx(2.694045, abs=1e-5)


def test_add_one(sents):
    m = lm.train_add_one(sents)
    tri, ctx = counts(m.ngram), counts(m.context)
    p = lambda a, b, c: (tri.get((a, b, c), 0) + 1) / (ctx.get((a, b), 0) + m.vocab)
    assert (len(tri), len(ctx)) == (59, 49)
    assert [round(p(*x), 9) for x in ((START, START, "the"), ("on", "the", "mat"), ("the", "dog", END))] == [0.090909091, 0.054054054, 0.026315789]
    words = [r["w1"] for r in m.unigram.collect()]
    assert sum(p(START, START, w) for w in [*words, END]) == pytest.approx(1.022727273)


def test_unigrams_sum_to_one(model):
    assert model.unigram.agg(F.sum(F.col("c") / model.total)).first()[0] == pytest.approx(1)


def test_index(spark, model):
    row = ca.index_statistics(ca.delete_index(model.vocabulary())).first()
    assert (row["keys"], row["postings"]) == (160, 172)
    one = ca.delete_index(spark.createDataFrame([("dog",)], "w string"))
    assert {r["variant"] for r in one.collect()} == {"dog", "og", "dg", "do"}


def test_candidates_and_best(spark, model):
    asked = {"dg": {"dog"}, "odg": {"dog"}, "thw": {"the"}, "sea": {"see"}, "mta": {"mat"}, "is": {"i"}, "zzzzqqqq": set(), "he": {"me", "she", "the"}, "": {"a", "i"}}
    q = spark.createDataFrame([(x,) for x in asked], "q string")
    for method in ("A", "B", "both"):
        found = {x: set() for x in asked}
        for r in ca.candidates(q, model.vocabulary(), method).collect():
            found[r["q"]].add(r["w"])
        assert found == asked
    best = {r["q"]: r["best"] for r in co.correct_non_words(q, model).collect()}
    assert best["he"] == "the" and best["thw"] == "the" and best["zzzzqqqq"] == "zzzzqqqq"


def test_methods_agree_and_raw_is_a_superset(spark, model):
    draw = random.Random(9)
    q = spark.createDataFrame([("".join(draw.choice("abcdefgo") for _ in range(draw.randint(1, 6))),) for _ in range(300)], "q string")
    a, b = ca.candidates(q, model.vocabulary(), "A"), ca.candidates(q, model.vocabulary(), "B")
    assert ca.mismatches(a, b).count() == 0
    raw = ca.by_index(q, ca.delete_index(model.vocabulary()), verify=False)
    assert b.exceptAll(raw).count() == 0 and raw.count() > b.count()


def test_unknown_method(spark, model):
    with pytest.raises(ValueError, match="unknown method"):
        ca.candidates(spark.createDataFrame([("a",)], "q string"), model.vocabulary(), "C")


@pytest.mark.parametrize(("scoring", "beta"), [("interpolated", 0.0), ("add-k", 0.0), ("interpolated", 1.0)])
def test_fold_agrees_with_the_join_where_the_context_is_raw(spark, sents, model, scoring, beta):
    config = co.CorrectorConfig(threshold=0.5, scoring=scoring, beta=beta)
    triples = spark.createDataFrame([("to", "sea", "the"), ("like", "so", "see"), ("the", "dog", "sat"), ("the", "fat", "and"), (BOS, "she", "is"), ("at", "the", "world"), ("the", "cat", EOS)], "prev string, w string, nxt string")
    part = co.reachable(triples.select(F.array("prev", "w", "nxt").alias("tokens")), model, config)
    fold = co.Fold(part, config)
    for r in co.correct_real_words(triples, model, config).collect():
        best, gain = fold.real_word(r["w"], r["prev"], r["nxt"])
        assert best == r["best"] and gain == pytest.approx(r["gain"], abs=1e-9)


def test_threshold_silences_and_short_words_stay(spark, model):
    triples = spark.createDataFrame([("to", "see", "the"), ("is", "a", "very")], "prev string, w string, nxt string")
    out = co.correct_real_words(triples, model, co.CorrectorConfig(threshold=1e9)).collect()
    assert all(r["best"] == r["w"] and r["gain"] == 0 for r in out)


def test_left_context_is_the_corrected_word(spark, model):
    part = co.reachable(spark.createDataFrame([(["teh", "dog"],)], "tokens array<string>"), model, co.CorrectorConfig())
    changes = co.Fold(part, co.CorrectorConfig()).run(["teh", "dog"])
    assert changes == [(0, "teh", "the", "non-word", 0.0)]


def test_text_keeps_spacing_and_case(spark, model):
    texts = spark.createDataFrame([(1, "Hello,   thw DOGG!  (Staton?)"), (2, "..."), (3, "")], "id int, text string")
    got = {r["id"]: r["corrected"] for r in co.correct_texts(texts, model, "id", co.CorrectorConfig(threshold=1e9)).collect()}
    assert got == {1: "Hello,   the DOG!  (Station?)", 2: "...", 3: ""}


def test_save_and_load(spark, model, tmp_path):
    corpus.save_ngrams(model, str(tmp_path / "m"))
    again = corpus.load_ngrams(spark, str(tmp_path / "m"))
    assert counts(again.ngram) == counts(model.ngram) and (again.total, again.vocab, again.order) == (model.total, model.vocab, model.order)
    calls = []
    load = lambda k: corpus.load_or_train(spark, str(tmp_path / "n"), {"k": k}, lambda: calls.append(k) or model)
    assert load(1).total == load(1).total == load(2).total and calls == [1, 2]


def test_empty_corpus(spark):
    m = lm.train_bigram(spark.createDataFrame([], "id int, tokens array<string>"))
    assert (m.total, m.vocab, m.ngram.count()) == (0, 0, 0) and math.isfinite(m.total)


def test_sweep_equals_single_runs(spark, sents, model):
    from textloom.operators import evaluate as ev

    rows = [(1, "the dog sat on the mat".split(), 1, "dog", "dg"), (2, "i would like to see the world".split(), 4, "see", "she"), (3, "the cat and the dog and the fox".split(), 7, "fox", "fix")]
    cases = spark.createDataFrame([(i, t, p, o, c, [*t[:p], c, *t[p + 1 :]]) for i, t, p, o, c in rows], "id int, tokens array<string>, pos int, original string, corrupted string, noisy array<string>")
    swept = {r["config"]: r for r in ev.threshold_sweep(cases, model, ["id"], (0.1, 5)).collect()}
    for t in (0.1, 5):
        one = ev.accuracy_of(ev.correction_cases(cases, model, ["id"], co.CorrectorConfig(method="B", threshold=float(t)))).first()
        assert all(one[c] == swept[str(t)][c] for c in (*ev.OUTCOMES, "n", "accuracy"))
    alarms = ev.false_alarms(cases, model, ["id"], co.CorrectorConfig(threshold=1e9)).first()
    assert (alarms["sentences"], alarms["words"], alarms["real_word"], alarms["per_word"]) == (3, 21, 0, 0.0)


def test_texts_that_reach_more_than_the_bound_are_corrected_in_batches(spark, model, monkeypatch):
    rows = spark.createDataFrame([(k, t.split()) for k, t in enumerate(["thw dogg sat", "the cst", "a se of wrds", "", "she si here"])], "id int, tokens array<string>")
    config = co.CorrectorConfig()
    part = co.reachable(rows, model, config)
    want = sorted(co.correct_token_arrays(rows, model, ["id"], config, part=part).collect())
    monkeypatch.setattr(co, "FOLD_ROWS", max(len(part["bigram"]), len(part["unigram"])) - 1)
    assert co.reachable(rows, model, config, co.FOLD_ROWS) is None and want
    assert sorted(co.correct_token_arrays(rows, model, ["id"], config).collect()) == want
