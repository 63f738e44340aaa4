"""Bundles, splits and running statistics: round trips and plain definitions."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.operators import corrupt as cr
from textloom.operators import live as lv
from textloom.plans.bundle import experiment, load_bundle, morph_tokens, save_bundle, train_bundle
from textloom.plans.demo import CONLLU, TREEBANK
from textloom.sources.conllu import parse_conllu
from textloom.sources.corpus import load_or_train


@pytest.fixture(scope="module")
def tagged(spark):
    draw = random.Random(5)
    words = {"D": ["the", "my"], "N": ["cat", "tree", "river"], "V": ["sees", "likes"]}
    rows = [(s, i, draw.choice(words[t]), t) for s in range(50) for i, t in enumerate("DNVDN")]
    return spark.createDataFrame(rows, "s int, i int, word string, tag string")


def test_a_bundle_learns_from_the_first_part_alone(spark, tagged):
    late = spark.createDataFrame([(60 + k, 0, "zebra", "Z") for k in range(10)], tagged.schema)
    bundle, test = train_bundle(tagged.union(late), "s", ["i"])
    assert {r["s"] for r in test.collect()} == {48, 49, *range(60, 70)}
    assert bundle.frequent.where("word = 'zebra'").count() == 0 and bundle.hmm.tag.count() == 3
    got = {r["metric"]: (r["n"], r["correct"]) for r in experiment(bundle, test, "s").collect()}
    assert got["tags frequency"] == (20, 10) and got["tags model"] == (20, 10)
    assert got["segmentation viterbi"] == (12, 2) == got["segmentation joint"]
    assert bundle.grammar is None
    with pytest.raises(ValueError, match="grammar"):
        bundle.parse(test, ["s"])


def test_a_bundle_survives_saving(spark, tagged, tmp_path):
    trees = spark.createDataFrame([(t,) for t in TREEBANK], "tree string")
    calls = []

    def make():
        calls.append(1)
        return train_bundle(tagged, "s", ["i"], trees=trees)[0]

    bundle = make()
    again = [load_or_train(spark, str(tmp_path), {"ratio": 0.8}, make, save_bundle, load_bundle, "grammar") for _ in range(2)][1]
    assert len(calls) == 2
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(again.frequent) == rows(bundle.frequent) and rows(again.grammar) == rows(bundle.grammar)
    assert rows(again.lm.ngram) == rows(bundle.lm.ngram) and rows(again.hmm.trigram) == rows(bundle.hmm.trigram)
    texts = spark.createDataFrame([("thecatlikesmytree",)], "text string")
    assert again.segment(texts).first()["words"] == ["the", "cat", "likes", "my", "tree"]
    save_bundle(train_bundle(tagged, "s", ["i"])[0], f"{tmp_path}/ratio=0.8")
    assert load_bundle(spark, f"{tmp_path}/ratio=0.8").grammar is None


def test_morphological_tags_are_learnt(spark):
    rows = morph_tokens(parse_conllu(spark.createDataFrame([("f", CONLLU)], "path string, value string")))
    bundle, test = train_bundle(rows, "id", ["pos"], ratio=1.0)
    assert test.count() == 0
    assert {(r["word"], r["tag"]) for r in bundle.frequent.collect()} >= {("casa", "NOUN-Fem-Sg"), ("gatos", "NOUN-Masc-Pl")}


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_shuffled_split_takes_the_least_draws(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "k")
    want = sorted(range(n), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))[: round(0.1 * n)]
    got = cr.shuffled_split(rows, "k", 0.1).collect()
    assert len(got) == n and {r["k"] for r in got if r["split"] == "test"} == set(want)


def test_shuffled_split_keeps_rows_of_one_key_together(spark):
    rows = spark.createDataFrame([(k % 40 if k % 9 else None,) for k in range(200)], "k long")
    got = cr.shuffled_split(rows, "k", 0.3).collect()
    assert len(got) == 200
    sides = {}
    for r in got:
        sides.setdefault(r["k"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values()) and {"test"} in sides.values()


def test_running_z_against_its_definition(spark):
    draw = random.Random(9)
    rows = [(p, i, draw.choice([1.0, 2.0, 2.5, draw.uniform(0, 400)])) for p in "ab" for i in range(150)]
    rows += [("c", 0, None), ("c", 1, 3.0), ("c", 2, None), ("c", 3, 4.0), ("c", 4, 9.0)]
    df = spark.createDataFrame([(p, i, v, ["x"]) for p, i, v in rows], "p string, n int, v double, w array<string>").repartition(3)
    got = {(r["p"], r["n"]): r for r in lv.robust_z(df, "p", "n", "v").collect()}
    assert len(got) == len(rows) and all(r["w"] == ["x"] for r in got.values())
    for p, i, v in rows:
        before = [x for q, j, x in rows if q == p and j < i and x is not None]
        r = got[p, i]
        assert r["history"] == len(before)
        if len(before) < 2:
            assert r["z"] == 0
            continue
        middle = statistics.median(before)
        sigma = 1.4826 * statistics.median([abs(x - middle) for x in before])
        assert r["z"] == (pytest.approx((v - middle) / sigma) if sigma >= 1e-6 else 0)
    assert lv.robust_z(df.where("false"), "p", "n", "v").count() == 0


def test_texts_of_a_passage(spark):
    tokens = spark.createDataFrame([("p", 1, "catsat"), ("p", 0, "the"), ("q", 0, "a")], "p string, token_index long, text string")
    sents = spark.createDataFrame([("p", 1, ["sat"]), ("p", 0, ["The", "cat"]), ("q", 0, ["A"]), ("q", 1, [])], "p string, s int, tokens array<string>")
    rows = cr.passage_texts(tokens, sents, "p", "s").orderBy("p").collect()
    assert [tuple(r[c] for c in ("p", "plain_text", "gold_text")) for r in rows] == [("p", "the catsat", "The cat sat"), ("q", "a", "A")]
    assert cr.passage_texts(tokens.where("false"), sents, "p", "s").select(F.count_if(F.col("plain_text") == "")).first()[0] == 2
