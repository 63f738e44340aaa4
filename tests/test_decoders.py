"""Decoders against brute force; tagging, grammar, metrics, sources."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.tokens import END, START
from textloom.operators import corrupt as cr
from textloom.operators import decode as de
from textloom.operators import evaluate as ev
from textloom.operators import grammar as gr
from textloom.operators import live as lv
from textloom.operators import lm
from textloom.operators import tagging as tg
from textloom.plans.demo import CONLLU, TREEBANK
from textloom.sources import sinks
from textloom.sources.conllu import parse_conllu, read_splits


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(3)
    words = ["a", "b", "ab", "ba", "aab", "bb"]
    tri = {(x, y, z): draw.randint(1, 9) for x in [START, *words] for y in [START, *words] for z in [*words, END] if draw.random() < 0.5}
    ctx = {}
    for (x, y, _), c in tri.items():
        ctx[x, y] = ctx.get((x, y), 0) + c
    emit = {(w, t): draw.randint(1, 5) for w in words for t in "NV" if draw.random() < 0.8}
    tag = {t: sum(c for (_, u), c in emit.items() if u == t) for t in "NV"}
    tag_tri = {(x, y, z): draw.randint(1, 5) for x in (START, "N", "V") for y in (START, "N", "V") for z in "NV"}
    tag_ctx = {}
    for (x, y, _), c in tag_tri.items():
        tag_ctx[x, y] = tag_ctx.get((x, y), 0) + c
    return de.Tables(words, tri, ctx, len(words), emit, tag, tag_tri, tag_ctx, len(words))


def cuts(text, words):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in words:
            for rest in cuts(text[n:], words):
                yield [text[:n], *rest]


def word_score(words, t):
    full = [START, START, *words, END]
    return sum(t.word_lp(*full[i : i + 3]) for i in range(len(full) - 2))


@pytest.mark.parametrize("text", ["aab", "abba", "aabbaab", "bbbb", "abc", ""])
def test_segment_is_the_best_cut(tables, text):
    every = list(cuts(text, tables.words)) if text else []
    got = de.segment(text, tables)
    assert bool(got) == bool(every)
    if every:
        assert word_score(got, tables) == pytest.approx(max(word_score(w, tables) for w in every))


@pytest.mark.parametrize("words", [["a"], ["ab", "b", "x"], ["a", "b", "ab", "bb"]])
def test_tags_are_the_best(tables, words):
    def score(tags):
        full = [START, START, *tags]
        return sum(tables.tag_lp(full[i], full[i + 1], full[i + 2], w) for i, w in enumerate(words))

    tags, best = de.viterbi_tags(words, tables)
    options = itertools.product(*[tables.tags_of(w) for w in words])
    assert best == pytest.approx(score(tags)) == pytest.approx(max(map(score, options)))


def test_wide_beam_is_exhaustive(tables):
    config = de.DecoderConfig(beam_width=10_000)
    for text in ("aab", "abba", "bbab"):
        got = de.joint_beam(text, tables, config)
        best = max(de.path_score(list(zip(w, t, strict=True)), tables, config) for w in cuts(text, tables.words) for t in itertools.product(*[tables.tags_of(x) for x in w]))
        assert de.path_score(got, tables, config) == pytest.approx(best)
    assert de.joint_beam("abc", tables) == [] == de.joint_beam("", tables)


def test_should_split(tables):
    split, pairs = de.should_split("bbbb", tables)
    assert split and "".join(w for w, _ in pairs) == "bbbb"
    assert de.should_split("zz", tables) == (False, [])
    split, pairs = de.should_split("ab", tables)
    assert "".join(w for w, _ in pairs) == "ab"


def test_greedy():
    assert de.greedy("TheQuickx", frozenset({"the", "quick", "qui"})) == ["the", "quick", "x"]
    assert de.greedy("", frozenset()) == []


def test_most_frequent_tag_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, "Run", "N"), (2, "run", "V"), (3, "dog", "N"), (4, "dog", "V"), (5, "dog", "V")], "n int, word string, tag string")
    tags = tg.most_frequent_tags(rows, ["n"])
    assert {r["word"]: r["tag"] for r in tags.collect()} == {"run": "N", "dog": "V"}
    out = tg.tag_by_frequency(spark.createDataFrame([("DOG",), ("cat",)], "word string"), tags)
    assert sorted(r["pred"] for r in out.collect()) == ["UNKNOWN", "V"]


def test_error_sources(spark):
    gold = spark.createDataFrame([(1, 0, "the", "D"), (1, 1, "dog", "N"), (1, 2, "ran", "V")], "s int, pos int, word string, tag string")
    pred = spark.createDataFrame([(1, 0, "the", "D"), (1, 1, "do", "V"), (1, 2, "g", "N"), (1, 3, "ran", "N")], "s int, pos int, word string, tag string")
    row = ev.error_sources(gold, pred, ["s"]).first()
    assert (row["words"], row["segmentation_errors"], row["genuine_errors"]) == (3, 1, 1) and row["genuine_share"] == 0.5
    none = ev.error_sources(gold, gold, ["s"]).first()
    assert none["segmentation_share"] is None


def test_accuracy_of_nothing(spark):
    assert ev.pos_accuracy(spark.createDataFrame([], "gold string, pred string")).first()["accuracy"] == 0.0


def test_conllu(spark, tmp_path):
    rows = parse_conllu(spark.createDataFrame([("x", CONLLU), ("y", "")], "path string, value string")).orderBy("sent", "pos").collect()
    assert [(r["sent"], r["pos"], r["form"]) for r in rows] == [(0, 0, "la"), (0, 1, "casa"), (0, 2, "es"), (1, 0, "gatos"), (1, 1, "comen"), (1, 2, ".")]
    assert rows[0]["feats"] == {"Gender": "Fem", "Number": "Sing"} and rows[5]["feats"] == {}
    for name in ("train", "dev"):
        (tmp_path / f"{name}.conllu").write_text(CONLLU)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_splits(spark, str(tmp_path)).count()
    (tmp_path / "test.conllu").write_text(CONLLU)
    assert {(r["split"], r["count"]) for r in read_splits(spark, str(tmp_path)).groupBy("split").count().collect()} == {("train", 6), ("dev", 6), ("test", 6)}


def test_reconcile(spark):
    tags = {"VB-HL": "VB", "PPS+BEZ": "PRP", "NN$": "NN", "??": "NN", "BEDZ": "VBD", ".": "."}
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", gr.reconcile(F.col("t")).alias("p")).collect()} == tags
    assert len(gr.TAG_MAP) == 88


def test_grammar_sums_to_one_and_parses(spark):
    rules = gr.induce(spark.createDataFrame([(t,) for t in [*TREEBANK, "not a tree", "(S"]], "tree string"))
    sums = rules.groupBy("lhs").agg(F.sum("prob").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in sums)
    chart = gr.Chart([(r["lhs"], r["rhs"], r["lexical"], r["prob"]) for r in rules.collect()])
    lp, tree, status = chart.parse("the dog saw the cat".split())
    assert status == "ok" and tree.startswith("(S (NP (DT the)") and math.exp(lp) > 0
    assert chart.parse("a zebra sleeps".split())[2] == "ok-projected"
    assert chart.parse([])[2] == chart.parse(["the"] * 26)[2] == chart.parse(["saw", "the"])[2] == "unparseable"
    assert len([c for c in gr.productions(gr.parse_bracketed(TREEBANK[2])) if "|<" in c[0]]) == 1


def test_binary_split(spark):
    toy = "the dog on at over quick a cat and i me is this".split()
    vocab = spark.createDataFrame([(w,) for w in toy], "w string")
    asked = {"thedog": ("the", "dog"), "onthe": ("on", "the"), "thequick": ("the", "quick"), "atthe": ("at", "the"), "overthe": ("over", "the"), "isa": None, "meat": None, "thecatand": None}
    got = {r["text"]: (r["left"], r["right"]) for r in lv.binary_splits(spark.createDataFrame([(t,) for t in asked], "text string"), vocab).collect()}
    assert got == {k: v for k, v in asked.items() if v}


def test_safe_suggestions(spark):
    rows = [("trills", "trials", False), ("caresser", "caresses", False), ("stationn", "station", True), ("teh", "the", False), ("crabby", "grabby", False), ("sentnce", "sentence", True)]
    df = spark.createDataFrame(rows, "a string, b string, ok boolean").withColumn("got", lv.safe_suggestion(F.col("a"), F.col("b"), F.lit(True)))
    assert all(r["ok"] == r["got"] for r in df.collect())


def test_robust_z(spark):
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate([100.0, 120.0, 90.0, 110.0, 400.0, 105.0])] + [("q", 0, 5.0), ("q", 1, 5.0), ("q", 2, 9.0)], "p string, n int, v double")
    z = {(r["p"], r["n"]): r["z"] for r in lv.robust_z(df, "p", "n", "v").collect()}
    assert [z["p", i] for i in range(6)] == pytest.approx([0, 0, -1.348982, 0.674491, 19.897477, -0.337245], abs=1e-5)
    assert z["q", 2] == 0


def test_triggers_jump_and_finish(spark):
    words = [["a"], ["b"], ["c"], ["d"], ["e", "f"], ["g"], ["h"], ["i"], ["j"], ["k"]]
    df = spark.createDataFrame([("p", i, w) for i, w in enumerate(words)] + [("q", 0, ["x"])], "p string, token_index long, final_words array<string>")
    got = {(r["p"], r["cum"]): (r["window"], r["is_last"]) for r in lv.triggers(df, "p").collect()}
    assert got == {("p", 10): (["f", "g", "h", "i", "j"], False), ("p", 11): (["g", "h", "i", "j", "k"], True)}


def test_merges_do_not_overlap(spark):
    sents = spark.createDataFrame([(i, [f"w{k}" for k in range(12)]) for i in range(40)], "id int, tokens array<string>")
    rows = cr.merge_tokens(sents, ["id"], p=0.6).collect()
    for i in range(40):
        mine = sorted((r for r in rows if r["id"] == i), key=lambda r: r["token_index"])
        assert [w for r in mine for w in r["gold_words"]] == [f"w{k}" for k in range(12)]
        assert all(len(r["gold_words"]) == 1 + r["is_merge"] and r["text"] == "".join(r["gold_words"]) for r in mine)
    assert any(r["is_merge"] for r in rows)


def test_splits(spark):
    rows = spark.range(25).withColumnRenamed("id", "k")
    assert {r["k"] for r in cr.sequential_split(rows, "k").where("split = 'train'").collect()} == set(range(20))
    test = cr.shuffled_split(rows, "k", 0.1).where("split = 'test'").count()
    assert test == round(2.5)
    with pytest.raises(ValueError, match="fewer"):
        cr.misspelling_batch(spark.createDataFrame([("1", "dog")], "id string, w string"), spark.createDataFrame([("dog",)], "w string"), 5)


def test_sinks(spark, tmp_path):
    path = tmp_path / "r" / "results.json"
    sinks.save_section(str(path), "a", {"x": 1})
    path.write_text("{broken")
    sinks.save_section(str(path), "b", {"y": 2})
    assert json.loads(path.read_text()) == {"b": {"y": 2}}
    run = sinks.write_run(spark.range(3), str(tmp_path / "runs"), "demo")
    assert spark.read.json(str(tmp_path / "runs")).where(F.col("run_id") == run).count() == 3
    row = spark.createDataFrame([(1, "pcfg", "grammatical", 0, 2, -1.26, -2.0, "logP=-3.00*", "a b")], "n int, method string, verdict string, merges long, spells long, bigram_lp double, trigram_lp double, pcfg string, text string")
    assert row.select(sinks.report_line()).first()[0] == "1   pcfg     grammatical    0   2      -1.3      -2.0 logP=-3.00*      a b"
    marked = spark.createDataFrame([(["thw", "dog"], ["the", "dog"], ["", " ", "!"])], "w array<string>, f array<string>, g array<string>")
    assert marked.select(sinks.highlight(F.col("w"), F.col("f"), F.col("g"))).first()[0] == "**the** dog!"


def test_texts_that_reach_more_than_the_bound_are_decoded_in_batches(spark, monkeypatch):
    draw = random.Random(12)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 3))) for _ in range(12)]
    sents = spark.createDataFrame([([draw.choice(words) for _ in range(6)],) for _ in range(40)], "tokens array<string>")
    model = lm.train_add_one(sents)
    hmm = tg.train_hmm(sents.select(F.col("tokens").alias("words"), F.transform("tokens", lambda w: F.when(F.length(w) > 1, "N").otherwise("V")).alias("tags")))
    texts = spark.createDataFrame([("".join(draw.choice(words) for _ in range(draw.randint(1, 3))),) for _ in range(6)] + [("",), (None,), ("Ab",)], "text string").distinct()
    key = lambda r: (r["text"], r["words"], r["tags"], r["split"])
    full = de.reach(texts, model, hmm)
    want = sorted(map(key, de.decode(texts, full, "joint").collect()))
    monkeypatch.setattr(de, "REACH_ROWS", len(full.tri) - 1)
    assert de.reach(texts, model, hmm, limit=de.REACH_ROWS) is None and any(r[1] for r in want)
    assert sorted(map(key, de.decode_all(texts, model, "joint", hmm).collect())) == want
