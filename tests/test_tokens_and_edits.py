"""Tokenisers and one-character edits on small inputs, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import edits as ed
from textloom.functions import tokens as tk


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_normalise(spark):
    got = values(spark, tk.normalise(F.col("t")), ["The", "don't", "Atlanta's", ",", "``", "1961", "$1.50", "٣", None])
    assert got == ["the", "don't", "atlanta's", None, None, "<num>", "<num>", "<num>", None]


def test_sentence_of_tokens(spark):
    df = spark.createDataFrame([(["The", "dog", ",", "he", "said", "."],)], "t array<string>")
    assert df.select(tk.normalise_tokens(F.col("t"))).first()[0] == ["the", "dog", "he", "said"]


def test_words_and_separators_rebuild_the_text(spark):
    text = "Hello,   world!  (Really?)"
    df = spark.createDataFrame([(text,)], "t string")
    words, gaps = df.select(tk.words(F.col("t")), tk.separators(F.col("t"))).first()
    assert words == ["Hello", "world", "Really"] and len(gaps) == 4
    assert "".join(g + w for g, w in zip(gaps, [*words, ""], strict=True)) == text


def test_match_case_keeps_the_quirk(spark):
    rows = [("Sentnce", "sentence"), ("SENTNCE", "sentence"), ("McDonald", "mcdonald"), ("iPhone", "iphone"), ("I", "i"), ("dog", "dog")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(tk.match_case(F.col("a"), F.col("b"))).collect()] == ["Sentence", "SENTENCE", "Mcdonald", "iphone", "I", "dog"]


def test_committed_and_partial(spark):
    texts = ["the quick bro", "the quick ", "stop.", "", "one"]
    assert values(spark, F.array_join(tk.committed(F.col("t")), " "), texts) == ["the quick", "the quick", "stop", "", ""]
    assert values(spark, tk.partial(F.col("t")), texts) == ["bro", "", "", "", "one"]


def test_live_token_keeps_letters_of_any_script(spark):
    assert values(spark, tk.live_token(F.col("t")), ["Don't!", "Éé-3", "...", "naïve"]) == ["don't", "éé3", "", "naïve"]


@pytest.mark.parametrize(("word", "expected"), [("abc", {"bc", "ac", "ab"}), ("a", {""}), ("", set()), ("aa", {"a"})])
def test_deletes(spark, word, expected):
    assert set(values(spark, ed.deletes(F.col("t")), [word])[0]) == expected


def one_edit(a, b):
    """Optimal string alignment distance of at most one, by definition."""
    if a == b:
        return True
    made = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    letters = set(a + b)
    made |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    return b in made


def test_within_one_against_definition(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randint(0, 5)))
    pairs = [("hello", "hlelo"), ("", "a"), ("abc", "axb"), ("abc", "cba"), ("hello", "helllo"), ("hello", "hellooo")] + [(word(), word()) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ed.within_one(F.col("a"), F.col("b")).alias("w"))
    assert all(r["w"] == one_edit(r["a"], r["b"]) for r in df.collect())


def test_edits_stay_within_their_bound(spark):
    n = len("station")
    got = values(spark, ed.edits(F.col("t")), ["station"])[0]
    assert len(got) == len(set(got)) <= n + n - 1 + 27 * n + 27 * (n + 1) and "sttaion" in got and "station's"[:8] in got


def test_common_prefix(spark):
    df = spark.createDataFrame([("trills", "trials"), ("", "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(ed.common_prefix(F.col("a"), F.col("b"))).collect()] == [3, 0, 4]
